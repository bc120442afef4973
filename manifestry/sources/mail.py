"""Mails: attachments in order of use, and the body's labelled lines where there is none."""

from __future__ import annotations

from email import message_from_bytes, policy

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

KINDS = ("pdf", "xlsx", "xls", "png", "jpg", "jpeg", "tif", "tiff")
MAX_LINES = 300
SCHEMA = "path string, subject string, attachment string, content binary, lines array<struct<label: string, value: string>>"


def _one(path: str, raw: bytes) -> tuple:
    mail = message_from_bytes(raw, policy=policy.default)
    files = [(KINDS.index(k), p.get_filename(), p.get_payload(decode=True)) for p in mail.iter_attachments() if (k := (p.get_filename() or "").rpartition(".")[2].lower()) in KINDS]
    best = min(files, default=None, key=lambda f: f[0])
    lines = []
    if best is None:
        body = mail.get_body(("plain",))
        for line in [x.strip() for x in (body.get_content() if body else "").splitlines() if x.strip()][:MAX_LINES]:
            label, colon, value = (t.strip() for t in line.partition(":"))
            lines.append({"label": label, "value": value} if colon and label and value else {"label": None, "value": line})
    return path, mail["subject"], best and best[1], best and best[2], lines


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each mail: the attachment that serves best with its content, or else the body's lines."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(lambda batches: (pd.DataFrame([_one(p, bytes(c)) for p, c in zip(b["path"], b["content"])], columns=["path", "subject", "attachment", "content", "lines"]) for b in batches), SCHEMA)
