"""MinHash fingerprints against plain Python, the edited texts, and likeness against exact Jaccard similarity."""

import hashlib
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from manifestry.llm import minhash, queries
from manifestry.llm.common import read

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashed(layout, values):
    h = 42
    for v in values:
        h = xxhash.xxh64(struct.pack(layout, v), seed=h).intdigest()
    return signed(h)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(text):
    bins = {}
    for s in shingles(text):
        h = hashed("<q", [signed(xxhash.xxh64(x.encode(), seed=42).intdigest()) for x in s])
        b = (h >> 56) + 128
        bins[b] = min(bins.get(b, h), h)
    out = ""
    for b in range(256 if bins else 0):
        asked = [b] + [(f * b + o) % minhash.PRIME % 256 for f, o in minhash.PROBE_AT]
        found = next((x for x in asked if x in bins), None)
        out += f"{bins[min(bins, key=lambda x: hashed('<i', [b, x])) if found is None else found] & 15:x}"
    return out


def likeness(a, b):
    if a == b or not a or not b:
        return float(a == b)
    return max(0.0, (sum(x == y for x, y in zip(a, b)) / 256 - 1 / 16) / (1 - 1 / 16))


def edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def expected(rows):
    """rows in the order of the documents: (doc_id, text)."""
    out = []
    for k, (i, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        e = edited(t, n)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), brute(t), brute(e), likeness(brute(t), brute(e)), likeness(brute(t), brute(n))))
    return sorted(((*x[:5], round(x[5], 9), round(x[6], 9)) for x in out), key=str)


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted(((*r[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()), key=str)


def test_query_against_brute_force(spark):
    rows = sorted((tuple(r) for r in read(spark, DATA, "documents").select("doc_id", "text").collect()), key=lambda r: -r[0])
    assert rows_of(queries.op12_minhash_fingerprints(spark, DATA)) == expected(rows)


def test_likeness_is_near_the_jaccard_similarity(spark):
    rows = sorted((tuple(r) for r in read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()), key=lambda r: -r[0])
    got = {r.doc_id: r for r in queries.op12_minhash_fingerprints(spark, "/root/testdata/sf0.01").collect()}
    errors = []
    for k, (i, t) in enumerate(rows):
        a, n = shingles(t or ""), rows[(k + 1) % len(rows)][1] or ""
        b = shingles(edited(t or "", n))
        if a and b:
            errors.append(got[i].near_edited - len(a & b) / len(a | b))
    assert len(errors) > 900 and (sum(x * x for x in errors) / len(errors)) ** 0.5 < 0.04 and abs(sum(errors) / len(errors)) < 0.01


ODD = [
    (60, "One two three four five six"), (50, None), (40, ""), (30, " \t\n\x0b"), (20, "a"), (19, "a b c d"), (18, "a b c d e"), (17, " é 日本語 😀 x y 😀 z"),
    (16, "x " * 3000), (15, " ".join(f"w{i % 977}" for i in range(30_000))), (14, "One two three four five six"), (-3, "last\n" * 9),
]


@pytest.mark.parametrize("many", [False, True])
def test_odd_rows(spark, many, monkeypatch):
    monkeypatch.setattr(minhash, "CUTS", 4 if many else 1)
    docs = spark.createDataFrame([(i, t, 1, 2, "3") for i, t in ODD], "doc_id bigint, text string, part int, tie int, next string").repartition(3)
    assert rows_of(minhash.edits(docs)) == expected(ODD)


def test_shared_and_missing_ids(spark):
    rows = [(5, "five and some more words"), (5, "five and some more words"), (5, "another five of the table"), (None, "nobody"), (None, "nothing"), (1, "one"), (9, "nine " * 40)] + [(2, "two copies of it " * 9)] * 40
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    tie = {t: signed(xxhash.xxh64((t or "").encode(), seed=42).intdigest()) for _, t in rows}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]), reverse=True)
    assert rows_of(minhash.edits(docs)) == expected(order)


def test_none_one_and_text_ids(spark):
    docs = spark.createDataFrame([("k", "some words that stand alone here")], "doc_id string, text string")
    assert minhash.edits(docs.where("false")).count() == 0
    assert rows_of(minhash.edits(docs)) == expected([("k", "some words that stand alone here")])
    assert {r.n_chars for r in minhash.fingerprints(docs).collect()} == {32}
    assert docs.select(F.length(minhash.packed(minhash.fingerprint(F.col("text"))))).first()[0] == 128


def test_main_path_has_no_python(spark):
    plan = minhash.edits(read(spark, DATA, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
