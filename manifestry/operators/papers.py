"""Invoices and packing lists: values by their labels alone, as their forms have no regions that could be relied on.

A label's value is what stands to its right on the same line and just below it, in reading order, up to the next label
of the same kind of document. Labels of fewer than six letters count only as whole words. A document stands in one
row, its boxes in one array, so all fields are one projection; a document without boxes has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s

# The labels of each field of the two kinds, how far a value may stand from its label (in heights of the
# label, which is taken as at least 20 high), how many boxes a value has at most, and how much less sure it is.
LABELS = {
    "commercial_invoice": {
        "invoice_no": ["INVOICE NO", "INVOICE NUMBER", "INV NO", "COMMERCIAL INVOICE NO"], "invoice_date": ["INVOICE DATE", "DATE OF INVOICE", "ISSUE DATE", "DATED"],
        "seller": ["SELLER", "SHIPPER", "EXPORTER", "MESSRS", "FROM"], "buyer": ["BUYER", "CONSIGNEE", "MESSRS", "TO", "IMPORTER", "APPLICANT"],
        "description_of_goods": ["DESCRIPTION OF GOODS", "DESCRIPTION", "COMMODITY", "GOODS"], "quantity": ["QUANTITY", "QTY", "TOTAL QUANTITY"],
        "total_amount": ["TOTAL AMOUNT", "TOTAL", "AMOUNT", "GRAND TOTAL", "SAY TOTAL"], "incoterms": ["PRICE TERM", "TERMS OF PRICE", "TRADE TERM", "DELIVERY TERM"],
        "lc_no": ["L/C NO", "LC NO", "CREDIT NO", "LETTER OF CREDIT NO"],
    },
    "packing_list": {
        "invoice_no": ["INVOICE NO", "INVOICE NUMBER", "INV NO"], "packing_date": ["DATE", "PACKING DATE", "ISSUE DATE", "DATED"],
        "seller": ["SELLER", "SHIPPER", "EXPORTER", "FROM"], "buyer": ["BUYER", "CONSIGNEE", "TO", "IMPORTER"],
        "description_of_goods": ["DESCRIPTION OF GOODS", "DESCRIPTION", "COMMODITY", "GOODS"], "package_count": ["NUMBER OF PACKAGES", "TOTAL PACKAGES", "PACKAGES", "NO OF PKGS", "CTNS"],
        "gross_weight": ["GROSS WEIGHT", "G/W", "TOTAL GROSS WEIGHT"], "net_weight": ["NET WEIGHT", "N/W", "TOTAL NET WEIGHT"],
        "measurement": ["MEASUREMENT", "CBM", "TOTAL MEASUREMENT", "VOLUME"], "marks": ["MARKS AND NUMBERS", "SHIPPING MARKS", "MARKS"],
    },
}
LONG_LABEL, LEAST_HEIGHT, MOST_BOXES, FACTOR = 6, 20.0, 6, 0.85
BESIDE, BELOW_FROM, BELOW_TO, LEFT, RIGHT = 0.7, 0.3, 2.5, 1.0, 4.0


def plain(text: str) -> str:
    return "".join(c if c.isascii() and c.isalnum() or c == " " else " " for c in text.upper()).strip()


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(c), "[^A-Z0-9 ]", " "))


def pages(tokens: DataFrame) -> DataFrame:
    """(document_id, boxes): each document's boxes from top to bottom and left to right, with their plain text."""
    sure = F.col("confidence") if "confidence" in tokens.columns else F.lit(1.0)
    y = (F.col("y_min") + F.col("y_max")) / 2
    box = F.struct(y.cast("double").alias("y"), F.col("x_min").cast("double").alias("x_min"), "idx", F.col("x_max").cast("double").alias("x_max"), (F.col("y_max") - F.col("y_min")).cast("double").alias("height"), "text", _plain(F.col("text")).alias("plain"), sure.cast("double").alias("confidence"))
    return tokens.groupBy("document_id").agg(F.array_sort(F.collect_list(box)).alias("boxes"))


def _label(boxes: Column, labels: list[str]) -> Column:
    """The box of the longest label that any box has: a long one within its text, a short one as a word of it."""

    def first(label: str) -> Column:
        has = lambda b: F.contains(b["plain"], F.lit(label)) if len(label) >= LONG_LABEL else F.array_contains(F.split(b["plain"], " +"), label)
        return F.get(F.filter(boxes, has), F.lit(0))

    return F.coalesce(*map(first, sorted(map(plain, labels), key=len, reverse=True)))


def _ends(kind: str) -> tuple[list[str], list[str]]:
    every = sorted({plain(x) for group in LABELS[kind].values() for x in group})
    return every, [x for x in every if len(x) >= LONG_LABEL]


def value(boxes: Column, kind: str, field: str) -> Column:
    """Struct (value, confidence) of a field; the value is null without a label or without a box that belongs to it."""
    every, long = _ends(kind)

    def of(at: Column) -> Column:
        high = F.greatest(at["height"], F.lit(LEAST_HEIGHT))
        beside = lambda b: (F.abs(b["y"] - at["y"]) <= high * BESIDE) & (b["x_min"] >= at["x_max"])
        below = lambda b: (b["y"] > at["y"] + high * BELOW_FROM) & (b["y"] < at["y"] + high * BELOW_TO) & (b["x_min"] >= at["x_min"] - high * LEFT) & (b["x_min"] <= at["x_max"] + high * RIGHT)
        near = F.filter(boxes, lambda b: (b["idx"] != at["idx"]) & (beside(b) | below(b)))
        ends = lambda b: b["plain"].isin(every) | F.exists(s.words(long), lambda w: F.contains(b["plain"], w))

        def taken(near: Column) -> Column:
            at_end = F.array_position(F.transform(near, ends), True)
            return F.slice(F.when(at_end > 0, F.slice(near, F.lit(1), (at_end - 1).cast("int"))).otherwise(near), 1, MOST_BOXES)

        return s.bound(s.bound(near, taken), out)

    def out(some: Column) -> Column:
        text = F.trim(F.regexp_replace(F.array_join(F.transform(some, lambda b: b["text"]), " "), r"\s+", " "))
        clean = F.nullif(F.regexp_replace(text, "^[ :;,·-]+|[ :;,·-]+$", ""), F.lit(""))
        mean = F.aggregate(some, F.lit(0.0), lambda a, b: a + b["confidence"]) / F.size(some)
        return F.struct(clean.alias("value"), F.when(clean.isNotNull(), mean * FACTOR).alias("confidence"))

    return s.bound(_label(boxes, LABELS[kind][field]), lambda at: F.when(at.isNotNull(), of(at)))


def parse(paged: DataFrame, kind: str) -> DataFrame:
    """(document_id, a struct (value, confidence) for each field of the kind)."""
    return paged.select("document_id", *(value(F.col("boxes"), kind, f).alias(f) for f in LABELS[kind]))
