"""Values by their printed labels: the boxes to the right of a label and below it, up to the next label.

A page's boxes, some hundreds, stand in one array of its row, so that all fields are looked up in one projection
without a join. Where a document's boxes come as rows, one aggregate over the tokens puts the array together (``pages``);
where they stand in its row already, nothing is shuffled (``page``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from .records import plausible_date

# Labels of each field, the most specific first, and how much less sure a value found by its label is.
LABELS = {
    "bl_no": ["B/L NO", "BL NO", "B.L.NO", "BILL OF LADING NO", "BILL OF LADING NUMBER", "B/L NUMBER"],
    "shipper": ["CONSIGNOR/SHIPPER", "SHIPPER/EXPORTER", "CONSIGNOR", "SHIPPER", "EXPORTER", "FROM"],
    "consignee": ["CONSIGNEE", "TO ORDER OF", "RECEIVER"],
    "notify_party": ["NOTIFY PARTY", "NOTIFY ADDRESS", "NOTIFY"],
    "port_of_loading": ["PORT OF LOADING", "PORT OF LOAD", "LOADING PORT", "POL", "PORT OF SHIPMENT", "PORT OF RECEIPT"],
    "port_of_discharge": ["PORT OF DISCHARGE", "PORT OF DISCHARGING", "DISCHARGE PORT", "POD", "PLACE OF DELIVERY", "FINAL DESTINATION"],
    "vessel": ["VESSEL / VOYAGE NO", "OCEAN VESSEL / VOY", "VESSEL/VOYAGE", "VESSEL NAME", "OCEAN VESSEL", "VESSEL", "SHIP"],
    "description_of_goods": ["DESCRIPTION OF GOODS", "DESCRIPTION OF PACKAGES AND GOODS", "DESCRIPTION OF PACKAGES", "GOODS DESCRIPTION"],
    "gross_weight": ["GROSS WEIGHT", "G.W.", "GROSS WT"],
    "measurement": ["MEASUREMENT", "CBM", "VOLUME"],
    "place_of_issue": ["PLACE AND DATE OF ISSUE", "PLACE OF ISSUE", "ISSUED AT"],
    "total_freight": ["TOTAL FREIGHT", "FREIGHT AND CHARGES", "FREIGHT & CHARGES", "FREIGHT AMOUNT"],
    "date_of_issue": ["DATE OF ISSUE", "DATE ISSUED", "PLACE AND DATE OF ISSUE", "DATED", "SIGNED ON"],
    "on_board_date": ["SHIPPED ON BOARD DATE", "DATE LADEN ON BOARD", "SHIPPED ON BOARD", "LADEN ON BOARD", "ON BOARD DATE", "ON BOARD"],
    "incoterms": ["INCOTERMS", "TRADE TERMS", "PRICE TERMS", "DELIVERY TERMS"],
    "no_of_original_bl": ["NO. OF ORIGINAL B/L", "NUMBER OF ORIGINAL", "NO. OF ORIGINALS", "ORIGINAL B/L"],
}
FACTOR = 0.85
#: Letters of the shortest label that ends a value, how much longer the label's box may be, and boxes of a value at most.
LEAST_LABEL, SLACK, MOST_BOXES = 6, 12, 10
MONTHS = "JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC"
DATE = rf"(?i)\b([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}|[0-9]{{1,2}}\s+(?:{MONTHS})\s+[0-9]{{4}}|(?:{MONTHS})\s+[0-9]{{1,2}}[,.]?\s+[0-9]{{4}}|[0-9]{{2}}-(?:{MONTHS})-[0-9]{{4}})\b"
BOX = ("idx", "text", "x_min", "y_min", "x_max", "y_max")


def plain(text: str) -> str:
    return re.sub("[^A-Z0-9/ ]", "", text.upper()).strip()


def _norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(c), "[^A-Z0-9/ ]", ""))


def pages(tokens: DataFrame) -> DataFrame:
    """(document_id, boxes): each document's boxes in reading order, with their plain text, middle and confidence (1 where
    the tokens say none)."""
    sure = F.col("confidence") if "confidence" in tokens.columns else F.lit(1.0)
    box = F.struct(*BOX, _norm(F.col("text")).alias("norm"), ((F.col("y_min") + F.col("y_max")) / 2).alias("y"), sure.cast("double").alias("confidence"))
    return tokens.groupBy("document_id").agg(F.array_sort(F.collect_list(box)).alias("boxes"))


def page(boxes: Column) -> Column:
    """As ``boxes`` of ``pages``, from an array of one document's boxes (idx, text, x_min, y_min, x_max, y_max)."""
    box = lambda b: F.struct(*(b[c].alias(c) for c in BOX), _norm(b["text"]).alias("norm"), ((b["y_min"] + b["y_max"]) / 2).alias("y"), F.lit(1.0).alias("confidence"))
    return F.sort_array(F.transform(boxes, box))


def lines(boxes: Column) -> Column:
    """The boxes' plain texts, each between line ends: a label is looked for in all of them at once."""
    return F.concat(F.lit("\n"), F.array_join(F.transform(boxes, lambda b: F.coalesce(b["norm"], F.lit(""))), "\n"), F.lit("\n"))


def first_label(text: Column, labels: list[str]) -> Column:
    """Where in the boxes' ``lines`` the first label that any box has stands: as a box of its own, or else within one."""
    found = None
    for label in filter(None, map(plain, labels)):
        whole, part = F.instr(text, f"\n{label}\n"), F.instr(text, label)
        found = (F if found is None else found).when(part > 0, F.when(whole > 0, whole).otherwise(part))
    return found


def place(text: Column, position: Column) -> Column:
    """Which box holds the position in the ``lines``, from 0; null without one."""
    upto = F.substring(text, F.lit(1), position)
    return F.length(upto) - F.length(F.replace(upto, F.lit("\n"), F.lit(""))) - 1


def located(boxes: Column, labels: list[str], at: Column | None = None) -> Column:
    """The first box that is, or else holds, the first label that any box has (``at``: its ``place``, if that is a column already)."""
    if at is None:
        at = s.bound(lines(boxes), lambda text: s.bound(first_label(text, labels), lambda position: place(text, position)))
    return F.get(boxes, at)


def stop_labels(labels: dict = LABELS, more: tuple[str, ...] = ()) -> list[str]:
    """Labels that end a value: all long ones, but "to order of", which values begin with as well."""
    return sorted({p for w in [*(w for group in labels.values() for w in group), *more] if w != "TO ORDER OF" and len(p := plain(w)) >= LEAST_LABEL})


def is_label(norm: Column, stops: list[str]) -> Column:
    """Does the text begin with a label and go on for little more?"""
    return (norm != "") & norm.rlike(f"^(?:{'|'.join(stops)}).{{0,{SLACK}}}$")


def picked(boxes: Column, labels: list[str], stops: list[str], same_line: bool = False, at: Column | None = None) -> Column:
    """The boxes that belong to the label: to its right, then (unless ``same_line``) below, each up to the next label.

    Distances are measured in the label's own height, so that they hold at every scale.  Null without a label.
    """

    def until_label(seq: Column) -> Column:
        ends = F.filter(F.transform(seq, lambda b, i: F.when(is_label(b["norm"], stops), i)), lambda i: i.isNotNull())
        return s.bound(F.get(ends, F.lit(0)), lambda at: F.when(at.isNull(), seq).otherwise(F.slice(seq, 1, at)))

    def ordered(seq: Column, *by: str) -> Column:
        keyed = F.transform(seq, lambda b: F.struct(*(b[c] for c in (*by, "idx")), b.alias("box")))
        return F.transform(F.sort_array(keyed), lambda k: k["box"])

    def among(anchor: Column, near: Column) -> Column:
        height = anchor["height"]
        right = ordered(F.filter(near, lambda b: (F.abs(b["y"] - anchor["y"]) <= height * 0.7) & (b["x_min"] > anchor["x_max"])), "x_min")
        parts = [s.bound(right, until_label)]
        if not same_line:
            under = F.filter(near, lambda b: (b["y"] > anchor["y"] + height * 0.3) & (b["y"] < anchor["y"] + height * 2.5) & (b["x_min"] >= anchor["x_min"] - height) & (b["x_min"] <= anchor["x_max"] + height * 4))
            parts.append(s.bound(ordered(under, "y", "x_min"), until_label))
        return F.slice(F.concat(*parts), 1, MOST_BOXES)

    def of(anchor: Column) -> Column:
        near = F.filter(boxes, lambda b: (b["y"] >= anchor["above"]) & (b["y"] <= anchor["below"]))  # a little more than is asked for
        return s.bound(near, lambda some: among(anchor, some))

    def measured(box: Column) -> Column:
        height = F.greatest(box["y_max"] - box["y_min"], F.lit(1.0))
        return F.struct(*(box[c].alias(c) for c in ("y", "x_min", "x_max")), height.alias("height"), (box["y"] - height).alias("above"), (box["y"] + height * 3).alias("below"))

    return s.bound(located(boxes, labels, at), lambda box: F.when(box.isNotNull(), s.bound(measured(box), of)))


def _text(some: Column) -> Column:
    return s.bound(F.trim(F.array_join(F.transform(some, lambda b: b["text"]), " ")), lambda t: F.when(t != "", t))


def found(boxes: Column, labels: list[str], stops: list[str], same_line: bool = False, at: Column | None = None) -> Column:
    """The text of the boxes that belong to the label; null without a label or a box."""
    return _text(picked(boxes, labels, stops, same_line, at))


def found_surely(boxes: Column, labels: list[str], stops: list[str], same_line: bool = False) -> Column:
    """Struct (value, confidence): the text, and the mean confidence of its boxes, less what finding it by a label costs."""
    mean = lambda some: F.aggregate(some, F.lit(0.0), lambda acc, b: acc + b["confidence"]) / F.size(some)
    return s.bound(picked(boxes, labels, stops, same_line), lambda some: F.struct(_text(some).alias("value"), F.when(F.size(some) > 0, mean(some) * FACTOR).alias("confidence")))


def dates_in(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(DATE), 1), plausible_date)


def date_found(boxes: Column, labels: list[str], stops: list[str], at: Column | None = None) -> Column:
    """The last date of the label's own boxes; only a document without the label is read as a whole."""
    whole = F.array_join(F.transform(F.array_sort(F.transform(boxes, lambda b: F.struct(b["y"], b["idx"], b["text"].alias("text")))), lambda b: b["text"]), " ")
    last = lambda words: F.try_element_at(dates_in(words), F.lit(-1))
    return s.bound(picked(boxes, labels, stops, at=at), lambda some: F.when(some.isNotNull(), last(_text(some))).otherwise(last(whole)))


def region_or_anchor(region: Column, anchor: Column, region_confidence: Column, anchor_confidence: Column, anchor_first: bool = False) -> Column:
    """Struct (value, confidence, method): the first way that gives a value, with its own confidence (``found_surely`` has the
    anchor's); none is null with the region's confidence."""
    by = lambda value, confidence, method: F.when(s.present(value).isNotNull(), F.struct(value.alias("value"), confidence.alias("confidence"), F.lit(method).alias("method")))
    tries = [by(region, region_confidence, "region"), by(anchor, anchor_confidence, "anchor")]
    none = F.struct(F.lit(None).cast("string").alias("value"), region_confidence.alias("confidence"), F.lit("region").alias("method"))
    return F.coalesce(*(reversed(tries) if anchor_first else tries), none)


def dates_of_regions(footer: Column, freight: Column) -> Column:
    """Struct (date_of_issue, on_board_date): the footer's last date; the first of all where there are two or more."""
    low, every = dates_in(footer), F.concat(dates_in(freight), dates_in(footer))
    issue = F.coalesce(F.try_element_at(low, F.lit(-1)), F.when(F.size(every) == 1, F.get(every, F.lit(0))))
    return F.struct(issue.alias("date_of_issue"), F.when(F.size(every) >= 2, F.get(every, F.lit(0))).alias("on_board_date"))
