"""Lay-out extraction: tokens with boxes to lines, regions and fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s

# Regions of the form as shares of the page's width and height (x from, to; y from, to).
REGIONS = {
    "header": (0.0, 1.0, 0.0, 0.13),
    "bl_no": (0.50, 0.85, 0.13, 0.26),
    "shipper": (0.0, 0.50, 0.04, 0.17),
    "consignee": (0.0, 0.50, 0.16, 0.26),
    "notify": (0.0, 0.50, 0.25, 0.38),
    "vessel_info": (0.0, 0.60, 0.37, 0.44),
    "port_left": (0.0, 0.28, 0.40, 0.47),
    "port_right": (0.28, 0.55, 0.40, 0.47),
    "cargo": (0.05, 0.68, 0.50, 0.70),
    "weight": (0.60, 0.82, 0.50, 0.75),
    "measurement": (0.80, 0.97, 0.50, 0.75),
    "freight": (0.0, 0.55, 0.73, 0.87),
    "footer": (0.0, 0.55, 0.83, 0.97),
}
#: Pixels between the centres of two boxes, one above the other, that still share a line.
LINE_GAP = 15
#: Titles by which a document's kind is known; the longest one found in its first twelve lines decides.
TITLES = {
    "bill_of_lading": ["BILL OF LADING", "MULTIMODAL TRANSPORT", "SEA WAYBILL", "COMBINED TRANSPORT", "선하증권"],
    "commercial_invoice": ["COMMERCIAL INVOICE", "INVOICE", "상업송장", "송장"],
    "packing_list": ["PACKING LIST", "PACKING SPECIFICATION", "포장명세서", "포장 명세서"],
}
TITLE_LINES = 12


def regions_of(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Names of all regions that hold the point, edges included; a point may lie in several."""
    names = [F.when(x.between(a * width, b * width) & y.between(c * height, d * height), F.lit(n)) for n, (a, b, c, d) in REGIONS.items()]
    return F.array_compact(F.array(*names))


def region_texts(tokens: DataFrame) -> DataFrame:
    """(document_id, region, text) of tokens (document_id, idx, text, x_min, y_min, x_max, y_max, width, height).

    Thirteen regions are conditions of one projection, not a join; a region's tokens stand in one array, which is cut where
    their centres part, so that one exchange does for all.
    """
    x, y = (F.col("x_min") + F.col("x_max")) / 2, (F.col("y_min") + F.col("y_max")) / 2
    placed = tokens.withColumn("y", y).withColumn("region", F.explode(regions_of(x, F.col("y"), F.col("width"), F.col("height"))))
    boxes = placed.groupBy("document_id", "region").agg(F.array_sort(F.collect_list(F.struct("y", "x_min", "idx", "text"))).alias("t"))
    begins = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i)["y"] - F.get("t", i - 1)["y"] > LINE_GAP))

    def lines(starts: Column) -> Column:
        cut = F.transform(starts, lambda a, k: F.slice("t", a + 1, F.coalesce(F.get(starts, k + 1), F.size("t")) - a))
        across = lambda line: F.array_sort(F.transform(line, lambda b: F.struct(b["x_min"], b["idx"], b["text"].alias("text"))))
        return F.transform(cut, lambda line: F.array_join(F.transform(across(line), lambda b: b["text"]), " "))

    return boxes.select("document_id", "region", F.array_join(s.bound(begins, lines), "\n").alias("text"))


def document_kind(text: Column) -> Column:
    """Kind by the longest title in the first lines; ``unknown`` without one."""
    head = F.regexp_replace(F.upper(F.array_join(F.slice(F.split(text, "\n"), 1, TITLE_LINES), "\n")), "[^A-Z0-9가-힣 ]", " ")
    ordered = sorted(((k, t) for k, ts in TITLES.items() for t in ts), key=lambda p: -len(p[1]))
    return F.coalesce(*(F.when(F.contains(head, F.lit(t)), F.lit(k)) for k, t in ordered), F.lit("unknown"))
