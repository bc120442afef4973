"""Term normalization: codes and formats, tiered glossary look-up, fuzzy ranking, spans."""

from __future__ import annotations

from bisect import bisect_left
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..sources.tables import checkpointed

# Unit codes and their other names, company forms and how they are written.
UNITS = {
    "KGM": ["KG", "KGS", "KILO", "KILOS", "KILOGRAM", "KILOGRAMS", "킬로그램", "킬로"],
    "TNE": ["MT", "TON", "TONS", "TONNE", "TONNES", "톤", "메트릭톤"],
    "LBR": ["LB", "LBS", "POUND", "POUNDS"],
    "MTQ": ["CBM", "M3", "CUM", "세제곱미터", "입방미터"],
    "LTR": ["L", "LITER", "LITERS", "LITRE", "LITRES"],
    "MTR": ["M", "METER", "METERS", "METRE", "METRES"],
    "CT": ["CTN", "CTNS", "CARTON", "CARTONS"],
    "PK": ["PKG", "PKGS", "PACKAGE", "PACKAGES"],
    "BX": ["BOX", "BOXES"],
    "PCE": ["PCS", "PC", "PIECE", "PIECES"],
}
SUFFIX_FORMS = {
    "CO": "Co.", "LTD": "Ltd.", "INC": "Inc.", "CORP": "Corp.", "LLC": "LLC", "GMBH": "GmbH", "PTE": "Pte.", "PVT": "Pvt.",
    "LIMITED": "Limited", "COMPANY": "Company", "CORPORATION": "Corporation", "AG": "AG", "SA": "SA", "BV": "BV", "NV": "NV",
}
TIERS = ("shipment", "organisation", "standard")  # most specific first
TOP_K, FLOOR = 5, 0.55
#: Spans of a group after which it is cut, at the next place where none reaches across.
MOST_SPANS = 4096


def unit_names() -> dict[str, str]:
    return {name: code for code, names in UNITS.items() for name in (code, *names)}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*map(F.lit, chain(*table.items()))), key)


def unit_code(token: Column) -> Column:
    """Code of a whole unit token, dots and spaces apart; unknown ones are null, never guessed."""
    return F.when(token.isNotNull(), F.try_element_at(F.create_map(*map(F.lit, chain(*unit_names().items()))), F.regexp_replace(F.upper(token), r"[.\s]+", "")))


QUANTITY = r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*([A-Za-z0-9가-힣./³]+)"


def split_quantity(text: Column) -> tuple[Column, Column]:
    """Number and unit as written; null if there is no quantity."""
    return F.nullif(F.regexp_extract(text, QUANTITY, 1), F.lit("")), F.nullif(F.regexp_extract(text, QUANTITY, 2), F.lit(""))


HS = r"^(?:HS\s*)?([0-9]{4})\.?([0-9]{2})(?:[-\s]?([0-9]{4}))?$"


def normalize_hs(text: Column) -> Column:
    """dddd.dd, with -dddd if those digits are there; none are made up; null for anything else."""
    t = F.upper(F.trim(text))
    part = lambda i: F.regexp_extract(t, HS, i)
    return F.when(t.rlike(HS), F.concat(part(1), F.lit("."), part(2), F.when(part(3) != "", F.concat(F.lit("-"), part(3))).otherwise("")))


PRICE = r"^\s*([A-Z])[.\s]?([A-Z])[.\s]?([A-Z])\b(.*)$"


def price_term(text: Column) -> tuple[Column, Column]:
    """Code and place (the trailing edition note is no part of it); null if it isn't a price term."""
    t = F.upper(text)
    code = F.concat(*(F.regexp_extract(t, PRICE, i) for i in (1, 2, 3)))
    place = F.regexp_replace(F.regexp_replace(F.regexp_extract(t, PRICE, 4), r"\s*\(\s*INCOTERMS\s*[0-9]{4}\s*\)\s*$", ""), r"^[ ,]+|[ ,]+$", "")
    known = code.isin(s.INCOTERMS)
    return F.when(known, code), F.when(known, F.nullif(place, F.lit("")))


def format_price_term(code: Column, place: Column) -> Column:
    """The standard form: the code, the place with a capital after whatever is no letter, and the edition."""
    parts = F.transform(F.split(F.lower(F.trim(place)), r"(?<=[^\p{L}])"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))
    return F.concat(F.upper(code), F.lit(" "), F.array_join(parts, ""), F.lit(" (Incoterms 2020)"))


SUFFIX = "(?:" + "|".join(sorted(SUFFIX_FORMS, key=lambda k: (-len(k), k))) + ")"


def party_suffix(text: Column) -> tuple[Column, Column]:
    """The company forms at the end of a name as written, and in their standard form; null if there are none."""
    raw = F.regexp_extract(F.upper(text), rf"(?:^|\s)({SUFFIX}(?:[.,]*\s*{SUFFIX})*[.,]*)\s*$", 1)
    forms = F.transform(F.regexp_extract_all(raw, F.lit(f"({SUFFIX})"), 1), lambda t: _lookup(SUFFIX_FORMS, t))
    return F.nullif(raw, F.lit("")), F.when(raw != "", F.array_join(forms, ", "))


def tier_lookup(wanted: DataFrame, glossary: DataFrame) -> DataFrame:
    """``wanted`` (key) with the terms of the most specific tier that knows the key; all hits of that tier stay.

    The tier to use is found by a map-side combined minimum over the glossary, which then meets the keys in an
    equi-join; Spark broadcasts the glossary if it is small.
    """
    place = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    ranked = glossary.withColumn("rank", place)
    best = ranked.groupBy("key").agg(F.min("rank").alias("rank"))
    return wanted.join(ranked.join(best, ["key", "rank"]).drop("rank"), "key")


def resolve(hits: DataFrame, by: list[str]) -> DataFrame:
    """One hit is applied, several need a choice: (by, outcome, n, term if there is only one)."""
    return hits.groupBy(*by).agg(F.count("*").alias("n"), F.min("term").alias("one")).select(
        *by, "n", F.when(F.col("n") == 1, "apply").otherwise("choice").alias("outcome"), F.when(F.col("n") == 1, F.col("one")).alias("term")
    )


def dice_top_k(queries: DataFrame, terms: DataFrame, k: int = TOP_K, floor: float = FLOOR) -> DataFrame:
    """(query, term, score, place): the best k terms of each query, at or above the floor."""
    scored = dice_pairs(queries, terms, floor)
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "term")).cast("long")).where(F.col("place") <= k)


def dice_pairs(queries: DataFrame, terms: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(query, term, score): Dice over 3-gram multisets of the different texts (text) of both sides, at or above the floor.

    Two texts at or above the floor share at least floor / (2 - floor) of either one's grams, so they share one of the
    rarest that are left over (an exact prefix filter).  Only those meet in the equi-join; the pairs that
    come out of it are then scored by their whole grams.  A repeated gram counts by its number in the text.
    """

    def numbered(df: DataFrame) -> DataFrame:
        g = s.grams(s.normalize_key(F.col("text")))
        items = s.bound(g, lambda g: F.transform(g, lambda x, i: F.concat(x, F.lit("#"), F.size(F.filter(F.slice(g, 1, i + 1), lambda y: y == x)).cast("string"))))
        return df.select("text").distinct().select("text", items.alias("items")).where(F.size("items") > 0)

    left, right = numbered(queries), numbered(terms)
    common = right.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("df"))
    share = floor / (2 - floor)

    def prefix(df: DataFrame, name: str) -> DataFrame:
        each = df.select("text", F.size("items").alias("n"), F.explode("items").alias("item")).join(common, "item", "left")
        rarest = F.row_number().over(Window.partitionBy("text").orderBy(F.coalesce("df", F.lit(0)), "item"))
        return each.withColumn("r", rarest).where(F.col("r") <= F.col("n") - F.ceil(share * F.col("n") - 1e-9) + 1).select("item", F.col("text").alias(name), F.col("n").alias(f"n_{name}"))

    met = prefix(left, "query").join(prefix(right, "term"), "item")
    pairs = met.where((F.col("n_term") >= share * F.col("n_query") - 1e-9) & (F.col("n_query") >= share * F.col("n_term") - 1e-9)).select("query", "term").distinct()
    whole = pairs.join(left.select(F.col("text").alias("query"), F.col("items").alias("a")), "query").join(right.select(F.col("text").alias("term"), F.col("items").alias("b")), "term")
    return whole.select("query", "term", F.round(2.0 * F.size(F.array_intersect("a", "b")) / (F.size("a") + F.size("b")), 6).alias("score")).where(F.col("score") >= floor)


def runs(spans: DataFrame) -> DataFrame:
    """(group, run, start, end): the distinct spans that aren't empty, a group's cut about every MOST_SPANS.

    A cut is made only where no span reaches across, so spans of different runs never overlap.  A group is looked through in
    parts of its order: each part knows how far and how many the parts before it reach.
    """
    some = spans.select("group", "start", "end").where("start < end").distinct()
    parts = checkpointed(some.repartitionByRange("group", "start", "end").withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("group", "part").orderBy("start", "end")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    # one row for each group and part
    upto = Window.partitionBy("of").orderBy("in").rowsBetween(Window.unboundedPreceding, -1)
    ends = parts.groupBy(F.col("group").alias("of"), F.col("part").alias("in")).agg(F.max("end").alias("far"), F.count("*").alias("n"))
    ends = ends.select("of", "in", F.max("far").over(upto).alias("far"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n"))
    here = F.col("group").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in"))
    met = parts.withColumn("reached", F.max("end").over(before)).withColumn("place", F.row_number().over(own) - 1).join(ends, here)
    met = met.withColumn("reached", F.greatest("reached", "far")).withColumn("place", F.col("place") + F.col("n")).drop("of", "in", "far", "n")
    apart = F.when(F.col("reached").isNull() | (F.col("start") >= F.col("reached")), F.col("place"))
    cut = met.withColumn("apart", apart).withColumn("cut", F.max("apart").over(own))
    last = met.withColumn("apart", apart).groupBy(F.col("group").alias("of"), F.col("part").alias("in")).agg(F.max("apart").alias("cut_before"))
    last = last.select("of", "in", F.max("cut_before").over(upto).alias("cut_before"))
    return cut.join(last, here).select("group", F.floor(F.coalesce("cut", "cut_before") / MOST_SPANS).alias("run"), "start", "end")


def resolve_overlaps(spans: DataFrame) -> DataFrame:
    """(group, start, end) that stay when overlapping ones are settled: longest first, then leftmost.

    The choice depends on what was chosen before, so it is made for each run of a group (one field's spans) in a
    small Python function, which asks only two neighbours of what it has taken; runs are independent and spread by Spark.
    """
    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.assign(size=pdf["start"] - pdf["end"]).sort_values(["size", "start", "end"]).drop_duplicates(["start", "end"])
        taken = order.iloc[choose(order["start"].tolist(), order["end"].tolist())]
        return pd.DataFrame({"group": pdf["group"].iloc[0], "start": taken["start"], "end": taken["end"]})

    return runs(spans).groupBy("group", "run").applyInPandas(keep, "group bigint, start bigint, end bigint")


def choose(starts: list[int], ends: list[int]) -> list[int]:
    """Places, in their order, that overlap none chosen before.  What is taken is kept sorted and apart, so each asks
    only its two neighbours; an empty place overlaps what it lies within, not what it touches."""
    taken: list[tuple[int, int]] = []
    out = []
    for i, (a, b) in enumerate(zip(starts, ends)):
        at = bisect_left(taken, (a, b))
        if not any(a < d and c < b for c, d in taken[max(0, at - 1) : at + 1]):
            taken.insert(at, (a, b))
            out.append(i)
    return out


def apply_spans(text: Column, spans: Column) -> Column:
    """The text with each span (start, end, new), none overlapping, replaced from right to left."""
    ordered = F.reverse(F.array_sort(spans))
    return F.aggregate(ordered, text, lambda acc, p: F.concat(F.substr(acc, F.lit(1), p["start"].cast("int")), p["new"], F.substr(acc, (p["end"] + 1).cast("int"))))
