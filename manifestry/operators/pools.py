"""Pools of values as real documents write them, in the order in which they were first seen; and the credit that a bill
of lading would have been made out under.

A pool's values are different texts (case apart); which spelling counts and where it stands in the pool follow from
the place of its first occurrence, a grouped minimum. Places within a pool come from the numbers of values before
each part of a range partitioning, so no pool is ever put in order in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaners as c
from ..functions import scalars as s
from .metrics import running

# Patterns and lengths of what is taken into the pools.
QUANTITY_WORD = rf"(?i)^[0-9]+\s*(?:{c.PACKED})\b"
POOL_WEIGHT, POOL_VOLUME, AMOUNT = r"(?i)([0-9,]+\.?[0-9]*)\s*(?:KGS?|KG)\b", r"(?i)([0-9,]+\.?[0-9]*)\s*(?:CBM|M3|CU\.?\s*M)\b", r"\$\s*([0-9,]+\.?[0-9]*)"
REFERENCE = r"\b([A-Z]{1,4}[0-9]{5,10})\b"
POOL_CONTACT = r"(?i)(?:TEL|FAX|T\)|F\)|PHONE|MOBILE)[^A-Za-z]*.*$"
MOST = {"company": 150, "goods": 150, "vessel": 80, "vessel_words": 4}


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), c.strip), lambda x: x != "")


def _first(of: Column) -> Column:
    return F.get(of, F.lit(0))


def company(text: Column) -> Column:
    """The first line with a legal form, a leading number's code apart."""
    named = F.filter(_lines(F.regexp_replace(text, POOL_CONTACT, "")), lambda x: x.rlike(c.LEGAL_FORM))
    return F.substring(_first(F.filter(F.transform(named, lambda x: F.regexp_replace(x, r"^[A-Z]{2}[0-9]{5,}\s+", "")), lambda x: F.length(x) > 3)), 1, MOST["company"])


def goods(text: Column) -> Column:
    """The first item that is counted in packages, without the count and what follows from a quantity on."""
    lines = F.transform(F.filter(_lines(text), lambda x: ~x.rlike(r"(?i)^TOTAL\b")), lambda x: F.regexp_replace(x, r"(?i)^[A-Z]{1,4}[0-9]{5,}\s+", ""))
    item = lambda x: F.regexp_replace(c.strip(F.regexp_replace(c.strip(F.regexp_replace(x, QUANTITY_WORD, "")), r"(?i),?\s*[0-9][0-9,.]*\s*(?:KGS?|KG|CBM|M3)\b.*$", "")), ",+$", "")
    return F.substring(_first(F.filter(F.transform(F.filter(lines, lambda x: x.rlike(QUANTITY_WORD)), item), lambda x: F.length(x) > 2)), 1, MOST["goods"])


def vessel(text: Column) -> Column:
    """Up to four words in capitals of the first line."""
    words = F.filter(F.split(_first(_lines(F.regexp_replace(text, c.PORT_NOISE, ""))), r"\s+"), lambda w: w.rlike(r"^[A-Z][A-Z.\-]*$"))
    return F.nullif(F.substring(F.array_join(F.slice(words, 1, MOST["vessel_words"]), " "), 1, MOST["vessel"]), F.lit(""))


#: The pools: which regions they are filled from, in their order, and how.
TEXTS: dict[str, tuple[tuple[str, ...], Callable[[Column], Column]]] = {
    "company": (("shipper", "consignee", "notify"), company), "port": (("port_left", "port_right"), c.port_name), "vessel": (("vessel_info",), vessel), "goods": (("cargo",), goods),
}
NUMBERS = {"weight_kg": POOL_WEIGHT, "measurement_cbm": POOL_VOLUME, "amount_usd": AMOUNT}


def found(rows: DataFrame, key: str) -> DataFrame:
    """(kind, value, file, i): every value of rows (key, regions: a map of texts, text: the whole), in the order of reading."""
    region = lambda n: F.coalesce(F.try_element_at("regions", F.lit(n)), F.lit(""))
    texts = [F.struct(F.lit(kind).alias("kind"), take(region(n)).alias("value"), F.lit(i).alias("i")) for kind, (names, take) in TEXTS.items() for i, n in enumerate(names)]
    codes = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(REFERENCE), 1), lambda v, i: F.struct(F.lit("reference_code").alias("kind"), v.alias("value"), i.alias("i")))
    each = rows.select(F.col(key).alias("file"), F.explode(F.concat(F.array(*texts), codes)).alias("x")).select("file", "x.*")
    return each.where("value IS NOT NULL")


def numbers(rows: DataFrame, key: str) -> DataFrame:
    """(kind, value, file, i): every weight, volume and amount of the whole text, as a number; repeats count."""
    of = [_numbers(kind, pattern) for kind, pattern in NUMBERS.items()]
    return rows.select(F.col(key).alias("file"), F.explode(F.concat(*of)).alias("x")).select("file", "x.*").where("value IS NOT NULL")


def _numbers(kind: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), 1), lambda v, i: F.struct(F.lit(kind).alias("kind"), F.replace(v, F.lit(","), F.lit("")).try_cast("double").alias("value"), i.alias("i")))


def pools(rows: DataFrame, key: str) -> DataFrame:
    """(kind, value, file, n, place): the different values of each pool, the file they were first seen in, how often they occur and
    their place in the pool, from 0."""
    at = F.struct("file", "i", "value")
    per = found(rows, key).groupBy("kind", F.upper("value").alias("same")).agg(F.min(at).alias("first"), F.count("*").alias("n"))
    one = per.select("kind", F.col("first.value").alias("value"), F.col("first.file").alias("file"), F.col("first.i").alias("i"), "n")
    return placed(one, "kind", "file", "i").drop("i")


def placed(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """rows with ``place``, from 0 in the order within each ``by``."""
    return running(rows.withColumn("one", F.lit(1)), [by], list(order), "one").withColumn("place", F.col("before_one")).drop("one", "before_one")


# The days a credit leaves for shipment and presentation, and how much above the weight its limit lies.
SHIP_WITHIN, SHOW_WITHIN, WEIGHT_FROM, WEIGHT_TO = (5, 30), (10, 40), 1.1, 1.5
DOCUMENTS = "COMMERCIAL INVOICE;PACKING LIST;BILL OF LADING"


def drawn(key: Column, what: str, n: int) -> Column:
    """A number below n that follows from the key: the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(what), key.cast("string"))), 1, 8), 16, 10).cast("long") % n


def credit(bills: DataFrame) -> DataFrame:
    """shipment_id and the terms (lc_*) of a credit under which the bill's fields are as they should be.

    ``bills``: shipment_id, the bill's fields and the days of its dates (``checks.prepare``).  Nothing is made up: what the
    bill does not say is null, so that rules that need it are not evaluated; a prohibition stands only where the bill's
    own words don't break it; and what is drawn follows from the key.
    """
    k = F.col("shipment_id")
    between = lambda what, span: (span[0] + drawn(k, what, span[1] - span[0] + 1)).cast("int")
    place = lambda f: F.nullif(F.coalesce(F.nullif(c.strip(F.regexp_extract(f, r"^([^,/(]*)", 1)), F.lit("")), c.strip(F.col(f))), F.lit(""))
    shipped = F.when(F.col("on_board_date").isNotNull(), F.col("day_on_board_date")).otherwise(F.col("day_date_of_issue"))
    latest = F.date_add(shipped, between("ship", SHIP_WITHIN))
    weight, freight = s.parse_quantity(F.col("gross_weight"), "KG"), s.parse_amount(F.col("total_freight"))
    text = F.upper(F.concat_ws(" ", "description_of_goods", "port_of_loading", "port_of_discharge"))
    named = F.upper(F.regexp_extract(F.regexp_extract("description_of_goods", r"^([^/\n]*)", 1), r"[A-Za-z]{2,}(?:\s+[A-Za-z]{2,})?", 0))
    said = F.coalesce("incoterms", "description_of_goods")  # where the check looks as well
    term = F.coalesce(*(F.when(s.has_word(said, t), t) for t in s.INCOTERMS))
    heads = lambda what: drawn(k, what, 2) == 0
    free = lambda *words: ~F.exists(s.words(list(words)), lambda w: F.contains(text, w))
    either = lambda what, *words: F.when(heads(what) & free(*words), "PROHIBITED").otherwise("ALLOWED")
    return bills.select(
        "shipment_id", place("port_of_loading").alias("lc_port_of_loading"), place("port_of_discharge").alias("lc_port_of_discharge"), F.col("consignee").alias("lc_consignee"), F.when(drawn(k, "notify", 10) < 6, F.col("notify_party")).alias("lc_notify_party"),
        F.nullif(named, F.lit("")).alias("lc_description_of_goods"), F.date_format(latest, "yyyy-MM-dd").alias("lc_latest_shipment_date"), F.date_format(F.date_add(latest, between("show", SHOW_WITHIN)), "yyyy-MM-dd").alias("lc_expiry_date"),
        F.when(weight > 0, F.round(weight * (WEIGHT_FROM + drawn(k, "weight", 1001) / 1000 * (WEIGHT_TO - WEIGHT_FROM)), 2)).alias("lc_max_gross_weight_kg"), F.lit(None).cast("double").alias("lc_max_measurement_cbm"),
        F.when(freight > 0, freight).alias("lc_freight_amount"), term.alias("lc_incoterms"), either("partial", "PARTIAL", "PART SHIPMENT", "1ST SHIPMENT").alias("lc_partial_shipment"), either("transit", "TRANSHIP", "TRANSSHIP", "TRANSIT").alias("lc_transhipment"),
        F.lit(10.0).alias("lc_tolerance_pct"), F.lit(21).alias("lc_presentation_days"), F.lit(None).cast("string").alias("lc_bl_consignment"), F.lit(DOCUMENTS).alias("lc_documents"),
    )
