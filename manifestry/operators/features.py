"""Feature groups of a shipment. Missing is null, never 0: a feature that can't be judged says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from . import verdict
from .catalog import RULES
from .checks import NOT_EVALUATED, PASS, VIOLATED
from .review import conditions_of

NO_DEADLINE = 999.0
CREDIT_FIELDS = ("port_of_loading", "port_of_discharge", "consignee", "notify_party", "description_of_goods", "latest_shipment_date", "expiry_date", "incoterms")
BL_FIELDS = (
    "bl_no", "shipper", "consignee", "notify_party", "vessel", "port_of_loading", "port_of_discharge", "description_of_goods", "gross_weight",
    "measurement", "date_of_issue", "on_board_date", "place_of_issue", "total_freight", "incoterms", "no_of_original_bl", "bl_clauses",
)


def rule_pivot(judged: DataFrame) -> DataFrame:
    """A column for each rule: 1 violated, 0 passed, null skipped or held; and the unclipped sum of weights.

    The outcomes stand in the order of the catalog, so each column is read at its place.
    """
    value = lambda status: F.when(status == VIOLATED, 1.0).when(status == PASS, 0.0)
    return judged.select("shipment_id", *(value(F.get("outcomes", F.lit(i))["status"]).alias(r.id.lower()) for i, r in enumerate(RULES)), F.round(verdict.weight(verdict.is_bad), 4).alias("weight_sum"))


def core(shipments: DataFrame) -> DataFrame:
    """Counts, ratios and day gaps, all within the row; no deadline is 999, a gap that can't be judged null."""
    missing = sum((F.col(f).isNull().cast("int") for f in BL_FIELDS), F.lit(0))
    terms = sum((F.col("lc_" + f).isNotNull().cast("int") for f in CREDIT_FIELDS), F.lit(0))
    bad = lambda severity: verdict.number(lambda r: verdict.is_bad(r) & (r["severity"] == severity))
    rows = shipments.select("*", F.round(missing / len(BL_FIELDS), 6).alias("missing_ratio"), terms.cast("long").alias("n_credit_terms"),
        F.coalesce(F.datediff("day_lc_expiry_date", "as_of").cast("double"), F.lit(NO_DEADLINE)).alias("days_to_expiry"),
        F.datediff("day_lc_latest_shipment_date", "day_on_board_date").cast("double").alias("days_to_latest_shipment"),
        (F.size(F.filter(F.split("held", ","), lambda x: x != ""))).cast("long").alias("n_held_fields"),
    )
    own = ("missing_ratio", "n_credit_terms", "days_to_expiry", "days_to_latest_shipment", "n_held_fields")
    return verdict.judged(rows, RULES, *own).select(
        "shipment_id", bad("critical").alias("n_critical"), bad("warning").alias("n_warning"), F.round(verdict.weight(verdict.is_bad), 4).alias("weight_sum"),
        F.round(verdict.number(lambda r: r["status"] == NOT_EVALUATED) / len(RULES), 6).alias("skipped_ratio"), *own,
    )


#: Order of the vector; what follows from rules comes first, so that a model without it is a cut of the columns.
VECTOR = (
    "critical_count", "warning_count", "info_count", "violation_weight_sum", "skipped_ratio", "evaluated_count", "field_missing_ratio",
    "critical_field_missing_count", "low_confidence_ratio", "mean_confidence", "anchor_derived_ratio", "days_to_shipment_deadline", "days_to_expiry", "lc_condition_count",
)
CRITICAL_FIELDS = ("bl_no", "consignee", "port_of_loading", "port_of_discharge", "date_of_issue")
LOW_CONFIDENCE = 0.80
CONDITIONS = (
    "port_of_loading", "port_of_discharge", "consignee", "notify_party", "description_of_goods", "latest_shipment_date", "expiry_date", "incoterms",
    "max_gross_weight_kg", "max_measurement_cbm", "freight_amount", "bl_consignment", "documents",
)


def vector(shipments: DataFrame, confidence: Column, provenance: Column) -> DataFrame:
    """The 14 features of a shipment, all doubles and never null, within the row.

    ``confidence`` and ``provenance`` are maps by field: without them nothing is uncertain.  No deadline is 999 days.
    """
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 4)).otherwise(F.lit(0.0))
    empty = lambda names: sum((F.col(f).isNull().cast("int") for f in names), F.lit(0))
    sure, origin = F.coalesce(F.map_values(confidence), F.array().cast("array<double>")), F.coalesce(F.map_values(provenance), F.array().cast("array<string>"))
    days = lambda c: F.coalesce(F.datediff(c, "as_of").cast("double"), F.lit(NO_DEADLINE))
    rows = shipments.select(
        "*", F.round(empty(BL_FIELDS) / len(BL_FIELDS), 4).alias("v7"), empty(CRITICAL_FIELDS).cast("double").alias("v8"), F.round(F.size(F.filter(sure, lambda c: c < LOW_CONFIDENCE)) / len(BL_FIELDS), 4).alias("v9"),
        F.when(F.size(sure) > 0, F.round(F.aggregate(sure, F.lit(0.0), lambda a, c: a + c) / F.size(sure), 4)).otherwise(F.lit(1.0)).alias("v10"),
        ratio(F.size(F.filter(origin, lambda o: o == "anchor")), F.size(origin)).alias("v11"), days("day_lc_latest_shipment_date").alias("v12"), days("day_lc_expiry_date").alias("v13"),
        sum((F.col("lc_" + c).isNotNull().cast("int") for c in CONDITIONS), F.lit(0)).cast("double").alias("v14"),
    )
    bad = lambda severity: verdict.number(lambda r: verdict.is_bad(r) & (r["severity"] == severity)).cast("double")
    skipped = verdict.number(lambda r: r["status"] == NOT_EVALUATED)
    evaluated = verdict.number(lambda r: r["status"].isin(PASS, VIOLATED))
    made = [bad("critical"), bad("warning"), bad("info"), F.round(verdict.weight(verdict.is_bad), 4), ratio(skipped, evaluated + skipped), evaluated.cast("double"), *(F.col(f"v{i}") for i in range(7, 15))]
    return verdict.judged(rows, RULES, *(f"v{i}" for i in range(7, 15))).select("shipment_id", *(c.alias(n) for c, n in zip(made, VECTOR)))


def consistency(shipments: DataFrame) -> DataFrame:
    """Edit distances and deviations between documents."""
    pairs = [("consignee", "inv_buyer"), ("shipper", "inv_seller"), ("description_of_goods", "inv_description_of_goods")]
    ratios = F.array(*(s.levenshtein_ratio(F.col(a), F.col(b)) for a, b in pairs))
    known = F.filter(ratios, lambda r: r.isNotNull())
    weight = s.deviation_ratio(s.parse_quantity(F.col("gross_weight"), "KG"), s.parse_quantity(F.col("pack_gross_weight"), "KG"))
    return shipments.select(
        "shipment_id", F.round(F.array_max(known), 6).alias("edit_max"), F.round(F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, b: a + b), F.size(known)), 6).alias("edit_mean"),
        F.round(weight, 6).alias("weight_deviation"), (weight > 0.15).alias("weight_mismatch"),
    )


def complexity(rows: DataFrame, key: str, conditions: Column) -> DataFrame:
    """Of a credit's further conditions (a semicolon list): half their number (six are all), half their length (800 letters are all)."""
    n, length = F.coalesce(F.size(conditions_of(conditions)), F.lit(0)), F.coalesce(F.length(conditions), F.lit(0))
    return rows.select(key, F.round(0.5 * F.least(n / 6, F.lit(1.0)) + 0.5 * F.least(length / 800, F.lit(1.0)), 6).alias("complexity"))


def time_margin(shipments: DataFrame) -> DataFrame:
    shipped = F.when(F.col("on_board_date").isNotNull(), F.col("day_on_board_date")).otherwise(F.col("day_date_of_issue"))
    gone = F.datediff("as_of", shipped)
    return shipments.select("shipment_id", gone.cast("long").alias("days_since_shipment"), F.round(F.greatest(F.lit(0.0), 1 - gone / F.col("lc_presentation_days")), 6).alias("remaining_ratio"), (gone > 21).alias("over_21"))
