"""Report tables: deadlines, checklists, outlook, counts by status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from .catalog import RULES, Rule
from .checks import NOT_EVALUATED, PASS, VIOLATED
from .verdict import HELD

#: Documents that a shipment hands in, as the checklist compares them with those that the credit asks for.
SUBMITTED = ("BILL OF LADING", "COMMERCIAL INVOICE", "PACKING LIST")
BASE_FIELDS = ("bl_no", "shipper", "consignee", "port_of_loading", "port_of_discharge", "description_of_goods", "date_of_issue")


def deadline(shipments: DataFrame) -> DataFrame:
    """due = shipped + days allowed; effective = the earlier of due and expiry; nothing known: null."""
    shipped = F.when(F.col("on_board_date").isNotNull(), F.col("day_on_board_date")).otherwise(F.col("day_date_of_issue"))
    due, expiry = F.date_add(shipped, F.col("lc_presentation_days")), F.col("day_lc_expiry_date")
    return shipments.select("shipment_id", "as_of", due.alias("due"), expiry.alias("expiry"), F.least(due, expiry).alias("effective")).select(
        "shipment_id", "due", "expiry", "effective", F.datediff("effective", "as_of").alias("days_left")
    )


def checklist(shipments: DataFrame) -> DataFrame:
    """Each document that the credit asks for, and whether a submitted one matches it by containment of their keys."""
    asked = shipments.select("shipment_id", F.explode(F.split("lc_documents", ";")).alias("document"))
    key = s.loose_key(F.col("document"))
    hit = reduce(lambda a, b: a | b, (F.contains(key, F.lit(k)) | F.contains(F.lit(k), key) for k in (d.replace(" ", "") for d in SUBMITTED)))
    return asked.select("shipment_id", "document", ((key != "") & hit).alias("submitted"))


def checklist_sql() -> str:
    key = "regexp_replace(upper(document), '[^A-Z0-9가-힣]', '', 'g')"
    hit = " OR ".join(f"contains({key}, '{d.replace(' ', '')}') OR contains('{d.replace(' ', '')}', {key})" for d in SUBMITTED)
    return f"SELECT shipment_id, document, {key} <> '' AND ({hit}) AS submitted FROM (SELECT shipment_id, unnest(string_split(lc_documents, ';')) AS document FROM s)"


def outlook(scores: DataFrame, deadlines: DataFrame) -> DataFrame:
    """Overdue before critical before warning before clean."""
    both = scores.join(deadlines.select("shipment_id", "days_left"), "shipment_id", "left")
    return both.select("shipment_id", F.when(F.col("days_left") < 0, "overdue").when(F.col("n_critical") > 0, "critical").when(F.col("n_warning") > 0, "warning").otherwise("clean").alias("outlook"), "days_left")


def status_pivot(judged: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of every status for each rule and severity, zeros included; a severity that no shipment has is left out.

    The outcomes are counted at their places in one pass: none becomes a row of its own. A severity other than the rule's
    own is a violation's (an unreadable value).
    """
    own = lambda r, rule: r["severity"] == rule.severity
    ask = {x: (lambda r, rule, x=x: (r["status"] == x) & own(r, rule)) for x in (PASS, VIOLATED, NOT_EVALUATED, HELD)} | {"other": lambda r, rule: ~own(r, rule)}
    counted = judged.agg(*(F.count(F.when(met(F.get("outcomes", F.lit(i)), rule), 1)).alias(f"{x}_{i}") for i, rule in enumerate(rules) for x, met in ask.items()))
    row = lambda rule, severity, n: F.struct(F.lit(rule.id).alias("rule_id"), F.lit(severity).alias("severity"), *(n(x).alias(x) for x in (PASS, VIOLATED, NOT_EVALUATED, HELD)))
    each = [row(rule, rule.severity, lambda x: F.col(f"{x}_{i}")) for i, rule in enumerate(rules)]
    each += [row(rule, "warning", lambda x: F.col(f"other_{i}") if x == VIOLATED else F.lit(0).cast("long")) for i, rule in enumerate(rules)]
    return counted.select(F.inline(F.array(*each))).where(F.col(PASS) + F.col(VIOLATED) + F.col(NOT_EVALUATED) + F.col(HELD) > 0)


def clean_base(shipments: DataFrame) -> DataFrame:
    """Shipments with all base fields present."""
    return shipments.where(reduce(lambda a, b: a & b, (F.col(f).isNotNull() for f in BASE_FIELDS))).select("shipment_id", "bl_no")


def clean_base_sql() -> str:
    return "SELECT shipment_id, bl_no FROM s WHERE " + " AND ".join(f"nullif(trim({f}), '') IS NOT NULL" for f in BASE_FIELDS)
