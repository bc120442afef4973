"""Queries over the shipments: single checks, verdicts, cross-document checks, deadlines, reports, impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, cross, impact, report, verdict
from ..operators.catalog import CROSS_RULES, RULES
from . import rules_sql as sql
from .shipments import shipments, with_as_of, with_query

#: One rule for each check, by the query that shows it alone.
SHOWN = {
    "chk_required": "D005", "chk_required_if_lc": "D010", "chk_match_place": "D003", "chk_contains_keywords": "D006", "chk_date_not_after": "D002",
    "chk_before_expiry": "D008", "chk_presentation_period": "D018", "chk_date_not_future": "D019", "chk_numeric_not_above": "D007",
    "chk_within_tolerance": "D017", "chk_forbidden_when_prohibited": "D014", "chk_contains_forbidden": "D029", "chk_on_board_required": "D030",
    "chk_freight_prepaid": "D026", "chk_consignment": "D027", "chk_contains_incoterms": "D015", "chk_documents_required": "D016",
}
CROSS_SHOWN = {"x_same_party": "X001", "x_goods_compatible": "X003", "x_same_quantity": "X005", "x_same_reference": "X007", "x_amount_not_above": "X009"}
N_FIELDS = 18


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.prepare(with_as_of(shipments(spark, sf_dir)))


def held(spark: SparkSession, d: str) -> DataFrame:
    """(shipment_id, doc, field): the fields of each bill that are held, and so may change."""
    return view(spark, d).select("shipment_id", F.lit("bl").alias("doc"), F.explode(F.split("held", ",")).alias("field")).where("field <> ''")


def queries() -> dict:
    rules, crosses = {r.id: r for r in RULES}, {r.id: r for r in CROSS_RULES}

    def one(rule):
        return lambda spark, d: view(spark, d).select("shipment_id", checks.REGISTRY[rule.check](rule).alias("o")).select("shipment_id", "o.*")

    def pair(rule):
        return lambda spark, d: view(spark, d).select("shipment_id", cross.outcome(rule).alias("status"))

    out = {name: one(rules[i]) for name, i in SHOWN.items()} | {name: pair(crosses[i]) for name, i in CROSS_SHOWN.items()}
    row = lambda spark, d: verdict.judged(view(spark, d))
    return out | {
        "verdict_facts": lambda spark, d: verdict.facts(view(spark, d)),
        "verdict_score": lambda spark, d: verdict.row_scores(row(spark, d)).withColumn("risk", verdict.risk_level()),
        "verdict_range": lambda spark, d: verdict.kept(verdict.row_scores(row(spark, d)), F.col("n_held") > 0).select("shipment_id", "score", "score_high"),
        "severity_counts": lambda spark, d: verdict.severity_counts(row(spark, d)),
        "violation_order": lambda spark, d: verdict.ordered_violations(row(spark, d)),
        "rule_hits": lambda spark, d: verdict.rule_hits(row(spark, d)),
        "hold_gate": lambda spark, d: verdict.hold_gate(view(spark, d), N_FIELDS),
        "x_verdict": lambda spark, d: cross.facts(view(spark, d)),
        "merged_verdict": lambda spark, d: verdict.row_scores(verdict.merged(view(spark, d))),
        "deadline": lambda spark, d: report.deadline(view(spark, d)),
        "checklist": lambda spark, d: report.checklist(view(spark, d)),
        "outlook": lambda spark, d: report.outlook(verdict.row_scores(row(spark, d)), report.deadline(view(spark, d))),
        "recommendations": lambda spark, d: verdict.places_of_violations(row(spark, d)),
        "status_pivot": lambda spark, d: report.status_pivot(row(spark, d)),
        "impact_edges": lambda spark, d: impact.edges(spark).join(held(spark, d).groupBy("doc", "field").agg(F.count("*").alias("n_held")), ["doc", "field"], "left").fillna(0, ["n_held"]),
        "impacted_fields": lambda spark, d: impact.impacted(impact.edges(spark), held(spark, d)),
        "impact_neighbors": lambda spark, d: impact.exposed(row(spark, d)),
        "clean_base": lambda spark, d: report.clean_base(view(spark, d)),
    }


SCORES = """SELECT shipment_id, count(*) FILTER (status = 'violated') AS n_violated, count(*) FILTER (status = 'pass') AS n_passed,
 count(*) FILTER (status = 'not_evaluated') AS n_skipped, count(*) FILTER (status = 'held') AS n_held,
 count(*) FILTER (status = 'violated' AND severity = 'critical') AS n_critical, count(*) FILTER (status = 'violated' AND severity = 'warning') AS n_warning, count(*) FILTER (status = 'violated' AND severity = 'info') AS n_info,
 round(least(1.0, coalesce(sum(weight) FILTER (status = 'violated'), 0)), 4) AS score,
 round(least(1.0, least(1.0, coalesce(sum(weight) FILTER (status = 'violated'), 0)) + coalesce(sum(weight) FILTER (status = 'held'), 0)), 4) AS score_high
 FROM {f} GROUP BY shipment_id"""
DEADLINE = f"""SELECT shipment_id, due, expiry, least(coalesce(due, expiry), coalesce(expiry, due)) AS effective, CAST(least(coalesce(due, expiry), coalesce(expiry, due)) - as_of AS INTEGER) AS days_left
 FROM (SELECT shipment_id, as_of, CAST({sql.day(sql.first(("on_board_date", "date_of_issue")))} + lc_presentation_days AS DATE) AS due, {sql.day("lc_expiry_date")} AS expiry FROM s)"""


HELD = "h AS (SELECT shipment_id, field FROM (SELECT shipment_id, unnest(string_split(held, ',')) AS field FROM s) WHERE field <> '')"


def oracle_sql() -> dict[str, str]:
    rules, crosses = {r.id: r for r in RULES}, {r.id: r for r in CROSS_RULES}
    f, scores = sql.facts_cte(), SCORES.format(f="f")
    cross_rows = " UNION ALL ".join(f"SELECT shipment_id, '{r.id}' AS rule_id, {sql.cross_check(r)} AS status, '{r.severity}' AS severity, {r.weight!r}E0 AS weight FROM s" for r in CROSS_RULES)
    out = {name: with_query(sql.one_check(rules[i])) for name, i in SHOWN.items()}
    out |= {name: with_query(f"SELECT shipment_id, {sql.cross_check(crosses[i])} AS status FROM s") for name, i in CROSS_SHOWN.items()}
    edges = impact.edges_sql()
    return out | {
        "verdict_facts": with_query("SELECT shipment_id, rule_id, status, severity, weight, detail FROM f", f),
        "verdict_score": with_query(f"SELECT *, CASE WHEN n_critical > 0 THEN 'high' WHEN n_warning > 0 THEN 'medium' ELSE 'low' END AS risk FROM ({scores})", f),
        "verdict_range": with_query(f"SELECT shipment_id, score, score_high FROM ({scores}) WHERE n_held > 0", f),
        "severity_counts": with_query("SELECT severity, count(*) AS n, count(DISTINCT shipment_id) AS n_shipments FROM f WHERE status = 'violated' GROUP BY severity", f),
        "violation_order": with_query("SELECT shipment_id, string_agg(rule_id, ',' ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, weight DESC, rule_id) AS rule_ids, count(*) AS n FROM f WHERE status = 'violated' GROUP BY shipment_id", f),
        "rule_hits": with_query("SELECT rule_id, count(*) FILTER (status = 'violated') AS n_violated, count(*) FILTER (status = 'pass') AS n_passed, count(*) FILTER (status = 'not_evaluated') AS n_skipped, count(*) FILTER (status = 'held') AS n_held, round(coalesce(count(*) FILTER (status = 'violated')::DOUBLE / nullif(count(*) FILTER (status IN ('violated', 'pass')), 0), 0), 6) AS violated_share FROM f GROUP BY rule_id", f),
        "hold_gate": with_query(f"SELECT shipment_id, n AS n_held_fields, round(n / {N_FIELDS}.0E0, 6) AS held_share, n / {N_FIELDS}.0E0 > 0.2 AS ranged FROM (SELECT shipment_id, CAST(len(list_filter(list_distinct(string_split(held, ',')), lambda x: x <> '')) AS BIGINT) AS n FROM s)"),
        "x_verdict": with_query(cross_rows),
        "merged_verdict": with_query(SCORES.format(f="m"), f"{f}, m AS (SELECT shipment_id, rule_id, status, severity, weight FROM f UNION ALL {cross_rows})"),
        "deadline": with_query(DEADLINE),
        "checklist": with_query(report.checklist_sql()),
        "outlook": with_query(f"SELECT v.shipment_id, CASE WHEN days_left < 0 THEN 'overdue' WHEN n_critical > 0 THEN 'critical' WHEN n_warning > 0 THEN 'warning' ELSE 'clean' END AS outlook, days_left FROM ({scores}) v LEFT JOIN ({DEADLINE}) d ON v.shipment_id = d.shipment_id", f),
        "recommendations": with_query("SELECT shipment_id, rule_id, row_number() OVER (PARTITION BY shipment_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, weight DESC, rule_id) AS place FROM f WHERE status = 'violated'", f),
        "status_pivot": with_query("SELECT rule_id, severity, " + ", ".join(f"count(*) FILTER (status = '{x}') AS \"{x}\"" for x in ("pass", "violated", "not_evaluated", "held")) + " FROM f GROUP BY rule_id, severity", f),
        "impact_edges": with_query(f"SELECT e.*, coalesce(n, 0) AS n_held FROM ({edges}) e LEFT JOIN (SELECT 'bl' AS doc, field, count(*) AS n FROM h GROUP BY field) USING (doc, field)", HELD),
        "impacted_fields": with_query(f"SELECT shipment_id, e.* FROM h JOIN ({edges}) e ON e.doc = 'bl' AND e.field = h.field", HELD),
        "impact_neighbors": with_query(f"SELECT e.doc, e.field, e.to_doc, e.to_field, e.rule_id, count(*) FILTER (f.status = 'violated') AS n_violated FROM ({edges}) e JOIN f ON e.rule_id = f.rule_id GROUP BY ALL", f),
        "clean_base": with_query(report.clean_base_sql()),
    }
