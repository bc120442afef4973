"""Queries on outcomes, gates, calibration, edits and merges over the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, outcomes, verdict
from . import metric_queries, rule_queries, rules_sql as sql, term_queries
from .layout_queries import tokens
from .metric_queries import GRADED, LABELLED, graded, labelled, per_defect_recall
from .shipments import with_query
from .term_queries import table

PARTIES = ("consignee", "notify_party", "shipper", "lc_consignee", "lc_notify_party", "inv_buyer", "inv_seller")
KNOWN_TYPES = ("click", "view", "purchase")
CRITICAL_FIELDS = ("click", "purchase")
TARGET_F1 = 0.85


def judged(spark: SparkSession, d: str) -> DataFrame:
    """(shipment_id, fired, y): whether the rules flag a shipment, and a made-up true outcome."""
    return outcomes.fired(verdict.judged(rule_queries.view(spark, d))).withColumn("y", F.when(F.col("shipment_id") % 4 == 1, 0).otherwise(1))


JUDGED = "j AS (SELECT shipment_id, max(CASE WHEN status = 'violated' AND severity = 'critical' THEN 1 ELSE 0 END) AS fired, CASE WHEN shipment_id % 4 = 1 THEN 0 ELSE 1 END AS y FROM f GROUP BY shipment_id)"


def sla_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = judged(spark, d)
    return outcomes.gate(outcomes.binary_metrics(rows), outcomes.false_alarms(rows), outcomes.critical_recalls(per_defect_recall(spark, d)), TARGET_F1, least_kinds=4)


def edited(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    edit = F.when(e % 5 == 0, F.col("event_type")).when(e % 5 == 1, F.concat("event_type", F.lit("!")))
    return graded(spark, d).select("event_id", outcomes.effective_grade(F.col("event_type"), F.col("grade"), edit).alias("grade"))


def settled(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    option = lambda v, c: F.struct(F.lit(v).alias("value"), F.lit(c).alias("confidence"))
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("value"), F.lit(0.5).alias("confidence"), (e % 3 == 0).alias("conflict"), F.when(e % 3 == 0, F.array(option("BUSAN", 0.9), option("INCHEON", 0.71))).otherwise(F.array().cast("array<struct<value: string, confidence: double>>")).alias("candidates"))
    return outcomes.settle(rows, F.when(e % 4 == 0, "BUSAN").when(e % 4 == 1, "INCHEON").when(e % 4 == 2, "ULSAN"))


def divergence(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a tier other than the standard, with the first standard term that differs."""
    hits, known = term_queries._hits(spark, d), term_queries.glossary(spark, d)
    standard = known.where("tier = 'standard'").select("key", F.col("term").alias("standard_term"))
    return hits.where("tier <> 'standard'").join(standard, "key", "left").where("standard_term IS NULL OR standard_term <> term").groupBy("s_suppkey", "key", "tier", "term").agg(F.min("standard_term").alias("standard_term"))


def merged_glossary(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    base = table(spark, d, "supplier")
    old = base.where(k % 5 != 0).select(k.alias("key"), F.col("s_name").alias("canonical"), F.array(F.lower("s_name")).alias("aliases"))
    new = base.where(k % 3 == 0).select(k.alias("key"), F.upper("s_name").alias("canonical"), F.array(F.concat(F.lit(" n"), k.cast("string")), F.lit(" "), F.lit("b"), F.lit("b ")).alias("aliases"))
    return outcomes.upsert(old, new)


def reattached(spark: SparkSession, d: str) -> DataFrame:
    """Part names as documents; the value is two of the words, changed in different ways."""
    w, k = F.split("p_name", " "), F.col("p_partkey") % 4
    two = F.concat_ws(" ", F.get(w, F.lit(0)), F.get(w, F.lit(1)))
    value = F.when(k == 0, F.upper(two)).when(k == 1, F.concat(two, F.lit("s"))).when(k == 2, F.substring(two, 3, 50)).otherwise("zzzz qqqq")
    return outcomes.reattach(table(spark, d, "part").select("p_partkey", w.alias("words"), value.alias("value")), "words", "value").drop("words")


def noisy(spark: SparkSession, d: str) -> DataFrame:
    """Labels of which a seeded share of 3 % is turned."""
    at = F.conv(F.substring(F.md5(F.concat(F.lit("noise"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("long") % 1000
    return table(spark, d, "labels").select("doc_id", (at < 30).alias("turned"), F.when(at < 30, 1 - F.col("quality")).otherwise(F.col("quality")).cast("int").alias("quality"))


def corpus_rollup(spark: SparkSession, d: str) -> DataFrame:
    """One row: shipments, those with a held rule, with any violation, and that are sound as far as evaluated."""
    per = verdict.row_scores(verdict.judged(rule_queries.view(spark, d)))
    n = lambda c: F.count(F.when(c, 1))
    return per.agg(F.count("*").alias("n"), n(F.col("n_held") > 0).alias("n_with_held"), n(F.col("n_violated") > 0).alias("n_with_violation"), n((F.col("n_violated") == 0) & (F.col("n_held") == 0)).alias("n_sound"), F.round(F.avg("score"), 6).alias("mean_score"))


def model_gain(spark: SparkSession, d: str) -> DataFrame:
    """F1 of the combined verdict (rules or model) above that of the rules alone."""
    rows = labelled(spark, d)
    n = lambda c: F.count(F.when(c, 1))
    y, rule, both = F.col("quality") == 1, F.col("n_chars") > 400, (F.col("n_chars") > 400) | (F.col("p") >= 0.35)
    f1 = lambda hit: 2.0 * n(y & hit) / (n(y) + n(hit))
    return rows.agg(F.round(f1(rule), 6).alias("rules"), F.round(f1(both), 6).alias("combined"), F.round(f1(both) - f1(rule), 6).alias("gain"))


def calibrated(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d)
    a, b = outcomes.platt(rows, "quality", "p")
    return rows.select("doc_id", F.round(1 / (1 + F.exp(-(F.col("p") * a + b))), 6).alias("calibrated"))


def queries() -> dict:
    row = lambda spark, d: verdict.judged(rule_queries.view(spark, d))
    return {
        "verdict_summary": lambda spark, d: outcomes.summary(row(spark, d)),
        "passed_rules": lambda spark, d: outcomes.passed_rules(row(spark, d)),
        "false_alarms": lambda spark, d: outcomes.false_alarms(judged(spark, d)),
        "leakage": lambda spark, d: outcomes.leakage(judged(spark, d)),
        "rule_only_metrics": lambda spark, d: outcomes.binary_metrics(judged(spark, d)),
        "sla_gate": sla_gate,
        "bootstrap_f1": lambda spark, d: outcomes.bootstrap_f1(labelled(spark, d), "doc_id", F.col("quality") == 1, F.col("p") >= 0.35),
        "model_gain": model_gain,
        "calibrated": calibrated,
        "effective_grade": edited,
        "conflict_settled": settled,
        "unknown_types": lambda spark, d: table(spark, d, "events").where(~F.col("event_type").isin(*KNOWN_TYPES)).groupBy("event_type").agg(F.count("*").alias("n")),
        "tier_divergence": divergence,
        "glossary_upsert": merged_glossary,
        "same_values": lambda spark, d: outcomes.same_values(rule_queries.view(spark, d), PARTIES),
        "rendered": lambda spark, d: outcomes.render(rule_queries.view(spark, d), features.BL_FIELDS),
        "readiness": lambda spark, d: outcomes.readiness(graded(spark, d).withColumnRenamed("event_type", "field"), "user_id", CRITICAL_FIELDS),
        "bbox_union": lambda spark, d: tokens(spark, d).groupBy("document_id").agg(F.min("x_min").alias("x_min"), F.min("y_min").alias("y_min"), F.max("x_max").alias("x_max"), F.max("y_max").alias("y_max")),
        "reattach": reattached,
        "label_noise": noisy,
        "corpus_rollup": corpus_rollup,
    }


def oracle_sql() -> dict[str, str]:
    f = sql.facts_cte()
    lab = lambda q, more="": f"WITH {LABELLED}{', ' + more if more else ''} {q}"
    on = lambda q: with_query(q, f + ", " + JUDGED)
    alarms = "SELECT count(*) FILTER (y = 0) AS n_clean, count(*) FILTER (y = 0 AND fired = 1) AS n_flagged, round(coalesce(count(*) FILTER (y = 0 AND fired = 1)::DOUBLE / nullif(count(*) FILTER (y = 0), 0), 0), 6) AS rate FROM j"
    cells = "(SELECT count(*) FILTER (y = 1 AND fired = 1)::DOUBLE AS tp, count(*) FILTER (y = 0 AND fired = 1)::DOUBLE AS fp, count(*) FILTER (y = 1 AND fired = 0)::DOUBLE AS fn, count(*) FILTER (y = 0 AND fired = 0)::DOUBLE AS tn, count(*) AS n FROM j)"
    recall = "(SELECT rule_id, round(avg(fired), 4) AS recall FROM f JOIN j ON f.shipment_id = j.shipment_id WHERE status = 'violated' GROUP BY rule_id)"
    u = "(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':' || CAST(draw AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"
    steps = [round(math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)), 9) for k in range(6)]
    weight = " + ".join(f"CAST({u} >= {t!r}E0 AS INTEGER)" for t in steps)
    loose = "regexp_replace(upper(value), '[^A-Z0-9가-힣]', '', 'g')"
    unpivot = " UNION ALL ".join(f"SELECT shipment_id, '{p}' AS field, {p} AS value FROM s" for p in PARTIES)
    lines = ", ".join(f"'{c.upper().replace('_', ' ')}: ' || {sql.nv(c)}" for c in features.BL_FIELDS)
    two = "concat_ws(' ', w[1], w[2])"
    plain = lambda c: f"lower(regexp_replace(upper({c}), '[^0-9A-Z가-힣]', '', 'g'))"
    grams = metric_queries._T
    at = "CAST('0x' || substr(md5('noise' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 1000"
    hit = lambda c: f"2.0 * count(*) FILTER (quality = 1 AND {c})::DOUBLE / (count(*) FILTER (quality = 1) + count(*) FILTER ({c}))"
    rule, both = "(n_chars > 400)", "(n_chars > 400 OR p >= 0.35)"
    per = "(SELECT count(*) FILTER (status = 'held') AS h, count(*) FILTER (status = 'violated') AS v, round(least(1.0, coalesce(sum(weight) FILTER (status = 'violated'), 0.0)), 4) AS score FROM f GROUP BY shipment_id)"
    return {
        "verdict_summary": with_query("SELECT *, critical + warning + info + deferred AS total, CASE WHEN critical > 0 THEN 'critical' WHEN warning > 0 THEN 'warning' WHEN info > 0 THEN 'info' END AS worst FROM (SELECT shipment_id, " + ", ".join(f"count(*) FILTER (status = 'violated' AND severity = '{v}') AS {v}" for v in outcomes.SEVERITIES) + ", count(*) FILTER (status = 'held') AS deferred FROM f GROUP BY shipment_id)", f),
        "passed_rules": with_query("SELECT shipment_id, coalesce(string_agg(CASE WHEN status = 'pass' THEN rule_id END, ',' ORDER BY rule_id), '') AS passed FROM f GROUP BY shipment_id", f),
        "false_alarms": on(alarms),
        "leakage": on("SELECT round(corr(y, fired), 6) AS phi, round(avg(y) FILTER (fired = 0), 6) AS defects_if_silent, round(avg(1 - y) FILTER (fired = 1), 6) AS sound_if_fired, count(*) FILTER (fired = 0) AS n_silent, count(*) FILTER (fired = 1) AS n_fired, round(avg(y), 6) AS defect_rate FROM j"),
        "rule_only_metrics": on(f"SELECT round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS auc, round((fp + fn) / nullif(n, 0), 6) AS brier, n, round((tp + fn) / nullif(n, 0), 6) AS positive_rate FROM {cells}"),
        "sla_gate": on(f"SELECT *, meets_f1 AND meets_false_alarms AND meets_recall AS passes FROM (SELECT round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) >= {TARGET_F1} AS meets_f1, (SELECT rate FROM ({alarms})) <= 0.05 AS meets_false_alarms, coalesce((SELECT min(recall) >= 0.95 AND count(DISTINCT CASE WHEN rule_id IN ('D003', 'D004') THEN 'port' ELSE rule_id END) = 4 FROM {recall} WHERE rule_id IN ('D002', 'D003', 'D004', 'D005B', 'D008')), false) AS meets_recall FROM {cells})"),
        "bootstrap_f1": lab(f"SELECT round(max(f1) FILTER (draw = 0), 6) AS point, round(quantile_cont(f1, 0.025) FILTER (draw > 0), 6) AS low, round(quantile_cont(f1, 0.975) FILTER (draw > 0), 6) AS high FROM (SELECT draw, coalesce(2.0 * sum(k * y * h)::DOUBLE / nullif(sum(k * (y + h)), 0), 0.0) AS f1 FROM (SELECT draw, CAST(quality = 1 AS INTEGER) AS y, CAST(p >= 0.35 AS INTEGER) AS h, CASE WHEN draw = 0 THEN 1 ELSE {weight} END AS k FROM l, (SELECT unnest(range(0, 1001)) AS draw)) GROUP BY draw)"),
        "model_gain": lab(f"SELECT round({hit(rule)}, 6) AS rules, round({hit(both)}, 6) AS combined, round({hit(both)} - {hit(rule)}, 6) AS gain FROM l"),
        "effective_grade": f"WITH {GRADED} SELECT event_id, CASE WHEN event_id % 5 = 1 THEN 'confirmed' ELSE grade END AS grade FROM e",
        "conflict_settled": "SELECT event_id, CASE WHEN event_id % 12 = 0 THEN 'BUSAN' WHEN event_id % 12 = 9 THEN 'INCHEON' ELSE event_type END AS value, CASE WHEN event_id % 12 = 0 THEN 0.9E0 WHEN event_id % 12 = 9 THEN 0.71E0 ELSE 0.5E0 END AS confidence, event_id % 3 = 0 AND event_id % 4 >= 2 AS conflict FROM events",
        "unknown_types": "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN (" + ", ".join(f"'{t}'" for t in KNOWN_TYPES) + ") GROUP BY event_type",
        "tier_divergence": f"WITH {term_queries.GLOSSARY} SELECT s_suppkey, h.key, h.tier, h.term, min(g.term) AS standard_term FROM h LEFT JOIN (SELECT * FROM g WHERE tier = 'standard') g ON g.key = h.key WHERE h.tier <> 'standard' AND (g.term IS NULL OR g.term <> h.term) GROUP BY ALL",
        "glossary_upsert": "SELECT coalesce(o.k, n.k) AS key, CASE WHEN n.k IS NOT NULL THEN upper(n.s_name) ELSE o.s_name END AS canonical, CASE WHEN n.k IS NOT NULL THEN 'b|n' || CAST(n.k AS VARCHAR) ELSE lower(o.s_name) END AS aliases, CASE WHEN n.k IS NULL THEN 'kept' WHEN o.k IS NULL THEN 'added' ELSE 'updated' END AS change FROM (SELECT s_suppkey AS k, s_name FROM supplier WHERE s_suppkey % 5 <> 0) o FULL JOIN (SELECT s_suppkey AS k, s_name FROM supplier WHERE s_suppkey % 3 = 0) n ON o.k = n.k",
        "same_values": with_query("SELECT a.shipment_id, a.field, string_agg(b.field, ',' ORDER BY b.field) AS others FROM k a JOIN k b ON a.shipment_id = b.shipment_id AND a.key = b.key AND a.field <> b.field GROUP BY a.shipment_id, a.field", f"k AS (SELECT * FROM (SELECT shipment_id, field, {loose} AS key FROM ({unpivot})) WHERE key <> '')"),
        "rendered": with_query(f"SELECT shipment_id, concat_ws(chr(10), {lines}) AS text FROM s"),
        "readiness": f"WITH {GRADED} SELECT user_id, round(count(*) FILTER (grade <> 'undetected') / count(*)::DOUBLE, 4) AS completeness, round(count(*) FILTER (grade = 'required') / count(*)::DOUBLE, 4) AS hold_ratio, count(*) FILTER (grade = 'required' OR (grade = 'undetected' AND event_type IN ('click', 'purchase'))) = 0 AS ready FROM e GROUP BY user_id",
        "bbox_union": "SELECT l_orderkey AS document_id, CAST(min(l_partkey * 37 % 1594) AS INTEGER) AS x_min, CAST(min(l_suppkey * 61 % 30 * 75 + l_linenumber * 9) AS INTEGER) AS y_min, CAST(max(l_partkey * 37 % 1594 + 60) AS INTEGER) AS x_max, CAST(max(l_suppkey * 61 % 30 * 75 + l_linenumber * 9 + 20) AS INTEGER) AS y_max FROM lineitem GROUP BY l_orderkey",
        "reattach": f"""WITH a AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), v AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN upper({two}) WHEN 1 THEN {two} || 's' WHEN 2 THEN substr({two}, 3, 50) ELSE 'zzzz qqqq' END AS value FROM a),
 i AS (SELECT *, unnest(range(0, len(w))) AS st FROM v), n AS (SELECT *, unnest(range(1, least(len(string_split(trim(value), ' ')) + 1, len(w) - st) + 1)) AS n FROM i),
 t AS (SELECT *, {plain("array_to_string(w[st + 1 : st + n], '')")} AS x, {plain('value')} AS y FROM n),
 q AS (SELECT p_partkey, value, st, n, round(coalesce(len(list_intersect({grams('x')}, {grams('y')}))::DOUBLE / nullif(len(list_distinct(list_concat({grams('x')}, {grams('y')}))), 0), 0.0), 9) AS sim FROM t),
 b AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY sim DESC, st, n) AS r FROM q)
 SELECT p_partkey, value, CASE WHEN sim >= 0.8 THEN CAST(st AS INTEGER) END AS start, CASE WHEN sim >= 0.8 THEN CAST(st + n AS INTEGER) END AS "end", CASE WHEN sim >= 0.8 THEN sim END AS sim FROM b WHERE r = 1""",
        "label_noise": f"SELECT doc_id, {at} < 30 AS turned, CAST(CASE WHEN {at} < 30 THEN 1 - quality ELSE quality END AS INTEGER) AS quality FROM labels",
        "corpus_rollup": with_query(f"SELECT count(*) AS n, count(*) FILTER (h > 0) AS n_with_held, count(*) FILTER (v > 0) AS n_with_violation, count(*) FILTER (v = 0 AND h = 0) AS n_sound, round(avg(score), 6) AS mean_score FROM {per}", f),
    }
