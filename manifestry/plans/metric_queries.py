"""Queries on metrics, samples, evidence, features and lay-out over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import evidence, features, metrics, outcomes, verdict
from ..operators.catalog import RULES
from . import rule_queries, rules_sql as sql
from .shipments import with_query
from .term_queries import table


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Labels with their document, and a made-up probability p of quality."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), "doc_id")
    return rows.withColumn("p", F.round(F.col("n_chars") % 1000 / 1000, 3) * 0.4 + F.col("quality") * 0.3)


LABELLED = "l AS (SELECT l.*, source, lang, n_chars, round(n_chars % 1000 / 1000, 3) * 0.4 + quality * 0.3 AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def graded(spark: SparkSession, d: str) -> DataFrame:
    """Events as extracted values: confidence from the value, missing for some."""
    confidence = F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.round(F.col("value") % 100 / 100, 4))
    value = F.when(F.col("event_id") % 11 == 0, " ").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", "user_id", "event_type", s.grade(value, confidence).alias("grade"))


GRADED = "e AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 11 = 0 THEN 'undetected' WHEN event_id % 7 = 0 THEN 'confirmed' WHEN round(value % 100 / 100, 4) < 0.7 THEN 'required' WHEN round(value % 100 / 100, 4) < 0.9 THEN 'recommended' ELSE 'confirmed' END AS grade FROM events)"
GRADES = ("undetected", "required", "recommended", "confirmed")


def values(spark: SparkSession, d: str) -> DataFrame:
    """A value for each document: three of its words, changed in different ways, to be found at a span."""
    words = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    docs = table(spark, d, "documents").select("doc_id", words.alias("words")).withColumn("start", (F.col("doc_id") % 5).cast("int")).withColumn("end", (F.col("doc_id") % 5 + 3).cast("int"))
    span = evidence.span_text(F.col("words"), F.col("start"), F.col("end"))
    k = F.col("doc_id") % 8
    return docs.select(
        "doc_id", span.alias("span"), (F.size("words") >= F.col("end")).alias("exists"),
        F.when(k == 0, evidence.upper(span)).when(k == 1, F.element_at(F.split(span, " "), 1)).when(k == 2, "12.5").when(k == 3, " ").when(k == 4, F.concat(span, F.lit("s"))).otherwise(span).alias("value"),
        F.when(k == 5, "MANUAL").when(k == 6, "JSON").otherwise("OCR").alias("extractor"), (k % 2 == 0).alias("representative"), F.when(k == 4, "required").otherwise("confirmed").alias("grade"),
    ).withColumn("o", evidence.chain(F.col("value"), F.col("span"), F.col("exists"), F.col("extractor"))).select("*", "o.status", "o.derivation").drop("o")


_N = lambda c: f"regexp_replace(upper({c}), '[^0-9A-Z가-힣]', '', 'g')"
_T = lambda c: f"list_distinct(CASE WHEN {c} = '' THEN [] ELSE list_transform(range(1, length('  ' || {c} || ' ') - 1), lambda i: substr('  ' || {c} || ' ', i, 3)) END)"
_NUM = lambda c: f"TRY_CAST(replace(nullif(regexp_extract({c}, '([0-9][0-9,]*(?:\\.[0-9]+)?)', 1), ''), ',', '') AS DOUBLE)"
VALUES = f"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words, CAST(doc_id % 5 AS INTEGER) AS st, CAST(doc_id % 5 + 3 AS INTEGER) AS en FROM documents),
 w2 AS (SELECT doc_id, array_to_string(words[st + 1 : en], ' ') AS span, len(words) >= en AS "exists" FROM w),
 w3 AS (SELECT *, CASE doc_id % 8 WHEN 0 THEN upper(span) WHEN 1 THEN split_part(span, ' ', 1) WHEN 2 THEN '12.5' WHEN 3 THEN ' ' WHEN 4 THEN span || 's' ELSE span END AS value, CASE doc_id % 8 WHEN 5 THEN 'MANUAL' WHEN 6 THEN 'JSON' ELSE 'OCR' END AS extractor, doc_id % 8 % 2 = 0 AS representative, CASE WHEN doc_id % 8 = 4 THEN 'required' ELSE 'confirmed' END AS grade FROM w2),
 w4 AS (SELECT *, {_N('value')} AS v, {_N('span')} AS t FROM w3),
 w5 AS (SELECT *, CASE WHEN extractor = 'MANUAL' THEN 'EXEMPT_MANUAL' WHEN extractor = 'JSON' THEN 'EXEMPT_JSON' WHEN trim(value) = '' THEN 'EMPTY_VALUE' WHEN NOT "exists" THEN 'SPAN_NOT_FOUND' WHEN v = t THEN 'EXACT'
  WHEN NOT regexp_full_match(value, '[0-9.,]+') AND v <> '' AND contains(t, v) THEN 'SUBSTRING' WHEN regexp_full_match(value, '[0-9.,]+') AND {_NUM('value')} = {_NUM('span')} THEN 'FORMAT'
  WHEN len(list_distinct(list_concat({_T('lower(v)')}, {_T('lower(t)')}))) > 0 AND len(list_intersect({_T('lower(v)')}, {_T('lower(t)')}))::DOUBLE / len(list_distinct(list_concat({_T('lower(v)')}, {_T('lower(t)')}))) >= 0.8 THEN 'SIMILARITY' ELSE 'CONTENT_MISMATCH' END AS derivation FROM w4),
 x AS (SELECT *, CASE WHEN derivation LIKE 'EXEMPT%' THEN NULL WHEN derivation IN ('EXACT', 'SUBSTRING') THEN 'GROUNDED' WHEN derivation IN ('FORMAT', 'SIMILARITY') THEN 'DERIVED' ELSE 'UNGROUNDED' END AS status FROM w5)"""


#: Conditions of a credit: three of 20 letters between two marks, seven of 200, none, one of five letters between marks.
CLAUSES = ["A" * 6 + "; " + "B" * 6 + ";" + "C" * 5, ";".join(["D" * 200] * 7), "", " EEEEE;"]
SAMPLE = 200


def enforced(spark: SparkSession, d: str) -> DataFrame:
    """A value for each order under each mode: literal cases, whose verdicts are stated by hand in the oracle."""
    n = len(CASES)
    case = F.element_at(F.array(*(F.struct(F.lit(v).cast("string").alias("value"), F.lit(k).alias("kind"), F.lit(x).alias("extractor"), F.lit(g).alias("grade"), F.split(F.lit(w).cast("string"), " ").alias("words"), F.lit(a).cast("int").alias("start"), F.lit(b).cast("int").alias("end"), F.lit(box).alias("boxed"), F.lit(al).cast("string").alias("alias")) for v, k, x, g, w, a, b, box, al, *_ in CASES)), (F.col("o_orderkey") % n + 1).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", case.alias("c"), F.explode(F.array(*map(F.lit, MODES))).alias("mode"))
    c = lambda name: F.col(f"c.{name}")
    verdict_of = evidence.enforce(c("value"), c("kind"), c("extractor"), c("grade"), c("words"), c("start"), c("end"), c("boxed"), F.array(c("alias")), F.col("mode"))
    return rows.select("o_orderkey", "mode", verdict_of.alias("v")).select("o_orderkey", "mode", "v.*")


MODES = ["P", "E1", "E2", "E3"]
#: value, kind, extractor, grade, words, start, end, box, alias; then status, derivation, reason in E1, E2 and E3.
CASES = [
    ("Busan", "text", "OCR", "CONFIRMED", "PORT BUSAN KOREA", 1, 2, False, None, ("GROUNDED", "NONE", "COORDS_PRESENT"), ("GROUNDED", "EXACT", None), ("GROUNDED", "EXACT", None)),
    ("busan korea", "text", "OCR", "CONFIRMED", "PORT OF BUSAN, KOREA", 0, 4, False, None, ("GROUNDED", "NONE", "COORDS_PRESENT"), ("GROUNDED", "SUBSTRING", None), ("GROUNDED", "SUBSTRING", None)),
    ("12", "number", "OCR", "CONFIRMED", "TOTAL 1234 CTNS", 1, 2, False, None, ("GROUNDED", "NONE", "COORDS_PRESENT"), ("UNGROUNDED", None, "CONTENT_MISMATCH"), ("UNGROUNDED", None, "CONTENT_MISMATCH")),
    ("1234.50", "number", "OCR", "CONFIRMED", "7 PKG 1,234.5 KGS", 0, 4, False, None, ("GROUNDED", "NONE", "COORDS_PRESENT"), ("UNGROUNDED", None, "CONTENT_MISMATCH"), ("DERIVED", "FORMAT", None)),
    ("2026-08-12", "date", "OCR", "CONFIRMED", "DATE OF ISSUE 12 AUG 2026", 0, 6, False, None, ("GROUNDED", "NONE", "COORDS_PRESENT"), ("UNGROUNDED", None, "CONTENT_MISMATCH"), ("DERIVED", "FORMAT", None)),
    ("2026-08-12", "date", "OCR", "CONFIRMED", "2026-08-12 EXTRA", 0, 2, False, None, ("GROUNDED", "NONE", "COORDS_PRESENT"), ("UNGROUNDED", None, "CONTENT_MISMATCH"), ("DERIVED", "FORMAT", None)),
    ("PUSAN", "text", "OCR", "CONFIRMED", "BUSAN PORT", 0, 2, False, "Busan", ("GROUNDED", "NONE", "COORDS_PRESENT"), ("UNGROUNDED", None, "CONTENT_MISMATCH"), ("DERIVED", "GLOSSARY", None)),
    ("SHANGHAI EAST TRADINGS", "text", "OCR", "CONFIRMED", "SHANGHAI EAST TRADING", 0, 3, False, None, ("GROUNDED", "NONE", "COORDS_PRESENT"), ("UNGROUNDED", None, "CONTENT_MISMATCH"), ("DERIVED", "SIMILARITY", None)),
    ("Busan", "text", "OCR", "CONFIRMED", "ROTTERDAM", 0, 1, False, None, ("GROUNDED", "NONE", "COORDS_PRESENT"), ("UNGROUNDED", None, "CONTENT_MISMATCH"), ("UNGROUNDED", None, "CONTENT_MISMATCH")),
    ("Busan", "text", "OCR", "CONFIRMED", "BUSAN", 0, 2, False, None, ("GROUNDED", "NONE", "COORDS_PRESENT"), ("UNGROUNDED", None, "SPAN_NOT_FOUND"), ("UNGROUNDED", None, "SPAN_NOT_FOUND")),
    ("Busan", "text", "OCR", "CONFIRMED", None, None, None, False, None, ("UNGROUNDED", None, "NO_COORDS"), ("UNGROUNDED", None, "NO_TOKEN_LAYER"), ("UNGROUNDED", None, "NO_TOKEN_LAYER")),
    ("Busan", "text", "OCR", "CONFIRMED", None, None, None, True, None, ("GROUNDED", "NONE", "COORDS_PRESENT"), ("UNGROUNDED", None, "NO_TOKEN_LAYER"), ("UNGROUNDED", None, "NO_TOKEN_LAYER")),
    ("...", "text", "OCR", "CONFIRMED", "BUSAN", 0, 1, False, None, ("GROUNDED", "NONE", "COORDS_PRESENT"), ("UNGROUNDED", None, "EMPTY_VALUE"), ("UNGROUNDED", None, "EMPTY_VALUE")),
    (None, "text", "OCR", "CONFIRMED", "BUSAN", 0, 1, False, None, ("UNGROUNDED", None, "NO_VALUE"), ("UNGROUNDED", None, "NO_VALUE"), ("UNGROUNDED", None, "NO_VALUE")),
    ("typed", "text", "MANUAL", "CONFIRMED", "BUSAN", None, None, False, None, (None, None, "EXEMPT_MANUAL"), (None, None, "EXEMPT_MANUAL"), (None, None, "EXEMPT_MANUAL")),
    (None, "text", "OCR", "NOT_FOUND", "BUSAN", None, None, False, None, (None, None, "NOT_FOUND"), (None, None, "NOT_FOUND"), (None, None, "NOT_FOUND")),
]


def _enforced_sql() -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'"
    rows = []
    for i, (_, _, _, grade, *_, e1, e2, e3) in enumerate(CASES):
        for mode, (status, how, reason) in zip(MODES, ((None, None, None), e1, e2, e3)):
            rows.append(f"({i}, '{mode}', {text(status)}, {text(how)}, {text(reason)}, '{'REVIEW_REQUIRED' if status == 'UNGROUNDED' else grade}')")
    return f"SELECT o_orderkey, mode, status, derivation, reason, grade FROM orders JOIN (VALUES {', '.join(rows)}) AS c(k, mode, status, derivation, reason, grade) ON o_orderkey % {len(CASES)} = k"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def extraction_quality(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("c", F.round(F.col("value") % 100 / 100, 4))
    return e.groupBy("user_id").agg(F.round(F.avg("c"), 6).alias("mean_c"), F.min("c").alias("min_c"), *(F.count(F.when((F.col("c") >= a) & (F.col("c") < b), 1)).alias(n) for n, a, b in (("low", 0, 0.7), ("middle", 0.7, 0.9), ("high", 0.9, 2))))


def per_defect_recall(spark: SparkSession, d: str) -> DataFrame:
    """Of the shipments in which each rule is violated, the share that has a critical violation at all."""
    return outcomes.rule_recalls(outcomes.with_fired(verdict.judged(rule_queries.view(spark, d))))


def queries() -> dict:
    view = rule_queries.view

    return {
        "history_rates": lambda spark, d: metrics.history_rates(labelled(spark, d), "source", "quality"),
        "history_join": lambda spark, d: metrics.with_history(table(spark, d, "documents").select("doc_id", "source"), metrics.history_rates(labelled(spark, d), "source", "quality"), "source"),
        "confusion": lambda spark, d: metrics.confusion(labelled(spark, d), F.col("quality"), F.col("p") >= 0.35),
        "per_defect_recall": per_defect_recall,
        "phi": lambda spark, d: labelled(spark, d).agg(F.round(F.corr("quality", "toxic"), 6).alias("phi"), F.round(F.avg(F.when(F.col("toxic") == 1, F.col("quality"))), 6).alias("if_toxic"), F.round(F.avg(F.when(F.col("toxic") == 0, F.col("quality"))), 6).alias("if_clean")),
        "feature_auc": lambda spark, d: metrics.rank_auc(labelled(spark, d), "quality", "n_chars"),
        "reliability": lambda spark, d: metrics.reliability(labelled(spark, d), "quality", "p"),
        "brier": lambda spark, d: metrics.brier(labelled(spark, d), "quality", "p"),
        "best_threshold": lambda spark, d: metrics.best_threshold(labelled(spark, d), "quality", "p"),
        "stratified": lambda spark, d: metrics.stratified(labelled(spark, d), "doc_id", "lang", SAMPLE),
        "balanced": lambda spark, d: metrics.balanced(labelled(spark, d), "doc_id", "quality"),
        "group_split": lambda spark, d: metrics.group_split(table(spark, d, "documents").select("doc_id", "source"), "source"),
        "latest_by": lambda spark, d: metrics.latest(_events(spark, d), "user_id", "ts", "event_id", "event_type").select("user_id", "event_id", "event_type"),
        "line_islands": lambda spark, d: metrics.islands(_events(spark, d).select("event_id", "user_id", (F.col("event_id") * 13 % 5000).alias("y")), "user_id", "y", "event_id", 150),
        "line_text": lambda spark, d: metrics.islands(_events(spark, d).select("event_id", "user_id", "event_type", (F.col("event_id") * 13 % 5000).alias("y")), "user_id", "y", "event_id", 150).groupBy("user_id", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "event_id", "event_type"))), lambda t: t["event_type"]), " ").alias("text")),
        "grade_histogram": lambda spark, d: graded(spark, d).groupBy("event_type").agg(*(F.count(F.when(F.col("grade") == g, 1)).alias(g) for g in GRADES)),
        "grades": graded,
        "latency_percentiles": lambda spark, d: metrics.quantiles(_events(spark, d), "event_type", "value"),
        "floor_days": lambda spark, d: _events(spark, d).select("event_id", s.floor_days(F.col("ts"), F.lit("2024-01-03 12:00:00").cast("timestamp")).alias("days"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-03")).alias("calendar")),
        "span_text": lambda spark, d: values(spark, d).select("doc_id", "span", "exists"),
        "evidence_chain": lambda spark, d: values(spark, d).select("doc_id", "status", "derivation"),
        "trusted_view": lambda spark, d: evidence.trusted(values(spark, d)).select("doc_id", "derivation"),
        "review_queue": lambda spark, d: evidence.review_queue(values(spark, d)).select("doc_id", "derivation", "grade"),
        "evidence_enforced": lambda spark, d: enforced(spark, d),
        "features_core": lambda spark, d: features.core(view(spark, d)),
        "rv_pivot": lambda spark, d: features.rule_pivot(verdict.judged(view(spark, d))),
        "features_consistency": lambda spark, d: features.consistency(view(spark, d)),
        "features_complexity": lambda spark, d: features.complexity(table(spark, d, "orders"), "o_orderkey", F.element_at(F.array(*map(F.lit, CLAUSES)), (F.col("o_orderkey") % 4 + 1).cast("int"))),
        "features_time": lambda spark, d: features.time_margin(view(spark, d)),
        "features_extraction": extraction_quality,
        "upload_dedup": lambda spark, d: table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")),
    }


def oracle_sql() -> dict[str, str]:
    f = sql.facts_cte()
    lab = lambda q, more="": f"WITH {LABELLED}{', ' + more if more else ''} {q}"
    isl = "i0 AS (SELECT event_id, user_id, event_type, event_id * 13 % 5000 AS y FROM events), i1 AS (SELECT *, lag(y) OVER (PARTITION BY user_id ORDER BY y, event_id) AS b FROM i0), i AS (SELECT event_id, user_id, event_type, y, CAST(sum(CASE WHEN y - b <= 150 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY y, event_id) AS BIGINT) AS line FROM i1)"
    pivot = ", ".join(f"max(CASE WHEN rule_id = '{r.id}' THEN CASE status WHEN 'violated' THEN 1.0 WHEN 'pass' THEN 0.0 END END)::DOUBLE AS {r.id.lower()}" for r in RULES)
    wsum = "round(coalesce(sum(weight) FILTER (status = 'violated'), 0), 4) AS weight_sum"
    missing = " + ".join(f"CAST({sql.nv(c)} IS NULL AS INTEGER)" for c in features.BL_FIELDS)
    terms = " + ".join(f"CAST({sql.nv('lc_' + c)} IS NOT NULL AS INTEGER)" for c in features.CREDIT_FIELDS)
    lev = lambda a, b: f"CASE WHEN {sql.nv(a)} = {sql.nv(b)} THEN 0.0 ELSE levenshtein({sql.nv(a)}, {sql.nv(b)})::DOUBLE / greatest(length({sql.nv(a)}), length({sql.nv(b)})) END"
    known = f"list_filter([{lev('consignee', 'inv_buyer')}, {lev('shipper', 'inv_seller')}, {lev('description_of_goods', 'inv_description_of_goods')}], lambda x: x IS NOT NULL)"
    qa, qb = sql.quantity(sql.nv("gross_weight"), "KG"), sql.quantity(sql.nv("pack_gross_weight"), "KG")
    dev = f"CASE WHEN {qa} IS NULL OR {qb} IS NULL THEN NULL WHEN greatest(abs({qa}), abs({qb})) = 0 THEN 0.0 ELSE abs({qa} - {qb}) / greatest(abs({qa}), abs({qb})) END"
    shipped = sql.day(sql.first(("on_board_date", "date_of_issue")))
    place = lambda seed, key: f"CAST(('0x' || substr(md5('{seed}' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT)"
    return {
        "history_rates": lab("SELECT source, round(avg(quality), 6) AS rate, count(*) AS n FROM l GROUP BY source"),
        "history_join": lab("SELECT d.source, doc_id, rate, coalesce(n, 0) AS n FROM documents d LEFT JOIN (SELECT source, round(avg(quality), 6) AS rate, count(*) AS n FROM l GROUP BY source) r ON d.source = r.source"),
        "confusion": lab("SELECT tp, fp, tn, fn, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + tn)::DOUBLE / (tp + fp + tn + fn), 6) AS accuracy FROM (SELECT count(*) FILTER (quality = 1 AND p >= 0.35) AS tp, count(*) FILTER (quality = 0 AND p >= 0.35) AS fp, count(*) FILTER (quality = 0 AND p < 0.35) AS tn, count(*) FILTER (quality = 1 AND p < 0.35) AS fn FROM l)"),
        "per_defect_recall": with_query("SELECT rule_id, round(avg(c), 4) AS recall, count(*) AS n FROM f JOIN (SELECT shipment_id, CASE WHEN count(*) FILTER (status = 'violated' AND severity = 'critical') > 0 THEN 1.0 ELSE 0.0 END AS c FROM f GROUP BY shipment_id) q ON f.shipment_id = q.shipment_id WHERE status = 'violated' GROUP BY rule_id", f),
        "phi": lab("SELECT round(corr(quality, toxic), 6) AS phi, round(avg(quality) FILTER (toxic = 1), 6) AS if_toxic, round(avg(quality) FILTER (toxic = 0), 6) AS if_clean FROM l"),
        "feature_auc": lab("SELECT round((r - p * (p + 1) / 2.0) / (p * (t - p))::DOUBLE, 6) AS auc, CAST(p AS BIGINT) AS n_positive, t AS n FROM (SELECT CAST(sum(quality * k) AS DOUBLE) AS r, sum(quality) AS p, count(*) AS t FROM (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS k FROM l))"),
        "reliability": lab("SELECT CAST(greatest(1, ceil(p * 10)) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(quality), 6) AS rate FROM l GROUP BY 1"),
        "brier": lab("SELECT round(avg((p - quality) * (p - quality)), 6) AS brier FROM l"),
        "best_threshold": lab("SELECT round(t / 100.0, 4)::DOUBLE AS threshold, round(f1, 6) AS f1 FROM (SELECT t, round(2.0 * sum(CASE WHEN floor(p * 100) >= t THEN quality ELSE 0 END)::DOUBLE / (count(*) FILTER (floor(p * 100) >= t) + sum(quality))::DOUBLE, 9) AS f1 FROM l, (SELECT unnest(range(1, 100)) AS t) GROUP BY t) ORDER BY f1 DESC, t = 50 DESC, t LIMIT 1"),
        "stratified": lab("SELECT doc_id, lang FROM q JOIN t ON q.lang = t.of WHERE r <= CASE WHEN total <= 200 THEN n WHEN of = last THEN least(n, greatest(0, 200 - coalesce((SELECT sum(k) FROM t WHERE of <> last), 0))) ELSE least(n, k) END", "q AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('s' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM l), c AS (SELECT lang AS of, count(*) AS n FROM l GROUP BY lang), t AS (SELECT of, n, CAST(round_even(200.0::DOUBLE * n / (SELECT sum(n) FROM c), 0) AS BIGINT) AS k, (SELECT sum(n) FROM c) AS total, (SELECT max(of) FROM c) AS last FROM c WHERE of IS NOT NULL)"),
        "balanced": lab("SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('b' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM l) WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM l GROUP BY quality))"),
        "group_split": f"SELECT doc_id, source, CASE WHEN {place('g', 'source')} % 100 < 60 THEN 'train' WHEN {place('g', 'source')} % 100 < 80 THEN 'validation' ELSE 'test' END AS split FROM documents",
        "latest_by": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
        "line_islands": f"WITH {isl} SELECT event_id, user_id, y, line FROM i",
        "line_text": f"WITH {isl} SELECT user_id, line, string_agg(event_type, ' ' ORDER BY y, event_id) AS text FROM i GROUP BY user_id, line",
        "grade_histogram": f"WITH {GRADED} SELECT event_type, " + ", ".join(f"count(*) FILTER (grade = '{g}') AS {g}" for g in GRADES) + " FROM e GROUP BY event_type",
        "grades": f"WITH {GRADED} SELECT * FROM e",
        "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(list_sort(list(value))[1 + CAST(round_even(0.95::DOUBLE * (count(*) - 1), 0) AS BIGINT)], 6) AS p95, max(value) AS most, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type",
        "floor_days": "SELECT event_id, CAST(floor(epoch_us(ts) / 86400000000.0 - epoch_us(TIMESTAMP '2024-01-03 12:00:00') / 86400000000.0) AS BIGINT) AS days, CAST(CAST(ts AS DATE) - DATE '2024-01-03' AS INTEGER) AS calendar FROM events",
        "span_text": f"WITH {VALUES} SELECT doc_id, span, \"exists\" FROM x",
        "evidence_enforced": _enforced_sql(),
        "evidence_chain": f"WITH {VALUES} SELECT doc_id, status, derivation FROM x",
        "trusted_view": f"WITH {VALUES} SELECT doc_id, derivation FROM x WHERE status IS DISTINCT FROM 'UNGROUNDED'",
        "review_queue": f"WITH {VALUES} SELECT doc_id, derivation, grade FROM x WHERE representative AND (coalesce(status = 'UNGROUNDED', false) OR grade = 'required')",
        "features_core": with_query(f"SELECT a.*, missing_ratio, n_credit_terms, days_to_expiry, days_to_latest_shipment, n_held_fields FROM (SELECT shipment_id, count(*) FILTER (status = 'violated' AND severity = 'critical') AS n_critical, count(*) FILTER (status = 'violated' AND severity = 'warning') AS n_warning, {wsum}, round(count(*) FILTER (status = 'not_evaluated') / count(*)::DOUBLE, 6) AS skipped_ratio FROM f GROUP BY shipment_id) a JOIN (SELECT shipment_id, round(({missing}) / {len(features.BL_FIELDS)}::DOUBLE, 6) AS missing_ratio, CAST({terms} AS BIGINT) AS n_credit_terms, coalesce(CAST({sql.day('lc_expiry_date')} - as_of AS DOUBLE), 999.0) AS days_to_expiry, CAST({sql.day('lc_latest_shipment_date')} - {sql.day('on_board_date')} AS DOUBLE) AS days_to_latest_shipment, CAST(len(list_filter(string_split(held, ','), lambda x: x <> '')) AS BIGINT) AS n_held_fields FROM s) b ON a.shipment_id = b.shipment_id", f),
        "rv_pivot": with_query(f"SELECT shipment_id, {pivot}, {wsum} FROM f GROUP BY shipment_id", f),
        "features_consistency": with_query(f"SELECT shipment_id, round(list_max(k), 6) AS edit_max, round(list_sum(k) / nullif(len(k), 0), 6) AS edit_mean, round(dev, 6) AS weight_deviation, dev > 0.15 AS weight_mismatch FROM (SELECT shipment_id, {known} AS k, {dev} AS dev FROM s)"),
        "features_complexity": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 0.2625 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 ELSE 0.087708 END::DOUBLE AS complexity FROM orders",
        "features_time": with_query(f"SELECT shipment_id, g AS days_since_shipment, CASE WHEN g IS NULL THEN 0.0 ELSE round(greatest(0.0, 1 - g / n::DOUBLE), 6) END AS remaining_ratio, g > 21 AS over_21 FROM (SELECT shipment_id, CAST(as_of - {shipped} AS BIGINT) AS g, lc_presentation_days AS n FROM s)"),
        "features_extraction": "SELECT user_id, round(avg(c), 6) AS mean_c, min(c) AS min_c, count(*) FILTER (c < 0.7) AS low, count(*) FILTER (c >= 0.7 AND c < 0.9) AS middle, count(*) FILTER (c >= 0.9) AS high FROM (SELECT user_id, round(value % 100 / 100, 4) AS c FROM events) GROUP BY user_id",
        "upload_dedup": "SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1",
    }
