"""The whole feature vector over the shipments, what a model may say of them, and reports that never change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import gate, snapshot, verdict
from . import rules_sql as sql
from .rule_queries import view
from .shipments import with_query
from .term_queries import table

#: Further conditions of the credits, by the shipment's key.
CLAUSES = ["INVOICE MUST SHOW THE L/C NUMBER; CERTIFICATE OF ORIGIN REQUIRED", "NOTIFY APPLICANT BY FAX WITHIN 3 DAYS OF SHIPMENT;", "", "ALL DOCUMENTS TO BE STATED IN ENGLISH; CONFIRM BY EMAIL; ;ARRANGE INSURANCE"]
#: Of each clause: conditions, those that documents can show, those that they can't.
CLASSIFIED = [(2, 2, 0), (1, 0, 1), (0, None, None), (3, 1, 2)]


def rows(spark: SparkSession, d: str) -> DataFrame:
    """The shipments as ``snapshot.features`` reads them: confidences, sources, history and clauses follow from the key."""
    k = F.col("shipment_id")
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    some = lambda names, keep: F.filter(F.array(*(F.when(keep(n), F.lit(n)) for n in names)), lambda x: x.isNotNull())
    checked = ("bl_no", "shipper", "consignee", "port_of_loading", "port_of_discharge", "date_of_issue", "gross_weight")
    credit = F.struct(
        F.when(F.col("lc_documents").isNotNull(), F.size(F.split("lc_documents", ";"))).alias("required_documents"),
        F.element_at(F.array(*map(F.lit, CLAUSES)), (k % 4 + 1).cast("int")).alias("conditions_47a"), (k % 3 == 1).alias("special_clause"), (k % 5 == 1).alias("transferable"),
        (F.upper("lc_partial_shipment") == "ALLOWED").alias("partial_allowed"), (F.upper("lc_transhipment") == "ALLOWED").alias("transshipment_allowed"), F.col("lc_tolerance_pct").alias("tolerance_pct"),
    )
    made = {
        "party_pairs": F.array(pair("consignee", "inv_buyer"), pair("shipper", "inv_seller")), "bl_qty": s.parse_quantity(F.col("measurement"), "CBM"), "packing_qty": s.parse_quantity(F.col("pack_measurement"), "CBM"),
        "bl_weight": s.parse_quantity(F.col("gross_weight"), "KG"), "packing_weight": s.parse_quantity(F.col("pack_gross_weight"), "KG"), "invoice_amount": s.parse_amount(F.col("total_freight")), "computed_amount": F.col("lc_freight_amount"),
        "conflict_fields": (k % 3).cast("int"), "confidences": F.when(k % 5 != 0, F.create_map(F.lit("bl_no"), F.round(k % 37 / 37, 4), F.lit("shipper"), F.round(k % 11 / 11, 4))), "missing_fields": some(checked, lambda n: F.col(n).isNull()),
        "no_evidence_fields": F.array_repeat(F.lit("x"), (k % 3).cast("int")), "checked_fields": F.when(k % 7 != 0, F.lit(len(checked))), "source": F.element_at(F.array(*map(F.lit, ("pdf", "scan", "json", "manual", "other"))), (k % 5 + 1).cast("int")),
        "credit": F.when(k % 6 != 0, credit), "credit_expiry": F.col("day_lc_expiry_date"), "onboard_date": F.col("day_on_board_date"), "bl_issue_date": F.col("day_date_of_issue"), "presentation_date": F.col("as_of"), "presentation_days": F.when(k % 6 != 1, F.col("lc_presentation_days")),
        "counterparty_rate": k % 10 / 10, "bank_rate": F.when(k % 4 != 1, k % 7 / 7), "cargo_rate": F.lit(0.25), "counterparty_shipments": (k % 4).cast("int"), "bl_goods": F.col("description_of_goods"), "invoice_goods": F.col("inv_description_of_goods"),
        "bl_consignee": F.col("consignee"), "invoice_consignee": F.col("inv_buyer"),
    }
    told = snapshot.semantic(view(spark, d).withColumns(made)).withColumn("semantic", F.when(k % 9 != 0, F.col("semantic")))
    texts = ("bl_goods", "invoice_goods", "bl_consignee", "invoice_consignee")
    return verdict.judged(told, snapshot.RULE_FEATURES, *(c for c in (*made, "semantic") if c not in texts))


def features(spark: SparkSession, d: str) -> DataFrame:
    some = snapshot.features(rows(spark, d))
    return some.select("shipment_id", *(F.round(F.nanvl(F.col(n), F.lit(None).cast("double")), 6).alias(n.lower()) for n in snapshot.NAMES))


def said(spark: SparkSession, d: str) -> DataFrame:
    probability = F.round(1 / (1 + F.exp(-(F.size("missing_fields") - 2.0))), 6)
    return gate.gated(rows(spark, d), probability)


def immutable(spark: SparkSession, d: str) -> DataFrame:
    """Each order's report, sent again: some are new, some unchanged, some with another place of their file, some changed."""
    k = F.col("o_orderkey")
    new = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.lit("a").alias("uri"), "o_orderpriority")
    old = new.where(k % 5 != 0).withColumns({
        "o_totalprice": F.when(k % 5 == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")), "o_orderstatus": F.when(k % 10 == 1, F.lit(None)).otherwise(F.col("o_orderstatus")), "uri": F.when(k % 5 == 2, "b").otherwise(F.col("uri")),
    })
    return gate.settled(old, new, "o_orderkey", "uri").withColumn("columns", F.array_join("columns", ","))


def queries() -> dict:
    return {"snapshot_features": features, "inference_gate": said, "immutable_reports": immutable}


def _features_sql() -> str:
    n, q, num = sql.nv, sql.quantity, sql.amount
    k = "shipment_id"
    day = lambda c: sql.day(n(c))
    ratio = lambda a, b: f"CASE WHEN {n(a)} IS NULL OR {n(b)} IS NULL THEN NULL WHEN upper(trim({n(a)})) = upper(trim({n(b)})) THEN 0.0 ELSE levenshtein(upper(trim({n(a)})), upper(trim({n(b)})))::DOUBLE / greatest(length(trim({n(a)})), length(trim({n(b)}))) END"
    dev = lambda a, b: f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN greatest(abs({a}), abs({b})) = 0 THEN 0.0 ELSE abs({a} - {b}) / greatest(abs({a}), abs({b})) END"
    words = lambda c: f"list_distinct(regexp_extract_all(upper(coalesce({n(c)}, '')), '[A-Z0-9]+'))"
    alike = lambda a, b, below: f"CASE WHEN {n(a)} IS NULL AND {n(b)} IS NULL THEN NULL WHEN len({words(a)}) = 0 AND len({words(b)}) = 0 THEN 1.0 WHEN len({words(a)}) = 0 OR len({words(b)}) = 0 THEN 0.0 ELSE len(list_intersect({words(a)}, {words(b)}))::DOUBLE / {below} END"
    union = lambda a, b: f"len(list_distinct(list_concat({words(a)}, {words(b)})))"
    least = lambda a, b: f"least(len({words(a)}), len({words(b)}))"
    bl_w, pk_w, bl_q, pk_q = q(n("gross_weight"), "KG"), q(n("pack_gross_weight"), "KG"), q(n("measurement"), "CBM"), q(n("pack_measurement"), "CBM")
    inv, comp = num(n("total_freight")), "lc_freight_amount"
    checked = ("bl_no", "shipper", "consignee", "port_of_loading", "port_of_discharge", "date_of_issue", "gross_weight")
    missing = " + ".join(f"CAST({n(c)} IS NULL AS INTEGER)" for c in checked)
    lc = lambda v: f"CASE WHEN {k} % 6 <> 0 THEN ({v})::DOUBLE END"
    case4 = lambda values: f"CASE {k} % 4 " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else v}" for i, v in enumerate(values)) + " END"
    flag = lambda v: f"CASE WHEN {v} THEN 1.0 ELSE 0.0 END"
    llm = lambda v: f"CASE WHEN {k} % 9 <> 0 THEN ({v})::DOUBLE END"
    rate = lambda v: f"CASE WHEN {k} % 4 <> 0 THEN ({v})::DOUBLE END"
    c1, c2 = f"round({k} % 37 / 37::DOUBLE, 4)", f"round({k} % 11 / 11::DOUBLE, 4)"
    sure = lambda v: f"CASE WHEN {k} % 5 <> 0 THEN {v} END"
    number = lambda test: f"CASE WHEN {k} % 5 <> 0 THEN (CASE WHEN {test('c1')} THEN 1.0 ELSE 0.0 END) + (CASE WHEN {test('c2')} THEN 1.0 ELSE 0.0 END) ELSE 0.0 END"
    low = lambda v: f"CASE WHEN {v} < 0.5 THEN 1 ELSE 0 END"
    far = lambda v: f"CASE WHEN {v} > 0.10 THEN 1 ELSE 0 END"
    rules = [r.id for r in snapshot.RULE_FEATURES]
    pivot = ", ".join(f"max(CASE WHEN rule_id = '{i}' THEN CASE status WHEN 'violated' THEN 1.0 WHEN 'pass' THEN 0.0 END END) AS rv_{i.lower()}" for i in rules)
    fields = "CASE rule_id " + " ".join(f"WHEN '{r.id}' THEN {sql.lst(r.fields)}" for r in snapshot.RULE_FEATURES if r.fields) + " ELSE [] END"
    bad = "status = 'violated'"
    skip = "status IN ('not_evaluated', 'held')"
    agg = (
        f"count(*) FILTER ({bad} AND severity = 'critical')::DOUBLE AS rv_critical_count, count(*) FILTER ({bad} AND severity = 'warning')::DOUBLE AS rv_warning_count, count(*) FILTER ({bad} AND severity = 'info')::DOUBLE AS rv_info_count, "
        f"coalesce(sum(CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END) FILTER ({bad}), 0)::DOUBLE AS rv_severity_weighted_sum, round(coalesce(sum(weight) FILTER ({bad}), 0), 6) AS rv_weight_sum, "
        f"len(list_distinct(coalesce(flatten(list({fields}) FILTER ({bad})), [])))::DOUBLE AS rv_distinct_field_count, CASE WHEN count(*) FILTER ({bad} AND severity = 'critical') > 0 THEN 1.0 ELSE 0.0 END AS rv_any_critical, "
        f"count(*) FILTER ({skip})::DOUBLE AS rv_skipped_count, count(*) FILTER ({skip} AND severity = 'critical')::DOUBLE AS rv_skipped_critical_count"
    )
    columns = {
        "dc_max_edit_distance_ratio": "list_max(ratios)", "dc_mean_edit_distance_ratio": "list_sum(ratios) / nullif(len(ratios), 0)", "dc_qty_deviation_ratio": "dq", "dc_weight_deviation_ratio": "dw", "dc_amount_deviation_ratio": "da",
        "dc_conflict_field_count": f"({k} % 3)::DOUBLE", "dc_party_name_mismatch_count": "len(list_filter(ratios, lambda r: r > 0.15))::DOUBLE", "eq_mean_confidence": sure("(c1 + c2) / 2"), "eq_min_confidence": sure("least(c1, c2)"),
        "eq_required_check_count": number(lambda c: f"{c} < 0.7"), "eq_recommend_check_count": number(lambda c: f"{c} >= 0.7 AND {c} < 0.9"), "eq_missing_field_count": "missing::DOUBLE", "eq_no_evidence_ratio": f"({k} % 3) / 7::DOUBLE",
        **{f"eq_src_{name}": flag(f"{k} % 5 = {i}") for i, name in enumerate(snapshot.SOURCES)},
        "lc_required_doc_count": lc("len(string_split(nullif(trim(lc_documents), ''), ';'))"), "lc_47a_char_length": lc(case4([len(c) for c in CLAUSES])), "lc_47a_condition_count": lc(case4([c[0] for c in CLASSIFIED])), "lc_has_special_clause": lc(flag(f"{k} % 3 = 1")),
        "lc_is_transferable": lc(flag(f"{k} % 5 = 1")), "lc_partial_shipment_allowed": lc(flag("upper(lc_partial_shipment) = 'ALLOWED'")), "lc_transshipment_allowed": lc(flag("upper(lc_transhipment) = 'ALLOWED'")), "lc_amount_tolerance_pct": lc("lc_tolerance_pct"),
        "lc_absent": flag(f"{k} % 6 = 0"), "tm_days_to_expiry": "(expiry - onboard)::DOUBLE", "tm_days_onboard_to_presentation": "(as_of - onboard)::DOUBLE",
        "tm_presentation_period_remaining_ratio": f"CASE WHEN {k} % 6 <> 1 THEN (lc_presentation_days - (as_of - onboard)) / lc_presentation_days::DOUBLE END", "tm_days_issue_to_onboard": "(onboard - issued)::DOUBLE",
        "tm_is_over_21d": "CASE WHEN as_of - onboard > 21 THEN 1.0 WHEN as_of - onboard <= 21 THEN 0.0 END", "hist_counterparty_defect_rate": rate(f"{k} % 10 / 10::DOUBLE"), "hist_bank_defect_rate": rate(f"CASE WHEN {k} % 4 <> 1 THEN {k} % 7 / 7::DOUBLE END"),
        "hist_cargo_type_defect_rate": rate("0.25"), "hist_counterparty_shipment_count": f"({k} % 4)::DOUBLE", "hist_is_cold_start": flag(f"{k} % 4 = 0"),
        "llm_47a_verifiable_ratio": llm(f"CASE WHEN {k} % 6 <> 0 THEN {case4([None if c[1] is None else c[1] / c[0] for c in CLASSIFIED])} END"), "llm_47a_unverifiable_count": llm(f"CASE WHEN {k} % 6 <> 0 THEN {case4([c[2] for c in CLASSIFIED])} END"),
        "llm_goods_semantic_equiv": llm("goods"), "llm_goods_invoice_semantic_equiv": llm("share"), "llm_party_semantic_equiv_min": llm("party"),
        "llm_doc_conflict_count": llm(" + ".join([low("goods"), low("party"), far("dq"), far("dw"), far("da")])), "llm_lc_complexity_score": llm(f"CASE WHEN {k} % 6 <> 0 THEN {case4([0.5 * min(c[0] / 6, 1) + 0.5 * min(len(t) / 800, 1) for c, t in zip(CLASSIFIED, CLAUSES)])} END"),
        "llm_available": flag(f"{k} % 9 <> 0"),
    }
    base = f"""x AS (SELECT *, list_filter([{ratio('consignee', 'inv_buyer')}, {ratio('shipper', 'inv_seller')}], lambda r: r IS NOT NULL) AS ratios, {dev(bl_q, pk_q)} AS dq, {dev(bl_w, pk_w)} AS dw, {dev(inv, comp)} AS da, {c1} AS c1, {c2} AS c2, {missing} AS missing,
 {day('lc_expiry_date')} AS expiry, {day('on_board_date')} AS onboard, {day('date_of_issue')} AS issued, {alike('description_of_goods', 'inv_description_of_goods', union('description_of_goods', 'inv_description_of_goods'))} AS goods,
 {alike('description_of_goods', 'inv_description_of_goods', least('description_of_goods', 'inv_description_of_goods'))} AS share, {alike('consignee', 'inv_buyer', union('consignee', 'inv_buyer'))} AS party FROM s),
 r AS (SELECT shipment_id, {pivot}, {agg} FROM f WHERE rule_id IN ({', '.join(f"'{i}'" for i in rules)}) GROUP BY shipment_id)"""
    names = ", ".join(f"round(CAST({v} AS DOUBLE), 6) AS {c.lower()}" for c, v in columns.items())
    ruled = ", ".join(f"CAST(r.{c} AS DOUBLE) AS {c}" for c in (x.lower() for x in snapshot.NAMES) if c.startswith("rv_"))
    return with_query(f"SELECT r.shipment_id, {ruled}, {names} FROM x JOIN r USING (shipment_id)", sql.facts_cte() + ", " + base)


def oracle_sql() -> dict[str, str]:
    checked = ("bl_no", "shipper", "consignee", "port_of_loading", "port_of_discharge", "date_of_issue", "gross_weight")
    missing = "(" + " + ".join(f"CAST({sql.nv(c)} IS NULL AS INTEGER)" for c in checked) + ")"
    return {
        "snapshot_features": _features_sql(),
        "inference_gate": with_query(f"SELECT shipment_id, round(1 / (1 + exp(-({missing} - 2.0::DOUBLE))), 6) AS probability, CAST({missing} + shipment_id % 3 AS BIGINT) AS open_fields, ({missing} + shipment_id % 3) / (CASE WHEN shipment_id % 7 <> 0 THEN 7 ELSE 1 END)::DOUBLE > 0.20 AS range_only, shipment_id % 6 = 0 AS credit_absent FROM s"),
        "immutable_reports": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'refused' ELSE 'kept' END AS change, CASE WHEN o_orderkey % 10 = 1 THEN 'o_totalprice,o_orderstatus' WHEN o_orderkey % 5 = 1 THEN 'o_totalprice' ELSE '' END AS columns FROM orders",
    }
