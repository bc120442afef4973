"""Rules on literal shipments: the clean pair has no violation, each change raises its own rule."""

import datetime

import pytest
from pyspark.sql import functions as F

from manifestry.operators import catalog, checks, cross, impact, verdict

CLEAN = dict(
    shipment_id=1, held="", bl_no="HG290309", shipper="GAE WOON CO., LTD.", consignee="DHHJ FRANCHISING CO., LTD.", notify_party="TRY ENERGY CO., LTD.", vessel="MSC BIANCA",
    port_of_loading="BUSAN, KOREA", port_of_discharge="TOKYO, JAPAN", description_of_goods="SAW MACHINE FOB", gross_weight="884 KG", measurement="349.64 CBM", date_of_issue="2026-06-01",
    place_of_issue="PUSAN", on_board_date="2026-06-01", total_freight="$1,741.56", incoterms="", no_of_original_bl="THREE (3)", bl_clauses="", lc_port_of_loading="PUSAN", lc_port_of_discharge="TOKYO",
    lc_consignee="DHHJ FRANCHISING CO., LTD.", lc_notify_party="TRY ENERGY CO., LTD.", lc_description_of_goods="SAW MACHINE", lc_latest_shipment_date="2026-06-30", lc_expiry_date="2026-12-31",
    lc_incoterms="FOB", lc_max_gross_weight_kg=1000.0, lc_max_measurement_cbm=400.0, lc_freight_amount=1741.56, lc_tolerance_pct=10.0, lc_presentation_days=21, lc_partial_shipment="ALLOWED",
    lc_transhipment="ALLOWED", lc_bl_consignment="", lc_documents="BILL OF LADING", as_of=datetime.date(2026, 6, 10),
    inv_invoice_no="INV-2026-0801", inv_buyer="DHHJ FRANCHISING", inv_seller="GAE WOON", inv_description_of_goods="SAW MACHINE", inv_total_amount="$12,000.00", inv_incoterms="FOB", inv_lc_no="LC-2026-101",
    pack_invoice_no="INV20260801", pack_description_of_goods="SAW MACHINE", pack_gross_weight="0.884 MT", pack_measurement="349.64 CBM", cr_lc_no="LC2026101", cr_currency_amount="USD 15,000.00", cr_incoterms="FOB",
)


def frame(spark, *changes):
    rows = [CLEAN | {"shipment_id": i} | c for i, c in enumerate(changes)]
    kinds = ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if k == 'lc_presentation_days' else 'bigint' if isinstance(v, int) else 'date' if isinstance(v, datetime.date) else 'string'}" for k, v in CLEAN.items())
    return checks.prepare(spark.createDataFrame([tuple(r[k] for k in CLEAN) for r in rows], kinds))


CHANGES = [
    ({}, set()), ({"port_of_loading": "SHANGHAI, CHINA"}, {"D003"}), ({"port_of_discharge": "HAMBURG, GERMANY"}, {"D004"}), ({"consignee": "WRONG COMPANY INC."}, {"D005B"}), ({"on_board_date": "2026-07-15"}, {"D002"}),
    ({"lc_expiry_date": "2026-01-01"}, {"D008"}), ({"gross_weight": "1500 KG"}, {"D007"}), ({"total_freight": "$5,000.00"}, {"D017"}), ({"bl_no": None}, {"D001"}), ({"bl_no": "  "}, {"D001"}),
    ({"lc_description_of_goods": "SAW MACHINE, SPARE PARTS"}, {"D006"}), ({"description_of_goods": "SAW MACHINE FOB PARTIAL SHIPMENT", "lc_partial_shipment": "PROHIBITED"}, {"D013"}), ({"description_of_goods": "SAW MACHINE FOB PARTIAL SHIPMENT"}, set()),
    ({"description_of_goods": "RUSTY SAW MACHINE FOB"}, {"D023"}), ({"description_of_goods": "WETSUIT SAW MACHINE FOB"}, set()), ({"bl_clauses": "CARGO MAY BE CARRIED ON DECK"}, set()), ({"bl_clauses": "SHIPPED ON DECK"}, {"D029"}),
    ({"date_of_issue": "2026-08-01"}, {"D019"}), ({"vessel": "INTENDED MSC BIANCA"}, {"D024"}), ({"lc_bl_consignment": "TO_ORDER"}, {"D027"}), ({"lc_documents": "INVOICE"}, {"D016"}),
]


def test_each_change_raises_its_rule(spark):
    rows = verdict.facts(frame(spark, *(c for c, _ in CHANGES))).where("status = 'violated'").collect()
    found = {i: {r.rule_id for r in rows if r.shipment_id == i} for i in range(len(CHANGES))}
    for i, (change, wanted) in enumerate(CHANGES):
        assert found[i] == wanted, change


def test_status_partition_and_scores(spark):
    facts = verdict.facts(frame(spark, {}, {"held": "consignee,bl_no"}, {"bl_no": None, "on_board_date": "60-55-2708"}))
    scores = {r.shipment_id: r for r in verdict.scores(facts).collect()}
    for r in scores.values():
        assert r.n_violated + r.n_passed + r.n_skipped + r.n_held == len(catalog.RULES)
    assert scores[0].score == 0 and scores[0].score_high == 0
    assert scores[1].n_held == 4 and scores[1].score == 0 and scores[1].score_high == 1.0
    broken = facts.where("shipment_id = 2 AND rule_id = 'D002'").first()
    assert (broken.status, broken.severity, broken.weight) == ("violated", "warning", 0.1)


def test_missing_credit_terms_are_not_evaluated(spark):
    none = {k: None for k in CLEAN if k.startswith("lc_") and k not in ("lc_tolerance_pct", "lc_presentation_days")}
    rows = verdict.facts(frame(spark, none)).where("rule_id IN ('D002', 'D003', 'D017', 'D015')").collect()
    assert {r.status for r in rows} == {"not_evaluated"}


def test_cross_documents(spark):
    changes = [({}, set()), ({"inv_buyer": "SHANGHAI EAST TRADING"}, {"X001"}), ({"pack_gross_weight": "1,240 KG"}, {"X005"}), ({"inv_total_amount": "$18,000.00"}, {"X009"}), ({"inv_lc_no": "LC-2026-999"}, {"X008"}), ({"inv_incoterms": "CIF"}, {"X010"}), ({"description_of_goods": "27 PKG MACHINERY PARTS"}, set()), ({"pack_gross_weight": None}, set())]
    rows = cross.facts(frame(spark, *(c for c, _ in changes))).where("status = 'violated'").collect()
    for i, (_, wanted) in enumerate(changes):
        assert {r.rule_id for r in rows if r.shipment_id == i} == wanted


def test_impact_is_one_step_deep(spark):
    graph = impact.edges(spark)
    near = lambda f: {(r.to_doc, r.to_field) for r in impact.impacted(graph, spark.createDataFrame([("bl", f)], "doc string, field string")).collect()}
    assert near("consignee") == {("credit", "consignee"), ("invoice", "buyer")}
    assert near("gross_weight") == {("packing", "gross_weight")}
    assert near("bl_no") == set()


def test_catalog_problems_and_fingerprint():
    assert not catalog.problems(catalog.RULES, set(checks.REGISTRY))
    wrong = (catalog.RULES[0], catalog.RULES[0], catalog.Rule("Z", "nothing", "grave", 2.0))
    assert len(catalog.problems(wrong, set(checks.REGISTRY))) == 4
    assert catalog.fingerprint(catalog.RULES) == catalog.fingerprint(catalog.RULES[::-1]) != catalog.fingerprint(catalog.RULES[1:])


def test_empty_table(spark):
    assert verdict.scores(verdict.facts(frame(spark, {}).where(F.lit(False)))).count() == 0


@pytest.mark.parametrize("cases", [[(0, 10), (5, 8), (9, 12), (12, 20), (3, 3)]])
def test_overlaps(spark, cases):
    from manifestry.operators import terms

    got = terms.resolve_overlaps(spark.createDataFrame([(1, a, b) for a, b in cases], "group bigint, start bigint, end bigint")).collect()
    assert {(r.start, r.end) for r in got} == {(0, 10), (12, 20)}


def test_what_is_asked_of_a_shipment_needs_no_exchange(spark):
    from manifestry.operators import features, outcomes

    rows = frame(spark, {}, {"bl_no": None})
    judged = verdict.judged(rows)
    for df in (verdict.row_scores(judged), verdict.ordered_violations(judged), outcomes.passed_rules(judged), outcomes.summary(judged), features.rule_pivot(judged), features.core(rows)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    by_row = {r.shipment_id: r for r in verdict.row_scores(judged).collect()}
    assert by_row == {r.shipment_id: r for r in verdict.scores(verdict.facts(rows)).collect()}


def test_rows_are_kept_by_what_is_worked_out_once(spark):
    """A filter below the catalog would evaluate all of it once more."""
    judged = verdict.judged(frame(spark, {}, {"held": "bl_no"}, {"bl_no": None}))
    ranged = verdict.kept(verdict.row_scores(judged), F.col("n_held") > 0)
    for df, wanted in ((ranged, {1}), (verdict.ordered_violations(judged), {2})):
        assert "Filter" not in df._jdf.queryExecution().optimizedPlan().toString()
        assert {r.shipment_id for r in df.collect()} == wanted


def test_impacts_do_not_meet_by_field(spark):
    """Fields are few: no exchange brings the shipments together by document and field alone."""
    from manifestry.operators import impact

    changed = spark.createDataFrame([(i, "bl", "consignee") for i in range(200)], "shipment_id int, doc string, field string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = impact.impacted(impact.edges(spark), changed)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    edges = [e for e in impact.pairs() if e[:2] == ("bl", "consignee")]
    assert out.count() == 200 * len(edges) and edges


def test_recalls_join_nothing(spark):
    """Each shipment is judged once, in its row: one join in the plan (orders and customers), no shuffle of outcomes."""
    from manifestry.plans import metric_queries

    plan = metric_queries.per_defect_recall(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    lines = [line.lstrip(" :+-") for line in plan.splitlines()]
    assert sum(line.startswith("Join ") for line in lines) == 1 and not any(line.startswith("Generate explode") for line in lines)
