"""Cleaners, pools and derived credits on literal texts; every derived credit passes the catalog on its own bill."""

import pytest
from pyspark.sql import functions as F

from manifestry.functions import cleaners
from manifestry.operators import checks, papers, pools, verdict
from manifestry.operators.catalog import RULES
from manifestry.plans import rule_queries

CASES = [
    ("bl_no", "BOOKING 123 HLCUBUS2608001 X", "HLCUBUS2608001"), ("bl_no", "DLSU12345678", None), ("bl_no", "ABCDEFGH123456789", None), ("bl_no", None, None), ("party_name", "SHIPPER\nTEL 1\nABC", None), ("party_name", "SHIPPER\nABCD\n", "ABCD"), ("party_name", "a.  B CO.", "B CO."),
    ("party_name", "TO ORDER OF SHIPPER", "TO ORDER OF SHIPPER"), ("party_name", "x" * 200 + " LTD.", "x" * 150), ("port_name", "SAY TWO\nTHREE (3)\n12 PKG\nCY/CFS  BUSAN,\nTOKYO, JAPAN", "TOKYO, JAPAN"), ("port_name", "AB\n5 KG", None), ("port_name", ", BUSAN ,", "BUSAN"),
    ("goods", "ABC12345\nABC12345 27 PKG CELL ASSEMBLY, 884 KG NET\nloose item\nLOOSE ITEM\n5 CTNS ab\nTOTAL 27\nafter", "CELL ASSEMBLY / loose item"), ("goods", "TOTAL 5", None), ("goods", " \n ", None), ("goods", "\n".join(["same beginning of thirty letters " + c for c in "abc"]), "same beginning of thirty letters a"),
    ("total_weight", "5 KG\ntotal 1,234.5kgs 3 MT\n7 KG", "1,234.5 KGS"), ("total_weight", "5 KG\nTOTAL none\n7 m.t.", "7 M.T."), ("total_weight", "HEAVY", None), ("total_volume", "1 CBM 2.5 m3", "2.5 CBM"), ("total_volume", "TOTAL 9 CU. M\n3 CBM", "9 CBM"),
    ("place_of_issue", "PUSAN, KOREA 2026-06-01 TEL 5", "PUSAN, KOREA"), ("place_of_issue", "AB", None), ("incoterms", "PRICE FOB   BUSAN\nX", "FOB BUSAN"), ("incoterms", "fob", None), ("originals", "x three  (3) y", "THREE (3)"), ("freight", "USD $ 1,741.56", "$1,741.56"), ("freight", "1,741.56", None),
    ("vessel", "M/V MSC BIANCA V.112", "MSC BIANCA"), ("voyage", "M/V MSC BIANCA V.112", "112"), ("vessel", "OCEAN VESSEL HMM-ONE", "HMM-ONE"), ("voyage", "HMM ALGECIRAS / 2608E", "2608E"), ("vessel", "V123", "V123"), ("voyage", "V123", "V123"), ("vessel", "CY/CY", None),
]


@pytest.mark.parametrize("name", sorted({c[0] for c in CASES}))
def test_cleaners(spark, name):
    rows = [(i, t) for i, (n, t, _) in enumerate(CASES) if n == name]
    got = {r.i: r.out for r in spark.createDataFrame(rows, "i int, t string").select("i", getattr(cleaners, name)(F.col("t")).alias("out")).collect()}
    assert got == {i: CASES[i][2] for i, _ in rows}


def test_fields_of_an_empty_page(spark):
    rows = spark.createDataFrame([(1, {}), (2, {"shipper": None})], "id int, regions map<string, string>")
    out = rows.select("id", *cleaners.fields(F.col("regions"))).collect()
    assert len(out[0]) == 16 and all(v is None for r in out for v in tuple(r)[1:])


def test_papers_by_hand(spark):
    tokens = [(1, i, t, x, y, x + 10 * len(t), y + h, c) for i, (t, x, y, h, c) in enumerate([("INVOICE NO", 0, 0, 10, 1.0), (": A-1 ;", 120, 5, 10, 0.5), ("A-2", 0, 30, 10, 1.0), ("SANTOS", 300, 0, 10, 1.0), ("ACME", 0, 200, 10, 1.0)])]
    frame = spark.createDataFrame(tokens, "document_id int, idx int, text string, x_min int, y_min int, x_max int, y_max int, confidence double")
    r = papers.parse(papers.pages(frame), "commercial_invoice").first()
    # a label 10 high counts as 20: the box beside it and the one below belong to it; SANTOS holds no word TO
    assert r.invoice_no.value == "SANTOS : A-1 ; A-2" and abs(r.invoice_no.confidence - (1.0 + 0.5 + 1.0) / 3 * 0.85) < 1e-12 and r.buyer is None
    assert papers.parse(papers.pages(frame.where("false")), "packing_list").count() == 0


def test_pools_keep_the_first_spelling(spark):
    rows = [(2, {"shipper": "Acme Co.", "consignee": "OTHER INC."}, "ABC12345 5 KG"), (1, {"shipper": "ACME CO.", "notify": "acme co."}, "x ABC12345 ZZ99999 1,000 KGS $5"), (3, {"cargo": "TOTAL 5\n3 BAGS  SUGAR, 50 KG\n", "vessel_info": "CY MSC Bianca V.1"}, None), (4, None, "")]
    frame = spark.createDataFrame(rows, "id int, regions map<string, string>, text string").repartition(3)
    got = {(r.kind, r.value, r.file, r.n, r.place) for r in pools.pools(frame, "id").collect()}
    assert got == {("company", "ACME CO.", 1, 3, 0), ("company", "OTHER INC.", 2, 1, 1), ("reference_code", "ABC12345", 1, 2, 0), ("reference_code", "ZZ99999", 1, 1, 1), ("goods", "SUGAR", 3, 1, 0), ("vessel", "MSC", 3, 1, 0)}
    assert sorted((r.kind, r.value) for r in pools.numbers(frame, "id").collect()) == [("amount_usd", 5.0), ("weight_kg", 5.0), ("weight_kg", 1000.0)]
    assert pools.pools(frame.where("false"), "id").count() == 0


def test_places_over_many_parts(spark):
    rows = spark.createDataFrame([(g, i * 7 % 500) for g in ("a", "b", "c") for i in range(500)], "g string, o int").repartition(6)
    got = pools.placed(rows, "g", "o").collect()
    assert len(got) == 1500 and all(r.place == r.o for r in got)


def test_a_derived_credit_passes_on_its_own_bill(spark):
    """No rule that compares the bill with the credit is violated, on all shipments; the bill is shown some days after shipment."""
    bills = rule_queries.view(spark, "/root/testdata/sf0.001")
    own = bills.drop(*(c for c in bills.columns if c.startswith(("lc_", "day_lc_"))))
    with_credit = own.join(pools.credit(bills), "shipment_id")
    shipped = F.coalesce(F.when(F.col("on_board_date").isNotNull(), F.col("day_on_board_date")).otherwise(F.col("day_date_of_issue")), F.col("as_of"))
    shown = with_credit.withColumn("as_of", F.date_add(shipped, 3)).drop(*(c for c in with_credit.columns if c.startswith("day_")))
    facts = verdict.facts(checks.prepare(shown)).where("status <> 'not_evaluated'")
    compared = {r.id for r in RULES if r.credit} - {"D026", "D008"}  # freight collect and a date of issue after the credit's end are faults of the bill itself
    # a date that can't be read is a fault of the bill, which weighs as a warning
    own_severity = F.create_map(*(F.lit(x) for r in RULES for x in (r.id, r.severity)))
    facts = facts.where((F.col("status") != "violated") | (F.col("severity") == F.element_at(own_severity, F.col("rule_id"))))
    counts = {r.rule_id: (r.bad, r.n) for r in facts.groupBy("rule_id").agg(F.count(F.when(F.col("status") == "violated", 1)).alias("bad"), F.count("*").alias("n")).collect()}
    bad = {i: counts[i] for i in compared & counts.keys() if counts[i][0]}
    assert not bad, bad
    assert {"D003", "D004", "D005B", "D006", "D007", "D010", "D017", "D018"} <= counts.keys()
