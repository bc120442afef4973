"""The feature vector, the registry of models, reports that never change and glossaries by version, on literal rows."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from manifestry.operators import gate, snapshot, verdict
from manifestry.plans import feature_queries, rule_queries
from manifestry.sources import glossaries

DATA = "/root/testdata/sf0.001"
AT = datetime.datetime(2026, 1, 2)


def test_vector_has_all_features_in_one_order(spark):
    rows = feature_queries.rows(spark, DATA).limit(40)
    assert len(snapshot.NAMES) == len(set(snapshot.NAMES)) == 74
    whole = snapshot.vectorized(rows).collect()
    named = {r.shipment_id: r for r in snapshot.features(rows).collect()}
    same = lambda a, b: a == b or (math.isnan(a) and math.isnan(b))
    for r in whole:
        assert len(r.vector) == 74 and r.fingerprint == snapshot.fingerprint()
        assert all(x is not None and same(x, named[r.shipment_id][n]) for x, n in zip(r.vector, snapshot.NAMES))
    cut = snapshot.vectorized(rows, snapshot.MODEL_ONLY).collect()
    n_rules = sum(n.startswith("rv_") for n in snapshot.NAMES)
    assert n_rules == 30 and all(all(math.isnan(x) for x in r.vector[:30]) and r.fingerprint == snapshot.fingerprint() for r in cut)
    assert snapshot.fingerprint(snapshot.NAMES[::-1]) != snapshot.fingerprint() != snapshot.fingerprint(version="fs-3")


def test_nothing_known_is_nan(spark):
    none = lambda t: F.lit(None).cast(t)
    credit = "struct<required_documents: int, conditions_47a: string, special_clause: boolean, transferable: boolean, partial_allowed: boolean, transshipment_allowed: boolean, tolerance_pct: double>"
    numbers = ("bl_qty", "packing_qty", "bl_weight", "packing_weight", "invoice_amount", "computed_amount", "counterparty_rate", "bank_rate", "cargo_rate")
    dates = ("credit_expiry", "onboard_date", "bl_issue_date", "presentation_date")
    texts = ("bl_goods", "invoice_goods", "bl_consignee", "invoice_consignee")
    extra = {c: none("double") for c in numbers} | {c: none("date") for c in dates} | {c: none("string") for c in texts} | {
        "party_pairs": F.array().cast("array<struct<a: string, b: string>>"), "conflict_fields": F.lit(0), "confidences": none("map<string, double>"), "missing_fields": F.array().cast("array<string>"), "no_evidence_fields": F.array().cast("array<string>"),
        "checked_fields": none("int"), "source": none("string"), "credit": none(credit), "presentation_days": none("int"), "counterparty_shipments": none("int"),
    }
    rows = verdict.judged(rule_queries.view(spark, DATA).limit(3), snapshot.RULE_FEATURES).withColumns(extra)
    (r, *_) = snapshot.features(rows.withColumn("semantic", none("struct<verifiable_ratio: double, unverifiable_count: bigint, goods: double, goods_invoice: double, party_min: double, conflicts: int, complexity: double>"))).collect()
    nan = {n for n in snapshot.NAMES if not n.startswith("rv_") and math.isnan(r[n])}
    assert nan == {n for n in snapshot.NAMES if n.startswith(("lc_", "tm_", "llm_")) and n not in ("lc_absent", "llm_available")} | {f"hist_{x}_defect_rate" for x in ("counterparty", "bank", "cargo_type")} | {"eq_mean_confidence", "eq_min_confidence"} | {f"dc_{x}" for x in ("max_edit_distance_ratio", "mean_edit_distance_ratio", "qty_deviation_ratio", "weight_deviation_ratio", "amount_deviation_ratio")}
    assert (r.lc_absent, r.llm_available, r.hist_is_cold_start, r.eq_no_evidence_ratio) == (1.0, 0.0, 1.0, 0.0)
    told = snapshot.semantic(rows).first().semantic
    assert (told.goods, told.party_min, told.complexity, told.verifiable_ratio, told.conflicts) == (None, None, None, None, 0)


def test_models_are_activated_and_rolled_back(spark, tmp_path):
    path = str(tmp_path / "registry")
    add = lambda v, f1: gate.register(spark, path, v, "fs-2", f"print {v}", AT, f1=f1, labels=10)
    state = lambda: {r.version: r for r in gate.models(gate.events(spark, path)).collect()}
    assert state() == {}
    add("a", 0.80)
    with pytest.raises(gate.Refused):
        add("a", 0.90)
    with pytest.raises(gate.Refused):
        gate.activate(spark, path, "z", AT)
    gate.activate(spark, path, "a", AT)
    add("b", 0.79), add("c", None), add("d", 0.85)
    for worse in ("b", "c"):
        with pytest.raises(gate.Refused):
            gate.activate(spark, path, worse, AT)
    assert [v for v, r in state().items() if r.active] == ["a"]
    gate.activate(spark, path, "d", AT)
    last = gate.roll_back(spark, path, "b", "d is wrong on ports", AT)
    now = state()
    assert [v for v, r in now.items() if r.active] == ["b"] and now["b"].rolled_back_from == "d" and now["b"].note == "d is wrong on ports" and now["a"].rolled_back_from is None
    # two that both follow the same event: the second is refused
    gate.activate(spark, path, "d", AT, after=last)
    with pytest.raises(gate.Refused):
        gate.activate(spark, path, "a", AT, after=last) if gate.may_activate(0.85, 0.85) else None
    with pytest.raises(gate.Refused):
        gate.roll_back(spark, path, "a", "late", AT, after=last)
    assert gate.may_activate(None, None) and not gate.may_activate(None, 0.1) and gate.may_activate(0.5, 0.5)
    names = {gate.version_name("fs-2", datetime.date(2026, 8, 16), x) for x in ("one", "two", "one")}
    assert len(names) == 2 and all(n.startswith("fs-2-20260816-") and len(n) == 20 for n in names)


def test_vectors_of_another_schema_are_refused(spark):
    vectors = spark.createDataFrame([(1, "x"), (2, "x")], "shipment_id int, fingerprint string")
    assert gate.same_schema(vectors, {"version": "a", "fingerprint": "x"}).count() == 2
    for other in (vectors.unionByName(spark.createDataFrame([(3, "y")], vectors.schema)), vectors.withColumn("fingerprint", F.lit(None).cast("string"))):
        with pytest.raises(gate.Refused):
            gate.same_schema(other, {"version": "a", "fingerprint": "x"})


def test_reports_never_change(spark, tmp_path):
    path = str(tmp_path / "reports")
    made = lambda *rows: spark.createDataFrame(rows, "id int, score double, lines array<string>, uri string")
    gate.write_reports(spark, path, made((1, 0.5, ["a"], None), (2, None, None, "u")), "id", "uri")
    gate.write_reports(spark, path, made((1, 0.5, ["a"], "other place"), (3, 0.1, [], "u")), "id", "uri")
    with pytest.raises(gate.Refused, match=r"1 \(score\); 2 \(score, lines\)"):
        gate.write_reports(spark, path, made((1, 0.6, ["a"], None), (2, 1.0, ["x"], "u"), (4, 0.0, [], None)), "id", "uri")
    assert sorted((r.id, r.score, r.uri) for r in spark.read.parquet(path).collect()) == [(1, 0.5, None), (2, None, "u"), (3, 0.1, "u")]


def entry(version, day, term, canonical, **more):
    row = {"tier": "standard", "class": "delivery", "form": None, "lang": "en", "authority": "a", "source": "s", "aliases": [], "country": None, "deprecated_by": None} | more
    return (version, day, row["tier"], row["class"], term, canonical, row["form"], row["lang"], row["authority"], row["source"], row["aliases"], row["country"], row["deprecated_by"])


def test_versions_of_a_glossary(spark, tmp_path):
    path, day = str(tmp_path / "glossary"), datetime.date
    first = [entry("1.0", day(2026, 1, 1), "t1", "Telex Release", aliases=["telex"])]
    second = [entry("1.10", day(2026, 3, 1), "t1", "TELEX RELEASE", aliases=["telex"]), entry("1.10", day(2026, 3, 1), "o1", "Own", tier="organisation", aliases=["TELEX"])]
    for rows in (first, second, [entry("_sample", day(2027, 1, 1), "s", "Sample")]):
        glossaries.write(spark.createDataFrame(rows, glossaries.TERMS), path)
    with pytest.raises(ValueError):
        glossaries.write(spark.createDataFrame(first, glossaries.TERMS), path)
    terms = glossaries.read(spark, path)
    assert glossaries.latest(glossaries.versions(terms)) == "1.10" and glossaries.latest(glossaries.versions(terms.where("false"))) is None
    assert {r.version for r in terms.collect()} == {"1.0", "1.10", "_sample"}  # texts, not numbers
    plan = glossaries.read(spark, path, "1.10")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(version" in plan and "(version" in plan and "= 1.10)" in plan
    rows = spark.createDataFrame([(1, day(2025, 12, 31)), (2, day(2026, 2, 28)), (3, day(2026, 3, 1)), (4, None)], "id int, day date").withColumns({"class": F.lit("delivery"), "value": F.lit("Telex")})
    got = {r.id: (r.version, r.hits and [(h.term_id, h.form) for h in r.hits]) for r in glossaries.looked_up(rows, "day", terms).collect()}
    assert got == {1: (None, None), 2: ("1.0", [("t1", "Telex Release")]), 3: ("1.10", [("o1", "Own")]), 4: (None, None)}
    assert glossaries.looked_up(rows, "day", terms.where("false")).where("hits IS NULL").count() == 4


def test_a_sound_glossary_has_no_problems(spark):
    rows = [entry("1", datetime.date(2026, 1, 1), "p1", "KRPUS", **{"class": "port"}, country="KR", aliases=["PORTLAND"]), entry("1", datetime.date(2026, 1, 1), "p2", "USPDX", **{"class": "port"}, country="US", aliases=["Portland"]), entry("1", datetime.date(2026, 1, 1), "d", "X", deprecated_by="p1")]
    frame = spark.createDataFrame(rows, glossaries.TERMS)
    assert glossaries.problems(frame, whole=False).count() == 0
    assert {r.detail for r in glossaries.problems(frame).collect()} == {"transport_doc", "practice_phrase", "price_term", "party_suffix", "qty_unit", "volume_unit", "container_no", "hs_code"}
    assert glossaries.problems(frame.where("false")).count() == 0
