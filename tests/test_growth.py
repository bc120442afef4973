"""What is asked of a row stays in its row: plans without the shuffles that grew faster than the tables."""

from pyspark.sql import functions as F
from test_rules import frame

from manifestry.operators import anchors, impact, records, snapshot, verdict
from manifestry.plans import catalog

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_same_values_are_found_in_the_row(spark):
    p = plan(catalog.queries()["same_values"](spark, DATA))
    assert "Aggregate" not in p and p.count("Join") <= 4  # the orders' customers alone are joined
    assert "hashpartitioning(shipment_id" not in p


def test_anchors_are_looked_up_in_the_row(spark):
    p = plan(catalog.queries()["anchor_fields"](spark, DATA))
    assert "Aggregate" not in p and "Generate" not in p


def test_boxes_in_a_row_are_the_boxes_of_its_tokens(spark):
    rows = [(2, "Notify Party", 0, 0, 120, 20), (0, "Port of Loading / POL", 0, 50, 150, 70), (1, "POL", 0, 90, 30, 110), (3, "BUSAN", 40, 90, 90, 110), (4, None, 0, 0, 1, 1)]
    tokens = spark.createDataFrame(rows, "idx int, text string, x_min int, y_min int, x_max int, y_max int").withColumn("document_id", F.lit(1))
    both = anchors.pages(tokens), tokens.groupBy("document_id").agg(F.collect_list(F.struct(*anchors.BOX)).alias("b")).select("document_id", anchors.page(F.col("b")).alias("boxes"))
    assert both[0].collect() == both[1].collect()
    boxes, stops = F.col("boxes"), anchors.stop_labels()
    of = lambda labels: anchors.located(boxes, labels)["idx"]
    # the first label counts before the first box; a box that is the label before one that holds it
    r = both[0].select(of(["POL"]).alias("whole"), of(["LOADING", "POL"]).alias("part"), of(["VESSEL"]).alias("none"), anchors.found(boxes, ["POL"], stops).alias("value")).first()
    assert tuple(r) == (1, 0, None, "BUSAN")


def test_articles_add_up_counted_rules(spark):
    rows = spark.createDataFrame([("A - x", 1, 3), ("A - y", 0, 2), ("", 2, 7)], "source string, rank int, n bigint")
    assert [tuple(r) for r in records.by_article(rows).orderBy("place").collect()] == [("A", 5, 0, 1), ("(none)", 7, 2, 2)]


def test_edit_distances_are_worked_out_once(spark):
    names = ("bl_qty", "packing_qty", "bl_weight", "packing_weight", "invoice_amount", "computed_amount")
    pairs = "array(named_struct('a', concat('AB', id), 'b', concat('AC', id)), named_struct('a', 'X', 'b', IF(id >= 0, NULL, 'X'))) AS party_pairs"
    rows = spark.range(2).selectExpr("id AS shipment_id", pairs, "id AS conflict_fields", *(f"double(id) AS {n}" for n in names))
    df = snapshot.features(rows, ("DOC_CONSISTENCY",))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("levenshtein(") == 1
    r = df.orderBy("shipment_id").first()
    assert (round(r.dc_max_edit_distance_ratio, 6), round(r.dc_mean_edit_distance_ratio, 6), r.dc_party_name_mismatch_count) == (0.333333, 0.333333, 1.0)


def test_a_filter_on_facts_is_planned_at_once(spark):
    """Facts become rows without an array; what is known of the catalog's columns ends there, so that a filter costs no memory to plan."""
    facts = verdict.facts(frame(spark, {}, {"bl_no": None}))
    p = plan(facts.where("status = 'violated'"))
    assert "Generate" not in p and "Expand" in p and len(p) < 500_000
    assert [tuple(r) for r in facts.where("status = 'violated'").collect()] == [(1, "D001", "violated", "critical", 0.3, None)]


def test_hits_are_counted_at_their_places(spark):
    rows = frame(spark, {}, {"bl_no": None}, {"held": "bl_no"})
    hits = verdict.rule_hits(verdict.judged(rows))
    p = plan(hits)
    assert "hashpartitioning" not in p and "explode" not in p
    assert {tuple(r) for r in hits.collect() if r.rule_id in ("D001", "D016")} == {("D001", 1, 1, 0, 1, 0.5), ("D016", 0, 3, 0, 0, 0.0)}
    assert verdict.rule_hits(verdict.judged(rows.where("false"))).count() == 0


def test_edges_are_read_off_the_counts(spark):
    rows = verdict.judged(frame(spark, {}, {"port_of_loading": "SHANGHAI, CHINA"}))
    near = impact.exposed(rows)
    p = plan(near)
    assert "Join" not in p and "hashpartitioning" not in p
    got = {tuple(r) for r in near.collect()}
    assert {e[:5] for e in got} == {e for e in impact.pairs() if e[4].startswith("D")}
    assert {e for e in got if e[5]} == {("bl", "port_of_loading", "credit", "port_of_loading", "D003", 1), ("credit", "port_of_loading", "bl", "port_of_loading", "D003", 1)}
    assert impact.exposed(rows.where("false")).count() == 0


def test_violations_are_put_in_order_within_the_row(spark):
    rows = verdict.judged(frame(spark, {}, {"bl_no": None, "vessel": None, "on_board_date": "60-55-2708", "lc_documents": "INVOICE"}))
    found = verdict.places_of_violations(rows)
    p = plan(found)
    assert "Window" not in p and "Exchange" not in p
    # ids part equal weights; a date that can't be read weighs as a warning
    assert [tuple(r) for r in found.orderBy("place").collect()] == [(1, "D001", 1), (1, "D011", 2), (1, "D002", 3), (1, "D018", 4), (1, "D016", 5)]


def test_severities_are_counted_in_the_row(spark):
    counts = verdict.severity_counts(verdict.judged(frame(spark, {}, {"bl_no": None, "vessel": None}, {"bl_no": None, "lc_documents": "INVOICE"})))
    p = plan(counts)
    assert "hashpartitioning" not in p and "Filter" not in p
    assert {tuple(r) for r in counts.collect()} == {("critical", 3, 2), ("info", 1, 1)}
