"""Outcome operators on literal rows: calibration, reattachment, merges, odd input."""

import math

import numpy as np
from pyspark.sql import functions as F

from manifestry.operators import outcomes


def test_platt_is_the_maximum(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, 400)
    y = (rng.uniform(0, 1, 400) < 1 / (1 + np.exp(-(6 * x - 3)))).astype(int)
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "p double, y int")
    a, b = outcomes.platt(rows, "y", "p")
    p = 1 / (1 + np.exp(-(a * x + b)))
    assert abs(((p - y) * x).sum() + a) < 1e-6 and abs((p - y).sum()) < 1e-6  # both gradients of the ridged loss vanish
    assert outcomes.platt(rows.where("p > 2"), "y", "p") == (0.0, 0.0)


def test_reattach_odd_rows(spark):
    rows = [(1, ["Port", "of", "Bu-san", "Korea"], "BUSAN KOREA"), (2, [], "x"), (3, None, "x"), (4, ["a"], None), (5, ["a", "a"], "a"), (6, ["q"] * 2000 + ["needle"], "needles")]
    got = {r.k: (r.start, r.end) for r in outcomes.reattach(spark.createDataFrame(rows, "k int, words array<string>, value string"), "words", "value", theta=0.6).collect()}
    assert got == {1: (2, 4), 2: (None, None), 3: (None, None), 4: (None, None), 5: (0, 1), 6: (2000, 2001)}


def test_gate_without_recalls_is_shut(spark):
    one = spark.createDataFrame([(0.9, 0.01)], "f1 double, rate double")
    none = spark.createDataFrame([], "rule_id string, recall double")
    row = outcomes.gate(one.select("f1"), one.select("rate"), none, 0.85).first()
    assert row.meets_f1 and row.meets_false_alarms and not row.meets_recall and not row.passes


def test_a_choice_that_is_no_candidate_changes_nothing(spark):
    kind = "k int, value string, confidence double, conflict boolean, candidates array<struct<value: string, confidence: double>>"
    rows = spark.createDataFrame([(1, "a", 0.5, True, [("b", 0.9)]), (2, "a", 0.5, True, []), (3, None, None, False, None)], kind)
    got = {r.k: (r.value, r.conflict) for r in outcomes.settle(rows, F.when(F.col("k") == 1, "b").otherwise("c")).collect()}
    assert got == {1: ("b", False), 2: ("a", True), 3: (None, False)}


def test_bootstrap_interval_holds_the_point(spark):
    rows = spark.range(500).select("id", (F.col("id") % 3 == 0).alias("y"), (F.col("id") % 4 == 0).alias("hit"))
    r = outcomes.bootstrap_f1(rows, "id", F.col("y"), F.col("hit")).first()
    assert r.low < r.point < r.high and math.isclose(r.point, 2 * 42 / (167 + 125), abs_tol=1e-6)
