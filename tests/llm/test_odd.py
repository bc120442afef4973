"""Stages of the pipeline on odd rows, and models against plain Python."""

import corpus_pipeline as cp
import numpy as np
import pytest
from pyspark.sql import functions as F

from manifestry.llm import pairwise, quality_rules
from test_ops import DATA, TEXTS

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ("row", "kept_id", "mixed_id", "mixed_row", "mixed_n", "found_values", "fp", "component", "key", "size", "rows")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, ("en", None)[i % 2], ("s1", None, "s2")[i % 3], 1) for i, t in enumerate(TEXTS)] + [(None, None, None, None, None), (3, "One", "en", "s1", 1), (3, "Another text", "en", "s1", 1)]
    return spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit(i) for i, c in enumerate(CLASH)}).repartition(3)


@pytest.mark.parametrize(("name", "stage"), cp.STAGES)
def test_stage_on_odd_rows(spark, odd, name, stage):
    out, none = stage(spark, odd, DATA), stage(spark, odd.where("false"), DATA)
    rows = out.collect()
    assert none.count() == 0 and none.columns == out.columns
    if name == "tokens":
        assert len(rows) == odd.count() and {r.n_tokens for r in rows if r.doc_id in (0, 1)} == {0}
        return
    assert out.columns == odd.columns
    assert all(tuple(r[c] for c in CLASH) == tuple(range(len(CLASH))) for r in rows)
    ids = [r.doc_id for r in rows]
    if name == "quality":  # no labels of both kinds among them
        assert len(ids) == odd.count()
    if name == "near_duplicates":
        assert ids.count(None) == 1 and sum(i in (0, 1, 2) for i in ids) == 1 and {r.text for r in rows if r.doc_id == 3} == {"One", "Another text"} and 11 not in ids
    if name == "personal_data":
        assert len(ids) == odd.count() and all(r.text is None for r in rows if r.doc_id in (0, None))


def test_op1_scores_are_a_walk_of_the_trees():
    rng = np.random.default_rng(5)
    x = rng.random((500, 15)).round(2)
    y = ((x[:, 0] + x[:, 4] > 1) ^ (rng.random(500) < 0.1)).astype(float)
    model = quality_rules.fit_trees(x, y)
    assert len(model.roots) > 10

    def walk(node, row):
        while model.left[node] != node:
            node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
        return model.value[node]

    for row, p in zip(x[:60], model.probability(x[:60])):
        assert abs(p - 1 / (1 + np.exp(-(model.bias + sum(walk(r, row) for r in model.roots))))) < 1e-12


def test_op5_fit_is_the_minimum():
    """The gradient of the ridged loss over the drawn pairs vanishes, by sums written out for each pair."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 15))
    y = (x[:, 1] > 0.2).astype(float)
    model = pairwise.fit_pairs(x, y, max_pairs=400, bins=3)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    draw = np.random.default_rng(7)
    n = min(400, 20 * max(len(good), len(bad)))
    first, second = draw.choice(good, n), draw.choice(bad, n)
    gradient = model.weights.copy()
    for a, b in zip(first, second):
        d = (model.design(x[a : a + 1]) - model.design(x[b : b + 1]))[0]
        gradient -= d * (1 - 1 / (1 + np.exp(-float(d @ model.weights))))
    assert np.abs(gradient).max() < 1e-2
    s = model.score(x)
    assert (s >= 0.3).sum() == len(good)  # the quantile: as many are cut off as have label 0
