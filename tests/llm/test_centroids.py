"""Clustering against plain Python: every distance of every round, in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from manifestry.llm import centroids, queries
from manifestry.llm.common import read

DATA = "/root/testdata/sf0.001"


def brute(rows, k=8, rounds=10, dims=64, scale=1024, seed=3):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(scale * x) if abs(x) < 1e6 else int(x) * scale for x in v]) for i, v in kept]
    starts = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in whole if i is not None)
    now = [v for _, v in starts[:k]]
    d = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    nearest = lambda v: min((d(v, c), j) for j, c in enumerate(now))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in whole]
        now = [[sum(col) // len(col) for col in zip(*own)] if (own := [v for (_, v), a in zip(whole, of) if a == j]) else c for j, c in enumerate(now)]
    last = [(i, *nearest(v)[::-1]) for i, v in whole]
    inertia = [sum(x for _, j, x in last if j == c) for c in range(len(now))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    long = lambda x: x if x < 2**63 else None
    return sorted(((i, j, long(x), long(inertia[j]), long(sum(inertia)), sha[j]) for i, j, x in last), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_against_every_distance(spark):
    got = queries.op11_centroid_clusters(spark, DATA)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert rows_of(got) == brute([(r.vec_id, r.embedding) for r in read(spark, DATA, "embeddings").collect()])


@pytest.fixture
def odd():
    """Four components on a coarse grid, so that distances tie; copies, bad vectors, shared and missing ids."""
    rng = random.Random(4)
    grid = lambda: [rng.choice((-1.5, -0.25, 0.0, 0.25, 2.0)) for _ in range(4)]
    good = [(i, grid()) for i in range(150)] + [(200 + i, [0.25] * 4) for i in range(80)] + [(7, grid()), (None, grid()), (None, [0.25] * 4)]
    bad = [(300, None), (301, []), (302, [1.0] * 3), (303, [1.0] * 5), (304, [1.0, None, 1.0, 1.0]), (305, [math.nan, 0.0, 0.0, 0.0]), (306, [0.0, math.inf, 0.0, 0.0])]
    return good + bad


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 9) for i, v in rows], "vec_id bigint, embedding array<double>, key string, before int").repartition(3)


@pytest.mark.parametrize("cut", [1, 4, 99])
def test_odd_vectors_and_ties(spark, odd, cut):
    got = rows_of(centroids.sort_means(frame(spark, odd), dimensions=4, cut_every=cut))
    assert got == brute(odd, dims=4) and len(got) == 233


def test_components_beyond_64_bits(spark, odd):
    rows = odd + [(410 + i, [2e30 * i, 0.0, 0.5, 0.25]) for i in range(1, 20)] + [(400, [1e30, 0.0, -1e30, 0.25]), (401, [1e30, 1.0, -1e30, 0.5]), (402, [3e5, 0.0, 0.0, 0.0]), (403, [-1e9, 1e9, 0.0, 0.0])]
    got = rows_of(centroids.sort_means(frame(spark, rows), dimensions=4, rounds=4, cut_every=2))
    assert got == brute(rows, rounds=4, dims=4) and any(r[2] is None for r in got)


def test_few_and_no_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [0.0, -2.0])]
    assert rows_of(centroids.sort_means(frame(spark, rows), dimensions=2)) == brute(rows, dims=2)
    assert centroids.sort_means(frame(spark, rows), dimensions=64).count() == 0
    assert centroids.sort_means(frame(spark, rows).where("false"), dimensions=2).count() == 0


def test_scan_stops_where_no_centroid_can_be_nearer():
    rng = np.random.default_rng(3)
    vectors, c = rng.integers(-50, 50, (500, 3)), rng.integers(-50, 50, (12, 3))
    before = rng.integers(0, 12, 500)
    number, distance = centroids.nearest(vectors, before, c, *centroids.others_by_distance(c))
    every = ((vectors[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_quantized_keeps_places():
    lists = pa.array([None, [1.0, 2.0], [], [math.nan, 1.0], [-0.0001, 0.5]], type=pa.list_(pa.float32()))
    keep, whole = centroids.quantized(lists, 2, 1024)
    assert keep.tolist() == [1, 4] and whole.tolist() == [[1024, 2048], [-1, 512]]
