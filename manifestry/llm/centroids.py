"""Centroid clustering by sort-means, in whole numbers: the same centroids on every run and every split of the rows.

A vector is kept if it has exactly the wanted number of components, none of them null, NaN or infinite; others are left
out. Components become floor(scale * x). In each round a vector looks at the centroid it was nearest to before,
then at the others by their distance from that one, and stops at the first that is strictly beyond twice its own
distance: no further one can be nearer, nor as near (which would matter for the smaller number).

Equal vectors and rows that share an id are vectors of their own; a vector without an id is clustered but is no
starting centroid, as the order of these follows from the ids; among rows that share an id the smaller vector
starts. Fewer kept vectors than centroids give as many centroids as there are; an empty table gives an empty result.
Sums and distances are exact at any size of the components (Python integers take over where 64 bits do not
suffice); a distance or inertia that no long holds is null. Further columns, of whatever name, are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, shared_dir

CENTROIDS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Rounds after which each vector's nearest centroid is written; those since then are worked out anew from it.
CUT_EVERY = 4
#: Below this size of all components, sums of squares of up to 2 ** 8 differences stay within 64 bits.
SMALL = 1 << 26
#: Vectors that are scanned at once.
ROWS = 4096
LIMB = 32
LONG = 2**63


def quantized(lists: pa.Array, dimensions: int = DIMENSIONS, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which of the lists are kept, and their components as whole numbers (int64, or Python's where these overflow)."""
    lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    right = lists.filter(pa.array(lengths == dimensions))
    flat = right.flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    finite = np.isfinite(values).all(axis=1)
    keep = np.flatnonzero(lengths == dimensions)[finite]
    values = values[finite]
    if np.abs(values).max(initial=0) * scale < SMALL:
        return keep, np.floor(values * scale).astype(np.int64)
    whole = np.empty(values.shape, dtype=object)
    for i, row in enumerate(values.tolist()):
        for j, x in enumerate(row):
            n, d = x.as_integer_ratio()
            whole[i, j] = n * scale // d
    return keep, whole


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return (d * d).sum(axis=1)


def _centroids(rows: list[list[int]]) -> np.ndarray:
    """As int64 if all are small, else as Python's integers."""
    small = all(abs(v) < SMALL for row in rows for v in row)
    return np.array(rows, dtype=np.int64 if small else object)


def others_by_distance(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the numbers of the others, nearest first, and their squared distances from it."""
    between = np.array([[int(((a - b) ** 2).sum()) for b in centroids] for a in centroids], dtype=centroids.dtype)
    order = np.array([sorted((j for j in range(len(centroids)) if j != i), key=lambda j: (between[i, j], j)) for i in range(len(centroids))], dtype=np.int64)
    return order, np.array([between[i, order[i]] for i in range(len(centroids))])


def nearest(vectors: np.ndarray, before: np.ndarray, centroids: np.ndarray, order: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number) and squared distance, scanning from the one before."""
    number, least = before.copy(), _distance(vectors, centroids[before])
    for home in np.unique(before).tolist():
        rows = np.flatnonzero(before == home)
        reach = 4 * least[rows]  # (twice the distance) squared
        for other, away in zip(order[home].tolist(), far[home].tolist()):
            live = reach >= away
            rows, reach = rows[live.astype(bool)], reach[live.astype(bool)]
            if not len(rows):
                break
            d = _distance(vectors[rows], centroids[other])
            nearer = ((d < least[rows]) | ((d == least[rows]) & (other < number[rows]))).astype(bool)
            least[rows[nearer]], number[rows[nearer]] = d[nearer], other
    return number, least


def _scanned(batch: pa.RecordBatch, dimensions: int, scale: int, rounds: list[tuple]) -> Iterator[tuple]:
    """(kept rows' places, vectors, nearest, distance) after the rounds' centroids, each scanned from the one before."""
    for start in range(0, batch.num_rows, ROWS):
        rows = batch.slice(start, ROWS)
        keep, vectors = quantized(rows["vector"], dimensions, scale)
        before = rows["before"].to_numpy(zero_copy_only=False)[keep].astype(np.int64)
        distance = np.zeros(len(keep), dtype=np.int64)
        for centroids, order, far in rounds:
            exact = vectors if centroids.dtype == vectors.dtype else vectors.astype(object)
            before, distance = nearest(exact, before, centroids.astype(exact.dtype), order, far.astype(exact.dtype))
        yield start + keep, vectors, before, distance


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    """(place, value): the total as a sum of value * 2 ** (LIMB * place); small totals are one value."""
    if abs(total) < 1 << 52:
        yield 0, total
        return
    sign, rest, place = (-1 if total < 0 else 1), abs(total), 0
    while rest:
        yield place, sign * (rest & ((1 << LIMB) - 1))
        rest, place = rest >> LIMB, place + 1


def _totals(rows) -> dict[tuple, int]:
    out: dict[tuple, int] = {}
    for r in rows:
        key = (r["cluster"], r["dimension"])
        out[key] = out.get(key, 0) + (r["value"] << (LIMB * r["place"]))
    return out


def _sums(state: DataFrame, rounds: list[tuple], dimensions: int, scale: int) -> dict[tuple, int]:
    """(cluster, dimension) -> exact sum; dimension -1 counts the vectors, -2 sums their distances.

    Each task hands on one row for each cluster and dimension, Spark sums them, and the driver gets the sums:
    as many as centroids have components, whatever the number of vectors.
    """
    schema = pa.schema([("cluster", pa.int32()), ("dimension", pa.int32()), ("place", pa.int32()), ("value", pa.int64())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, int] = {}
        for batch in batches:
            for _, vectors, number, distance in _scanned(batch, dimensions, scale, rounds):
                for c in np.unique(number).tolist():
                    own = number == c
                    for d, v in enumerate(vectors[own].sum(axis=0).tolist()):
                        totals[c, d] = totals.get((c, d), 0) + v
                    totals[c, -1] = totals.get((c, -1), 0) + int(own.sum())
                    totals[c, -2] = totals.get((c, -2), 0) + sum(distance[own].tolist())
        rows = [(c, d, place, value) for (c, d), total in totals.items() for place, value in _limbs(total)]
        yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows) if rows else ([],) * 4, schema)], schema=schema)

    summed = state.select("vector", "before").mapInArrow(partial, "cluster int, dimension int, place int, value bigint")
    return _totals(summed.groupBy("cluster", "dimension", "place").agg(F.sum("value").alias("value")).collect())


def _stepped(state: DataFrame, rounds: list[tuple], dimensions: int, scale: int) -> DataFrame:
    """key, vector and before, now the nearest after the rounds, of the kept rows."""
    key, vector = state.schema["key"].dataType.simpleString(), state.schema["vector"].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, number, _ in _scanned(batch, dimensions, scale, rounds):
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([rows["key"], rows["vector"], pa.array(number.astype(np.int32))], names=["key", "vector", "before"])

    return state.mapInArrow(step, f"key {key}, vector {vector}, before int")


def _starts(kept: DataFrame, centroids: int, dimensions: int, scale: int, seed: int) -> list[list[int]]:
    """The kept vectors with the smallest SHA-256 of ``seed:id``; of rows that share an id the smaller vector first."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")).cast("binary"), 256)
    first = kept.where(F.col("key").isNotNull()).orderBy(order, "vector").limit(centroids).select("vector").collect()
    return quantized(pa.array([r["vector"] for r in first], type=pa.list_(pa.float64())), dimensions, scale)[1].tolist()


def sort_means(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, cut_every: int = CUT_EVERY,
) -> DataFrame:
    """The key, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Rows are never shuffled: every round is one pass that hands on sums. The assignments of the last rounds are
    worked out on the way from the last one written (each ``cut_every`` rounds, to the shared folder; the one before
    it is removed), so a lost executor costs its own tasks at most ``cut_every`` rounds.
    """
    spark = table.sparkSession
    finite = F.forall(F.col("vector"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    named = table.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    state = named.where((F.size("vector") == dimensions) & finite).withColumn("before", F.lit(0))
    now = _starts(state, centroids, dimensions, scale, seed)
    pending: list[tuple] = []
    folder, written = f"{shared_dir(spark)}/sort-means-{uuid.uuid4().hex}", None
    for done in range(rounds if now else 0):
        at = _centroids(now)
        pending.append((at, *others_by_distance(at)))
        sums = _sums(state, pending, dimensions, scale)
        now = [[sums.get((c, d), 0) // n for d in range(dimensions)] if (n := sums.get((c, -1), 0)) else old for c, old in enumerate(now)]
        if len(pending) >= cut_every and done + 1 < rounds:
            path = f"{folder}/{done}"
            _stepped(state, pending, dimensions, scale).write.parquet(path)
            state, pending = spark.read.parquet(path), []
            if written:
                remove(spark, written)
            written = path
    last = pending + ([(at, *others_by_distance(at))] if (at := _centroids(now)).size else [])
    sums = _sums(state, last, dimensions, scale) if now else {}
    whole = sum(sums.get((c, -2), 0) for c in range(len(now)))
    facts = [(c, _long(sums.get((c, -2), 0)), _long(whole), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(now)]
    kind = table.schema[key].dataType.simpleString()

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kept, _, number, distance in _scanned(batch, dimensions, scale, last):
                ids = batch["key"].take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array([_long(d) for d in distance.tolist()], type=pa.int64())], names=["key", "cluster", "distance"])

    rows = state.mapInArrow(assigned, f"key {kind}, cluster int, distance bigint")
    of = F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"))
    return rows.join(of, "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _long(value: int) -> int | None:
    return value if -LONG <= value < LONG else None
