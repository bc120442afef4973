"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length.  A source whose target is above its size takes every
document once; the remaining budget (below the size) is met by choosing a number of documents of each length:
the proportional share first, then bounded knapsack over what is left.  Which documents of a length are taken
follows a seeded hash of their ids, of equal ids of the whole row.  A null text or id is a document like any
other (size 0; its own hash); repeated rows, and rows that share an id, are documents of their own with their own
decision; of rows equal in every column it does not matter which is taken; further columns, of whatever name, only
enter that hash; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, fresh, map_batches, row_hash

WEIGHTS = (3, 1, 2)
SHARE, MOST_REPEATS, SEED = 1.5, 2, 17
#: Words up to which a budget that the proportional share missed is met anew (64 MB for the steps); below it the nearest sum is found.
MOST_WINDOW = 1 << 24
#: Parts of the hash range into which the documents of one source and length are dealt.
PARTS = 1024


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, row (a hash of the whole row), size (words) and order (a seeded hash) of every document."""
    kind, key = docs.schema["doc_id"].dataType.simpleString(), docs.schema["source"].dataType.simpleString()
    counted = map_batches(
        docs.select("doc_id", "source", row_hash(docs).alias("row"), F.col("text").cast("binary").alias("raw")),
        f"doc_id {kind}, source {key}, row bigint, size bigint",
        lambda b: [b["doc_id"], b["source"], b["row"], [len(raw.split()) if raw else 0 for raw in b["raw"].to_pylist()]],
    )
    return counted.withColumn("order", F.xxhash64(F.lit(SEED), "doc_id"))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """source, source_size, target: weighted shares of ``share`` times all words, none above ``most`` times its source.

    One row for each source takes part, and they never meet in one task: their places by code point follow from
    a range partitioning and the number of rows before each part, and the level to which the sources are filled
    from sums over all, anew while sources reach their limit (each time at least one, mostly nearly all at once).
    """
    per = sized.groupBy("source").agg(F.sum("size").cast("double").alias("source_size"))
    ordered = checkpoint(per.orderBy(F.col("source").cast("binary").asc_nulls_last()).withColumn("of", F.spark_partition_id()))
    before, n = [], 0
    for r in ordered.groupBy("of").agg(F.count("*").alias("n")).orderBy("of").collect():  # a row for each partition
        before.append((r["of"], n))
        n += r["n"]
    offsets = F.broadcast(sized.sparkSession.createDataFrame(before, "of int, offset bigint"))
    own = F.row_number().over(Window.partitionBy("of").orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    placed = ordered.join(offsets, "of").withColumn("place", own + F.col("offset")).withColumn("w", w).withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    placed = checkpoint(placed.select("source", "source_size", "w", "limit"))
    every = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0.0)).alias("size"), F.coalesce(F.sum("limit"), F.lit(0.0)).alias("limit")).first()
    budget, level, full = min(share * every["size"], every["limit"]), -1.0, F.lit(False)
    while True:
        rest = placed.agg(F.coalesce(F.sum(F.when(full, F.col("limit"))), F.lit(0.0)).alias("limit"), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0)).alias("w")).first()
        new = (budget - rest["limit"]) / rest["w"] if rest["w"] else level
        if new <= level:
            break
        level = new
        full = F.col("limit") <= F.col("w") * F.lit(level)
    return placed.select("source", F.col("source_size").cast("long").alias("source_size"), F.when(full, F.col("limit")).otherwise(F.col("w") * F.lit(level)).alias("target"))


def choose_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that their total comes nearest to the budget from below.

    The proportional share, rounded down, keeps the mix of lengths; the rest (less than one of each length) is
    cut by whole documents from the longest down, and the last part, below the longest length, is met by
    bounded knapsack.  Where that misses the budget by as much as the lengths' common divisor, documents are given
    back, twice as many of each length every time, and the larger rest is met anew: until it is met, or all are
    given back, and the sum is the nearest of all.  Only beyond MOST_WINDOW words does the search end
    before: there a gap may stay that giving back that many words did not close.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    share = np.floor(counts * (budget / total)).astype(np.int64) if total else np.zeros_like(counts)
    rest = budget - int((lengths * share).sum())
    longest = int(lengths.max(initial=0))
    for i in np.argsort(-lengths, kind="stable"):
        if rest > 2 * longest and lengths[i] > 0:
            more = min(int(counts[i] - share[i]), (rest - 2 * longest) // int(lengths[i]))
            share[i] += more
            rest -= more * int(lengths[i])
    unit = int(np.gcd.reduce(lengths[counts > 0])) if total else 0
    back, best, least = 0, share, rest + 1
    while unit and least >= unit:
        base = np.maximum(share - back, 0)
        window = budget - int((lengths * base).sum())
        if back and window > MOST_WINDOW:
            break
        take = base + _knapsack(lengths, counts - base, window)
        if (gap := budget - int((lengths * take).sum())) < least:
            best, least = take, gap
        if not base.any():
            break
        back = 2 * back or 1
    return best


def _knapsack(lengths: np.ndarray, counts: np.ndarray, rest: int) -> np.ndarray:
    """Bounded knapsack: how many of each length come nearest to ``rest`` from below, by a bit set of the reachable
    sums and, for each of them, the step (1, 2, 4, ... copies of a length) that reached it first."""
    take = np.zeros_like(counts)
    mask, reach, steps = (1 << (rest + 1)) - 1, 1, []
    first = np.full(rest + 1, -1, dtype=np.int32)
    for i in np.argsort(-lengths, kind="stable"):
        if reach >> rest & 1:
            break
        left, part = (min(int(counts[i]), rest // int(lengths[i])) if lengths[i] > 0 else 0), 1
        while left > 0:
            piece = min(part, left)
            new = (reach << (piece * int(lengths[i])) & mask) & ~reach
            first[_bits(new)] = len(steps)
            steps.append((i, piece))
            reach |= new
            left, part = left - piece, part * 2
    at = reach.bit_length() - 1
    while at > 0:  # what is left was reached by an earlier step, so no step is taken twice
        i, piece = steps[first[at]]
        take[i] += piece
        at -= piece * int(lengths[i])
    return take


def _bits(of: int) -> np.ndarray:
    """Places of the bits that are set; only the words that hold some are taken apart."""
    words = np.frombuffer(of.to_bytes(-(-of.bit_length() // 64) * 8, "little"), dtype="<u8")
    some = np.flatnonzero(words)
    at, bit = np.nonzero(np.unpackbits(words[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return some[at] * 64 + bit


def _choose(group: pd.DataFrame) -> pd.DataFrame:
    """One source: its lengths and their counts, at most as many rows as the square root of twice its words."""
    size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
    whole = int(target // size) if size else 0
    rest = int(round(target - whole * size)) if size else 0
    take = choose_counts(group["size"].to_numpy(), group["n"].to_numpy(), rest)
    return pd.DataFrame({"key": group["key"], "size": group["size"], "whole": whole, "extra": take})


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes of it) of every document; with source, copies
    (how often it is taken) and row (a hash of the whole row).

    Documents of one source and length are never gathered: they are counted by part of the hash range, and only
    those of the part that holds the last one taken are ordered among themselves.
    """
    key = F.xxhash64("source", F.col("source").isNull())
    sized = checkpoint(sizes(docs).withColumn("key", key).withColumn("part", F.shiftrightunsigned("order", 54)))
    goals = checkpoint(targets(sized).withColumn("key", key).drop("source"))
    counts = sized.groupBy("key", "size", "part").agg(F.count("*").alias("n"))
    lengths = counts.groupBy("key", "size").agg(F.sum("n").alias("n")).join(goals, "key")
    chosen = lengths.groupBy("key").applyInPandas(_choose, "key bigint, size bigint, whole bigint, extra bigint")
    by_part = Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        counts.withColumn("before", F.coalesce(F.sum("n").over(by_part), F.lit(0)))
        .join(chosen, ["key", "size"])
        .select("key", "size", "part", "whole", F.greatest(F.lit(0), F.least("n", F.col("extra") - F.col("before"))).alias("here"), "n")
    )
    rows = sized.join(plan, ["key", "size", "part"])
    settled = rows.where((F.col("here") == 0) | (F.col("here") == F.col("n"))).withColumn("again", F.col("here") > 0)
    ranked = rows.where((F.col("here") > 0) & (F.col("here") < F.col("n"))).withColumn("again", F.row_number().over(Window.partitionBy("key", "size", "part").orderBy("order", "doc_id", "row")) <= F.col("here"))
    return settled.unionByName(ranked).join(goals, "key").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("again").cast("long"))).alias("taken"), "source", (F.col("whole") + F.col("again").cast("long")).alias("copies"), "row"
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, all columns.

    Each row is taken as often as ``mix`` decided for it; rows equal in every column are put together and
    taken as often as all of them.
    """
    key, row, n = fresh(docs, "mixed_id"), fresh(docs, "mixed_row"), fresh(docs, "mixed_n")
    copies = checkpoint(mix(docs).groupBy(F.col("doc_id").alias(key), F.col("row").alias(row)).agg(F.sum("copies").alias(n), F.count("*").alias("rows")))
    marked = docs.withColumn(row, row_hash(docs))
    if not copies.where("rows > 1").isEmpty():
        marked = marked.dropDuplicates(["doc_id", row])
    joined = marked.join(copies.where(F.col(n) > 0).drop("rows"), marked["doc_id"].eqNullSafe(copies[key]) & (marked[row] == copies[row]))
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n)))).select(*(marked[f"`{c}`"] for c in docs.columns))
