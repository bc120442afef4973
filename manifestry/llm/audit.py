"""What five filters remove, alone and in every order: an audit of their interaction.

Each document fails some of the filters A to E: one of 32 masks. In each of the 120 orders the first filter that it
fails removes it, so a table of 32 by 120 first failures, worked out once, says for every document at which step of
which order it goes. Tasks look the table up for their rows and count; their partial arrays are summed by Spark.

A null text is the empty text, which has no words: it fails A alone, and E if a smaller id has an empty text. A null
source is the part with the empty name, together with the empty source. Repeated rows all count; of rows that share an
id none is smaller than the other, so copies among them do not fail E. A row without an id is neither smaller nor
larger than any other and has no label. A document is good (toxic) if any label row of its id says so. Further columns,
of whatever name, are not read; very long texts are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, code_points, map_batches, words_of

FILTERS = "ABCDE"
STEPS = len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: ORDERS as filter numbers, one row each.
ORDER_FILTERS = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
MASKS = 1 << STEPS
FEWEST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_UPPER_PERCENT = 2
MARKS = b"#$%&*|"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
#: Parts whose counts a task holds at once (each some 35 kB); beyond it they are handed on and begun anew.
MOST_PARTS = 512
#: Rows that are looked up at once.
ROWS = 8192
#: Columns that are counted at each step, in the order of the partial arrays.
COUNTED = ("removed", "good_lost", "toxic_lost")


def first_failures() -> np.ndarray:
    """[mask, order]: the step (0 to 4) at which a document of this mask goes; 5 if it stays."""
    fails = (np.arange(MASKS)[:, None] >> np.arange(STEPS)[None, :]) & 1 == 1
    in_order = fails[:, ORDER_FILTERS]  # mask, order, step
    return np.where(in_order.any(axis=2), in_order.argmax(axis=2), STEPS)


def text_mask(raw: bytes | None) -> int:
    """Filters A to D as bits 0 to 3; E depends on the other documents."""
    raw = raw or b""
    words = words_of(raw)
    upper, marks = len(raw) - len(raw.translate(None, UPPER)), len(raw) - len(raw.translate(None, MARKS))
    return (
        (len(words) < FEWEST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words)) << 1
        | (100 * upper > MOST_UPPER_PERCENT * code_points(raw)) << 2
        | (marks > 0) << 3
    )


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (all five filters), good, toxic and n: how many documents of an id and a text are like that.

    The texts are read once and do not travel: what does is an id, a part, a mask and a digest (SHA-256, so that
    equal digests mean equal texts). The first id of each text is a grouped minimum, and the row that holds it is
    found by its id, not by its text, so copies of one text, however many, do not meet in one task.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def facts(batch: pa.RecordBatch) -> list:
        raws = [raw.as_py() or b"" for raw in batch["raw"]]
        return [batch["doc_id"], batch["part"], np.array([text_mask(raw) for raw in raws], dtype=np.int32), [hashlib.sha256(raw).digest() for raw in raws]]

    read = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("binary").alias("raw"))
    rows = map_batches(read, f"doc_id {kind}, part string, mask int, digest binary", facts)
    rows = checkpoint(rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n")))
    known = rows.where(F.col("doc_id").isNotNull())
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(_one("quality")).alias("good"), F.max(_one("toxic")).alias("toxic"))
    joined = known.join(first, ["doc_id", "digest"], "left").join(marked, "doc_id", "left")
    copy = F.when(F.col("is_first"), 0).otherwise(1 << FILTERS.index("E"))
    alone = rows.where(F.col("doc_id").isNull()).select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "n")
    return joined.select("part", F.col("mask").bitwiseOR(copy).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "n").unionByName(alone)


def _one(label: str) -> Column:
    return F.when(F.col(label) == 1, 1).otherwise(0)


#: A task's counts of one part and order: documents, then COUNTED, failing and unique failing, each by step.
PARTIAL = ["documents"] + [f"{name}_{s}" for name in COUNTED + ("failing", "unique") for s in range(1, STEPS + 1)]


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each part and order with the counts of PARTIAL, over all rows of the task."""
    table, cells = first_failures(), len(ORDERS) * (STEPS + 1)
    bits = (np.arange(MASKS)[:, None] >> np.arange(STEPS)[None, :]) & 1
    alone = bits * (bits.sum(axis=1, keepdims=True) == 1)
    lost: dict[str, np.ndarray] = {}  # part -> COUNTED x order x step
    seen: dict[str, np.ndarray] = {}  # part -> documents by mask
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string())] + [(name, pa.int64()) for name in PARTIAL])

    def partial() -> Iterator[pa.RecordBatch]:
        for part, by_step in lost.items():
            fails, only = seen[part] @ bits, seen[part] @ alone
            counts = [np.full(len(ORDERS), seen[part].sum())]
            counts += [by_step[k, :, s] for k in range(len(COUNTED)) for s in range(STEPS)]
            counts += [of[ORDER_FILTERS[:, s]] for of in (fails, only) for s in range(STEPS)]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(ORDERS)), pa.array(ORDERS)] + [pa.array(c, type=pa.int64()) for c in counts], schema=schema)
        lost.clear()
        seen.clear()

    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            rows = batch.slice(start, ROWS)
            parts = rows["part"].dictionary_encode()
            code, names = parts.indices.to_numpy().astype(np.int64), parts.dictionary.to_pylist()
            mask, n, good, toxic = (rows[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("mask", "n", "good", "toxic"))
            by_mask = _counted(code * MASKS + mask, n, len(names) * MASKS).reshape(len(names), MASKS)
            for first in range(0, len(names), MOST_PARTS):
                if len(lost) >= MOST_PARTS:
                    yield from partial()
                some = names[first : first + MOST_PARTS]
                at = (code >= first) & (code < first + len(some))
                cell = (code[at, None] - first) * cells + np.arange(len(ORDERS)) * (STEPS + 1) + table[mask[at]]
                for k, weight in enumerate((n, n * good, n * toxic)):
                    counted = _counted(cell.ravel(), np.repeat(weight[at], len(ORDERS)), len(some) * cells).reshape(len(some), len(ORDERS), STEPS + 1)
                    for i, part in enumerate(some):
                        lost.setdefault(part, np.zeros((len(COUNTED), len(ORDERS), STEPS + 1), dtype=np.int64))[k] += counted[i]
                for i, part in enumerate(some):
                    seen[part] = seen.get(part, 0) + by_mask[first + i]
    yield from partial()


def _counted(cells: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """Sums by cell as whole numbers; np.bincount's doubles hold them exactly, as a batch's sums are below 2 ** 53."""
    return np.bincount(cells, weights=weights, minlength=size).astype(np.int64)


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley: 600 rows
    (120 orders of 5 steps) for each part."""
    counts = ", ".join(f"{name} bigint" for name in PARTIAL)
    partial = masks(docs, labels).mapInArrow(_partials, f"part string, filter_order string, {counts}")
    sums = partial.groupBy("part", "filter_order").agg(*(F.sum(name).alias(name) for name in PARTIAL))

    def at(step: int) -> Column:
        gone = sum((F.col(f"removed_{s}") for s in range(2, step + 1)), F.col("removed_1"))
        return F.struct(
            F.lit(step).alias("step"), (F.col("documents") - gone).alias("kept"), *(F.col(f"{name}_{step}").alias(name) for name in COUNTED),
            (F.col(f"failing_{step}") - F.col(f"removed_{step}")).alias("redundant"), F.col(f"unique_{step}").alias("unique_fails"),
        )

    steps = sums.select("part", "filter_order", F.explode(F.array(*(at(s) for s in range(1, STEPS + 1)))).alias("x")).select("part", "filter_order", "x.*")
    steps = checkpoint(steps.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1))))
    shares = steps.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return steps.join(shares, ["part", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
