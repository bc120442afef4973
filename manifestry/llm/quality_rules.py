"""Quality rules: gradient-boosted trees over document statistics, scored from flat numpy node arrays.

Null or empty text: no words, so the base rule fails and the document is not kept.  Repeated rows are
scored alike; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_bytes, is_fold, map_batches
from .textstats import FEATURES, base_statistics, features

#: Kept probability may only fall as these features rise.
DECREASING = ("symbol_rate", "dup_line_rate", "repeat_rate", "exclaim_rate", "pipe_rate")
#: Bound of the labelled rows that a model is fitted on (the lowest hashes of their ids).
MAX_TRAIN_ROWS = 10_000
#: Least probability of quality 1 of a document that is kept.
KEEP_AT = 0.5


@dataclass(frozen=True)
class FlatTrees:
    """All trees' nodes end to end. A leaf points to itself on both sides; ``value`` counts at leaves only."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    bias: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, decreasing: tuple[str, ...] = DECREASING, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 1.0, min_rows: int = 5) -> FlatTrees:
    """Newton boosting of the logistic loss on binned features.

    A split on a monotone feature is taken only if the right child's weight is not above the left one's, and
    the children of any split on it are bounded by the middle of both weights, so the whole tree is monotone.
    No rows, or one label only: no trees, and the bias alone decides.
    """
    sign = np.array([-1 if f in decreasing else 0 for f in FEATURES][: x.shape[1]] if x.shape[1] == len(FEATURES) else [0] * x.shape[1])
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        codes = [np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]
        raw = np.full(len(y), bias)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            step = np.zeros(len(y))

            def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
                at, gs, hs = len(nodes), g[rows].sum(), h[rows].sum()
                weight = float(np.clip(-gs / (hs + l2), low, high))
                nodes.append([0, np.inf, at, at, weight * rate])
                best = (1e-6, -1, -1, 0.0, 0.0)
                if level < depth and len(rows) >= 2 * min_rows:
                    for j, c in enumerate(cuts):
                        if not len(c):
                            continue
                        k = codes[j][rows]
                        gl, hl, nl = (np.cumsum(np.bincount(k, weights=v, minlength=len(c) + 1))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                        gr, hr = gs - gl, hs - hl
                        wl, wr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
                        loss = lambda a, b, w: a * w + 0.5 * (b + l2) * w * w
                        gain = loss(gs, hs, weight) - loss(gl, hl, wl) - loss(gr, hr, wr)
                        bad = (nl < min_rows) | (len(rows) - nl < min_rows) | ((wr - wl) * sign[j] < 0)
                        gain[bad] = -1
                        i = int(np.argmax(gain))
                        if gain[i] > best[0]:
                            best = (float(gain[i]), j, i, float(wl[i]), float(wr[i]))
                if best[1] < 0:
                    step[rows] = weight * rate
                    return at
                _, j, i, wl, wr = best
                middle = (wl + wr) / 2
                left_low, left_high, right_low, right_high = low, high, low, high
                if sign[j] < 0:
                    left_low, right_high = middle, middle
                goes = codes[j][rows] <= i
                a, b = grow(rows[goes], level + 1, left_low, left_high), grow(rows[~goes], level + 1, right_low, right_high)
                nodes[at] = [j, float(cuts[j][i]), a, b, 0.0]
                return at

            roots.append(grow(np.arange(len(y)), 0, -4.0, 4.0))
            raw += step
    part = lambda k, kind: np.array([n[k] for n in nodes], dtype=kind)
    return FlatTrees(np.array(roots, dtype=np.int64), part(0, np.int64), part(1, float), part(2, np.int64), part(3, np.int64), part(4, float), depth, bias)


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, train: F.Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``max_rows`` labelled rows (lowest hashes of the id), the stated bound of what reaches the driver.

    A row without an id, label or document takes no part; a repeated one counts as often as it occurs in both tables.
    """
    some = labels.select(F.col("doc_id"), F.col(label).cast("double").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
    if train is not None:
        some = some.where(train)
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    rows = map_batches(
        docs.select(F.col("doc_id"), F.col("text").cast("binary").alias("raw")).join(F.broadcast(some), "doc_id").select("doc_id", "raw", "y"),
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>, y double",
        lambda b: [b["doc_id"], [features(raw) for raw in b["raw"].to_pylist()], b["y"]],
    ).orderBy(F.xxhash64("doc_id"), "doc_id", "x", "y").limit(max_rows).collect()
    return np.array([r.x for r in rows]).reshape(-1, len(FEATURES)), np.array([r.y for r in rows])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> FlatTrees:
    """Trees for ``quality``, from rows outside fold 0 of 5, so that fold is there to measure on."""
    return fit_trees(*labelled_features(docs, labels, "quality", max_rows, ~is_fold("doc_id", 5, 0)))


def quality_rules(docs: DataFrame, model: FlatTrees, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, the base statistics, base_failed, probability and kept of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> list:
        base, x = [], []
        for raw in batch["raw"].to_pylist():
            b = base_statistics(raw)
            base.append(b[:5])
            x.append(features(raw, b))
        failed = [b[0] < 50 or 100 * b[4] > 50 * b[0] for b in base]
        p = shared.value.probability(np.array(x).reshape(-1, len(FEATURES)))
        return [batch["doc_id"], *([b[k] for b in base] for k in range(5)), failed, p, (p >= keep_at) & ~np.array(failed, dtype=bool)]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(
        id_and_bytes(docs),
        f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, probability double, kept boolean",
        work,
    )
