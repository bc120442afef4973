"""Quality classifier: Bradley-Terry ranking of documents, cut at a quantile of the scores.

Each preference pair says that a document of label 1 is better than one of label 0.  The model is a sum over
features of a step function (quantile bins), learnt by the logistic loss on the difference of both documents.
Null or empty text has finite features and so a score like any other, as has a very long one; equal texts have equal
scores, repeated rows a row each; a score at the cut is accepted.  Without labels of both kinds all texts have the
score of the cut.  Further columns, of whatever name, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_bytes, is_fold, map_batches
from .quality_rules import labelled_features
from .textstats import FEATURES, features

#: Bounds of the fit: labelled rows (lowest hashes of their ids) and preference pairs drawn from them.
MAX_TRAIN_ROWS = 10_000
MAX_PAIRS = 20_000
#: The score that stands at the quantile; a document at or above it is accepted.
CUT = 0.3


@dataclass(frozen=True)
class Ranker:
    cuts: list[np.ndarray]
    weights: np.ndarray
    at: float

    def design(self, x: np.ndarray) -> np.ndarray:
        parts = []
        for j, c in enumerate(self.cuts):
            one = np.zeros((len(x), len(c) + 1))
            one[np.arange(len(x)), np.searchsorted(c, x[:, j], side="left")] = 1
            parts.append(one)
        return np.hstack(parts)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, rising with the strength, CUT at the chosen quantile."""
        z = np.clip(self.strength(x) - self.at, -30, 30)
        return 1 / (1 + np.exp(-z) * (1 - CUT) / CUT)


def fit_pairs(x: np.ndarray, y: np.ndarray, max_pairs: int = MAX_PAIRS, bins: int = 10, l2: float = 1.0, seed: int = 7) -> Ranker:
    """Newton steps on the mean logistic loss of drawn pairs. Without both labels all strengths are 0, as is the cut."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(len(FEATURES))]
    model = Ranker(cuts, np.zeros(sum(len(c) + 1 for c in cuts)), 0.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return model
    rng = np.random.default_rng(seed)
    n = min(max_pairs, 20 * max(len(good), len(bad)))
    pairs = np.column_stack([rng.choice(good, n), rng.choice(bad, n)])
    design = model.design(x)
    w = model.weights
    for _ in range(12):
        g, h = l2 * w, l2 * np.eye(len(w))
        for some in np.array_split(pairs, max(1, n // 4000)):
            d = design[some[:, 0]] - design[some[:, 1]]
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            g = g - d.T @ (1 - p)
            h = h + (d * (p * (1 - p))[:, None]).T @ d
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    strength = np.sort(design @ w)
    # the quantile: as large a share of the labelled rows is cut off as has label 0, at the middle of the gap there
    k = len(bad)
    return Ranker(cuts, w, float((strength[k - 1] + strength[min(k, len(strength) - 1)]) / 2))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Ranker:
    """Learns ``quality`` only from rows whose crc32(doc_id) mod 5 is not 0."""
    return fit_pairs(*labelled_features(docs, labels, "quality", max_rows, ~is_fold("doc_id", 5, 0)))


def score_documents(docs: DataFrame, model: Ranker) -> DataFrame:
    """doc_id, held_out, score and predicted (1: accepted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> list:
        score = shared.value.score(np.array([features(raw) for raw in batch["raw"].to_pylist()]).reshape(-1, len(FEATURES)))
        return [batch["doc_id"], batch["held_out"], score, (score >= CUT).astype(np.int32)]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(id_and_bytes(docs, "doc_id", "text", is_fold("doc_id", 5, 0).alias("held_out")), f"doc_id {kind}, held_out boolean, score double, predicted int", work)


def accepted(docs: DataFrame, model: Ranker) -> DataFrame:
    """The documents that the model accepts, all columns, in one pass without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                raw = batch.column(at).cast(pa.binary()).to_pylist()
                yield batch.filter(pa.array(shared.value.score(np.array([features(r) for r in raw])) >= CUT))

    return docs.mapInArrow(run, docs.schema)
