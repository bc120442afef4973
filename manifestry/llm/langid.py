"""Language identification by interpolated Kneser-Ney character models, one for each language.

A model holds, for every character n-gram of a word (a space on both sides) up to ORDER, its interpolated log
probability, and for every context its back-off weight, in arrays sorted by the n-gram's 64-bit hash.  A text's
cross-entropy in a language is the sum over its words divided by its characters; the lowest wins, of equal ones
the language first by name.  It may be rejected by a threshold calibrated on training rows that the models were not
fitted on.  Null text, or one without a letter, is ``und`` with score 0; a very long text is scored whole; repeated
rows are treated alike; further columns, of whatever name, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_fold, map_batches

ORDER, DISCOUNT = 4, 0.75
#: Bounds of the fit: training rows of each language (about; by a hash of their ids), and characters of each row;
#: with many languages both shrink, to LEAST_ROWS and LEAST_CHARS at least, so that all texts together have about
#: MAX_TOTAL characters.
MAX_ROWS, MAX_CHARS, MAX_TOTAL = 400, 40_000, 64_000_000
LEAST_ROWS, LEAST_CHARS = 25, 2_000
#: Every how many of a language's training rows one is left out of the fit, to calibrate the rejection.
LEFT_OUT = 5
#: Words whose cross-entropies a task remembers before it starts afresh.
REMEMBERED = 200_000
#: Share of the rows left out of the fit that the calibrated threshold rejects.
REJECTED = 0.005
LETTERS = regex.compile(r"\p{L}+")
_FLOOR = np.log(1e-7)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def letters_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def _chars(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all words, each between two spaces; for each character its word and its place in it."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    chars = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), lengths)
    return chars, word, np.arange(len(chars)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _hashes(chars: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that ends at each character (of the n-gram before the text, garbage, to be masked)."""
    h = np.full(len(chars), n, dtype=np.uint64)
    for k in range(n - 1, -1, -1):
        shifted = np.zeros(len(chars), dtype=np.uint64)
        shifted[k:] = chars[: len(chars) - k]
        h = (h ^ shifted) * _MIX[k]
        h ^= h >> np.uint64(29)
    return h


@dataclass(frozen=True)
class CharModel:
    """For each order 1..ORDER: sorted hashes and log probabilities of n-grams, and those of contexts with back-off."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]


def _find(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, values = table
    if not len(keys):
        return np.zeros(len(h), dtype=bool), np.zeros(len(h))
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    return keys[at] == h, values[at]


def fit_model(words: Counter) -> CharModel:
    """Kneser-Ney: raw counts at the highest order, numbers of different left neighbours below it."""
    items = sorted(words.items())
    chars, word, place = _chars([w for w, _ in items])
    weight = np.array([n for _, n in items], dtype=float)[word] if items else np.zeros(0)
    grams, contexts = [], []
    lower: dict = {}
    for n in range(1, ORDER + 1):
        ok = place >= max(n - 1, 1)  # the first space is only a context
        h, c = _hashes(chars, n)[ok], (_hashes(np.roll(chars, 1), n - 1) if n > 1 else np.full(len(chars), 1, dtype=np.uint64))[ok]
        low = _hashes(chars, n - 1)[ok] if n > 1 else None
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if n == ORDER:
            count = np.bincount(inverse, weights=weight[ok], minlength=len(keys))
        else:  # continuation count: different (n+1)-grams that end in this n-gram; at a word's start there is none to the left
            longer = np.where(place >= n, _hashes(chars, n + 1), h_start(chars, n))[ok]
            kinds, which = np.unique(longer, return_inverse=True)
            pairs = np.unique(inverse.astype(np.int64) * max(len(kinds), 1) + which)
            count = np.bincount(pairs // max(len(kinds), 1), minlength=len(keys)).astype(float)
        context, lows = c[first], (low[first] if n > 1 else None)
        ck, at = np.unique(context, return_inverse=True)
        total, kinds = np.bincount(at, weights=count, minlength=len(ck)), np.bincount(at, minlength=len(ck))
        backoff = DISCOUNT * kinds / total if len(ck) else np.zeros(0)
        below = np.array([lower.get(x, 1e-7) for x in lows.tolist()]) if n > 1 else np.full(len(keys), 1e-4)
        p = np.maximum(count - DISCOUNT, 0) / total[at] + backoff[at] * below
        lower = dict(zip(keys.tolist(), p.tolist()))
        grams.append((keys, np.log(p)))
        contexts.append((ck, np.log(backoff)))
    return CharModel(grams, contexts)


def h_start(chars: np.ndarray, n: int) -> np.ndarray:
    """Stands for the one left neighbour that an n-gram at a word's start has."""
    return _hashes(chars, n) ^ np.uint64(0x5851F42D4C957F2D)


def word_entropies(models: list[CharModel], words: list[str]) -> np.ndarray:
    """Negative log probability of each word and its closing space, a column for each model.

    Each distinct n-gram among the words is looked up once.
    """
    chars, word, place = _chars(words)
    before = np.roll(chars, 1)
    at = np.flatnonzero(place >= 1)
    top = _hashes(chars, ORDER)[at]
    top[place[at] < ORDER - 1] ^= np.uint64(1)  # shorter ones, at a word's start, are told apart by their own hash below
    short = place[at] < ORDER - 1
    if short.any():
        whole = np.where(place[at] == 1, _hashes(chars, 2)[at], _hashes(chars, 3)[at])
        top = np.where(short, whole, top)
    _, first, inverse = np.unique(top, return_index=True, return_inverse=True)
    some = at[first]
    depth = np.minimum(place[some] + 1, ORDER)
    hashes = {n: _hashes(chars, n)[some] for n in range(1, ORDER + 1)}
    contexts = {n: _hashes(before, n - 1)[some] for n in range(2, ORDER + 1)}
    out = np.empty((len(words), len(models)))
    for k, model in enumerate(models):
        value, todo = np.zeros(len(some)), np.ones(len(some), dtype=bool)
        for n in range(ORDER, 0, -1):
            i = np.flatnonzero(todo & (depth >= n))
            found, p = _find(model.grams[n - 1], hashes[n][i])
            value[i[found]] += p[found]
            todo[i[found]] = False
            rest = i[~found]
            if n > 1 and len(rest):
                known, weight = _find(model.contexts[n - 1], contexts[n][rest])
                value[rest] += np.where(known, weight, 0.0)
        value[todo] += _FLOOR
        out[:, k] = -np.bincount(word[at], weights=value[inverse], minlength=len(words))
    return out


@dataclass(frozen=True)
class Identifier:
    languages: list[str]
    models: list[CharModel]
    reject_above: float = np.inf

    def entropies(self, words: list[str]) -> np.ndarray:
        return word_entropies(self.models, words) if words else np.zeros((0, len(self.models)))


class _Scorer:
    """Scores texts by their white-space tokens, remembering each token's letters and entropies for a while."""

    def __init__(self, identifier: Identifier):
        self.of, self.at, self.rows = identifier, {}, np.zeros((0, 1 + len(identifier.models)))

    def _rows_of(self, tokens: list[str]) -> np.ndarray:
        """For each token: the characters of its words (a closing space for each), then their entropies."""
        words, owner = [], []
        for i, token in enumerate(tokens):
            found = [token] if token.isalpha() else LETTERS.findall(token)
            words += found
            owner += [i] * len(found)
        rows = np.zeros((len(tokens), 1 + len(self.of.models)))
        if words:
            np.add.at(rows, np.array(owner), np.column_stack([np.fromiter(map(len, words), dtype=float, count=len(words)) + 1, self.of.entropies(words)]))
        return rows

    def cross_entropies(self, texts: list[str | None]) -> np.ndarray:
        """Nats a character in each language; nan without a letter."""
        found = [t.lower().split() if t else [] for t in texts]
        if len(self.at) > REMEMBERED:
            self.at, self.rows = {}, self.rows[:0]
        new = list(set().union(*found) - self.at.keys())
        if new:
            self.at.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.vstack([self.rows, *(self._rows_of(new[i : i + 50_000]) for i in range(0, len(new), 50_000))])
        out = np.full((len(texts), len(self.of.models)), np.nan)
        place = self.at.__getitem__
        for i, w in enumerate(found):
            if w:
                total = self.rows[list(map(place, w))].sum(axis=0)
                if total[0]:
                    out[i] = total[1:] / total[0]
        return out


def decide(identifier: Identifier, entropies: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score (0 to 1: share of the winner if the entropies of one character are weighed as likelihoods
    of ten) and whether the calibrated threshold rejects it."""
    none = np.isnan(entropies).any(axis=1) if entropies.shape[1] else np.ones(len(entropies), dtype=bool)
    if not identifier.models:
        return ["und"] * len(entropies), np.zeros(len(entropies)), none
    e = np.where(none[:, None], 0, entropies)
    best = e.argmin(axis=1)
    like = np.exp(-10 * (e - e.min(axis=1, keepdims=True)))
    score = np.where(none, 0.0, 1 / like.sum(axis=1))
    return ["und" if n else identifier.languages[b] for n, b in zip(none, best)], score, none | (e.min(axis=1) > identifier.reject_above)


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, max_total: int = MAX_TOTAL) -> Identifier:
    """Models from rows outside fold 0 of 5 that have a language.

    Of each language about ``max_rows`` are taken, by a hash of id and text below a share of its range, all if there
    are fewer; rows equal in both count once, rows that only share an id each for itself. Of a longer text than ``max_chars`` the characters before that are learnt from.  These, and a
    row for each language, are what reaches the driver: about ``max_total`` characters, unless the languages are
    so many that LEAST_ROWS of LEAST_CHARS each are more.  Every language with a letter in a training row is learnt.
    """
    train = docs.where(~is_fold("doc_id", 5, 0) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    hashed = F.xxhash64(F.lit("langid"), "doc_id", "text")
    sizes = {r.lang: r.n for r in train.select("lang", hashed.alias("hash")).distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not sizes:
        return Identifier([], [])
    max_rows = int(max(min(max_rows, max_total / len(sizes) / max_chars), min(max_rows, LEAST_ROWS)))
    max_chars = int(max(min(max_chars, max_total / len(sizes) / max_rows), min(max_chars, LEAST_CHARS)))
    place = F.shiftrightunsigned(hashed, 11) / float(1 << 53)
    # each language's share of the range stands in the filter itself, so texts are neither joined nor shuffled
    cut = F.element_at(F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, max_rows / n)))), F.col("lang"))
    some = train.where(place < cut).select("lang", F.substring("text", 1, max_chars).alias("text"), place.alias("place"), "doc_id")
    rows = some.dropDuplicates(["lang", "place", "doc_id"]).collect()
    texts: dict = {}
    for r in sorted(rows, key=lambda r: (r.place, r.doc_id, r.text)):
        texts.setdefault(r.lang, []).append(r.text)
    languages = sorted(k for k, v in texts.items() if any(letters_of(t) for t in v))
    models, aside = [], []
    for k in languages:
        learnt = [t for i, t in enumerate(texts[k]) if i % LEFT_OUT != LEFT_OUT - 1]
        if any(letters_of(t) for t in learnt):
            aside.append([t for i, t in enumerate(texts[k]) if i % LEFT_OUT == LEFT_OUT - 1])
        else:
            learnt = texts[k]
            aside.append([])
        counts: Counter = Counter()
        for t in learnt:
            counts.update(letters_of(t))
        models.append(fit_model(counts))
    found = Identifier(languages, models)
    lowest = np.concatenate([np.zeros(0), *(_Scorer(found).cross_entropies(v)[:, i] for i, v in enumerate(aside) if v)])
    lowest = lowest[~np.isnan(lowest)]
    return Identifier(languages, models, float(np.quantile(lowest, 1 - REJECTED)) if len(lowest) else np.inf)


def identify(docs: DataFrame, identifier: Identifier) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected (by the calibrated threshold) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(identifier)
    scorers: list[_Scorer] = []

    def work(batch):
        if not scorers:
            scorers.append(_Scorer(shared.value))
        texts, parts = batch["text"].to_pylist(), []
        for i in range(0, len(texts), 2_000):
            parts.append(scorers[0].cross_entropies(texts[i : i + 2_000]))
        lang, score, rejected = decide(shared.value, np.vstack(parts) if parts else np.zeros((0, len(shared.value.models))))
        return [batch["doc_id"], batch["held_out"], lang, score, rejected]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text"), is_fold("doc_id", 5, 0).alias("held_out")), f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean", work)
