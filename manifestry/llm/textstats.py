"""Statistics of a text that the quality operators (GBT rules, pairwise ranking) use as features."""

from __future__ import annotations

import numpy as np

from .common import code_points

SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_PUNCT = b"!\"'()+,-./:;=?@[\\]^_`{}~"
_SENTENCE = b".!?"

#: Order of the features in a row of ``features``.
FEATURES = (
    "log_words", "mean_word_chars", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate",
    "punct_rate", "sentence_rate", "words_per_line", "type_rate", "non_ascii_rate", "exclaim_rate", "pipe_rate", "log_longest_word",
)


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more in the text, the first occurrence included."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    first: dict = {}
    twice = set()
    if len(set(windows)) == n:
        return 0
    for i, w in enumerate(windows):
        if first.setdefault(w, i) != i:
            twice.add(w)
    covered = bytearray(n + 2)
    for i, w in enumerate(windows):
        if w in twice:
            covered[i : i + 3] = b"\x01\x01\x01"
    return covered.count(1)


def duplicate_lines(raw: bytes) -> int:
    """Lines (split at \\n) that hold a word and equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def base_statistics(raw: bytes | None) -> tuple[int, int, int, int, int, list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the words; a null text has none."""
    if not raw:
        return 0, 0, 0, 0, 0, []
    words = raw.split()
    return (
        len(words),
        code_points(b"".join(words)),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        duplicate_lines(raw) if b"\n" in raw else 0,
        repeated_words(words),
        words,
    )


def _count(raw: bytes, what: bytes) -> int:
    return len(raw) - len(raw.translate(None, what))


def features(raw: bytes | None, base: tuple | None = None) -> list[float]:
    """One row in the order of FEATURES; an empty or null text gives finite values too."""
    n_words, chars, symbols, dup, repeat, words = base or base_statistics(raw)
    raw = raw or b""
    n, c = max(n_words, 1), max(chars, 1)
    upper, lower = _count(raw, _UPPER), _count(raw, _LOWER)
    lines = raw.count(b"\n") + 1
    return [
        float(np.log1p(n_words)), chars / n, symbols / c, dup / lines, repeat / n, upper / max(upper + lower, 1), _count(raw, _DIGITS) / c,
        _count(raw, _PUNCT) / c, _count(raw, _SENTENCE) / n, float(np.log1p(n_words / lines)), len(set(words)) / n, 1 - (len(raw) and len(raw.translate(None, bytes(range(128, 256)))) / len(raw)) if raw else 0.0,
        raw.count(b"!") / n, raw.count(b"|") / n, float(np.log1p(max(map(len, words), default=0))),
    ]
