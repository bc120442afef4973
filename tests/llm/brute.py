"""Plain Python versions of the training-data operators, written apart from them."""

import collections
import math
import re
import zlib

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    raw = (text or "").encode()
    if lower:
        raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw)
    return WORD.findall(raw)


def fold(key, n):
    return zlib.crc32(str(key).encode()) % n


def base(text):
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def fingerprint(text):
    w = words(text, True)
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    """fps: {id: fingerprint} -> {id: smallest id reachable}."""
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


class Ppm:
    """One trie of byte contexts, by dictionaries; escape by half the kinds, symbols of longer contexts excluded."""

    def __init__(self, texts, order=5):
        self.order, self.trie = order, [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
        for t in texts:
            s = self.spelled(t)
            for i in range(order, len(s)):
                for k in range(order + 1):
                    self.trie[k][s[i - k : i]][s[i]] += 1

    def spelled(self, text):
        return b"\0" * (self.order - 1) + b" " + b"".join(w + b" " for w in words(text, True)) + b"\n"

    def log10(self, text):
        s, total = self.spelled(text), 0.0
        for i in range(self.order, len(s)):
            out, excluded, found = 0.0, set(), False
            for k in range(self.order, -1, -1):
                f = self.trie[k].get(s[i - k : i])
                if not f:
                    continue
                live = {a: n for a, n in f.items() if a not in excluded}
                if live:
                    t = sum(live.values())
                    if s[i] in live:
                        total += out + math.log10((live[s[i]] - 0.5) / t)
                        found = True
                        break
                    out += math.log10(len(live) / 2 / t)
                excluded |= set(f)
            if not found:
                total += out - math.log10(256 - len(excluded))
        return total
