"""SimHash near-duplicates: fingerprints, deletion-variant signatures, equality join, verification, components.

Two fingerprints that differ in at most 3 of 64 bits differ in at most 1 bit of one of their two 32-bit
segments.  So each distinct fingerprint is indexed under every one-wildcard variant of each segment, and
those that meet under a variant are compared in full.  Rows without an id are linked like any other but
carry a null id; a null or empty text has fingerprint zero; repeated rows and rows that share an id are
each given their own fingerprint's answer; other columns, of whatever name, are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh, id_and_bytes, map_batches, partitions, row_hash, words_of
from .components import connected_components

BITS, SEGMENTS, SEED = 64, 2, 42
WIDTH = BITS // SEGMENTS
#: Most differing bits of a link: a segment pair has at most one bit in its better half.
MAX_DISTANCE = 2 * SEGMENTS - 1
#: Fingerprints of one bucket that are compared pair by pair inside a task; a larger bucket is split and looked up.
DENSE = 4096
#: Tasks over which a hot key's rows are dealt before they are split by value.
SALTS = 32
#: Longest run that is compared at once with all other runs of a batch.
SHORT = 48


def shingle_hashes(raw: bytes | None, size: int = 3) -> np.ndarray:
    """XXH64 of every word shingle of the text with A-Z lowered; shorter texts have one, wordless ones none."""
    words = words_of(raw.lower() if raw else raw)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    text, h = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - size + 1
    if n <= 1:
        return np.array([h(text, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[: n - 1]])
    return np.array([h(text[s:e], SEED) for s, e in zip(starts.tolist(), (ends[size - 1 :] - 1).tolist())], dtype=np.uint64)


def fingerprint(raw: bytes | None) -> int:
    """Bit i is set if it is set in over half of the shingle hashes; unsigned."""
    h = shingle_hashes(raw)
    if not len(h):
        return 0
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 100_000):  # a long text's bits are never all unpacked at once
        counts += np.unpackbits(h[i : i + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the whole row) and fp (the fingerprint's 64 bits as a signed long) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(
        id_and_bytes(docs, "doc_id", "text", row_hash(docs).alias("row")),
        f"doc_id {kind}, row bigint, fp bigint",
        lambda b: [b["doc_id"], b["row"], np.array([fingerprint(raw) for raw in b["raw"].to_pylist()], dtype=np.uint64).view(np.int64)],
    )


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): one row for each segment and each of its bits, with that bit left out of the key."""
    keys = []
    for s in range(SEGMENTS):
        part = F.shiftrightunsigned("fp", s * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1))
        for bit in range(WIDTH):
            keys.append(part.bitwiseAND(F.lit(((1 << WIDTH) - 1) ^ (1 << bit))).bitwiseOR(F.lit((s * WIDTH + bit) << WIDTH)))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(x, y).view(np.uint64))


#: Every change of at most MAX_DISTANCE bits within one segment and one further bit of the other, made on first use.
_MASKS: dict[int, np.ndarray] = {}


def _masks(segment: int) -> np.ndarray:
    """The changes of 1 to 3 bits in the segment that a bucket's key does not hold."""
    if segment not in _MASKS:
        from itertools import combinations

        bits = [1 << (segment * WIDTH + i) for i in range(WIDTH)]
        _MASKS[segment] = np.array([sum(c) for n in range(1, MAX_DISTANCE + 1) for c in combinations(bits, n)], dtype=np.uint64)
    return _MASKS[segment]


def _parts_by_pairs(u: np.ndarray) -> np.ndarray:
    """Least index of each value's part, by comparing blocks of rows; nothing but the labels is kept."""
    label = np.arange(len(u))
    while True:
        before = label.copy()
        for i in range(0, len(u), 128):
            near = np.bitwise_count(u[i : i + 128, None] ^ u[None, :]) <= MAX_DISTANCE
            label[i : i + 128] = np.where(near, label[None, :], len(u)).min(axis=1)
        label = label[label]
        if (label == before).all():
            return label


def _near_in_run(key: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold together what a long run of one bucket links, by no more than one link a member for
    each part or mask: pair by pair up to DENSE members, beyond it by looking up each change of at most three
    bits, so that work is linear in the bucket."""
    u = np.unique(values.view(np.uint64))
    if len(u) <= DENSE:
        label = _parts_by_pairs(u)
        return u.view(np.int64), u[label].view(np.int64)
    segment, bit = divmod(key >> WIDTH, WIDTH)
    flip = np.uint64(1 << (segment * WIDTH + bit))
    masks = _masks(1 - segment)
    label, left, right = np.arange(len(u)), [], []
    for change in np.concatenate([masks, [flip], masks[np.bitwise_count(masks) < MAX_DISTANCE] | flip]):
        goal = u ^ change
        at = np.searchsorted(u, goal)
        at[at == len(u)] = 0
        hit = np.flatnonzero((u[at] == goal) & (u < goal))
        hit = hit[label[hit] != label[at[hit]]]  # only links between parts that no link joins so far
        if len(hit):
            keep = hit[forest(label[hit], label[at[hit]])]
            left.append(keep)
            right.append(at[keep])
            label = _joined(label, label[keep], label[at[keep]])
    x, y = (np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (left, right))
    return u[x].view(np.int64), u[y].view(np.int64)


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The labels after parts x[i] and y[i] are joined, each part named by its least label."""
    parent = np.arange(len(label))
    while (parent[x] != parent[y]).any():
        low = np.minimum(parent[x], parent[y])
        np.minimum.at(parent, parent[x], low)
        np.minimum.at(parent, parent[y], low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return parent[label]


def forest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Indices of links that hold the same components together: each link that joins two parts so far."""
    parent: dict = {}

    def root(v):
        while (p := parent.setdefault(v, v)) != v:
            parent[v] = parent[p]
            v = p
        return v

    keep = []
    for i, (a, b) in enumerate(zip(x.tolist(), y.tolist())):
        if (p := root(a)) != (q := root(b)):
            parent[p] = q
            keep.append(i)
    return np.array(keep, dtype=np.int64)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links among rows of equal (key, sub), which come sorted; a run may span batches."""
    names = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    rest = np.zeros((3, 0), dtype=np.int64)

    def linked(rows: np.ndarray) -> pa.RecordBatch:
        key, sub, fp = rows
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])])) if len(key) else np.zeros(0, dtype=np.int64)
        lengths = np.diff(np.append(starts, len(key)))
        left, right = [], []
        big = lengths > SHORT
        for s, n in zip(starts[big], lengths[big]):
            x, y = _near_in_run(int(key[s]), fp[s : s + n])
            left.append(x)
            right.append(y)
        run = np.repeat(np.where(big, -1 - np.arange(len(starts)), np.arange(len(starts))), lengths)
        for lag in range(1, int(lengths[~big].max(initial=1))):
            at = np.flatnonzero((run[lag:] == run[:-lag]) & (run[lag:] >= 0))
            at = at[_distance(fp[at], fp[at + lag]) <= MAX_DISTANCE]
            left.append(fp[at])
            right.append(fp[at + lag])
        x, y = (np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (left, right))
        keep = forest(x, y)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]), pa.array(y[keep])], schema=names)

    for batch in batches:
        new = np.vstack([batch[n].to_numpy(zero_copy_only=False) for n in ("key", "sub", "fp")])
        rows = np.hstack([rest, new])
        last = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1]) if rows.shape[1] else np.zeros(0, dtype=bool)
        yield linked(rows[:, ~last])
        rest = rows[:, last]
    yield linked(rest)


def near_links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) that keep all those within MAX_DISTANCE together.

    A bucket that very many distinct fingerprints share is split before it reaches a task: its members agree
    on one segment but for a bit, so two of them within 3 bits agree on one byte of the other segment at
    least, and are dealt once for each of these four bytes (sub).  A hot bucket holds a segment value that
    over DENSE / 2 fingerprints have; these values are counted first, two rows for each fingerprint.
    """
    spark = fps.sparkSession
    low = lambda of, s: F.shiftrightunsigned(of, s * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1))
    segments = fps.select(F.explode(F.array(*(F.struct(F.lit(s).alias("s"), low("fp", s).alias("v")) for s in range(SEGMENTS)))).alias("x")).select("x.*")
    hot = checkpoint(segments.groupBy("s", "v").agg(F.count("*").alias("n")).where(F.col("n") > DENSE // 2))
    index = variants(fps).withColumn("sub", F.lit(0).cast("long"))
    if not hot.isEmpty():
        masks = F.array(*(F.lit(1 << i) for i in range(WIDTH)))
        keys = hot.select("s", "v", F.posexplode(masks).alias("bit", "mask")).select(
            F.col("v").bitwiseAND(F.bitwise_not("mask")).bitwiseOR(F.shiftleft((F.col("s") * WIDTH + F.col("bit")).cast("long"), WIDTH)).alias("key")
        ).distinct().withColumn("is_hot", F.lit(True))
        other = F.when(F.shiftright("key", WIDTH) < WIDTH, low("fp", 1)).otherwise(low("fp", 0))
        bytes_of = F.array(*(F.shiftright(other, 8 * i).bitwiseAND(F.lit(255)).bitwiseOR(F.lit((i + 1) << 8)) for i in range(4)))
        # the rows of one key are dealt over SALTS tasks for this join; each hot key has thousands of them
        index = index.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
        keys = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        index = index.join(keys, ["key", "salt"], "left").select("key", F.explode(F.when(F.col("is_hot"), bytes_of).otherwise(F.array("sub"))).alias("sub"), "fp")
    dealt = index.repartition(partitions(spark), "key", "sub").sortWithinPartitions("key", "sub", "fp")
    return dealt.mapInArrow(_links, "a bigint, b bigint").where("a <> b").distinct()


def classes(rows: DataFrame) -> DataFrame:
    """fp and component (a fingerprint that stands for all reachable ones) of every distinct fingerprint of rows."""
    nodes = checkpoint(rows.select("fp").distinct())
    parts = connected_components(near_links(nodes))
    return nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) of every document.

    Documents of equal fingerprint are one node, whose smallest id stands for it, so copies cost one row each.
    """
    rows = checkpoint(fingerprints(docs).drop("row"))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = checkpoint(classes(rows).join(least, "fp"))
    ids = linked.join(linked.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    return rows.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents, all columns, one row of each component of near copies.

    It is the row with the smallest id, of rows with that id the one with the smallest hash of the whole row; of
    rows equal in every column one stays.  So rows that share an id but not a text both stay, unless their
    texts are near copies.  Rows without an id are all kept; an empty table gives an empty result; further
    columns, of whatever name, are kept as they are.
    """
    rows = checkpoint(fingerprints(docs).where(F.col("doc_id").isNotNull()))
    first = rows.groupBy("fp").agg(F.min(F.struct("doc_id", "row")).alias("first")).join(classes(rows), "fp")
    row, key = fresh(docs, "row"), fresh(docs, "kept_id")
    keep = first.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias(key), F.col("first.row").alias(row + "_kept"))
    marked = docs.where(F.col("doc_id").isNotNull()).withColumn(row, row_hash(docs))
    kept = marked.join(keep, (F.col("doc_id") == F.col(key)) & (F.col(row) == F.col(row + "_kept")), "left_semi")
    if not rows.groupBy("doc_id", "row").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", row])
    return kept.drop(row).unionByName(docs.where(F.col("doc_id").isNull()))
