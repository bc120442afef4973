"""Fingerprints of documents by one-permutation MinHash, in SQL functions only.

Each word shingle is hashed once; the hash's high bits name its bin, and a bin keeps its least hash. An empty bin takes
the value of another, found by optimal densification: it asks bin after bin, in an order drawn for it alone by 2-universal
functions, until one is not empty. Of each bin the low-order bits are stored, one hex digit a bin. Two documents' share of
equal digits, less what equal digits by chance would give, is their likeness (an estimate of the shingles' Jaccard
similarity).

Words are ``[^\\x20\\x09-\\x0D]+``, as they are written; a text of fewer words than a shingle is one shingle. A null text
is the empty text; a text without words has the empty fingerprint, which is like itself (1) and like nothing else (0).
Equal texts have equal fingerprints; further columns, of whatever name, are not read; very long texts are read whole; an
empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, partitions

WORDS, BIN_BITS, DIGIT_BITS = 5, 8, 4
BINS = 1 << BIN_BITS
#: Bins that an empty bin asks in turn; where all are empty, it takes the one of the least hash of both numbers.
PROBES = 24
PRIME = (1 << 31) - 1
_draw = random.Random(11)
#: Factor and offset of each probe: bin b asks (factor * b + offset) mod PRIME mod BINS.
PROBE_AT = [(_draw.randrange(1, PRIME), _draw.randrange(PRIME)) for _ in range(PROBES)]
#: Parts into which the ids are cut for each shuffle partition, so that their sizes even out.
CUTS = 4


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once for each row."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """XXH64 of every shingle's word hashes, as an array; repeats are kept, a text without words has none."""
    hashes = F.transform(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(words))))
        return F.when(F.size(h) >= words, many).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return _with(hashes, shingles)


def _bin(h: Column) -> Column:
    return (F.shiftright(h, 64 - BIN_BITS) + BINS // 2).cast("int")


def _digit(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).cast("int")


def least_of_bins(hashes: Column) -> Column:
    """The least hash of each bin that has one, by bin: sorted, a bin's hashes lie together, the least first."""
    return _with(F.sort_array(hashes), lambda s: F.filter(s, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(s, i - 1)))))


def densified(least: Column) -> Column:
    """The digit of every bin, empty ones filled, from the least hashes (at least one)."""

    def spread(m: Column) -> Column:
        before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(_bin(F.get(m, i - 1)))
        own = F.transform(m, lambda h, i: F.concat(F.array_repeat(F.lit(None).cast("int"), _bin(h) - before(i) - 1), F.array(_digit(h))))
        after = F.array_repeat(F.lit(None).cast("int"), F.lit(BINS - 1) - _bin(F.element_at(m, -1)))
        return F.concat(F.flatten(own), after)

    def fill(bins: Column, m: Column) -> Column:
        ask = lambda b, factor, offset: F.get(bins, ((F.lit(factor) * b.cast("bigint") + F.lit(offset)) % F.lit(PRIME) % F.lit(BINS)).cast("int"))
        rest = lambda b: F.array_min(F.transform(m, lambda h: F.struct(F.xxhash64(b, _bin(h)).alias("rank"), _digit(h).alias("digit"))))["digit"]
        return F.transform(bins, lambda v, b: F.coalesce(v, *(ask(b, f, o) for f, o in PROBE_AT), rest(b)))

    return _with(least, lambda m: _with(spread(m), lambda bins: fill(bins, m)))


def fingerprint(text: Column) -> Column:
    """One hex digit for each bin; empty for a null text or one without words."""
    return _with(
        least_of_bins(shingle_hashes(F.coalesce(text, F.lit("")))),
        lambda m: F.when(F.size(m) == 0, F.lit("")).otherwise(F.array_join(F.transform(densified(m), lambda d: F.lower(F.hex(d))), "")),
    )


def packed(digits: Column) -> Column:
    """The fingerprint's bits, two bins to a byte."""
    return F.unhex(digits)


def likeness(x: Column, y: Column) -> Column:
    """Estimated Jaccard similarity (0 to 1) of two fingerprints: equal digits, less those that are equal by chance."""
    equal = F.size(F.filter(F.zip_with(F.split(x, ""), F.split(y, ""), lambda a, b: a == b), lambda same: same)) / F.lit(float(BINS))
    chance = 1.0 / (1 << DIGIT_BITS)
    return F.when(x == y, F.lit(1.0)).when((x == "") | (y == ""), F.lit(0.0)).otherwise(F.greatest((equal - chance) / (1 - chance), F.lit(0.0)))


def with_next(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text and more) with ``next``: the row that follows by descending doc_id, as a struct.

    Null ids come last, rows that share an id are ordered by a hash of their texts, and after the last row comes the
    first. The texts are shuffled once: ids and hashes are sorted first, which gives the place where each part of
    the order ends (one key for each part reaches the driver); the row that ends a part is also dealt to the part
    above it, as the next of that part's last row.
    """
    n_parts = CUTS * partitions(rows.sparkSession)
    place = F.struct(F.col("doc_id").isNotNull().alias("has_id"), F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")).alias("place")
    keys = checkpoint(rows.select(place))
    ends = [r["end"] for r in keys.repartitionByRange(n_parts, "place").groupBy(F.spark_partition_id()).agg(F.max("place").alias("end")).orderBy("end").collect()]
    kind = rows.schema["doc_id"].dataType
    bounds = F.array(*(F.struct(F.lit(e["has_id"]).alias("has_id"), F.lit(e["doc_id"]).cast(kind).alias("doc_id"), F.lit(e["tie"]).alias("tie")) for e in ends))
    columns = [F.col(c) for c in rows.columns]
    if not ends:
        return rows.select(*columns, F.struct(*columns).alias("next"))
    own = rows.withColumn("place", place).withColumn("part", F.size(F.filter(bounds, lambda e: e < F.col("place"))))
    above = F.when(F.get(bounds, F.col("part")) == F.col("place"), (F.col("part") + 1) % len(ends))
    dealt = own.withColumn("dealt", F.explode(F.filter(F.array(F.struct(F.col("part").alias("to"), F.lit(True).alias("stays")), F.struct(above.alias("to"), F.lit(False).alias("stays"))), lambda x: x["to"].isNotNull())))
    order = Window.partitionBy("dealt.to").orderBy("dealt.stays", "place")
    return dealt.withColumn("next", F.lag(F.struct(*columns)).over(order)).where("dealt.stays").select(*columns, "next")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points) and fingerprint of every document."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.length(text).cast("bigint").alias("n_chars"), fingerprint(text).alias("fingerprint"))


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, whose last half is the next document's beginning.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next: the likeness of the
    document's fingerprint to the edited text's and to the next document's. A sole document is its own next one.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("fingerprint", fingerprint(F.col("text"))))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), edited.alias("edited"), "fingerprint", F.col("next.fingerprint").alias("next_fingerprint"))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    near = lambda other: likeness(F.col("fingerprint"), F.col(other))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"),
    )
