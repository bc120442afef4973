"""LM scoring by prediction by partial matching (PPM, escape method D with symbol exclusion) over bytes.

The model is a trie of byte contexts with counts from the training documents.  A text is its words, A-Z
lowered, each followed by a space, and an end symbol; a byte's context is the ORDER bytes before it, over
words' ends back to the start of the text (where a space is taken to stand before it).  A byte unseen in a
context escapes to the next shorter one, from which all bytes seen in the longer one are excluded; after the
empty context all other bytes are alike.  There is one trie for each of the common values of a column (here the
language of the training rows); a text's probability is their mixture, weighted by their shares of the
training documents, whatever its own value.

Documents are put together in batches of about BATCH_BYTES.  Each batch counts its distinct grams (a byte and its
context) and words; these are summed over all batches by their key.  The tries are then worked out order by order
from the shortest contexts up, by grouping, windows over one context (256 rows at most) and a join with the order
below.  Last, keys and log probabilities are dealt in buckets of about BUCKET_KEYS, each batch is answered what
it asked for, and its documents are summed.  Nothing of the corpus passes through the driver but totals.

A null or empty text is the end symbol alone; very long texts are cut between words into pieces that keep the
bytes before them as context, and summed again; repeated rows are scored alike and count each time in training; an
empty table gives an empty result; other columns, of whatever name, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, id_and_bytes, is_fold, spread

ORDER = 5
#: The end symbol: a byte that no word can hold.
END = b"\n"
#: Stands before a text: a space, and before it nothing.
START = b"\0" * (ORDER - 1) + b" "
#: Bytes of text in one batch, in one piece of a long text, and in what a task works on at once.
BATCH_BYTES, PIECE_BYTES, AT_ONCE = 32 << 20, 4 << 20, 1 << 19
#: Words that a task remembers the counts of before it starts afresh.
REMEMBERED = 100_000
#: Most tries, and the least share of the training documents that a value needs to have its own.
MOST_TRIES, LEAST_SHARE = 6, 0.01
#: Keys of the model in one bucket, and keys asked by all the batches that meet with it in one group.
BUCKET_KEYS, GROUP_KEYS = 200_000, 4_000_000
#: A key is a gram (its symbol in the lowest 8 bits, its context above) with the trie above it, or a word's hash.
GRAM_BITS = 8 * (ORDER + 1)
GRAM, HELD, WORD = (1 << GRAM_BITS) - 1, 7, 1 << 62
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_BATCH = "batch string, docs binary, keys binary, counts binary, size bigint"


def _pack(array: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(array).tobytes(), 3)


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype=kind)


def _pack_planes(array: np.ndarray) -> bytes:
    """The first bytes of all numbers, then their second ones, and so on, so that what they have in common packs well."""
    width = array.dtype.itemsize
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(array).ravel().view(np.uint8).reshape(-1, width).T).tobytes(), 3)


def _unpack_planes(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack_planes(np.diff(keys, prepend=0).astype(np.int64))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack_planes(data, np.int64))


# -- documents -> batches of distinct keys ----------------------------------------------------------------

def pieces_of(raw: bytes | None) -> Iterator[tuple[bytes, bytes]]:
    """(bytes before, bytes) of each piece of the text's spelling: its words, each with a space, then one end."""
    raw, before, start = (raw or b"").lower(), START, 0
    while True:
        cut = _BLANK.search(raw, start + PIECE_BYTES) if len(raw) - start > PIECE_BYTES else None
        words = raw[start : cut.start()].split() if cut else raw[start:].split()
        spelled = b" ".join([*words, b""]) if words else b""
        if not cut:
            yield before, spelled + END
            return
        if spelled:
            yield before, spelled
            before = (before + spelled)[-ORDER:]
        start = cut.end()


def grams_of(pieces: list[tuple[bytes, bytes]]) -> np.ndarray:
    """The code of each byte of the pieces, in order, with its context."""
    raw = np.frombuffer(b"".join(x for piece in pieces for x in piece), dtype=np.uint8).astype(np.int64)
    code = raw.copy()
    for k in range(1, ORDER + 1):
        code[k:] += raw[:-k] << (8 * k)
    lengths = np.fromiter((len(s) + ORDER for _, s in pieces), dtype=np.int64, count=len(pieces))
    place = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return code[place >= ORDER]


def key_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) & (WORD - 1) | WORD


class _Hashes(dict):
    """A word's key."""

    def __missing__(self, word: bytes) -> int:
        key = self[word] = key_of(word)
        return key


class _Values(dict):
    """A word's value, looked up by its key among sorted ones, and remembered for a while."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        super().__init__()
        self.keys_, self.values_ = keys, values

    def __missing__(self, word: bytes) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = float(self.values_[np.searchsorted(self.keys_, key_of(word))])
        return value


def words_of(spelled: bytes) -> list[bytes]:
    return [*spelled.split(), END] if spelled.endswith(END) else spelled.split()


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.diff(np.append(first, len(codes)))


class _Batch:
    """Documents put together until they have BATCH_BYTES: their pieces, and the counts of their keys so far."""

    def __init__(self, name: str, kind: pa.DataType):
        self.name, self.kind, self.size = name, kind, 0
        self.rows: list[tuple] = []
        self.open: dict = {}  # trie -> pieces not counted yet, and their size
        self.keys, self.counts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        self.waiting = 0

    def add(self, uid: str, doc_id, held: bool, trie: int, before: bytes, spelled: bytes) -> None:
        self.rows.append((uid, doc_id, held, before, spelled))
        self.size += len(spelled)
        self.open.setdefault(trie, []).append((before, spelled))
        self.waiting += len(spelled)
        if self.waiting >= AT_ONCE:
            self.count()

    def count(self) -> None:
        hashed = _Hashes()
        for trie, pieces in self.open.items():
            keys, n = _runs(grams_of(pieces))
            self.keys.append(keys + ((trie if trie >= 0 else HELD) << GRAM_BITS))
            self.counts.append(n if trie >= 0 else np.zeros_like(n))
            words = np.fromiter((k for _, s in pieces for k in map(hashed.__getitem__, words_of(s))), dtype=np.int64)
            keys, n = _runs(words)
            self.keys.append(keys)
            self.counts.append(n if trie >= 0 else np.zeros_like(n))
        self.open, self.waiting = {}, 0
        if sum(map(len, self.keys[1:])) > len(self.keys[0]):  # so that each key is put in order a few times at most
            self.sum()

    def sum(self) -> None:
        keys, counts = _summed(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts = [keys], [counts]

    def packed(self) -> tuple:
        self.count()
        self.sum()
        uid, ids, held, before, spelled = zip(*self.rows)
        table = pa.RecordBatch.from_arrays([pa.array(uid), pa.array(ids, type=self.kind), pa.array(held), pa.array(before, type=pa.binary()), pa.array(spelled, type=pa.large_binary())], names=["uid", "doc_id", "held_out", "before", "spelled"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
            out.write_batch(table)
        return self.name, sink.getvalue().to_pybytes(), _pack_sorted(self.keys[0]), _pack(self.counts[0]), len(self.keys[0])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, serial, name = TaskContext.get().partitionId(), 0, 0
    now: _Batch | None = None

    def row(batch: _Batch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip(batch.packed(), (pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64()))], names=["batch", "docs", "keys", "counts", "size"])

    for some in batches:
        for doc_id, raw, held, trie in zip(*(some[c] for c in ("doc_id", "raw", "held_out", "trie"))):
            serial += 1
            for before, spelled in pieces_of(raw.as_py()):
                now = now or _Batch(f"{task}-{name}", some["doc_id"].type)
                now.add(f"{task}-{serial}", doc_id.as_py(), held.as_py(), trie.as_py(), before, spelled)
                if now.size >= BATCH_BYTES:
                    yield row(now)
                    now, name = None, name + 1
    if now:
        yield row(now)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) of every batch."""
    for some in batches:
        for keys, counts in zip(some["keys"].to_pylist(), some["counts"].to_pylist()):
            keys, counts = _unpack_sorted(keys), _unpack(counts, np.int64)
            for a in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 100_000]), pa.array(counts[a : a + 100_000])], names=["key", "n"])


# -- the tries: log probability of every gram -------------------------------------------------------------

def log_probabilities(grams: DataFrame, tries: int) -> DataFrame:
    """gram and s0, s1, ...: log10 P(symbol | context) of each gram in each trie, from its counts n0, n1, ...

    For each order k and trie: n counts the gram of k context bytes, t and d are the total and the kinds of
    symbols in its context, s is the log probability if prediction starts at this order, and w if it goes on
    below it after an escape from this context (with what was seen there excluded).
    """
    per = lambda make: [c for k in range(tries) for c in make(k)]
    n, t, d, s, w = (lambda k, x=x: F.col(f"{x}{k}") for x in "ntdsw")
    least = lambda v: F.greatest(v, F.lit(1))

    def summed(order: int) -> DataFrame:
        if order == ORDER:
            return grams
        return grams.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1)).alias("gram")).agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(tries)))

    def in_context(df: DataFrame, more: list[Column]) -> DataFrame:
        """With t and d of the context, and further sums over it."""
        over = Window.partitionBy(*(["mid"] if "mid" in df.columns else []), F.shiftright("gram", 8))
        return df.select("*", *(F.sum(f"n{k}").over(over).alias(f"t{k}") for k in range(tries)), *(F.sum((n(k) > 0).cast("bigint")).over(over).alias(f"d{k}") for k in range(tries)), *(F.sum(c).over(over).alias(name) for c, name in more))

    # the empty context, of at most 256 symbols; all others are alike
    now = in_context(summed(0), [])
    now = now.select("gram", *per(lambda k: (n(k), t(k), d(k), (-F.log10(least(256 - d(k)))).alias(f"w{k}"))))
    now = now.select("*", *per(lambda k: (F.when(t(k) == 0, w(k)).when(n(k) > 0, F.log10((n(k) - 0.5) / t(k))).otherwise(F.log10(d(k) / 2 / t(k)) + w(k)).alias(f"s{k}"),)))
    for order in range(1, ORDER + 1):
        own = F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1))
        if order <= 2:  # at most 256 and 65,536 rows
            below = now.select(F.col("gram").alias("below"), *per(lambda k: (F.col(f"{x}{k}").alias(f"b{x}{k}") for x in "ntdsw")))
            joined = summed(order).join(F.broadcast(below), own == F.col("below"))
        else:
            # the shorter grams of one context, at most 256, stand in one row of arrays, so that each gram meets one row; the join
            # deals both sides by the shorter context, so that the window over the context finds its rows together
            symbol = F.col("gram").bitwiseAND(F.lit(255)).cast("int")
            each = F.struct(symbol.alias("symbol"), *per(lambda k: (F.col(f"{x}{k}") for x in "nsw")))
            kinds = now.groupBy(F.shiftright("gram", 8).alias("mid")).agg(F.collect_list(each).alias("all"), *per(lambda k: (F.first(f"{x}{k}").alias(f"b{x}{k}") for x in "td")))
            part = lambda name: F.transform("all", lambda x: x[name])
            below = kinds.select("mid", part("symbol").alias("symbols"), *per(lambda k: (part(f"{x}{k}").alias(f"all_{x}{k}") for x in "nsw")), *per(lambda k: (F.col(f"b{x}{k}") for x in "td")))
            mid = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))
            met = summed(order).withColumn("mid", mid).join(below, "mid").withColumn("at", F.array_position("symbols", symbol).cast("int"))
            joined = met.select("mid", "gram", *per(lambda k: (n(k), F.col(f"bt{k}"), F.col(f"bd{k}"), *(F.element_at(f"all_{x}{k}", F.col("at")).alias(f"b{x}{k}") for x in "nsw"))))
        now = in_context(joined, [(F.when(n(k) > 0, F.col(f"bn{k}")).otherwise(0), f"off{k}") for k in range(tries)])

        def escaped(k: int) -> Column:
            kinds, total = F.col(f"bd{k}") - d(k), F.col(f"bt{k}") - F.col(f"off{k}")
            go_on = F.log10(kinds / 2 / total) + F.col(f"bw{k}")
            return F.when(kinds == 0, F.col(f"bw{k}")).when(F.col(f"bn{k}") > 0, F.log10((F.col(f"bn{k}") - 0.5) / total)).otherwise(go_on)

        now = now.select("gram", *per(lambda k: (n(k), t(k), d(k), F.col(f"bs{k}"), F.when(n(k) == 0, escaped(k)).alias(f"w{k}"))))
        now = now.select("gram", *per(lambda k: (n(k), t(k), d(k), w(k), F.when(d(k) == 0, F.col(f"bs{k}")).when(n(k) > 0, F.log10((n(k) - 0.5) / t(k))).otherwise(F.log10(d(k) / 2 / t(k)) + w(k)).alias(f"s{k}"))))
    return now.select("gram", *(s(k) for k in range(tries)))


# -- answers ----------------------------------------------------------------------------------------------

def _asked(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A batch's distinct grams and words in order of their bucket, and the buckets."""
    words = keys >= WORD
    own = np.concatenate([np.unique(keys[~words] & GRAM), keys[words]])
    home = own % buckets
    order = np.argsort(home, kind="stable")
    return own[order], home[order]


def _questions(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for batch, keys in zip(some["batch"].to_pylist(), some["keys"].to_pylist()):
                own, home = _asked(_unpack_sorted(keys), buckets)
                cuts = np.searchsorted(home, np.arange(buckets + 1)).tolist()
                rows = [(batch, b, _pack_sorted(own[x:y])) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
                for a in range(0, len(rows), 100):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*rows[a : a + 100]), (pa.string(), pa.int64(), pa.binary()))], names=["batch", "bucket", "keys"])

    return run


def _bucket_of(pdf: pd.DataFrame, tries: int) -> pd.DataFrame:
    """One bucket of the model: its keys in order and their values (words have theirs in s0)."""
    pdf = pdf.sort_values("key")
    keys = pdf["key"].to_numpy()
    values = pdf[[f"s{k}" for k in range(tries)]].to_numpy(dtype=np.float64)
    at = int(np.searchsorted(keys, WORD))
    return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "keys": [_pack_sorted(keys)], "grams": [_pack_planes(values[:at].astype(np.float32))], "words": [_pack_planes(values[at:, 0])]})


def _answers(pdf: pd.DataFrame, tries: int) -> pd.DataFrame:
    """One bucket and the questions of some batches to it."""
    model, asked = pdf[pdf["batch"].isna()].iloc[0], pdf[pdf["batch"].notna()]
    keys = _unpack_sorted(model["keys"])
    grams, words = _unpack_planes(model["grams"], np.float32).reshape(-1, tries), _unpack_planes(model["words"], np.float64)
    out = []
    for batch, own in zip(asked["batch"], asked["keys"]):
        at = np.searchsorted(keys, _unpack_sorted(own))
        cut = int(np.searchsorted(at, len(grams)))
        out.append((batch, model["bucket"], _pack_planes(grams[at[:cut]]), _pack_planes(words[at[cut:] - len(grams)])))
    return pd.DataFrame(out, columns=["batch", "bucket", "grams", "words"])


def _score_batch(pdf: pd.DataFrame, buckets: int, tries: int) -> pd.DataFrame:
    """One batch: sums over each of its pieces, in each trie, and of the words' log10(count + 1)."""
    own = pdf[pdf["docs"].notna()].iloc[0]
    answers = pdf[pdf["docs"].isna()].sort_values("bucket")
    keys, _ = _asked(_unpack_sorted(own["keys"]), buckets)
    is_word = keys >= WORD
    grams, logs = keys[~is_word], np.concatenate([_unpack_planes(x, np.float32) for x in answers["grams"]]).reshape(-1, tries)
    order = np.argsort(grams)
    grams, logs = grams[order], logs[order]
    order = np.argsort(keys[is_word])
    value = _Values(keys[is_word][order], np.concatenate([_unpack_planes(x, np.float64) for x in answers["words"]])[order])
    docs, out = pa.ipc.open_stream(own["docs"]).read_all(), []
    lengths = pc.binary_length(docs["spelled"]).to_numpy()
    starts = np.unique(np.searchsorted(np.cumsum(lengths), np.arange(0, lengths.sum() + AT_ONCE, AT_ONCE), side="right"))
    for start, end in zip(starts[:-1], starts[1:]):
        some = list(zip(docs["before"][start:end].to_pylist(), docs["spelled"][start:end].to_pylist()))
        # each different gram is looked up once, in order, and the bytes then read from a table that stays in the cache
        kinds, place = np.unique(grams_of(some), return_inverse=True)
        found, here = logs[np.searchsorted(grams, kinds)], lengths[start:end]
        sums = np.column_stack([np.add.reduceat(np.ascontiguousarray(found[:, k])[place], np.cumsum(here) - here, dtype=np.float64) for k in range(tries)])
        for (_, spelled), total in zip(some, sums.tolist()):
            known = [value[word] for word in words_of(spelled)]
            out.append((len(known), sum(v > 0 for v in known), sum(known), *total))
    return pd.DataFrame({
        "uid": docs["uid"].to_pylist(), "doc_id": pd.Series(docs["doc_id"].to_pylist(), dtype=object), "held_out": docs["held_out"].to_pylist(),
        **{name: [r[i] for r in out] for i, name in enumerate(("n_tokens", "n_known", "counted", *(f"s{k}" for k in range(tries))))},
    })


def score_documents(docs: DataFrame, modulus: int = 7, remainder: int = 2, kinds: str | None = "lang") -> DataFrame:
    """doc_id, held_out (in the fold that isn't learnt from), n_tokens, n_known, train_tokens, base_score (add-one
    unigrams) and score (PPM), both log10 probabilities of the whole text.  Words are told apart by 62 bits of a hash."""
    held = is_fold("doc_id", modulus, remainder)
    # a trie for each common value among the training rows, and one for all others
    named: list = []
    shares = [1.0]
    if kinds:
        seen = docs.where(~held).groupBy(kinds).agg(F.count("*").alias("n"))
        every = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        top = seen.where(F.col(kinds).isNotNull() & (F.col("n") >= LEAST_SHARE * every)).orderBy(F.desc("n"), kinds).limit(MOST_TRIES - 1).collect()
        named = [r[kinds] for r in top]
        shares = [*(r["n"] for r in top), every - sum(r["n"] for r in top)]
        if len(shares) > 1 and shares[-1] == 0:
            shares.pop()
    tries = len(shares)
    prior = [(x + 0.5) / (sum(shares) + 0.5 * tries) for x in shares]
    trie = F.lit(tries - 1)
    for k, value in enumerate(named):
        trie = F.when(F.col(kinds).eqNullSafe(F.lit(value)), F.lit(k)).otherwise(trie)
    trie = F.when(held, F.lit(-1)).otherwise(trie).alias("trie")
    kind = docs.schema["doc_id"].dataType.simpleString()
    packed = checkpoint(spread(id_and_bytes(docs, "doc_id", "text", held.alias("held_out"), trie)).mapInArrow(_batches, _BATCH))
    counted = checkpoint(packed.select("keys", "counts").mapInArrow(_counts, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")))
    words = counted.where(F.col("key") >= WORD)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    of = F.shiftright("key", GRAM_BITS)
    grams = counted.where(F.col("key") < WORD).groupBy(F.col("key").bitwiseAND(F.lit(GRAM)).alias("gram")).agg(*(F.sum(F.when(of == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(tries)))
    values = log_probabilities(checkpoint(grams), tries).withColumnRenamed("gram", "key").unionByName(words.select("key", F.log10(F.col("n") + 1).alias("s0"), *(F.lit(0.0).alias(f"s{k}") for k in range(1, tries))))
    # buckets by the size of the model, and of each as many copies as the questions need
    asked = packed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    buckets = counted.count() // BUCKET_KEYS // 2 * 2 + 1  # odd, so that all bytes of a key count
    copies = asked // buckets // GROUP_KEYS + 1
    model = values.withColumn("bucket", F.col("key") % buckets).groupBy("bucket").applyInPandas(lambda pdf: _bucket_of(pdf, tries), "bucket bigint, keys binary, grams binary, words binary")
    model = model.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    questions = packed.select("batch", "keys").mapInArrow(_questions(buckets), "batch string, bucket bigint, keys binary").withColumn("copy", (F.crc32(F.col("batch").cast("binary")) % copies).cast("int"))
    both = questions.unionByName(model, allowMissingColumns=True).groupBy("bucket", "copy")
    answers = both.applyInPandas(lambda pdf: _answers(pdf, tries), "batch string, bucket bigint, grams binary, words binary")
    sums = ", ".join(f"s{k} double" for k in range(tries))
    pieces = packed.select("batch", "docs", "keys").unionByName(answers, allowMissingColumns=True).groupBy("batch").applyInPandas(
        lambda pdf: _score_batch(pdf, buckets, tries), f"uid string, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, counted double, {sums}"
    )
    whole = pieces.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "counted", *(f"s{k}" for k in range(tries)))))
    each = [F.col(f"s{k}") + float(np.log10(prior[k])) for k in range(tries)]
    most = F.greatest(*each) if tries > 1 else each[0]
    score = most + F.log10(sum((F.pow(F.lit(10.0), e - most) for e in each), F.lit(0.0)))
    size = float(np.log10(total.n + total.v + 1))
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total.n)).cast("bigint").alias("train_tokens"), (F.col("counted") - F.col("n_tokens") * size).alias("base_score"), score.alias("score"))
