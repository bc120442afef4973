"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A null text is taken as empty: no ids, and the hashes of nothing.  Repeated rows give repeated results; an
empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Texts above this many code points are encoded in pieces.
PIECE_CHARS = 20_000
#: A safe cut: before a single space between two letters or digits.  The space can only begin a match there
#: (`` ?\\p{L}+`` or `` ?\\p{N}+``), for no match with a letter or digit goes on over a space.
SAFE_CUT = regex.compile(r"(?<=[\p{L}\p{N}])(?= [\p{L}\p{N}])")
#: White space so long that the library's pattern engine runs out of stack on it.  The pattern takes such a run
#: as one match, but for its last character where more text follows.
LONG_BLANK = regex.compile(r"\p{White_Space}{5000,}")


@cache
def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file (base64 token and rank on each line), once for each worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """The text cut at safe boundaries, each at or after a multiple of ``size``; whole where there is none."""
    out, start = [], 0
    while len(text) - start > size and (cut := SAFE_CUT.search(text, start + size)):
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


def encode(enc, text: str | None) -> list[int]:
    """The ids of the text, as the library gives them for the whole."""
    text, ids, start = text or "", [], 0

    def ordinary(part: str) -> None:
        for piece in pieces(part):
            ids.extend(enc.encode_ordinary(piece))

    for blank in LONG_BLANK.finditer(text):
        ordinary(text[start : blank.start()])
        start = blank.end() - (blank.end() < len(text))
        ids.extend(enc._encode_single_piece(text[blank.start() : start]))
    ordinary(text[start:])
    return ids


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded (the bytes that the ids stand for) of every document."""

    def work(batch):
        enc = encoding(path, pattern)
        ids = [encode(enc, t) for t in batch["text"].to_pylist()]
        return [batch["doc_id"], ids, [enc.decode_bytes(x) for x in ids]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), f"doc_id {kind}, ids array<int>, decoded binary", work)


def encoded_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256; ids and bytes are hashed where they are made."""

    def work(batch):
        enc = encoding(path, pattern)
        names = _decimals(enc.n_vocab)
        n, a, b = [], [], []
        for text in batch["text"].to_pylist():
            ids = encode(enc, text)
            n.append(len(ids))
            a.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
            b.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
        return [batch["doc_id"], n, a, b]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", work)


@cache
def _decimals(n: int) -> list[str]:
    return [str(i) for i in range(n + 1)]
