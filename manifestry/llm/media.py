"""Media columns: ISO base media containers, written and read by their boxes.

``wrap`` stores a payload losslessly as 8-bit samples of an ISO media file.  ``walk`` goes through nested boxes,
``tracks`` decodes the sample tables to codec, duration and the byte ranges of samples and keyframes, without
touching the payload.  Fragments (``moof``) are read as well: the runs of samples (``trun``) add to their track.

A null text is taken as empty (one frame of padding); equal texts give equal files; a long text's tables have a
row for each frame.  Of a damaged file, or one that is no ISO media file, what the boxes still say is given:
a table whose count does not fit its box, or samples that are not within the file, give no track; nothing is
raised.  Repeated rows are treated alike; further columns, of whatever name, are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import id_and_bytes, map_batches

#: Bytes of one sample (frame), samples in a chunk, and every how many samples a keyframe stands.
FRAME, CHUNK, KEY_EVERY, RATE, PADDING = 576, 16, 12, 8000, 255
#: Boxes whose content is boxes, and the bytes before the first of them.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0, b"moof": 0, b"traf": 0, b"mvex": 0}
#: Levels of boxes that are entered.
DEEPEST = 32
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full_box(kind: bytes, *content: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *content)


def pad(raw: bytes) -> bytes:
    """The bytes and 255s up to a positive multiple of FRAME."""
    return raw + bytes([PADDING]) * (FRAME - len(raw) % FRAME if len(raw) % FRAME or not raw else 0)


def wrap(payload: bytes) -> bytes:
    """An ISO media file of one raw 8-bit track, FRAME bytes to a sample; payload is a multiple of FRAME."""
    n = len(payload) // FRAME
    chunks = -(-n // CHUNK)
    length = n * FRAME
    u32 = lambda *v: struct.pack(f">{len(v)}I", *v)
    table = lambda v: np.asarray(v, dtype=">u4").tobytes()
    ftyp = box(b"ftyp", b"isom", u32(512), b"isommp41")

    def moov(first: int) -> bytes:
        entry = box(b"raw ", bytes(6), struct.pack(">HHIHHHHI", 1, 0, 0, 1, 8, 0, 0, RATE << 16))
        last = n - (chunks - 1) * CHUNK
        runs = [(1, CHUNK, 1)] * (chunks > 1 or last == CHUNK) + [(chunks, last, 1)] * (last != CHUNK)
        keys = np.arange(1, n + 1, KEY_EVERY)
        stbl = box(
            b"stbl",
            full_box(b"stsd", u32(1), entry),
            full_box(b"stts", u32(1, n, FRAME)),
            full_box(b"stsc", u32(len(runs)), b"".join(u32(*r) for r in runs)),
            full_box(b"stsz", u32(FRAME, n)),
            full_box(b"stss", u32(len(keys)), table(keys)),
            full_box(b"co64", u32(chunks), (first + np.arange(chunks) * (CHUNK * FRAME)).astype(">u8").tobytes()),
        )
        dinf = box(b"dinf", full_box(b"dref", u32(1), full_box(b"url ", flags=1)))
        minf = box(b"minf", full_box(b"smhd", u32(0)), dinf, stbl)
        mdia = box(b"mdia", full_box(b"mdhd", u32(0, 0, RATE, length), struct.pack(">HH", 0x55C4, 0)), full_box(b"hdlr", u32(0), b"soun", bytes(12), b"samples\0"), minf)
        tkhd = full_box(b"tkhd", u32(0, 0, 1, 0, length), bytes(8), struct.pack(">hhhH", 0, 0, 0x100, 0), _MATRIX, u32(0, 0), flags=7)
        mvhd = full_box(b"mvhd", u32(0, 0, RATE, length, 0x10000), struct.pack(">H", 0x100), bytes(10), _MATRIX, bytes(24), u32(2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    first = len(ftyp) + len(moov(0)) + 16
    return ftyp + moov(first) + struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) + payload


def walk(media: bytes, start: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path, first byte of the content, end) of every box, parents first. A size of 0 reaches to the end; 1
    has the size in 8 further bytes. A size that doesn't fit its parent ends the walk of that parent; boxes below
    DEEPEST levels are not entered."""
    todo = [(start, len(media) if end is None else end, path)]
    while todo:
        start, end, path = todo.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", media, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", media, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            continue
        here = (*path, kind)
        yield here, start + head, start + size
        todo.append((start + size, end, path))
        if kind in CONTAINERS and len(here) < DEEPEST:
            todo.append((start + head + CONTAINERS[kind], start + size, here))


@dataclass(frozen=True)
class Track:
    codec: str
    timescale: int
    duration: int
    offsets: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray  # indices of the samples that are keyframes


def _none() -> np.ndarray:
    return np.zeros(0, dtype=np.int64)


class _Box:
    """The content of a full box: numbers at places after its version and flags, none beyond its end."""

    def __init__(self, media: bytes, at: tuple[int, int]):
        self.media, self.at, self.end = media, *at
        self.version = media[self.at] if self.at < self.end else 0
        self.flags = self.number(0) & 0xFFFFFF if self.end - self.at >= 4 else 0

    def number(self, at: int, kind: str = ">I") -> int:
        if self.at + at + struct.calcsize(kind) > self.end:
            raise _Damaged
        return struct.unpack_from(kind, self.media, self.at + at)[0]

    def array(self, at: int, n: int, kind: str = ">u4") -> np.ndarray:
        if self.at + at + n * np.dtype(kind).itemsize > self.end:
            raise _Damaged
        return np.frombuffer(self.media, dtype=kind, count=n, offset=self.at + at).astype(np.int64)


class _Damaged(Exception):
    """A table that does not fit its box."""


def tracks(media: bytes) -> list[Track]:
    """Every track's samples, by its sample tables and the fragments; damaged tracks are left out."""
    found, fragments, defaults = [], [], {}
    for path, a, b in walk(media):
        kind = path[-1]
        if kind == b"trak":
            found.append({})
        elif b"trak" in path and found:
            found[-1].setdefault(kind, (a, b))
        elif kind == b"trex":
            defaults.setdefault(_number(media, (a, b), 4), (a, b))
        elif kind == b"moof":
            first = a - 8 if media[a - 4 : a] == b"moof" else a - 16
            fragments.append([first, []])
        elif kind == b"traf" and fragments:
            fragments[-1][1].append([])
        elif b"traf" in path and fragments and fragments[-1][1]:
            fragments[-1][1][-1].append((kind, (a, b)))
    runs = _runs(media, fragments, defaults)
    out = []
    for boxes in found:
        try:
            out.append(_track(media, boxes, runs))
        except _Damaged:
            continue
    return [t for t in out if t is not None]


def _number(media: bytes, at: tuple[int, int], place: int) -> int | None:
    try:
        return _Box(media, at).number(place)
    except _Damaged:
        return None


def _track(media: bytes, boxes: dict, runs: dict) -> Track | None:
    if not {b"mdhd", b"stsd", b"stsc"} <= boxes.keys() or not boxes.keys() & {b"stsz", b"stz2"} or not boxes.keys() & {b"stco", b"co64"}:
        return None
    of = {k: _Box(media, v) for k, v in boxes.items()}
    head = of[b"mdhd"]
    timescale, duration = (head.number(20), head.number(24, ">Q")) if head.version == 1 else (head.number(12), head.number(16))
    codec = bytes(of[b"stsd"].array(12, 4, ">u1").astype(np.uint8)).decode("latin-1")
    sizes = _sizes(media, of)
    n = len(sizes)
    chunks = of[b"co64"] if b"co64" in of else of[b"stco"]
    chunk_at = chunks.array(8, chunks.number(4), ">u8" if b"co64" in of else ">u4")
    filled = of[b"stsc"].array(8, 3 * of[b"stsc"].number(4)).reshape(-1, 3)
    chunks_of = np.diff(np.append(filled[:, 0], len(chunk_at) + 1))
    if len(filled) and (filled[0, 0] != 1 or (chunks_of < 0).any() or (filled[:, 1] * chunks_of).sum() < n) or not len(filled) and n:
        raise _Damaged
    per_chunk = np.minimum(np.repeat(filled[:, 1], chunks_of), n)
    first = np.minimum(np.cumsum(per_chunk) - per_chunk, n)
    chunk = np.repeat(np.arange(len(per_chunk)), np.minimum(per_chunk, n - first))
    before = np.append(np.cumsum(sizes) - sizes, sizes.sum())
    offsets = chunk_at[chunk] + before[:-1] - before[first][chunk]
    keys = of[b"stss"].array(8, of[b"stss"].number(4)) - 1 if b"stss" in of else np.arange(n)
    if len(keys) and (keys.min() < 0 or keys.max() >= n):
        raise _Damaged
    name = None
    if b"tkhd" in of:
        name = of[b"tkhd"].number(20 if of[b"tkhd"].version == 1 else 12)
    for run in runs.get(name, ()) if name is not None else ():
        if run is None:
            raise _Damaged
        keys = np.concatenate([keys, run.keys + len(offsets)])
        offsets, sizes = np.concatenate([offsets, run.offsets]), np.concatenate([sizes, run.sizes])
        duration += run.duration
    if len(offsets) and (offsets.min() < 0 or sizes.sum() > len(media) or (offsets > len(media) - sizes).any()):
        raise _Damaged
    return Track(codec, timescale, duration, offsets, sizes, keys)


def _sizes(media: bytes, of: dict[bytes, _Box]) -> np.ndarray:
    """Each sample's size: one for all, a table of four bytes each (``stsz``), or a compact one of 4, 8 or 16 bits (``stz2``)."""
    if b"stsz" in of:
        same, n = of[b"stsz"].number(4), of[b"stsz"].number(8)
        if same and n * same > len(media):
            raise _Damaged
        return np.full(n, same, dtype=np.int64) if same else of[b"stsz"].array(12, n)
    bits, n = of[b"stz2"].number(4) & 0xFF, of[b"stz2"].number(8)
    if bits == 4:
        pairs = of[b"stz2"].array(12, -(-n // 2), ">u1")
        return np.column_stack([pairs >> 4, pairs & 15]).reshape(-1)[:n]
    if bits not in (8, 16):
        raise _Damaged
    return of[b"stz2"].array(12, n, f">u{bits // 8}")


@dataclass(frozen=True)
class Run:
    """The samples of one ``traf``."""

    offsets: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray
    duration: int
    end: int  # where its data ends


def _runs(media: bytes, fragments: list, defaults: dict) -> dict[int, list[Run | None]]:
    """By track the samples of its fragments in order; None stands for a damaged one.

    Places count from what ``tfhd`` states; or else from the ``moof``, if it says so or is the first of its moof; or
    else from where the data of the ``traf`` before it ends, whichever track that belongs to.
    """
    out: dict = {}
    for start, pieces in fragments:
        end: int | None = start
        for boxes in pieces:
            owner = next((_number(media, at, 4) for kind, at in boxes if kind == b"tfhd"), None)
            try:
                run = _run(media, start, end, boxes, defaults.get(owner))
                end = run.end
            except _Damaged:
                run, end = None, None
            if owner is not None:
                out.setdefault(owner, []).append(run)
    return out


def _run(media: bytes, start: int, before: int | None, boxes: list, default: tuple[int, int] | None) -> Run:
    """Offsets, sizes and durations of the samples of one ``traf``, and which are keyframes (not marked as depending on others).

    A run without a place goes on where the one before it ended.  What is not in the run is that of ``tfhd``, or else
    of ``trex``.
    """
    length, size, flags, base = 0, 0, 0, before
    if default is not None:
        length, size, flags = (_Box(media, default).number(p) for p in (12, 16, 20))
    offsets, sizes, keys, seen, duration = [_none()], [_none()], [_none()], 0, 0
    at = base
    for kind, place in boxes:
        box = _Box(media, place)
        if kind == b"tfhd":
            p = 8
            if box.flags & 0x20000:
                base = at = start
            for bit, name, width in ((0x1, "base", 8), (0x2, "entry", 4), (0x8, "length", 4), (0x10, "size", 4), (0x20, "flags", 4)):
                if box.flags & bit:
                    value = box.number(p, ">Q" if width == 8 else ">I")
                    p += width
                    if name == "base":
                        base = at = value
                    elif name == "length":
                        length = value
                    elif name == "size":
                        size = value
                    elif name == "flags":
                        flags = value
        elif kind == b"trun":
            n, p = box.number(4), 8
            if base is None:
                raise _Damaged
            if box.flags & 0x1:
                at = base + box.number(p, ">i")
                p += 4
            first = None
            if box.flags & 0x4:
                first = box.number(p)
                p += 4
            fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if box.flags & bit]
            if not fields and n * max(size, 1) > len(media):
                raise _Damaged
            table = box.array(p, n * len(fields)).reshape(n, len(fields))
            s = table[:, fields.index(0x200)] if 0x200 in fields else np.full(n, size, dtype=np.int64)
            f = table[:, fields.index(0x400)] if 0x400 in fields else np.full(n, flags, dtype=np.int64)
            if first is not None and n:
                f = np.concatenate([[first], f[1:]])
            offsets.append(at + np.cumsum(s) - s)
            sizes.append(s)
            keys.append(seen + np.flatnonzero(f & 0x10000 == 0))
            duration += int(table[:, fields.index(0x100)].sum()) if 0x100 in fields else n * length
            seen += n
            at += int(s.sum())
    return Run(np.concatenate(offsets), np.concatenate(sizes), np.concatenate(keys), duration, start if at is None else at)


def payload_of(media: bytes, track: Track) -> bytes:
    """The samples' bytes in order; samples that lie end to end are taken in one piece."""
    if not len(track.offsets):
        return b""
    ends = track.offsets + track.sizes
    cuts = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    return b"".join(media[a:b] for a, b in zip(track.offsets[np.concatenate([[0], cuts])].tolist(), ends[np.append(cuts - 1, len(ends) - 1)].tolist()))


def keyframe_ranges(track: Track) -> list[tuple[int, int]]:
    return list(zip(track.offsets[track.keys].tolist(), track.sizes[track.keys].tolist()))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's bytes, padded, as an ISO media file."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch):
        raw = [x or b"" for x in batch["raw"].to_pylist()]
        return [batch["doc_id"], [len(x) for x in raw], [wrap(pad(x)) for x in raw]]

    return map_batches(id_and_bytes(docs), f"doc_id {kind}, n_bytes bigint, media binary", work)


def describe(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and, from the stored bytes: codec, timescale, duration, samples, keyframes (offset and size
    of each), the payload's size, hash and tail checksum, all of the first track, the file's own size and hash, and
    ``tracks``, all of them by codec, timescale, duration, samples and keyframes."""
    kind = media.schema["doc_id"].dataType.simpleString()

    def work(batch):
        rows = []
        for m in batch["media"].to_pylist():
            found = tracks(m or b"")
            t = found[0] if found else Track("", 0, 0, _none(), _none(), _none())
            p = payload_of(m, t)
            seen = [{"codec": x.codec, "timescale": x.timescale, "duration": x.duration, "samples": len(x.sizes), "keyframes": [{"offset": a, "size": b} for a, b in keyframe_ranges(x)]} for x in found]
            first = seen[0]["keyframes"] if seen else []
            rows.append((t.codec, t.timescale, t.duration, len(t.sizes), first, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m or b""), hashlib.sha256(m or b"").hexdigest(), seen))
        return [batch["doc_id"], batch["n_bytes"], *([r[k] for r in rows] for k in range(11))]

    return map_batches(
        media,
        f"doc_id {kind}, n_bytes bigint, codec string, timescale bigint, duration bigint, samples bigint, keyframes array<struct<offset: bigint, size: bigint>>, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, "
        "tracks array<struct<codec: string, timescale: bigint, duration: bigint, samples: bigint, keyframes: array<struct<offset: bigint, size: bigint>>>>",
        work,
    )
