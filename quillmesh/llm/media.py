"""Media columns: ISO media containers, walked and described without decoding payloads.

``describe`` walks nested boxes, decodes each track's own sample tables and its fragments' runs, and gives codec, duration
and the byte ranges of keyframes of every track. ``store`` makes such a container of any payload, as 8-bit audio samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a table sample that ``store`` writes; table samples of a chunk; distance of keyframes; frames a second.
UNIT, PER_CHUNK, KEY_EVERY, RATE = 576, 16, 8, 8000
PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta", b"dinf", b"moof", b"traf", b"mvex"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 2**32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, flags: int, *parts: bytes, version: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def store(payload: bytes) -> bytes:
    """A container whose one track holds the payload (a positive multiple of UNIT bytes) as raw 8-bit samples."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"the payload must be a positive multiple of {UNIT} bytes")
    count = len(payload) // UNIT
    chunks = -(-count // PER_CHUNK)
    matrix = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    brand = box(b"ftyp", b"qt  ", struct.pack(">I", 512), b"qt  isom")
    length = len(payload)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    runs = [(1, PER_CHUNK, 1)] if chunks > 1 or count == PER_CHUNK else []
    if (rest := count - (chunks - 1) * PER_CHUNK) != PER_CHUNK:
        runs.append((chunks, rest, 1))
    keys = np.arange(1, count + 1, KEY_EVERY, dtype=">u4")

    def movie(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * (UNIT * PER_CHUNK)
        wide = first + length >= 2**32
        table = box(
            b"stbl",
            full(b"stsd", 0, struct.pack(">I", 1), entry),
            full(b"stts", 0, struct.pack(">III", 1, count, UNIT)),
            full(b"stsc", 0, struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", 0, struct.pack(">II", UNIT, count)),
            full(b"co64" if wide else b"stco", 0, struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
            full(b"stss", 0, struct.pack(">I", len(keys)), keys.tobytes()),
        )
        # Version 1 headers have 64-bit durations.
        track = box(
            b"trak",
            full(b"tkhd", 7, struct.pack(">QQIIQ8xhhhH", 0, 0, 1, 0, length, 0, 0, 0x100, 0), matrix, bytes(8), version=1),
            box(
                b"mdia",
                full(b"mdhd", 0, struct.pack(">QQIQHH", 0, 0, RATE, length, 0x55C4, 0), version=1),
                full(b"hdlr", 0, bytes(4), b"soun", bytes(12), b"\0"),
                box(b"minf", full(b"smhd", 0, bytes(4)), box(b"dinf", full(b"dref", 0, struct.pack(">I", 1), full(b"url ", 1))), table),
            ),
        )
        header = full(b"mvhd", 0, struct.pack(">QQIQIH10x", 0, 0, RATE, length, 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", header, track)

    size = len(movie(0))
    lead = 8 if length + 8 < 2**32 else 16
    return brand + movie(len(brand) + size + lead) + box(b"mdat", payload)


@dataclass
class Track:
    number: int = 0
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def key_ranges(self) -> list[tuple[int, int]]:
        """Byte ranges of keyframes, end exclusive."""
        at = self.offsets[self.keys]
        return list(zip(at.tolist(), (at + self.sizes[self.keys]).tolist(), strict=True))


class Malformed(ValueError):
    """The bytes aren't a sound container."""


def walk(data: bytes, at: int = 0, stop: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Paths and content bounds of all boxes, parents before children; depth is bounded by PARENTS' nesting."""
    stop = len(data) if stop is None else stop
    while at < stop:
        if at + 8 > stop:
            raise Malformed("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > stop:
                raise Malformed("a box header is cut off")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = stop - at
        if size < head or at + size > stop:
            raise Malformed(f"the length of {kind!r} doesn't fit")
        here = (*path, kind)
        yield here, at + head, at + size
        if kind in PARENTS and len(here) < 16:
            yield from walk(data, at + head, at + size, here)
        at += size


def fields(form: str, data: bytes, at: int, stop: int) -> tuple:
    """Fields of a box, which end where it does."""
    if at + struct.calcsize(form) > stop:
        raise Malformed("a box ends within its fields")
    return struct.unpack_from(form, data, at)


def numbers(data: bytes, at: int, stop: int, count: int, kind: str) -> np.ndarray:
    if at + count * np.dtype(kind).itemsize > stop:
        raise Malformed("a table is cut off")
    return np.frombuffer(data, kind, count, at).astype(np.int64)


def compact(data: bytes, at: int, stop: int, count: int, bits: int) -> np.ndarray:
    """Sizes of a compact table: 4, 8 or 16 bits each."""
    if bits == 4:
        pairs = numbers(data, at, stop, -(-count // 2), "u1")
        return np.column_stack([pairs >> 4, pairs & 15]).ravel()[:count]
    if bits not in (8, 16):
        raise Malformed(f"sizes of {bits} bits")
    return numbers(data, at, stop, count, f">u{bits // 8}")


def sampled(data: bytes, tables: dict[bytes, tuple[int, int]]) -> Track:
    """A track from the boxes of its own ``trak``."""
    track = Track()
    at, stop = tables[b"mdhd"]
    track.timescale, track.duration = fields(">20xIQ" if fields("B", data, at, stop)[0] else ">12xII", data, at, stop)
    if b"tkhd" in tables:
        at, stop = tables[b"tkhd"]
        track.number = fields(">20xI" if fields("B", data, at, stop)[0] else ">12xI", data, at, stop)[0]
    at, stop = tables[b"stsd"]
    track.codec = fields("4s", data, at + 12, stop)[0].decode("latin-1")
    if b"stsz" in tables:
        at, stop = tables[b"stsz"]
        same, count = fields(">II", data, at + 4, stop)
        if same and count * same > len(data):
            raise Malformed("the samples don't fit")
        track.sizes = np.full(count, same, np.int64) if same else numbers(data, at + 12, stop, count, ">u4")
    elif b"stz2" in tables:
        at, stop = tables[b"stz2"]
        bits, count = fields(">xxxBI", data, at + 4, stop)
        track.sizes = compact(data, at + 12, stop, count, bits)
    wide = b"co64" in tables
    at, stop = tables[b"co64" if wide else b"stco"]
    chunk = numbers(data, at + 8, stop, fields(">I", data, at + 4, stop)[0], ">u8" if wide else ">u4")
    at, stop = tables[b"stsc"]
    runs = numbers(data, at + 8, stop, 3 * fields(">I", data, at + 4, stop)[0], ">u4").reshape(-1, 3)
    reach = np.diff(np.append(runs[:, 0], len(chunk) + 1))
    if len(runs) and (runs[0, 0] != 1 or (reach < 0).any()) or (runs[:, 1] * reach).sum() != len(track.sizes):
        raise Malformed("chunks and samples don't agree")
    per = np.repeat(runs[:, 1], reach)
    first = np.cumsum(per) - per
    before = np.cumsum(track.sizes) - track.sizes
    track.offsets = np.repeat(chunk, per) + before - np.repeat(before[np.minimum(first, len(before) - 1)], per) if len(before) else before
    # Offsets of 64 bits can pass for negative ones.
    if len(before) and not 0 <= track.offsets.min() <= (track.offsets + track.sizes).max() <= len(data):
        raise Malformed("a sample lies outside the file")
    if b"stss" in tables:
        at, stop = tables[b"stss"]
        track.keys = numbers(data, at + 8, stop, fields(">I", data, at + 4, stop)[0], ">u4") - 1
        if len(track.keys) and not 0 <= track.keys.min() <= track.keys.max() < len(track.sizes):
            raise Malformed("a keyframe isn't among the samples")
    else:
        track.keys = np.arange(len(track.sizes))
    return track


#: Flags of fragment headers and runs, of samples that are no keyframes, and the order of a run's optional fields.
BASE_GIVEN, DESCRIPTION_GIVEN, DURATION_GIVEN, SIZE_GIVEN, FLAGS_GIVEN = 0x1, 0x2, 0x8, 0x10, 0x20
OFFSET_IN_RUN, FIRST_FLAGS_IN_RUN, RUN_FIELDS = 0x1, 0x4, (0x100, 0x200, 0x400, 0x800)
NO_KEY = 0x10000


class Fragments:
    """Samples that movie fragments add to the tracks."""

    def __init__(self, data: bytes, tracks: list[Track], defaults: dict[int, tuple[int, int, int]]):
        self.data, self.defaults = data, defaults
        self.tracks = {t.number: t for t in reversed(tracks)}
        self.start = self.next = self.base = 0
        self.now: Track | None = None
        self.usual = (0, 0, 0)

    def header(self, at: int, stop: int) -> None:
        """A track fragment's header: its track, base offset and defaults."""
        flags, number = fields(">II", self.data, at, stop)
        flags &= 0xFFFFFF
        at += 8
        self.now = self.tracks.get(number)
        self.base, usual = self.start, list(self.defaults.get(number, (0, 0, 0)))
        if flags & BASE_GIVEN:
            self.base, at = fields(">Q", self.data, at, stop)[0], at + 8
        at += 4 * bool(flags & DESCRIPTION_GIVEN)
        for k, bit in enumerate((DURATION_GIVEN, SIZE_GIVEN, FLAGS_GIVEN)):
            if flags & bit:
                usual[k], at = fields(">I", self.data, at, stop)[0], at + 4
        if self.base > len(self.data):
            raise Malformed("a fragment's base lies outside the file")
        self.usual, self.next = (usual[0], usual[1], usual[2]), self.base

    def run(self, at: int, stop: int) -> None:
        """A run of samples, which follow each other in the file."""
        if self.now is None:
            return
        flags, count = fields(">II", self.data, at, stop)
        flags &= 0xFFFFFF
        at += 8
        begin = self.next
        if flags & OFFSET_IN_RUN:
            begin, at = self.base + fields(">i", self.data, at, stop)[0], at + 4
        first = None
        if flags & FIRST_FLAGS_IN_RUN:
            first, at = fields(">I", self.data, at, stop)[0], at + 4
        given = [bit for bit in RUN_FIELDS if flags & bit]
        if not given and count * max(1, self.usual[1]) > len(self.data):
            raise Malformed("the samples don't fit")
        rows = numbers(self.data, at, stop, count * len(given), ">u4").reshape(count, len(given))

        def column(k: int) -> np.ndarray:
            return rows[:, given.index(RUN_FIELDS[k])] if RUN_FIELDS[k] in given else np.full(count, self.usual[k], np.int64)

        sizes, marks = column(1), column(2).copy()
        if first is not None and count:
            marks[0] = first
        offsets = begin + np.cumsum(sizes) - sizes
        self.next = int(begin + sizes.sum())
        if count and not 0 <= begin <= self.next <= len(self.data):
            raise Malformed("a sample lies outside the file")
        t = self.now
        t.keys = np.append(t.keys, len(t.sizes) + np.flatnonzero(marks & NO_KEY == 0))
        t.sizes, t.offsets = np.append(t.sizes, sizes), np.append(t.offsets, offsets)
        t.duration += int(column(0).sum())


def tracks(data: bytes) -> list[Track]:
    """All tracks of a container, each from its own boxes, then its fragments; Malformed where they don't fit together.

    Tracks without sample tables (as such of a reserved kind) are left out.
    """
    scopes: list[dict[bytes, tuple[int, int]]] = []
    defaults: dict[int, tuple[int, int, int]] = {}
    parts: list[tuple[bytes, int, int]] = []
    for path, at, stop in walk(data):
        if path == (b"moov", b"trak"):
            scopes.append({})
        elif path[:2] == (b"moov", b"trak"):
            scopes[-1].setdefault(path[-1], (at, stop))
        elif path == (b"moov", b"mvex", b"trex") and stop - at >= 24:
            number, _, *usual = fields(">5I", data, at + 4, stop)
            defaults[number] = (usual[0], usual[1], usual[2])
        elif path[0] == b"moof":
            parts.append((path[-1], at, stop))
    try:
        found = [sampled(data, x) for x in scopes if {b"stbl", b"stsd", b"mdhd", b"stsc"} <= x.keys()]
        if not found:
            raise Malformed("there is no sample table")
        fragments = Fragments(data, found, defaults)
        for kind, at, stop in parts:
            if kind == b"moof":
                fragments.start = at - (8 if data[at - 4 : at] == b"moof" else 16)
            elif kind == b"tfhd":
                fragments.header(at, stop)
            elif kind == b"trun":
                fragments.run(at, stop)
    except Malformed:
        raise
    except (struct.error, KeyError, IndexError, OverflowError, ValueError) as e:
        raise Malformed(f"a table is missing or cut off: {e}") from e
    return found


def probe(data: bytes) -> Track:
    """The first track of a container."""
    return tracks(data)[0]


def read_back(data: bytes, track: Track) -> bytes:
    """The samples' bytes, found by the tables, in order; runs of adjacent samples are read at once."""
    if not len(track.sizes):
        return b""
    stop = track.offsets + track.sizes
    cut = np.flatnonzero(track.offsets[1:] != stop[:-1]) + 1
    begin, end = track.offsets[np.append(0, cut)], stop[np.append(cut - 1, len(stop) - 1)]
    return b"".join(data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True))


def describe(table: DataFrame, media: str = "media") -> DataFrame:
    """All columns of ``table`` and media_codec, media_seconds, media_samples, media_keyframes (byte ranges, end exclusive) of the
    first track, media_tracks (the same of every track) and media_error.

    A null or malformed container has null columns and the reason in media_error; a column of such a name is replaced.
    """
    one = "codec:string,seconds:double,samples:long,keyframes:array<struct<start:long,end:long>>"
    made = f"struct<{one},tracks:array<struct<{one}>>,error:string>"

    def shown(t: Track) -> dict:
        return {"codec": t.codec, "seconds": t.duration / t.timescale if t.timescale else None, "samples": len(t.sizes), "keyframes": [{"start": a, "end": b} for a, b in t.key_ranges()]}

    @F.pandas_udf(made)
    def look(values: pd.Series) -> pd.DataFrame:
        rows = []
        for data in values:
            try:
                if data is None:
                    raise Malformed("null")
                every = [shown(t) for t in tracks(bytes(data))]
                rows.append((*every[0].values(), every, None))
            except Malformed as e:
                rows.append((None, None, None, None, None, str(e)))
        return pd.DataFrame(rows, columns=["codec", "seconds", "samples", "keyframes", "tracks", "error"]).astype({"samples": "Int64"})

    names = ("codec", "seconds", "samples", "keyframes", "tracks", "error")
    found = table.withColumn("media_", look(F.col(media)))
    return found.withColumns({f"media_{n}": F.col(f"media_.{n}") for n in names}).drop("media_")


def store_documents(docs: DataFrame) -> DataFrame:
    """Store every whole text as a container, read it back by its sample tables and describe it; one row per row.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256 and tail_crc32 (of the bytes read back), media_bytes,
    media_sha256, feature. A null text counts as empty (one unit of bytes 255); a null doc_id stays null; repeated
    rows give repeated rows; an empty table gives none; other columns are not looked at.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                raw = (text or "").encode("utf-8", "surrogatepass")
                data = store(raw + b"\xff" * (UNIT if not raw else -len(raw) % UNIT))
                track = probe(data)
                back = read_back(data, track)
                spans = np.array(track.key_ranges(), np.int64).reshape(-1, 2)
                feature = f"codec={track.codec.strip()};seconds={track.duration / track.timescale:.3f};samples={len(track.sizes)};keyframes={len(spans)};key_bytes={(spans[:, 1] - spans[:, 0]).sum()};first_key={spans[0, 0]}-{spans[0, 1]};last_key={spans[-1, 0]}-{spans[-1, 1]}"
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")][1:])
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").array)
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(make, schema)
