"""Byte-level BPE over rank files: overlapping chunks, stitched pre-tokens, merges, decoding.

Texts longer than ``chunk_chars`` are cut into chunks that overlap; the chunks are pre-tokenised apart from each
other. In an overlap the first start of a pre-token that both chunks share is where they resynchronise: what the
pattern matches from there on depends only on the text from there on. Pieces between two such places are encoded apart
from each other, and a text's ids are gathered in the pieces' order.
Where an overlap has no shared start (one run of letters may be longer than it), the left chunk's last sure start is
kept and the text from there to the right chunk's end is pre-tokenised again.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.text import slices

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 1 << 10
#: Pre-tokens whose ids a worker keeps; bytes of those that are merged many at once, and how many.
CACHE_ENTRIES, SHORT_BYTES, MERGED_AT_ONCE = 150_000, 48, 2048
#: The rank of parts that aren't joined.
NONE = 1 << 40


class Vocabulary(dict):
    """Pre-token -> ids, filled on first use; ``ranks`` maps bytes to ids."""

    def __init__(self, lines: Iterable[bytes], pattern: str):
        super().__init__()
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.split = regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([k])] for k in range(256)], np.int64)
        # Every way to put a token together from two tokens, by both of them, in order.
        ranks, keys, values = self.ranks, array("q", [-1]), array("q", [NONE])
        for t, i in ranks.items():
            for k in range(1, len(t)):
                if (left := ranks.get(t[:k])) is not None and (right := ranks.get(t[k:])) is not None:
                    keys.append(left << 32 | right)
                    values.append(i)
        pair, joined = np.frombuffer(keys, np.int64), np.frombuffer(values, np.int64)
        order = np.argsort(pair)
        self.pair, self.joined = pair[order], joined[order]
        self.byte_pairs = self.rank_of(self.byte_ids[:, None], self.byte_ids[None, :])

    def __missing__(self, token: str) -> tuple[int, ...]:
        raw = token.encode("utf-8", "surrogatepass")
        return (self.ranks[raw],) if raw in self.ranks else tuple(self.merge(raw))

    def fill(self, tokens: set[str]) -> None:
        """Ids of all of some pre-tokens that are short enough to be kept."""
        if len(self) + len(tokens) > CACHE_ENTRIES:
            self.clear()
        coded = [(t, t.encode("utf-8", "surrogatepass")) for t in tokens if len(t) <= SHORT_BYTES]
        self.update((t, (self.ranks[raw],)) for t, raw in coded if raw in self.ranks)
        rest = sorted(((len(raw), t, raw) for t, raw in coded if raw not in self.ranks and len(raw) <= SHORT_BYTES), key=lambda x: x[0])
        for k in range(0, len(rest), MERGED_AT_ONCE):
            part = rest[k : k + MERGED_AT_ONCE]
            self.update(zip((t for _, t, _ in part), self.merge_many([raw for _, _, raw in part]), strict=True))

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that two parts make together; NONE where they don't, and where one of them is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (left >= 0) & (right >= 0), self.joined[at], NONE)

    def merge_many(self, raws: list[bytes]) -> list[tuple[int, ...]]:
        """``merge`` of many short sequences at once, one step of each at a time."""
        size = np.fromiter(map(len, raws), np.int64, len(raws))
        width = int(size.max())
        inside = np.arange(width + 1) < size[:, None]
        data = np.zeros(inside.shape, np.uint8)
        data[inside] = np.frombuffer(b"".join(raws), np.uint8)
        part = np.where(inside, self.byte_ids[data], -1)  # the id of the part that begins at each byte; the last column stays none
        after = np.minimum(np.tile(np.arange(1, width + 2), (len(raws), 1)), size[:, None])
        after[~inside] = width
        after[np.arange(len(raws)), size - 1] = width
        before = np.tile(np.arange(-1, width), (len(raws), 1))
        rank = np.full(inside.shape, NONE)
        rank[:, :-1] = np.where(inside[:, 1:], self.byte_pairs[data[:, :-1], data[:, 1:]], NONE)
        row = np.arange(len(raws))
        while len(row):
            at = rank[row].argmin(axis=1)  # the leftmost of the least
            best = rank[row, at]
            go = best < NONE
            row, at, best = row[go], at[go], best[go]
            gone = after[row, at]
            follower = after[row, gone]
            part[row, at], part[row, gone], rank[row, gone] = best, -1, NONE
            after[row, at], before[row, follower] = follower, at
            rank[row, at] = self.rank_of(best, part[row, follower])
            ahead = before[row, at]
            has = ahead >= 0
            rank[row[has], ahead[has]] = self.rank_of(part[row[has], ahead[has]], best[has])
        left = part >= 0
        ids, stop = part[left].tolist(), np.cumsum(left.sum(axis=1)).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *stop], stop, strict=False)]

    def merge(self, raw: bytes) -> list[int]:
        """Join the adjacent pair of the lowest rank, leftmost first, until no pair has a rank; O(n log n)."""
        ranks, n = self.ranks, len(raw)
        end = list(range(1, n + 1))  # the part that starts at i ends before end[i]; 0: joined to another
        before = list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(raw[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (j := before[i]) >= 0 and (r := ranks.get(raw[j:stop])) is not None:
                heapq.heappush(heap, (r, j, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each of some texts that end where pre-tokens end."""
        split = [self.split.findall(p) for p in pieces]
        every = set(chain.from_iterable(split))
        fresh = every.difference(self)
        self.fill(fresh if len(self) + len(fresh) <= CACHE_ENTRIES else every)
        return [list(chain.from_iterable(map(self.__getitem__, some))) for some in split]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary(f, pattern)


def starts(split: regex.Pattern, text: str, offset: int) -> list[int]:
    """Where the pre-tokens of a chunk begin, in the whole text's positions."""
    return [offset + m.start() for m in split.finditer(text)]


def sure(marks: list[int], text: str, offset: int) -> list[int]:
    """Starts of a chunk where a piece may end: later text can't move them, and they don't move what is before them.

    The pattern looks one character ahead at most, so the last start, and one before it for white space, may move. A run
    of white space is split by what follows it, so no piece ends behind white space.
    """
    return [x for x in marks[:-2] if x == offset or not text[x - offset - 1].isspace()]


def stitch(split: regex.Pattern, chunks: list[tuple[int, str, list[int]]]) -> list[str]:
    """Pieces of one text that end where pre-tokens end; chunks: offset, text and starts, in order."""
    pieces: list[str] = []
    begin, (offset, text, marks) = 0, chunks[0]
    for at, more, right in chunks[1:]:
        left = set(sure(marks, text, offset))
        meet = next((x for x in right if x in left and x >= begin), None)
        if meet is None:
            back = max((x for x in left if begin <= x), default=begin)
            joined = text[back - offset : at - offset] + more
            if back > begin:
                pieces.append(text[begin - offset : back - offset])
            begin, offset, text = back, back, joined
            marks = starts(split, joined, back)
        else:
            if meet > begin:
                pieces.append(text[begin - offset : meet - offset])
            begin, offset, text, marks = meet, at, more, right
    pieces.append(text[begin - offset :])
    return pieces


def digest(v: Vocabulary, ids: list[int]) -> tuple[int, str, str, list[int]]:
    listed = " ".join(map(v.text_of.__getitem__, ids))
    return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(v.decode(ids)).hexdigest(), ids


def gathered(v: Vocabulary, parts: Iterable[Iterable[int]]) -> tuple[int, str, str]:
    """``digest`` without the ids, part by part."""
    count, listed, decoded = 0, hashlib.sha256(), hashlib.sha256()
    for part in parts:
        ids = list(map(int, part))
        if ids:
            listed.update((" " * bool(count) + " ".join(map(v.text_of.__getitem__, ids))).encode())
            decoded.update(v.decode(ids))
            count += len(ids)
    return count, listed.hexdigest(), decoded.hexdigest()


def encode_documents(docs: DataFrame, path: str, pattern: str, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, keep_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids again; one row per input row.

    Columns: doc_id, n_tokens, ids_sha256 (decimal ids joined by spaces), decoded_sha256, and with ``keep_ids`` the
    ids themselves. A null text counts as empty (no ids); a null doc_id stays null; repeated rows give repeated rows;
    an empty table gives none; other columns of ``docs`` are not looked at. Lone surrogates can't occur in Spark.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
        return out.astype({"doc_id": "Int64"})

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path, pattern)
        for b in (part for batch in batches for part in slices(batch)):
            ids = v.encode(b["text"].tolist())
            yield frame([(i, *digest(v, x)[: 4 if keep_ids else 3]) for i, x in zip(b["doc_id"].astype("Int64"), ids, strict=True)])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path, pattern)
        for b in batches:
            marks = [starts(v.split, t, at) for t, at in zip(b["chunk"], b["at"], strict=True)]
            yield b.assign(marks=marks)

    def join(group: pd.DataFrame) -> pd.DataFrame:
        v = vocabulary(path, pattern)
        group = group.sort_values("at")
        chunks = [(int(a), t, [int(x) for x in m]) for a, t, m in zip(group["at"], group["chunk"], group["marks"], strict=True)]
        pieces = stitch(v.split, chunks)
        out = pd.DataFrame({"row": group["row"].iloc[0], "number": range(len(pieces)), "piece": pieces})
        return out.assign(doc_id=group["doc_id"].astype("Int64").iloc[0])[["doc_id", "row", "number", "piece"]].astype({"doc_id": "Int64"})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path, pattern)
        for b in (part for batch in batches for part in slices(batch.rename(columns={"piece": "text"}))):
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "row": b["row"], "number": b["number"], "ids": v.encode(b["text"].tolist())})

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        v = vocabulary(path, pattern)
        parts = group.sort_values("number")["ids"]
        doc_id = group["doc_id"].iloc[0]
        got = gathered(v, parts)
        return frame([(None if pd.isna(doc_id) else int(doc_id), *got, *([[int(x) for part in parts for x in part]] if keep_ids else []))])

    # Long texts are numbered so that repeated rows and null ids stay apart.
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    whole = docs.filter(F.length("text") <= chunk_chars).mapInPandas(short, schema)
    long = docs.filter(F.length("text") > chunk_chars)
    step = chunk_chars - overlap
    pieces = (
        long.withColumn("row", F.monotonically_increasing_id())
        .select("doc_id", "row", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1 - F.lit(overlap), F.lit(step))).alias("at"))
        .select("doc_id", "row", F.col("at").cast("long").alias("at"), F.expr(f"substring(text, at + 1, {chunk_chars})").alias("chunk"))
    )
    spread = pieces.repartition("row", "at").mapInPandas(cut, "doc_id long, row long, at long, chunk string, marks array<long>")
    stitched = spread.groupBy("row").applyInPandas(join, "doc_id long, row long, number int, piece string")
    # As many tasks as the session shuffles into: merging costs more than its bytes show.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    encoded = stitched.repartition(tasks, "row", "number").mapInPandas(merge, "doc_id long, row long, number int, ids array<int>")
    return whole.unionByName(encoded.groupBy("row").applyInPandas(gather, schema))
