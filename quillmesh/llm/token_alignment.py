"""Cross-tokenizer alignment: where the tokens of two tokenizers end together in the same text.

Arrow batches tokenize a text twice and mark the bytes at which tokens end; what both sides mark cuts the tokens into groups,
and the two tokens that end at a cut are linked. This is done for many texts at once: each side's tokens spell the same bytes,
so a text's tokens end where the next one's begin. The work is linear in bytes and tokens.

How often two ids are linked is counted over the whole corpus. Of those counts a bounded number, the largest, is sent to
all workers, so that no id pair is frequent among the links that are shuffled to their counts.

Nulls: null and empty texts have no tokens, as have texts that a tokenizer doesn't keep byte by byte (a normalizer's work).
A null id stays null; rows that repeat an id are rows of their own. An empty table has no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.shared import publish, release

#: Id pairs at most whose counts are sent to all workers.
FREQUENT = 65_536
#: Characters of text that are tokenized at once.
SLICE = 1 << 18
# Fixed value: what splits a text before the merges of a byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The characters of byte-level vocabularies: bytes that print stand for themselves, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level BPE vocabulary file; special tokens' strings are plain text.

    Where ids follow the order of the merges, and nothing but the usual pattern comes before them, the ids are ranks and
    the faster of two libraries encodes; else the file's own.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocab, special = byte_alphabet(), spec["model"]["vocab"], {x["id"] for x in spec.get("added_tokens", [])}
        self.bytes = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if i not in special}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        before, extra = spec.get("pre_tokenizer") or {}, spec["model"]
        ranked = (
            [vocab[m] for m in merged] == list(range(256, 256 + len(merged))) and len(self.bytes) == 256 + len(merged) and spec.get("normalizer") is None and before.get("type") == "ByteLevel"
            and before.get("use_regex", True) and not before.get("add_prefix_space") and not any(extra.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        )
        if ranked:
            self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens={}).encode_ordinary
        else:
            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self.encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids


class Pieces:
    """A piece vocabulary file, which puts a space before a text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            byte = re.fullmatch("<0x([0-9A-Fa-f]{2})>", piece)
            self.bytes[i] = bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()
        self.encode = lambda text: model.encode(text, num_threads=1)


@lru_cache(maxsize=2)
def both_sides(byte_level: str, pieces: str) -> tuple[list[tuple[ByteLevel | Pieces, pa.Array]], np.ndarray]:
    """The two tokenizers with the bytes that each id has, and ",id" of all ids in digits, zeros behind; made once a worker."""
    sides: list[tuple[ByteLevel | Pieces, pa.Array]] = []
    for t in (ByteLevel(byte_level), Pieces(pieces)):
        if not all(t.bytes.values()):
            raise ValueError("tokens without bytes aren't aligned")
        sides.append((t, pa.array([t.bytes.get(i) for i in range(max(t.bytes) + 1)], pa.binary())))
    most = max(len(names) for _, names in sides)
    width = len(f",{most}")
    digits = "".join(f",{i}".ljust(width, "\0") for i in range(most)).encode()
    return sides, np.frombuffer(digits, np.uint8).reshape(most, width)


def joined(names: pa.Array, lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """All ids of ``lists``, the bytes at which they end one after another, and these bytes."""
    ids = np.fromiter(chain.from_iterable(lists), np.int32, sum(map(len, lists)))
    if not len(ids):
        return ids, ids, b""
    _, offsets, data = names.take(pa.array(ids)).buffers()
    ends = np.frombuffer(offsets, np.int32)[1 : len(ids) + 1]
    return ids, ends, data.slice(0, int(ends[-1])).to_pybytes()


def cut(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each side, the places of the tokens that end where one of the other side ends."""
    places = []
    for ends, others in ((a_ends, b_ends), (b_ends, a_ends)):
        marks = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, bool)
        marks[others] = True
        places.append(np.flatnonzero(marks[ends]))
    return places[0], places[1]


def spelled(digits: np.ndarray, a: np.ndarray, a_cuts: np.ndarray, b: np.ndarray, b_cuts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups as text, "a1,a2|b1;a3|b2,b3", and where texts end in it; ``starts`` are the first tokens of texts, of both sides' together."""
    a_first, b_first = (np.concatenate(([0], x[:-1] + 1))[: len(x)] for x in (a_cuts, b_cuts))
    ids = np.empty(len(a) + len(b), np.int32)
    ids[np.arange(len(a)) + np.repeat(b_first, a_cuts + 1 - a_first)] = a
    ids[np.arange(len(b)) + np.repeat(a_cuts + 1, b_cuts + 1 - b_first)] = b
    text = digits[ids]
    text[a_first + b_first, 0] = ord(";")
    text[a_cuts + 1 + b_first, 0] = ord("|")
    text[starts[starts < len(ids)], 0] = 0
    kept = text != 0
    bounds = [*starts.tolist(), len(ids)]
    return text[kept], np.cumsum([0, *(np.count_nonzero(kept[x:y]) for x, y in zip(bounds, bounds[1:], strict=False))])


def tokenize(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """key, doc_id, n_a, n_b, and of every text both sides' ids by groups ("a1,a2|b1;a3|b2,b3") and its links (a, b) in order."""
    schema = "key long, doc_id long, n_a int, n_b int, ids string, links array<struct<a: int, b: int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillmesh.llm.token_alignment import both_sides  # the module's own: what is sent along has no cache

        sides, digits = both_sides(byte_level, pieces)

        def both(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """Each side's tokens a text, ids and ends; none of a text that a side doesn't keep byte by byte."""
            given = [f" {t}" if t else "" for t in texts]
            data = [t.encode("utf-8", "surrogatepass") for t in given]
            lists = [[t.encode(x) if x else [] for x in own] for (t, _), own in zip(sides, (given, texts), strict=True)]
            found = [joined(names, own) for (_, names), own in zip(sides, lists, strict=True)]
            if any(spelt != b"".join(data) for _, _, spelt in found):
                same = [all(joined(names, [own[k]])[2] == d for (_, names), own in zip(sides, lists, strict=True)) for k, d in enumerate(data)]
                lists = [[ids if s else [] for ids, s in zip(own, same, strict=True)] for own in lists]
                found = [joined(names, own) for (_, names), own in zip(sides, lists, strict=True)]
            return [(np.array([len(ids) for ids in own], np.int32), ids, ends) for own, (ids, ends, _) in zip(lists, found, strict=True)]

        def batch_of(keys: pa.Array, doc_ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
            (n_a, a, a_ends), (n_b, b, b_ends) = both(texts)
            a_cuts, b_cuts = cut(a, a_ends, b, b_ends)
            a_to, b_to = np.cumsum(n_a), np.cumsum(n_b)
            text, text_ends = spelled(digits, a, a_cuts, b, b_cuts, a_to + b_to - n_a - n_b)
            bounds = pa.array(text_ends, pa.int32())  # raises where ids spell more than a string may hold
            ids = pa.StringArray.from_buffers(len(texts), bounds.buffers()[1], pa.py_buffer(text))
            offsets = np.concatenate(([0], np.searchsorted(a_cuts, a_to))).astype(np.int32)
            links = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(a[a_cuts]), pa.array(b[b_cuts])], ["a", "b"]))
            return pa.RecordBatch.from_arrays([keys, doc_ids, pa.array(n_a), pa.array(n_b), ids, links], names=["key", "doc_id", "n_a", "n_b", "ids", "links"])

        for batch in batches:
            keys, doc_ids, texts = (batch.column(n) for n in ("key", "doc_id", "text"))
            begun, held, size = 0, [], 0
            for k, text in enumerate(texts):
                held.append(text.as_py() or "")
                size += len(held[-1])
                if size > SLICE or k + 1 == len(texts):
                    yield batch_of(keys[begun : k + 1], doc_ids[begun : k + 1], held)
                    begun, held, size = k + 1, [], 0

    named = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return named.mapInArrow(run, schema)


def align(tokens: DataFrame) -> DataFrame:
    """key, doc_id, n_a, n_b, and of every text its groups ("a1,a2|b1") and links (a, b) in order."""
    groups = F.when(F.col("ids") == "", F.array().cast("array<string>")).otherwise(F.split("ids", ";"))
    return tokens.select("key", "doc_id", "n_a", "n_b", groups.alias("groups"), "links")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, n (how many links hold the pair) and best (no other pair of that b has more)."""
    counts = aligned.select(F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.count("*").alias("n"))
    counts = publish(counts)
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    out = publish(counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")))
    release(counts)
    return out


def frequent_pairs(pairs: DataFrame, most: int = FREQUENT) -> DataFrame:
    """At most ``most`` pairs, all that are more frequent than any other."""
    bins = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log2("n") * 64) + 384).cast("int")
    least, room = None, most
    for r in pairs.groupBy(bins.alias("bin")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).orderBy(F.desc("bin")).collect():
        room -= r["pairs"]
        if room < 0:
            break
        least = r["least"]
    return pairs.filter(F.col("n") >= least if least is not None else F.lit(False))


def weigh(aligned: DataFrame, pairs: DataFrame, most: int = FREQUENT) -> DataFrame:
    """key, n_best and count_sum of every text that has links."""
    top = F.broadcast(frequent_pairs(pairs, most).select("a", "b", F.col("n").alias("top_n"), F.col("best").alias("top_best")))
    links = aligned.select("key", F.explode("links").alias("l")).select("key", "l.a", "l.b").join(top, ["a", "b"], "left")
    rare = F.when(F.col("top_n").isNull(), F.struct("a", "b"))
    summed = publish(links.groupBy("key", rare.alias("rare")).agg(F.count("*").alias("times"), F.sum("top_n").alias("count_sum"), F.count_if("top_best").alias("n_best")))
    others = summed.filter("rare is not null").select("key", "rare.a", "rare.b", "times").join(pairs, ["a", "b"])
    others = others.select("key", (F.col("times") * F.col("n")).alias("count_sum"), F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"))
    both = summed.filter("rare is null").select("key", "count_sum", "n_best").unionByName(others)
    return both.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_documents(docs: DataFrame, byte_level: str, pieces: str, most: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    digest = F.when(F.col("ids") != "", F.sha2("ids", 256)).otherwise("")
    # Tokens have bytes, so one of each side ends at a cut: a text has as many links as groups.
    aligned = publish(tokenize(docs, byte_level, pieces).select("key", "doc_id", "n_a", "n_b", F.size("links").alias("n_groups"), digest.alias("groups_sha256"), "links"))
    pairs = pair_counts(aligned)
    weights = weigh(aligned, pairs, most)
    joined = aligned.select("key", "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "groups_sha256").join(weights, "key", "left")
    counted = [F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return joined.select("doc_id", *counted, "groups_sha256")
