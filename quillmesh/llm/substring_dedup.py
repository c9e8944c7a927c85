"""Substring dedup: paragraphs that repeat, edited a little or not, and passages that repeat inside longer ones.

Paragraphs are lines with a word. They are joined by MinHash bands, tuned for recall, and verified by the exact
Jaccard similarity of their five-word shingles (a line of one to four words has one shingle, so only its copies reach
it); components of links are clusters.

A passage of at least PASSAGE_WORDS words may also repeat inside longer lines. So these are cut into pieces where the
hash of a word is the least of its neighbourhood, which depends on nearby words only. Pieces that stand earlier too
are candidates: those that follow each other on one diagonal are a chain, whose words and the earlier ones around it
are laid side by side, followed to their ends over small edits, and verified by exact Jaccard similarity.

Of each cluster the first member by (doc_id, hash of the text, line, word) stays; the others are removed. Rows are
named by their id and a 64-bit hash of their text, which only tells texts of one id apart.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.components import components
from quillmesh.llm.shared import publish, release
from quillmesh.llm.similar import forest_depth, leaders_of, least_partner, linked, signatures
from quillmesh.llm.text import Words, mix, set_ids, shingle_sets, slices, whole_groups, words_of

WORDS, THRESHOLD = 5, 0.8
BANDS, MAX_ROWS, RECALL = 8, 8, 0.995
#: Words of a passage inside a longer line; of the neighbourhood on each side that a cut is the least of; of a piece.
PASSAGE_WORDS, REACH, PIECE_WORDS = 25, 4, 4
#: Words between two pieces of a chain, how far its diagonal may move at each, and words around a chain that are looked at.
GAP, DRIFT, AROUND = 30, 3, 64
#: Equal words behind an edit that join what is before it.
AGREE = 3
WORD = re.compile(r"[^\x00-\x20]+")


def cuts(w: Words) -> np.ndarray:
    """Whether a piece begins at each word: at a text's first word, and where the hash is less than those of the REACH
    words before and not more than those of the REACH words after; words of other texts don't count."""
    n = len(w.hash)
    owner = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    order = mix(w.hash + np.uint64(0xC0FFEE))
    low = np.ones(n, bool)
    for k in range(1, REACH + 1):
        if k < n:
            same = owner[k:] == owner[:-k]
            low[k:] &= (order[k:] < order[:-k]) | ~same
            low[:-k] &= (order[:-k] <= order[k:]) | ~same
    low[w.first[:-1][np.diff(w.first) > 0]] = True
    return low


def pieces_of(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of a batch: their text's place, first word (counted in its text), number of words and hash."""
    begin = np.flatnonzero(cuts(w))
    if not len(begin):
        return begin, begin, begin, begin.astype(np.uint64)
    row = np.searchsorted(w.first, begin, "right") - 1
    size = np.diff(np.append(begin, len(w.hash)))
    # Order matters within a piece: each word's hash is mixed with its place in it.
    place = np.arange(len(w.hash)) - np.repeat(begin, size)
    value = np.add.reduceat(mix(w.hash ^ mix(place.astype(np.uint64) + np.uint64(1))), begin)
    return row, begin - w.first[row], size, mix(value + size.astype(np.uint64))


def chains(rows: pd.DataFrame) -> pd.DataFrame:
    """Chains of pieces of whole rows that stand earlier too: columns doc_id, h, line, owner, oh, oline, a, b, oa, ob.

    ``rows`` (doc_id, h, place, owner, oh, oplace) lists pieces with the place of their first occurrence. a and b are the
    words where the first and the last piece of a chain begin, oa and ob those of the earlier text.
    """
    columns = {c: rows[c].to_numpy(np.int64) for c in rows.columns}
    columns |= {"line": columns["place"] >> 32, "oline": columns["oplace"] >> 32}
    at, oat = columns["place"] & 0xFFFFFFFF, columns["oplace"] & 0xFFFFFFFF
    key = np.column_stack([columns[c] for c in ("doc_id", "h", "line", "owner", "oh", "oline")])
    order = np.lexsort((oat, at, *key.T[::-1]))
    key, at, oat = key[order], at[order], oat[order]
    step = np.diff(at)
    new = np.ones(len(rows), bool)
    new[1:] = (key[1:] != key[:-1]).any(axis=1) | (step > GAP) | (np.abs(np.diff(oat) - step) > DRIFT)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows)) - 1
    out = pd.DataFrame(key[first], columns=["doc_id", "h", "line", "owner", "oh", "oline"])
    return out.assign(a=at[first], b=at[last], oa=oat[first], ob=oat[last])


def follow(own: list[str], other: list[str], i: int, j: int, step: int) -> list[tuple[int, int]]:
    """Ends reached from (i, j) in one direction: behind the equal words, and behind those that each small edit joins.

    ``step`` is 1 or -1; the words at i and j are the first to compare. An edit is up to two words on each side, and
    AGREE equal words must follow it.
    """
    n, m = len(own), len(other)

    def same(x: int, y: int) -> bool:
        return 0 <= x < n and 0 <= y < m and own[x] == other[y]

    ends = []
    while True:
        while same(i, j):
            i, j = i + step, j + step
        ends.append((i, j))
        for x, y in ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2)):
            x, y = i + x * step, j + y * step
            if all(same(x + k * step, y + k * step) for k in range(AGREE)):
                i, j = x, y
                break
        else:
            return ends


def similarity(a: list[str], b: list[str]) -> float:
    x, y = ({tuple(w[k : k + WORDS]) for k in range(max(1, len(w) - WORDS + 1))} if w else set() for w in (a, b))
    return len(x & y) / len(x | y) if x or y else 0.0


def passages(own: list[str], other: list[str], a: int, b: int, oa: int, ob: int) -> list[tuple[int, int]]:
    """Word ranges of ``own`` verified as copies of passages of ``other``, around the chain from (a, oa) to (b, ob)."""
    found: list[tuple[int, int]] = []
    left, right = follow(own, other, a - 1, oa - 1, -1), follow(own, other, b, ob, 1)
    # The widest range first; then fewer edits at both ends.
    for k in range(max(len(left), len(right))):
        (i, x), (j, y) = left[max(0, len(left) - 1 - k)], right[max(0, len(right) - 1 - k)]
        if j - i - 1 >= PASSAGE_WORDS and similarity(own[i + 1 : j], other[x + 1 : y]) >= THRESHOLD - 1e-9:
            return [(i + 1, j)]
    # Else only equal words around its first and its last piece.
    for p, q in {(a, oa), (b, ob)}:
        i, j = follow(own, other, p - 1, q - 1, -1)[0][0] + 1, follow(own, other, p, q, 1)[0][0]
        if j - i >= PASSAGE_WORDS:
            found.append((i, j))
    return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def read_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines with a word: their set, bands, and the pieces of those that may hold a passage."""
    depth = forest_depth(THRESHOLD, BANDS, MAX_ROWS, RECALL)
    for b in (part for batch in batches for part in slices(batch)):
        split = [t.split("\n") for t in b["text"]]
        size = np.fromiter(map(len, split), np.int64, len(split))
        lines = [x for some in split for x in some]
        owner = np.repeat(np.arange(len(b)), size)
        number = np.arange(len(lines)) - np.repeat(np.cumsum(size) - size, size)
        w = words_of(lines)
        values, bounds = shingle_sets(w, WORDS)
        ids, keys = set_ids(values, bounds), signatures(values, bounds, BANDS, depth).view(np.int64)
        count = np.diff(w.first)
        row, at, words, piece = pieces_of(w)
        some = (count[row] >= PASSAGE_WORDS) & (words >= PIECE_WORDS) if len(row) else np.zeros(0, bool)
        row, at, piece = row[some], at[some].astype(np.int32), piece[some].view(np.int64)
        edge = np.searchsorted(row, np.arange(len(lines) + 1))
        kept = np.flatnonzero(count > 0)
        if not len(kept):
            continue
        banded = np.diff(bounds) >= least_partner(THRESHOLD)
        yield pd.DataFrame({
            "doc_id": b["doc_id"].to_numpy(np.int64)[owner[kept]], "h": b["h"].to_numpy(np.int64)[owner[kept]], "line": number[kept].astype(np.int32),
            "chars": np.fromiter(map(len, lines), np.int64, len(lines))[kept], "set_id": [ids[x] for x in kept],
            "keys": [keys[x] if banded[x] else keys[x, :0] for x in kept],
            "at": [at[edge[x] : edge[x + 1]] for x in kept], "pieces": [piece[edge[x] : edge[x + 1]] for x in kept],
        })


def drop_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Remove repeated paragraphs and passages from every whole text; one row per input row.

    Columns: doc_id, class_id (the least doc_id that keeps something removed here, else the row's own), n_lines
    (lines with a word), n_removed (removed ranges), chars_removed, removed (those ranges in code points), kept_sha256
    (of what is left, as UTF-8) and with ``keep_text`` what is left. Rows are told apart by id and text: rows that
    repeat an id with another text are texts of their own, equal repeated rows are one text and all stay. Null texts
    count as empty; rows with a null doc_id are returned whole and take no part. An empty table gives none; other
    columns are not looked at.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    named = texts.filter("doc_id is not null")
    units = publish(named.mapInPandas(read_units, "doc_id long, h long, line int, chars long, set_id binary, keys array<long>, at array<int>, pieces array<long>"))
    place = F.struct("doc_id", "h", "line")
    sets = publish(units.groupBy("set_id").agg(F.min(place).alias("first"), F.count("*").alias("times"), F.max("chars").alias("chars"), F.any_value("keys").alias("keys")))
    wanted = publish(leaders_of(sets.select("set_id", "first", "chars", "keys")))

    # Pieces that occur again: all but the first occurrence, with the place of the first. A place is a line and a word.
    pieces = units.filter(F.size("at") > 0).select("doc_id", "h", "line", F.explode(F.arrays_zip("at", "pieces")).alias("x"))
    pieces = pieces.select("doc_id", "h", (F.shiftleft(F.col("line").cast("long"), 32) + F.col("x.at")).alias("place"), F.col("x.pieces").alias("piece"))
    common = pieces.groupBy("piece").agg(F.count("*").alias("n")).filter("n > 1").select("piece")
    again = publish(pieces.join(common.hint("merge"), "piece"))
    where = F.struct("doc_id", "h", "place")
    low = again.groupBy("piece").agg(F.min(where).alias("low"))
    late = again.join(low.hint("merge"), "piece").filter(where != F.col("low"))
    late = late.select("doc_id", "h", "place", F.col("low.doc_id").alias("owner"), F.col("low.h").alias("oh"), F.col("low.place").alias("oplace"))

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_groups(batches, ["doc_id", "h"]):
            yield chains(rows.drop_duplicates())

    shape = "doc_id long, h long, line int, owner long, oh long, oline int, a int, b int, oa int, ob int"
    found = late.repartition("doc_id", "h").sortWithinPartitions("doc_id", "h").mapInPandas(chain, shape)
    # Equal reaches of a much copied passage are asked for once.
    begin, end = F.greatest(F.lit(0), F.floor((F.col("oa") - AROUND) / 32) * 32).cast("int"), (F.ceil((F.col("ob") + AROUND) / 32) * 32).cast("int")
    found = publish(found.withColumn("begin", begin).withColumn("end", end))
    release(again)

    # What the rows are asked for: texts of lines to compare, and stretches of words to lay beside a chain.
    asked = wanted.select("first.doc_id", "first.h", F.struct(F.col("first.line").alias("line"), "set_id").alias("x")).groupBy("doc_id", "h").agg(F.collect_set("x").alias("lines"))
    ranges = found.select("owner", "oh", "oline", "begin", "end").distinct()
    ranges = ranges.groupBy(F.col("owner").alias("doc_id"), F.col("oh").alias("h")).agg(F.collect_list(F.struct(F.col("oline").alias("line"), "begin", "end")).alias("ranges"))
    need = asked.join(ranges, ["doc_id", "h"], "full")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, h, text, lines, ranges in zip(b["doc_id"], b["h"], b["text"], b["lines"], b["ranges"], strict=True):
                every, split = text.split("\n"), {}
                for x in lines if lines is not None else ():
                    rows.append((x["set_id"], doc_id, h, x["line"], 0, 0, every[x["line"]]))
                for x in ranges if ranges is not None else ():
                    if x["line"] not in split:
                        split[x["line"]] = WORD.findall(every[x["line"]].lower())
                    rows.append((None, doc_id, h, x["line"], x["begin"], x["end"], " ".join(split[x["line"]][x["begin"] : x["end"]])))
            yield pd.DataFrame(rows, columns=["set_id", "doc_id", "h", "line", "begin", "end", "text"])

    source = named.select("doc_id", "h", "text").join(need.hint("merge"), ["doc_id", "h"])
    fetched = publish(source.mapInPandas(fetch, "set_id binary, doc_id long, h long, line int, begin int, end int, text string"))

    # Lines: the first member of each cluster stays.
    lines = fetched.filter("set_id is not null").select("set_id", "text").join(wanted.select("set_id", F.lit(1).alias("copies"), "leaders").hint("merge"), "set_id")
    done = linked(wanted, lines, WORDS, THRESHOLD)
    roots = components(done.select(F.col("set_id").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "set_id")
    known = sets.select("set_id", "first", "times").join(roots, "set_id", "left").filter("root is not null or times > 1")
    known = publish(known.withColumn("root", F.coalesce("root", "set_id")))
    release(sets, wanted, done)
    keepers = known.groupBy("root").agg(F.min("first").alias("keeper"))
    lost = units.select("set_id", "doc_id", "h", "line").join(known.join(keepers, "root").select("set_id", "keeper").hint("merge"), "set_id").filter(place != F.col("keeper"))
    lost = lost.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("line")).alias("lines"), F.min("keeper.doc_id").alias("of_lines"))

    # Chains: with the earlier words around them.
    beside = fetched.filter("set_id is null").select(F.col("doc_id").alias("owner"), F.col("h").alias("oh"), F.col("line").alias("oline"), "begin", "end", F.col("text").alias("words"))
    laid = found.join(beside.hint("merge"), ["owner", "oh", "oline", "begin", "end"])
    laid = laid.groupBy("doc_id", "h").agg(F.collect_set(F.struct("line", "a", "b", (F.col("oa") - F.col("begin")).alias("oa"), (F.col("ob") - F.col("begin")).alias("ob"), "words", "owner")).alias("chains"))
    both = lost.join(laid, ["doc_id", "h"], "full")

    schema = "doc_id long, class_id long, n_lines long, n_removed long, chars_removed long, removed array<struct<start:long,end:long>>, kept_sha256 string" + ", text string" * keep_text

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text, gone, of_lines, beside in zip(b["doc_id"].astype("Int64"), b["text"], b["lines"], b["of_lines"], b["chains"], strict=True):
                spans, keepers = [], []
                every = text.split("\n")
                gone = set() if gone is None else set(map(int, gone))
                if gone or beside is not None:
                    ends = np.cumsum([len(x) + 1 for x in every]).tolist()
                if gone:
                    spans += [(ends[k] - len(every[k]) - 1, ends[k] - 1) for k in gone]
                    keepers.append(int(of_lines))
                split: dict[int, tuple[list[str], list[tuple[int, int]]]] = {}
                for x in beside if beside is not None else ():
                    k = int(x["line"])
                    if k in gone:
                        continue
                    if k not in split:
                        marks = [m.span() for m in WORD.finditer(every[k])]
                        split[k] = [every[k][i:j].lower() for i, j in marks], marks
                    own, marks = split[k]
                    for i, j in passages(own, x["words"].split(" "), x["a"], x["b"], x["oa"], x["ob"]):
                        start = ends[k] - len(every[k]) - 1
                        spans.append((start + marks[i][0], start + marks[j - 1][1]))
                        keepers.append(int(x["owner"]))
                spans = merged(spans)
                kept = "".join(text[a:b] for a, b in zip([0, *(y for _, y in spans)], [*(x for x, _ in spans), len(text)], strict=True)) if spans else text
                owner = None if pd.isna(doc_id) else min([int(doc_id), *keepers])
                rows.append((doc_id, owner, sum(WORD.search(x) is not None for x in every), len(spans), len(text) - len(kept), [{"start": x, "end": y} for x, y in spans], hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest(), *([kept] * keep_text)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.replace("<start:long,end:long>", "").split(", ")]).astype({"doc_id": "Int64", "class_id": "Int64"})

    return texts.join(both.hint("merge"), ["doc_id", "h"], "left").select("doc_id", "text", "lines", "of_lines", "chains").mapInPandas(cut, schema)
