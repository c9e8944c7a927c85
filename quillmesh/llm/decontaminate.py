"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of the words around them.

Every n-gram of a test item is a seed, so that any copy which keeps GRAM words in a row, whole, partial or edited, is
aligned, whatever other documents hold. Items of fewer words have no such seed and are found only as they are. One pass looks the seeds up in every document, opens a window of words around
each group of hits on near diagonals, and aligns the whole item with the window. No text is shuffled; items are taken
in blocks of a bounded number of n-grams, so what each task holds doesn't grow with the benchmark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.shared import publish
from quillmesh.llm.text import Words, grams, slices, words_of

GRAM = 3
#: Of the score that a perfect copy of the item would get.
THRESHOLD = 0.4
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bytes of item texts in one block; the pass runs once a block.
BLOCK_BYTES = 8 << 20
#: Cells of alignment tables held at once.
CELLS = 1 << 20


def align(items: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each row pair, and the window position after its (first) end.

    Rows are word hashes, padded with 0 in ``items`` and 1 in ``windows``. Along an item, gaps are linear, so the
    best way to arrive by gaps is a running maximum.
    """
    n, m = items.shape
    slope = np.arange(m, dtype=np.int32) * -GAP
    above = np.zeros((n, m + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for j in range(windows.shape[1]):
        step = np.where(items == windows[:, j : j + 1], np.int32(MATCH), np.int32(MISMATCH))
        cell = np.maximum(above[:, :-1] + step, above[:, 1:] + GAP)
        np.maximum(cell, 0, out=cell)
        cell = np.maximum.accumulate(cell + slope, axis=1) - slope
        above[:, 1:] = cell
        top = cell.max(axis=1)
        better = top > best
        best[better], end[better] = top[better], j + 1
    return best, end


def padded(values: np.ndarray, at: np.ndarray, size: np.ndarray, fill: int) -> np.ndarray:
    out = np.full((len(at), int(size.max())), fill, np.uint64)
    for k, (a, s) in enumerate(zip(at, size, strict=True)):
        out[k, :s] = values[a : a + s]
    return out


class Items:
    """A block of test items: their words, and their n-grams as seeds."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = np.array(ids, np.int64)
        self.words = words_of(texts, bare=True)
        values, bounds = grams(self.words, GRAM)
        long = np.diff(self.words.first) >= GRAM
        owner = np.repeat(np.arange(len(ids)), np.diff(bounds))
        keep = long[owner] if len(owner) else np.zeros(0, bool)
        gram, owner = values[keep], owner[keep]
        # Shorter items: their one gram, by number of words.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, GRAM):
            mine = np.flatnonzero(np.diff(self.words.first) == n)
            if len(mine):
                whole = values[bounds[mine]]
                by = np.argsort(whole, kind="stable")
                self.short[n] = whole[by], mine[by]
        order = np.argsort(gram, kind="stable")
        self.seed, self.seed_owner = gram[order], owner[order]
        self.kept_grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def search(self, w: Words, short: bool = True) -> pd.DataFrame:
        """Alignments of at least the threshold: text, item, score, first and end word; the best of each pair.

        ``short`` looks for whole copies of items of fewer than GRAM words too.
        """
        found = [self.aligned(w), *(self.copies(w, n) for n in self.short if short)]
        found = [f for f in found if len(f)]
        if not found:
            return pd.DataFrame({"row": [], "item": [], "score": [], "start_word": [], "end_word": []})
        got = pd.concat(found).sort_values(["row", "item", "score", "start_word"], ascending=[True, True, False, True])
        return got.drop_duplicates(["row", "item"])

    def copies(self, w: Words, n: int) -> pd.DataFrame:
        """Where the items of ``n`` words stand as they are."""
        values, bounds = grams(w, n)
        seed, owner = self.short[n]
        left, right = np.searchsorted(seed, values, "left"), np.searchsorted(seed, values, "right")
        times = right - left
        at = np.repeat(np.arange(len(values)), times)
        item = owner[np.repeat(left, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        row = np.searchsorted(bounds, at, "right") - 1
        return pd.DataFrame({"row": row, "item": self.ids[item], "score": 1.0, "start_word": at - bounds[row], "end_word": at - bounds[row] + n})

    def aligned(self, w: Words) -> pd.DataFrame:
        """Alignments around seeds; a pair may have several.

        Pairs of a text and an item that share a seed are few of all, but where a seed is common they are many: only those
        go on whose text holds as many of the item's words as the threshold needs, and of these only such windows.
        """
        values, bounds = grams(w, GRAM)
        left = np.searchsorted(self.seed, values, "left")
        hits = np.flatnonzero(np.append(self.seed, np.uint64(0))[left] == values) if len(self.seed) else np.zeros(0, int)
        hits = hits[left[hits] < len(self.seed)]
        none = pd.DataFrame({"row": [], "item": [], "score": [], "start_word": [], "end_word": []})
        if not len(hits):
            return none
        # Distinct seeds of each text: a text that repeats itself repeats them.
        row = np.searchsorted(bounds, hits, "right") - 1
        seen = np.unique(row * np.int64(len(self.seed)) + left[hits])
        row, first = seen // len(self.seed), seen % len(self.seed)
        times = np.searchsorted(self.seed, self.seed[first], "right") - first
        places = Places(w, self.words)
        need = np.ceil(THRESHOLD * np.diff(self.words.first)).astype(np.int64)
        out = []
        for part in in_parts(times, PAIRS):
            owner = self.seed_owner[runs(first[part], times[part])]
            pairs = np.unique(np.repeat(row[part], times[part]) * np.int64(len(self.ids)) + owner)
            r, i = pairs // len(self.ids), pairs % len(self.ids)
            held = places.enough(i, w.first[r], w.first[r + 1], need[i])
            out.append(pairs[held])
        pairs = np.unique(np.concatenate(out))
        if not len(pairs):
            return none
        r, i = pairs // len(self.ids), pairs % len(self.ids)
        found = [self.windows(w, values, bounds, r[part], i[part], places, need) for part in in_parts(np.diff(w.first)[r], PAIRS)]
        found = [f for f in found if len(f)]
        return pd.concat(found) if found else none

    def windows(self, w: Words, values: np.ndarray, bounds: np.ndarray, rows: np.ndarray, items: np.ndarray, places: Places, need: np.ndarray) -> pd.DataFrame:
        """Alignments of pairs: windows around groups of hits on near diagonals, in pieces of bounded size."""
        lows, highs, of = [], [], []
        for k, (r, i) in enumerate(zip(rows.tolist(), items.tolist(), strict=True)):
            mine = self.own_grams(i)
            text = values[bounds[r] : bounds[r + 1]]
            left = np.searchsorted(mine[0], text, "left")
            at = np.flatnonzero(np.append(mine[0], np.uint64(0))[left] == text)
            at = at[left[at] < len(mine[0])]
            if not len(at):
                continue
            times = np.searchsorted(mine[0], text[at], "right") - left[at]
            begin = np.unique(np.repeat(at, times) - mine[1][runs(left[at], times)])
            size = int(self.words.first[i + 1] - self.words.first[i])
            cut = np.flatnonzero(np.diff(begin) > size) + 1
            slack, count = size // 2 + 1, int(w.first[r + 1] - w.first[r])
            low = np.maximum(begin[np.append(0, cut)] - slack, 0)
            high = np.minimum(begin[np.append(cut - 1, len(begin) - 1)] + size + slack, count)
            # An alignment that reaches the threshold spans at most size + (2 - 2 * THRESHOLD) * size words.
            span, step = 3 * size + 1, 3 * size
            pieces = np.maximum(1, -(-(high - low - span) // step))
            begin_at = np.repeat(low, pieces) + step * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            lows.append(begin_at)
            highs.append(np.minimum(begin_at + step + span, np.repeat(high, pieces)))
            of.append(np.full(len(begin_at), k))
        none = pd.DataFrame({"row": [], "item": [], "score": [], "start_word": [], "end_word": []})
        if not lows:
            return none
        low, high, of_pair = np.concatenate(lows), np.concatenate(highs), np.concatenate(of)
        row, item = rows[of_pair], items[of_pair]
        held = places.enough(item, w.first[row] + low, w.first[row] + high, need[item])
        low, high, row, item = low[held], high[held], row[held], item[held]
        size = np.diff(self.words.first)[item]
        out = []
        order = np.lexsort((high - low, size))
        at = 0
        while at < len(order):
            # Rows are as wide as their longest: the last ones of 256.
            last = order[min(at + 255, len(order) - 1)]
            take = max(1, int(CELLS // max(1, size[last], high[last] - low[last])))
            part = order[at : at + min(take, 256)]
            at += len(part)
            a = padded(self.words.hash, self.words.first[item[part]], size[part], 0)
            b = padded(w.hash, w.first[row[part]] + low[part], (high - low)[part], 1)
            best, end = align(a, b)
            good = best >= THRESHOLD * MATCH * size[part]
            if not good.any():
                continue
            part, best, end = part[good], best[good], end[good]
            back_a = padded(self.words.hash[::-1], len(self.words.hash) - self.words.first[item[part] + 1], size[part], 0)
            back_b = padded(w.hash[::-1], len(w.hash) - (w.first[row[part]] + low[part] + end), end, 1)
            span = align(back_a, back_b)[1]
            out.append(pd.DataFrame({"row": row[part], "item": self.ids[item[part]], "score": best / (MATCH * size[part]), "start_word": low[part] + end - span, "end_word": low[part] + end}))
        return pd.concat(out) if out else none

    def own_grams(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """An item's n-grams in order, and where in it they stand."""
        if i not in self.kept_grams:
            a, b = self.words.first[i], self.words.first[i + 1]
            part = Words(self.words.data, self.words.hash[a:b], self.words.start[a:b], self.words.end[a:b], np.array([0, b - a]), np.zeros(1, np.int64))
            values = grams(part, GRAM)[0]
            order = np.argsort(values, kind="stable")
            self.kept_grams[i] = values[order], order
        return self.kept_grams[i]


#: Pairs of texts and items, or words of texts, that are looked at together.
PAIRS = 1 << 20


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, end to end."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def in_parts(size: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Indices in order, in parts of about ``most`` in sum (one at least)."""
    group = (np.cumsum(size) - size) // most
    return (part for part in np.split(np.arange(len(size)), np.flatnonzero(np.diff(group)) + 1) if len(part))


class Places:
    """Where the words of some texts stand, to tell how many of an item's words a range of them holds."""

    def __init__(self, w: Words, items: Words):
        self.n = np.int64(len(w.hash) + 1)
        words, code = np.unique(w.hash, return_inverse=True)
        self.sorted = np.sort(code.astype(np.int64) * self.n + np.arange(len(w.hash)))
        at = np.minimum(np.searchsorted(words, items.hash), max(0, len(words) - 1))
        self.code = np.where(words[at] == items.hash, at, -1) if len(words) else np.full(len(items.hash), -1)
        self.first = items.first
        known = np.concatenate(([0], np.cumsum(self.code >= 0)))
        self.known = known[items.first[1:]] - known[items.first[:-1]]

    def enough(self, item: np.ndarray, low: np.ndarray, high: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Whether the words from ``low`` to ``high`` hold ``need`` of the item's, so that their alignment can reach it."""
        out = self.known[item] >= need
        size = np.diff(self.first)[item]
        for part in in_parts(np.where(out, size, 0), PAIRS):
            part = part[out[part]]
            code = self.code[runs(self.first[item[part]], size[part])]
            key = code * self.n + np.repeat(low[part], size[part])
            at = np.searchsorted(self.sorted, key)
            found = np.append(self.sorted, np.int64(2**63 - 1))[at] < code * self.n + np.repeat(high[part], size[part])
            total = np.concatenate(([0], np.cumsum(found & (code >= 0))))
            ends = np.cumsum(size[part])
            out[part] = total[ends] - total[ends - size[part]] >= need[part]
        return out


def blocks(items: DataFrame, block_bytes: int) -> Iterator[Items]:
    """The items in blocks of at most ``block_bytes`` of text (one item at least)."""
    ids, texts, size = [], [], 0
    rows = items.select(F.col("item_id").cast("long"), "text").filter("item_id is not null and text is not null")
    for item_id, text in rows.toLocalIterator():
        if ids and size + len(text) * 4 > block_bytes:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(item_id)
        texts.append(text)
        size += len(text) * 4
    if ids:
        yield Items(ids, texts)


def find_leaks(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs of a document and a test item of which it holds a copy, edited or not.

    Columns: doc_id, item_id, score (of the perfect copy's alignment score, THRESHOLD or more), start_word and
    end_word (bare words of the document, end exclusive; the best alignment, the first among equals). Null or empty
    texts match nothing; items with a null id match nothing, nor do copies without GRAM words in a row; items of fewer
    words match where they stand as they are, with a score of 1; equal items each match; repeated documents each give
    rows; a null doc_id stays null. Other columns are not looked at. Where the items need several blocks, each block's
    pass is published before the next one begins.
    """
    schema = "doc_id long, item_id long, score double, start_word long, end_word long"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def leaks(block: Items) -> DataFrame:
        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in (part for batch in batches for part in slices(batch)):
                found = block.search(words_of(b["text"], bare=True))
                ids = b["doc_id"].astype("Int64").array
                found.insert(0, "doc_id", ids[found["row"].to_numpy(np.int64)])
                yield found.rename(columns={"item": "item_id"}).drop(columns="row").astype({"item_id": "int64", "start_word": "int64", "end_word": "int64", "score": "float64"})

        return docs.mapInPandas(search, schema)

    held = list(pairs_of(blocks(items, block_bytes), leaks))
    return reduce(DataFrame.unionAll, held) if held else docs.sparkSession.createDataFrame([], schema)


def pairs_of(every: Iterator[Items], run: Callable[[Items], DataFrame]) -> Iterator[DataFrame]:
    """Results of each block; all but an only one published, so that no plan holds more than one block."""
    block, only = next(every, None), True
    while block is not None:
        after = next(every, None)
        only = only and after is None
        yield run(block) if only else publish(run(block))
        block = after


def drop_leaks(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows, with all their columns, whose text holds no copy of a test item.

    Items of fewer than GRAM words reject nothing here: that a text holds a word like "yes" doesn't make it a leak.
    """

    def kept(block: Items, rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in (part for batch in batches for part in slices(batch)):
                found = block.search(words_of(b["text"], bare=True), short=False)
                clean = np.ones(len(b), bool)
                clean[found["row"].to_numpy(np.int64)] = False
                yield b[clean]

        return rows.mapInPandas(run, rows.schema)

    out, begun = docs, False
    for block in blocks(items, block_bytes):
        out = kept(block, publish(out) if begun else out)
        begun = True
    return out
