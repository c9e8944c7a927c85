"""Suffix-array dedup: bytes covered by a 200-byte string that starts anywhere else too.

Every 200-byte window has an anchor: the place in it where a 32-byte gram has the least hash, the leftmost among
equals. Equal windows have equal anchors, so only suffixes at anchors are sorted (about one in eighty-five), and of
those only suffixes whose gram occurs more than once. Splitters sampled from the texts deal the suffixes out into
ranges of their leading bytes. A task reads its ranges in the order of their leading grams, a few whole grams at a
time, sorts them by multikey quicksort on eight-byte characters, and takes the common prefixes of neighbours from the
sorted order. Splitters are whole grams, so suffixes that share the gram of a window are never on two sides of a
boundary. A window that begins ``left`` bytes before its anchor repeats if another suffix of the same run with a
common prefix of at least 200 - left bytes has the same ``left`` bytes before it (found by hashes, compared by bytes).

Anchors whose gram is so frequent that one gram could outgrow a task go another exact way: 128-bit hashes of their
windows are counted by a distributed aggregate. Their joins are salted.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.shared import publish, release
from quillmesh.llm.text import mix, slices, whole_groups

LENGTH, GRAM = 200, 32
REACH = LENGTH - GRAM
#: Anchors of one gram from which on its windows are counted by hashes; suffixes in one range, about, as long as there
#: are no more than MOST_RANGES (then ranges grow; tasks read them in parts); sampled suffixes for each splitter.
FREQUENT, RANGE, MOST_RANGES, SAMPLED = 100_000, 25_000, 20_000, 16
#: Parts of a frequent gram's rows in a join, and the most frequent grams that are broadcast (8 bytes each, counted before).
SALTS, BROADCAST_GRAMS = 64, 1 << 20
PLACE_BITS = np.uint64(22)
BASE = np.uint64(0x9E3779B97F4A7C15)


def rolled(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` bytes (a power of two), by doubling."""
    h, n, factor = data.astype(np.uint64) + np.uint64(1), 1, int(BASE)
    while n < size:
        h = h[:-n] * np.uint64(factor) + h[n:]
        n, factor = 2 * n, factor * factor % 2**64
    return mix(h)


def least(h: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of ``width`` values."""
    n = 1
    while 2 * n <= width:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[: len(h) - (width - n)], h[width - n :]) if width > n else h


class Anchors:
    """Anchors of a batch: text, place of the gram, first and last window (in the text's bytes), and the gram's hash."""

    def __init__(self, coded: list[bytes]):
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        stop = np.cumsum(size)
        data = np.frombuffer(b"".join(coded), np.uint8)
        self.row = self.place = self.low = self.high = np.zeros(0, np.int64)
        self.gram = np.zeros(0, np.uint64)
        if len(data) < LENGTH:
            return
        h = rolled(data, GRAM)
        if len(h) < 1 << int(PLACE_BITS):
            best = least(h >> PLACE_BITS << PLACE_BITS | np.arange(len(h), dtype=np.uint64), REACH + 1)
            at = (best & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)
        else:  # one long text: in overlapping parts
            step = (1 << int(PLACE_BITS)) - REACH - 1
            parts = []
            for a in range(0, len(h) - REACH, step):
                part = h[a : a + step + REACH]
                best = least(part >> PLACE_BITS << PLACE_BITS | np.arange(len(part), dtype=np.uint64), REACH + 1)
                parts.append((best & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64) + a)
            at = np.concatenate(parts)
        row = np.repeat(np.arange(len(coded)), size)[: len(at)]
        inside = np.flatnonzero(np.arange(len(at)) + LENGTH <= stop[row])
        at, row = at[inside], row[inside]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        if len(first):
            start = stop - size
            self.row, place = row[first], at[first]
            self.low = inside[first] - start[self.row]
            self.high = inside[np.append(first[1:], len(at)) - 1] - start[self.row]
            self.place = place - start[self.row]
            self.gram = h[place]

    def packed(self) -> np.ndarray:
        """Place, bytes from the first and from the last window to the place, in one number; a bit is free for FREQUENT."""
        return self.place << 17 | (self.place - self.low) << 8 | (self.place - self.high)


def unpacked(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place, first window, last window, frequent."""
    place = p >> 17
    return place, place - (p >> 8 & 0xFF), place - (p & 0xFF), (p >> 16 & 1).astype(bool)


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of rows of 64-bit characters: rows that tie so far are split by their next character, and only those."""
    order = np.arange(len(words))
    group = np.zeros(len(words), np.int64)  # of each sorted place: its run of ties
    active = np.arange(len(words))
    for depth in range(words.shape[1]):
        if len(active) < 2:
            break
        rows = order[active]
        char = words[rows, depth]
        by = np.lexsort((char, group[active]))
        rows, char, own = rows[by], char[by], group[active][by]
        order[active] = rows
        new = np.ones(len(rows), bool)
        new[1:] = (char[1:] != char[:-1]) | (own[1:] != own[:-1])
        run = np.cumsum(new) - 1
        group[active] = active[np.flatnonzero(new)][run]
        active = active[np.bincount(run)[run] > 1]
    return order


def repeated_windows(contexts: list[bytes], left: np.ndarray, count: np.ndarray, times: np.ndarray) -> list[list[int]]:
    """For each distinct context the windows that repeat, as starts and lengths of runs.

    A context is the text from its first window to 200 bytes after its anchor (or the text's end); ``left`` bytes of it
    lie before the anchor; it has ``count`` windows and stands ``times`` times in the texts.
    """
    m = len(contexts)
    after, before = np.zeros((m, LENGTH), np.uint8), np.zeros((m, REACH), np.uint8)
    for k, (c, a) in enumerate(zip(contexts, left.tolist(), strict=True)):
        after[k, : len(c) - a] = np.frombuffer(c, np.uint8, len(c) - a, a)
        before[k, :a] = np.frombuffer(c, np.uint8, a)[::-1]
    order = multikey_order(after.view(">u8").astype(np.uint64))
    after, before, left, count, times = after[order], before[order], left[order], count[order], times[order]
    differs = after[1:] != after[:-1]
    common = np.append(0, np.where(differs.any(axis=1), differs.argmax(axis=1), LENGTH))
    found = np.zeros((m, REACH + 1), bool)
    hashed = np.zeros(m, np.uint64)
    for n in range(REACH + 1):
        if n:
            hashed = hashed * BASE + before[:, n - 1] + np.uint64(1)
        mine = np.flatnonzero((n <= left) & (n > left - count))
        if len(mine):
            run = np.cumsum(common < LENGTH - n)
            key = mix(hashed[mine] ^ mix(run[mine].astype(np.uint64)))
            by = np.argsort(key)
            same = key[by][1:] == key[by][:-1]
            near = np.flatnonzero(same)
            if n and len(near):
                x, y = mine[by[near]], mine[by[near + 1]]
                same[near] = (before[x, :n] == before[y, :n]).all(axis=1)
            again = np.zeros(len(mine), bool)
            again[by[1:]] |= same
            again[by[:-1]] |= same
            found[mine, left[mine] - n] = again | (times[mine] > 1)
    edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    out: list[list[int]] = [[] for _ in range(m)]
    for k, a, b in zip(*np.nonzero(edges == 1), np.nonzero(edges == -1)[1], strict=True):
        out[order[k]] += [int(a), int(b - a)]
    return out


def drop_repeats(docs: DataFrame, keep_text: bool = False, frequent: int = FREQUENT) -> DataFrame:
    """Remove every byte covered by a 200-byte string that starts anywhere else too; one row per input row.

    Columns: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and with ``keep_text`` the
    remaining bytes. Texts are UTF-8, null counts as empty; matches never cross texts; strings are judged on the
    input. Repeated rows are texts of their own, so each removes the other; a null doc_id stays null; an empty table
    gives none; texts under 200 bytes stay whole; other columns are not looked at.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Two hashes, 128 bits, name a row by its id and text.
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("h2"), "text")

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
        for b in (part for batch in batches for part in slices(batch, 1 << 20)):
            yield b, [t.encode("utf-8", "surrogatepass") for t in b["text"]]

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, raw in coded(batches):
            yield pd.DataFrame({"gram": Anchors(raw).gram.view(np.int64)})

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, raw in coded(batches):
            a = Anchors(raw)
            yield pd.DataFrame({"gram": a.gram.view(np.int64), "h1": b["h1"].to_numpy()[a.row], "h2": b["h2"].to_numpy()[a.row], "at": a.packed()})

    def leading(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, raw in coded(batches):
            a = Anchors(raw)
            yield pd.DataFrame({"lead": [raw[r][p : p + GRAM] for r, p in zip(a.row[::8], a.place[::8], strict=True)]})

    counted = times = publish(docs.mapInPandas(grams, "gram long").groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"))
    often = times.filter(F.col("n") > frequent).select("gram", F.lit(True).alias("often"))
    often = F.broadcast(often) if often.count() <= BROADCAST_GRAMS else often.hint("merge")
    salted = docs.mapInPandas(anchors, "gram long, h1 long, h2 long, at long").join(often, "gram", "left")
    salted = salted.withColumn("salt", F.when(F.col("often"), F.pmod(F.hash("h1", "at"), F.lit(SALTS))).otherwise(0))
    times = times.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > frequent, SALTS - 1).otherwise(0))))
    marked = salted.join(times.hint("merge"), ["gram", "salt"])
    marked = marked.select("h1", "h2", F.when(F.col("often"), F.col("at").bitwiseOR(F.lit(1 << 16))).otherwise(F.col("at")).alias("at"))
    marks = publish(marked.groupBy("h1", "h2").agg(F.collect_set("at").alias("marks")))
    release(counted)
    total = marks.agg(F.sum(F.size("marks")).alias("n"), F.max(F.exists("marks", lambda x: x.bitwiseAND(1 << 16) > 0)).alias("hot")).first()
    ranges = min(MOST_RANGES, max(1, round((total["n"] or 0) / RANGE)))
    splitters: list[bytes] = []
    if ranges > 1:
        wanted = SAMPLED * ranges
        share = min(1.0, 2 * wanted / max(1, total["n"] // 8))
        leads = docs.sample(share, seed=3).mapInPandas(leading, "lead binary").orderBy(F.rand(5)).limit(wanted)
        seen = sorted(bytes(r["lead"]) for r in leads.collect())
        splitters = sorted({seen[len(seen) * k // ranges] for k in range(1, ranges)}) if seen else []
    held = docs.join(marks.hint("merge"), ["h1", "h2"]).select("doc_id", "h1", "h2", "text", "marks")

    def contexts(b: pd.DataFrame, which: tuple[bool, ...]) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
        """Row, first window, bytes left of the anchor, windows, context and gram of the anchors that are frequent or not."""
        for k, (text, at) in enumerate(zip(b["text"], b["marks"], strict=True)):
            raw = text.encode("utf-8", "surrogatepass")
            place, low, high, hot = unpacked(np.asarray(at, np.int64))
            some = np.isin(hot, which)
            for p, a, z in zip(place[some].tolist(), low[some].tolist(), high[some].tolist(), strict=True):
                yield k, a, p - a, z - a + 1, raw[a : p + LENGTH], raw[p : p + GRAM]

    def named(context: bytes, left: int, count: int) -> tuple[int, int]:
        d = xxhash.xxh3_128_intdigest(context, left << 8 | count)
        return (d >> 64) - 2**63, (d & (2**64 - 1)) - 2**63

    def send(which: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                kept: dict[tuple[int, int], list] = {}
                for _, _, left, count, context, gram in contexts(b, (which,)):
                    key = named(context, left, count)
                    if key in kept:
                        kept[key][-1] += 1
                    else:
                        kept[key] = [bisect_right(splitters, gram), *key, context, left, count, 1]
                yield pd.DataFrame(list(kept.values()), columns=["range", "d1", "d2", "context", "left", "count", "times"])

        return run

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h1, h2 = b["h1"].to_numpy(), b["h2"].to_numpy()
            rows = [(*named(context, left, count), h1[k], h2[k], a) for k, a, left, count, context, _ in contexts(b, (False, True))]
            yield pd.DataFrame(rows, columns=["d1", "d2", "h1", "h2", "low"])

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(batches, ["lead"], 1 << 20):
            times = part.groupby(["d1", "d2"], sort=False)["times"].transform("sum")
            part = part.assign(times=times).drop_duplicates(["d1", "d2"])
            runs = repeated_windows([bytes(c) for c in part["context"]], part["left"].to_numpy(np.int64), part["count"].to_numpy(np.int64), part["times"].to_numpy(np.int64))
            yield pd.DataFrame({"d1": part["d1"], "d2": part["d2"], "runs": runs})[[bool(r) for r in runs]]

    # Equal contexts are one already where they are made; repeated rows of one document count twice in them.
    made = "range int, d1 long, d2 long, context binary, left int, count int, times long"
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ranges // 8)
    dealt = held.mapInPandas(send(False), made).repartition(tasks, "range").withColumn("lead", F.expr(f"substring(context, `left` + 1, {GRAM})"))
    found = dealt.sortWithinPartitions("range", "lead").mapInPandas(sort, "d1 long, d2 long, runs array<int>")

    if total["hot"]:

        def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for d1, d2, context, count, times in zip(b["d1"], b["d2"], b["context"], b["count"], b["times"], strict=True):
                    for k in range(count):
                        d = xxhash.xxh3_128_intdigest(context[k : k + LENGTH])
                        rows.append(((d >> 64) - 2**63, (d & (2**64 - 1)) - 2**63, d1, d2, k, times))
                yield pd.DataFrame(rows, columns=["w1", "w2", "d1", "d2", "at", "times"])

        hot = held.mapInPandas(send(True), made).groupBy("d1", "d2").agg(F.any_value("context").alias("context"), F.any_value("count").alias("count"), F.sum("times").alias("times"))
        each = hot.mapInPandas(windows, "w1 long, w2 long, d1 long, d2 long, at int, times long")
        often = each.groupBy("w1", "w2").agg(F.sum("times").alias("n")).filter("n > 1").select("w1", "w2")
        again = each.join(often.hint("merge"), ["w1", "w2"]).groupBy("d1", "d2").agg(F.collect_set("at").alias("at"))
        found = found.unionByName(again.select("d1", "d2", F.flatten(F.transform(F.array_sort("at"), lambda k: F.array(k, F.lit(1)))).alias("runs")))

    where = held.mapInPandas(places, "d1 long, d2 long, h1 long, h2 long, low long").join(found.hint("merge"), ["d1", "d2"]).select("h1", "h2", "low", "runs")
    spans = where.groupBy("h1", "h2").agg(F.collect_set(F.struct("low", "runs")).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, found in zip(b["text"], b["spans"], strict=True):
                raw, cut, begin = text.encode("utf-8", "surrogatepass"), [], []
                if found is not None:
                    for x in found:
                        begin += [(x["low"] + a, x["low"] + a + n - 1 + LENGTH) for a, n in zip(x["runs"][::2], x["runs"][1::2], strict=True)]
                for a, z in sorted(begin):
                    if cut and a <= cut[-1][1]:
                        cut[-1][1] = max(cut[-1][1], z)
                    else:
                        cut.append([a, z])
                kept = b"".join(raw[a:z] for a, z in zip([0, *(z for _, z in cut)], [*(a for a, _ in cut), len(raw)], strict=True))
                rows.append((len(raw), len(raw) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), *([kept] * keep_text)))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")][1:])
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").array)
            yield out

    return docs.join(spans.hint("merge"), ["h1", "h2"], "left").select("doc_id", "text", "spans").mapInPandas(cut, schema)
