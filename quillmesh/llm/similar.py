"""Links between similar sets of word shingles: MinHash bands, then exact Jaccard on the shingles themselves.

Every set has ``trees`` bands of equally many MinHash values: the most, up to ``max_depth``, with which sets at the
threshold agree on some band with the target recall. That depth is worked out before any text is read; no prefixes are
sorted or shortened by text, as an LSH forest would. Where sets agree is a bucket; a bucket's leader is the least id in
it. A text is sent once to each of its leaders (most trees of a family of copies agree on one), never once per tree,
and a pair that shares leaders is compared at the least of them only.

Equal shingle sets are one text here, with a count of copies. A leader's texts are compared together if they are few,
else in pairs of blocks, so that no group goes to one task whole. A task reads its groups one after the other from
sorted rows, and sends back one row a text: how many links it has there and to which root its links lead. Pairs are
never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.shared import publish, release
from quillmesh.llm.text import minhash, mix, set_ids, shingle_sets, slices, whole_groups, words_of

#: Most texts, and most characters of texts, in one block of a leader's texts.
BLOCK_TEXTS, BLOCK_CHARS = 4096, 1 << 25
#: Cells of a block of the membership matrix.
CELLS = 1 << 23
#: Comparisons of pairs in one task, about.
TASK_PAIRS = 1 << 22


def forest_recall(threshold: float, depth: int, trees: int) -> float:
    """How likely two sets of that similarity share a prefix of that depth in at least one tree."""
    return 1 - (1 - threshold**depth) ** trees


def forest_depth(threshold: float, trees: int, max_depth: int, target: float) -> int:
    """Shorten the matched prefix until the recall at the threshold reaches the target (1 at least)."""
    depth = max_depth
    while depth > 1 and forest_recall(threshold, depth, trees) < target:
        depth -= 1
    return depth


def signatures(values: np.ndarray, bounds: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """Prefix hashes of each set, one column a tree."""
    low = minhash(values, bounds, trees * depth).reshape(-1, trees, depth)
    key = np.zeros(low.shape[:2], np.uint64)
    for k in range(depth):
        key = mix(key * np.uint64(3) + low[:, :, k])
    return mix(key + np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x1000193))


def least_partner(threshold: float) -> int:
    """The least size of a set that another, unequal set can reach the threshold with: n of n + 1 members."""
    n = 1
    while n / (n + 1) < threshold - 1e-9:
        n += 1
    return n


def shared_counts(sets: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Sizes of all pairwise intersections, by blocks of rows: first row, last row, counts against all sets."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times[column] > 1
    owner, column = owner[common], column[common]
    kept = np.unique(column)
    column = np.searchsorted(kept, column)
    rows = max(1, min(len(sets), 1024))
    wide = max(1, CELLS // rows)
    order = np.argsort(column, kind="stable")  # by blocks of columns, rows in order within
    by_column = np.searchsorted(column[order], np.arange(0, len(kept) + wide, wide))
    for a in range(0, len(sets), rows):
        b = min(a + rows, len(sets))
        total = np.zeros((b - a, len(sets)), np.float32)
        for k in range(len(by_column) - 1):
            part = order[by_column[k] : by_column[k + 1]] if len(by_column) > 2 else np.arange(len(owner))
            who, what = owner[part], column[part] - k * wide
            width = min(wide, len(kept) - k * wide)
            left = np.zeros((b - a, width), np.float32)
            mine = (who >= a) & (who < b)
            left[who[mine] - a, what[mine]] = 1
            for c in range(0, len(sets), rows):
                d = min(c + rows, len(sets))
                right = left
                if c != a:
                    right = np.zeros((d - c, width), np.float32)
                    theirs = (who >= c) & (who < d)
                    right[who[theirs] - c, what[theirs]] = 1
                total[:, c:d] += left @ right.T
        yield a, b, total


def spanning_roots(link: np.ndarray) -> np.ndarray:
    """The first row of each row's component in a symmetric matrix of links."""
    n = len(link)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] < 0:
            edge = np.zeros(n, bool)
            edge[i] = True
            while edge.any():
                root[edge] = i
                edge = link[edge].any(axis=0) & (root < 0)
    return root


def met_before(home: int, leaders: list[list[int]]) -> tuple[np.ndarray, bool]:
    """The leaders less than ``home`` of each text, as numbers (-1: none), one row a text; and whether there are none."""
    lesser: dict[int, int] = {}
    rows = [[lesser.setdefault(x, len(lesser)) for x in some if x < home] for some in leaders]
    out = np.full((len(rows), max(1, *map(len, rows))), -1)
    for k, x in enumerate(rows):
        out[k, : len(x)] = x
    return out, not lesser


def compare(home: int, block: np.ndarray, copies: np.ndarray, leaders: list[list[int]], sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of one group's texts: how many other documents each is linked to, and the index of its root.

    With two blocks only pairs of a text of each are compared; the pairs within a block are a group of their own.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    count = len(sets)
    link = np.zeros((count, count), bool)
    mixed = (block != block[0]).any()
    # A pair that also meets at a lesser leader is compared there.
    met, plain = met_before(home, leaders)
    for a, b, shared in shared_counts(sets):
        both = size[a:b, None] + size[None, :] - shared
        good = (shared > 0) & (shared >= threshold * both - 1e-9)
        good[np.arange(b - a), np.arange(a, b)] = False
        if mixed:
            good &= block[a:b, None] != block[None, :]
        if not plain and good.any():
            i, j = np.nonzero(good)
            for part in range(0, len(i), 1 << 18):
                x, y = i[part : part + (1 << 18)], j[part : part + (1 << 18)]
                meet = np.zeros(len(x), bool)
                for s in range(met.shape[1]):
                    mine = met[a + x, s]
                    meet |= (mine >= 0) & (met[y] == mine[:, None]).any(axis=1)
                good[x[meet], y[meet]] = False
        link[a:b] = good
    return (link * copies[None, :]).sum(axis=1), spanning_roots(link)


def compare_two(home: int, leaders: list[list[int]], a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two texts alone at a leader are linked there."""
    low, high = sorted((len(a), len(b)))
    if low < threshold * high - 1e-9 or not set(leaders[0]).isdisjoint(x for x in leaders[1] if x < home):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= threshold * (low + high - shared) - 1e-9


def leaders_of(sets: DataFrame) -> DataFrame:
    """The sets that share a bucket with another, with ``leaders`` (sorted), the 64-bit numbers of their buckets' first sets.

    ``sets`` has set_id, keys and columns to keep. Sets that share a number only meet in more groups.
    """
    number = F.xxhash64("set_id").alias("number")
    placed = sets.select(number, F.explode("keys").alias("key"))
    buckets = placed.groupBy("key").agg(F.min("number").alias("leader"), F.max("number").alias("most")).filter("leader < most").drop("most")
    led = placed.join(buckets.hint("merge"), "key").groupBy("number").agg(F.array_sort(F.collect_set("leader")).alias("leaders"))
    return sets.drop("keys").withColumn("number", number).join(led.hint("merge"), "number").drop("number")


def linked(wanted: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """Verified links: set_id, root (a linked set) and links (documents with another set) of every group's linked sets.

    ``wanted`` has set_id, chars and leaders, one row a set; ``texts`` has set_id, copies, leaders and text of those
    sets (rows that repeat one count once).
    """
    sizes = wanted.select("chars", F.explode("leaders").alias("home")).groupBy("home").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    homes = publish(sizes.select("home", "n", F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("chars") / BLOCK_CHARS)).cast("int").alias("blocks")))
    pairs = homes.agg(F.sum(F.col("n") * F.col("n")).alias("pairs")).first()["pairs"] or 0
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // TASK_PAIRS))
    own = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    each = texts.select("set_id", "copies", "leaders", "text", F.explode("leaders").alias("home"))
    sent = each.join(homes.drop("n").hint("merge"), "home").withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    sent = sent.select("home", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set_id", "copies", "leaders", "text")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(batches, ["home", "i", "j"]):
            part = part.drop_duplicates(["home", "i", "j", "set_id"])
            values, bounds = shingle_sets(words_of(part["text"].tolist()), n)
            home, ids, own = part["home"].tolist(), part["set_id"].tolist(), part["own"].to_numpy()
            copies, leaders = part["copies"].to_numpy(), part["leaders"].tolist()
            place = list(zip(home, part["i"].tolist(), part["j"].tolist(), strict=True))
            first = [0, *(k for k in range(1, len(place)) if place[k] != place[k - 1])]
            out: list[tuple[bytes, int, bytes]] = []
            for a, b in zip(first, [*first[1:], len(place)], strict=True):
                if b - a < 2 or (place[a][1] != place[a][2] and (own[a:b] == own[a]).all()):
                    continue
                sets = [values[bounds[k] : bounds[k + 1]] for k in range(a, b)]
                if b - a == 2:
                    if compare_two(home[a], leaders[a:b], *sets, threshold):
                        out += [(ids[a], int(copies[a + 1]), ids[a]), (ids[a + 1], int(copies[a]), ids[a])]
                    continue
                links, root = compare(home[a], own[a:b], copies[a:b], leaders[a:b], sets, threshold)
                out += [(ids[a + k], int(links[k]), ids[a + int(root[k])]) for k in np.flatnonzero(links)]
            yield pd.DataFrame(out, columns=["set_id", "links", "root"])

    dealt = sent.repartition(tasks, "home", "i", "j").sortWithinPartitions("home", "i", "j")
    done = publish(dealt.mapInPandas(verify, "set_id binary, links long, root binary"))
    release(homes)
    return done


def signed(texts: pd.DataFrame, n: int, trees: int, depth: int, threshold: float) -> Iterator[tuple[pd.DataFrame, list[bytes | None], list[np.ndarray]]]:
    """Slices of a batch with their set ids (None without words) and keys (none for sets that only equal sets match)."""
    for b in slices(texts):
        values, bounds = shingle_sets(words_of(b["text"].tolist()), n)
        keys = signatures(values, bounds, trees, depth).view(np.int64)
        some = np.diff(bounds) >= least_partner(threshold)
        yield b, set_ids(values, bounds), [k if s else k[:0] for k, s in zip(keys, some, strict=True)]
