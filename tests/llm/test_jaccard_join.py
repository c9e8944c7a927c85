from collections import Counter

import numpy as np
from helpers import by_id, documents, jaccard, prose, shingles

from quillmesh.llm import jaccard_join, similar


def edited(text, places):
    words = text.split()
    for k in places:
        words[k] = f"edit{k}"
    return " ".join(words)


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    links = Counter()

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.8:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    return [(rows[k][0], links[k], find(k)) for k in range(len(rows))]


ROWS = (
    [(i, edited(prose(200, 1), range(0, i * 3, 30))) for i in range(12)]
    + [(100 + i, prose(150, 50 + i)) for i in range(30)]
    + [(200 + i, prose(120, 7)) for i in range(5)]
    + [(300, ""), (301, "  \n"), (302, None), (303, "two words"), (304, "two words"), (305, "a b c d"), (306, prose(20000, 9)), (307, edited(prose(20000, 9), [5]))]
)


def test_classes_and_links_are_those_of_all_pairs(spark):
    found = by_id(jaccard_join.join_similar(documents(spark, ROWS)))
    want = brute(ROWS)
    least = {}
    for doc_id, _, root in want:
        least[root] = min(doc_id, least.get(root, doc_id))
    assert len(found) == len(ROWS)
    for doc_id, links, root in want:
        assert (found[doc_id]["n_links"], found[doc_id]["class_id"]) == (links, least[root]), doc_id


def test_blocks_lose_and_repeat_no_pair(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK_TEXTS", 3)
    rows = [(i, edited(prose(300, 1), [i * 7])) for i in range(25)]
    found = by_id(jaccard_join.join_similar(documents(spark, rows)))
    want = {i: n for i, n, _ in brute(rows)}
    assert {i: r["n_links"] for i, r in found.items()} == want
    assert {r["class_id"] for r in found.values()} == {0}


def test_null_ids_repeated_rows_and_empty_tables(spark):
    assert jaccard_join.join_similar(documents(spark, [])).count() == 0
    rows = [(None, prose(50, 1)), (5, prose(50, 1)), (5, prose(50, 1)), (None, prose(50, 2)), (7, prose(50, 3))]
    found = sorted((r["doc_id"] or -1, r["class_id"] or -1, r["n_links"]) for r in jaccard_join.join_similar(documents(spark, rows)).collect())
    assert found == [(-1, -1, 0), (-1, 5, 2), (5, 5, 2), (5, 5, 2), (7, 7, 0)]
    kept = jaccard_join.keep_one(documents(spark, rows))
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, 5, 7]
    assert kept.columns == documents(spark, rows).columns


def test_the_prefix_is_shortened_until_the_recall_is_met():
    depth = similar.forest_depth(0.8, 12, 8, 0.998)
    assert similar.forest_recall(0.8, depth, 12) >= 0.998 > similar.forest_recall(0.8, depth + 1, 12)


def test_intersections_by_blocks_of_columns(monkeypatch):
    monkeypatch.setattr(similar, "CELLS", 50)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(23)]
    total = np.concatenate([c for _, _, c in similar.shared_counts(sets)])
    for a in range(23):
        for b in range(23):
            if a != b:
                assert total[a, b] == len(np.intersect1d(sets[a], sets[b]))


def test_rows_of_one_id_are_told_apart_by_text(spark):
    a, b = prose(60, 801), prose(60, 802)
    rows = [(1, a), (5, a), (5, b), (6, b), (6, b), (7, a + " more"), (None, a)]
    kept = sorted((r["doc_id"] or -1, r["text"]) for r in jaccard_join.keep_one(documents(spark, rows)).collect())
    assert kept == sorted([(1, a), (5, b), (-1, a)])


def test_recall_of_pairs_at_the_threshold(spark):
    rows = []
    for k in range(200):
        words = prose(41, 9000 + k).split()
        rows.append((2 * k, " ".join(words)))
        words[3] = "edit"
        rows.append((2 * k + 1, " ".join(words)))
    found = by_id(jaccard_join.join_similar(documents(spark, rows)))
    assert sum(found[2 * k + 1]["class_id"] == 2 * k for k in range(200)) >= 197
