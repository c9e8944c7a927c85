import random
import time

import numpy as np
from helpers import documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.llm import decontaminate as D
from quillmesh.llm.text import words_of


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "item_id long, text string, doc_id string, score double")


def edited(text, every):
    return " ".join("other" if k % every == every - 1 else w for k, w in enumerate(text.split()))


def pairs(df):
    return {(r["doc_id"], r["item_id"]) for r in df.collect()}


def test_copies_are_found_and_clean_texts_are_left(spark):
    bench = [(k, prose(30, 100 + k)) for k in range(20)] + [(90, "onetwo"), (91, None), (92, ""), (93, prose(30, 100)), (None, prose(30, 105))]
    rows = [(k, prose(200, 300 + k)) for k in range(30)]
    rows += [(50, f"{prose(40, 1)} {bench[0][1]} {prose(40, 2)}"), (51, f"{prose(90, 3)} {edited(bench[1][1], 6)}"), (52, bench[2][1].upper().replace(" ", ",  ")), (53, bench[3][1] + "\n" + bench[4][1])]
    rows += [(54, None), (55, ""), (None, bench[5][1]), (56, bench[6][1]), (56, bench[6][1]), (57, prose(8000, 4) + " " + bench[7][1] + " " + prose(8000, 5)), (58, " ".join(bench[8][1].split()[:10]))]
    found = D.find_leaks(documents(spark, rows), items(spark, bench))
    assert pairs(found) == {(50, 0), (50, 93), (51, 1), (52, 2), (53, 3), (53, 4), (None, 5), (56, 6), (57, 7)}
    got = {(r["doc_id"], r["item_id"]): r for r in found.collect()}
    assert got[50, 0]["score"] == 1.0 and (got[50, 0]["start_word"], got[50, 0]["end_word"]) == (40, 70)
    assert got[57, 7]["start_word"] == 8000 and 0.4 <= got[51, 1]["score"] < 1
    assert found.filter("doc_id = 56").count() == 2
    small = D.find_leaks(documents(spark, rows), items(spark, bench), block_bytes=600)
    assert sorted(map(str, small.collect())) == sorted(map(str, found.collect()))
    kept = D.drop_leaks(documents(spark, rows), items(spark, bench))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows if i is not None} - {50, 51, 52, 53, 56, 57}
    assert kept.columns == documents(spark, []).columns


def test_an_item_that_leaked_everywhere_still_has_seeds(spark):
    bench = [(1, prose(25, 1))]
    rows = [(k, f"{prose(30, 10 + k)} {bench[0][1]}") for k in range(60)]
    assert len(pairs(D.find_leaks(documents(spark, rows), items(spark, bench)))) == 60


def test_lone_half_copies_and_lone_edited_copies_are_found(spark):
    bench = [(k, prose(30, 600 + k)) for k in range(4)]
    first, last = (" ".join(bench[0][1].split()[:15])), (" ".join(bench[1][1].split()[15:]))
    rows = [(1, f"{prose(40, 1)} {first} {prose(40, 2)}"), (2, f"{prose(40, 3)} {last}"), (3, f"{prose(40, 4)} {edited(bench[2][1], 5)} {prose(40, 5)}")]
    # A half that leaks beside whole copies elsewhere.
    rows += [(4, bench[3][1]), (5, f"{prose(30, 6)} {' '.join(bench[3][1].split()[:15])}")]
    assert pairs(D.find_leaks(documents(spark, rows), items(spark, bench))) == {(1, 0), (2, 1), (3, 2), (4, 3), (5, 3)}
    assert D.drop_leaks(documents(spark, rows), items(spark, bench)).count() == 0


def test_short_items_are_found_as_they_are(spark):
    bench = [(1, "Zebra!"), (2, "zebra crossing"), (3, "crossing zebra stripes again"), (4, "..."), (5, prose(30, 700))]
    rows = [(1, "a zebra, crossing"), (2, "zebras cross"), (3, "crossing zebra"), (4, "crossing zebra stripes again")]
    found = D.find_leaks(documents(spark, rows), items(spark, bench))
    assert pairs(found) == {(1, 1), (1, 2), (3, 1), (4, 1), (4, 3)}
    got = {(r["doc_id"], r["item_id"]): (r["score"], r["start_word"], r["end_word"]) for r in found.collect()}
    assert got[1, 2] == (1.0, 1, 3) and got[3, 1] == (1.0, 1, 2)
    assert sorted(map(str, D.find_leaks(documents(spark, rows), items(spark, bench), block_bytes=1).collect())) == sorted(map(str, found.collect()))
    assert {r["doc_id"] for r in D.drop_leaks(documents(spark, rows), items(spark, bench), block_bytes=1).collect()} == {1, 2, 3}


def test_recall_and_scores_against_brute_force(spark):
    # Every k-th word of a copy is another one; all pairs are aligned by the full table.
    bench = [(k, prose(24 + k, 800 + k)) for k in range(8)]
    rows = [(10 * every + k, f"{prose(15, 900 + k)} {edited(bench[k][1], every)} {prose(15, 950 + k)}") for every in (4, 5, 7, 100) for k in range(8)] + [(5000 + k, prose(60, 990 + k)) for k in range(6)]
    number = {}

    def words(t):
        return [number.setdefault(x, len(number) + 2) for x in t.lower().split()]

    want = {}
    for i, t in rows:
        for j, item in bench:
            score = smith_waterman(words(item), words(t)) / (D.MATCH * len(words(item)))
            if score >= D.THRESHOLD:
                want[i, j] = score
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in D.find_leaks(documents(spark, rows), items(spark, bench)).collect()}
    assert got.keys() <= want.keys() and len(got) >= 0.97 * len(want) and len(want) >= 32
    assert all(abs(got[p] - want[p]) < 1e-9 for p in got)


def test_empty_tables(spark):
    assert D.find_leaks(documents(spark, []), items(spark, [(1, prose(30, 1))])).count() == 0
    assert D.find_leaks(documents(spark, [(1, "a b c")]), items(spark, [])).count() == 0
    assert D.drop_leaks(documents(spark, [(1, "a b c")]), items(spark, [])).count() == 1


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (D.MATCH if a[i - 1] == b[j - 1] else D.MISMATCH), h[i - 1, j] + D.GAP, h[i, j - 1] + D.GAP)
    return int(h.max())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(2, 5), min_size=1, max_size=9), st.lists(st.integers(2, 5), min_size=1, max_size=14))
def test_alignment_scores_are_those_of_the_full_table(a, b):
    best, end = D.align(np.array([a + [0] * 3], np.uint64), np.array([b + [1] * 2], np.uint64))
    assert best[0] == smith_waterman(a, b)
    assert smith_waterman(a, b[: end[0]]) == best[0]


def test_pairs_that_share_seeds_are_those_of_whole_alignments():
    """Few words, so that seeds are common and texts repeat themselves: scores are those of aligning the whole text."""
    r = random.Random(8)
    words = ["one", "of", "the", *"abcdefghij"]
    items = [" ".join(r.choice(words) for _ in range(r.randrange(3, 25))) for _ in range(25)] + ["one of the " * 8]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(0, 90))) for _ in range(20)] + ["one of the " * 300, "one of the " * 100 + items[3] + " b" * 50, " ".join(items[:12]) * 3]
    block, w = D.Items(list(range(len(items))), items), words_of(texts, bare=True)
    got = {(int(x["row"]), int(x["item"])): float(x["score"]) for _, x in block.search(w).iterrows()}
    for row, text in enumerate(texts):
        t = text.split()
        for k, item in enumerate(items):
            i = item.split()
            seeds = {tuple(i[x : x + 3]) for x in range(len(i) - 2)} & {tuple(t[x : x + 3]) for x in range(len(t) - 2)}
            if not seeds:
                assert (row, k) not in got
                continue
            a, b = block.words.hash[block.words.first[k] : block.words.first[k + 1]][None, :], w.hash[w.first[row] : w.first[row + 1]][None, :]
            score = int(D.align(a, b)[0][0]) / (2 * len(i))
            if score >= D.THRESHOLD:
                # A window around seeds holds the alignment unless it lies away from every seed's diagonal.
                assert (row, k) in got and got[row, k] <= score
                assert score < 0.6 or got[row, k] == score
            else:
                assert (row, k) not in got


def test_common_seeds_and_repetitive_texts_cost_little():
    r = random.Random(3)
    voc = [f"w{k}" for k in range(3000)]
    items = [" ".join([*r.choices(voc, k=20), "one", "of", "the", *r.choices(voc, k=20)]) for _ in range(1000)]
    texts = ["one of the " * 30_000, " ".join([*r.choices(voc, k=100), "one", "of", "the", items[5], *r.choices(voc, k=100)])]
    began = time.process_time()
    got = D.Items(list(range(1000)), items).search(words_of(texts, bare=True))
    assert [(x["row"], x["item"], x["score"]) for _, x in got.iterrows()] == [(1, 5, 1.0)] and time.process_time() - began < 20
