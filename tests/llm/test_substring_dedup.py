import hashlib
import random

from helpers import by_id, documents, jaccard, prose, shingles

from quillmesh.llm import substring_dedup as S
from quillmesh.llm.text import words_of


def lines(*parts):
    return "\n".join(parts)


def test_repeated_lines_edited_lines_and_embedded_passages(spark):
    passage, para = prose(60, 1), prose(80, 2)
    words = para.split()
    words[40] = "changed"
    edited = " ".join(words)
    rows = [
        (1, lines(prose(50, 10), para)), (2, lines(para, prose(50, 11))), (3, lines("short line", edited, prose(46, 12))),
        (4, f"{prose(40, 13)} {passage} {prose(40, 14)}"), (5, lines(prose(20, 15), f"{prose(30, 16)} {passage}")), (6, f"{passage} {prose(70, 17)}"),
        (7, lines(prose(120, 18), "a short line", prose(60, 19))), (8, lines("another short line", prose(90, 20))), (9, prose(300, 21)),
    ]
    found = by_id(S.drop_repeats(documents(spark, rows), keep_text=True))
    text = dict(rows)
    for i in (1, 4, 7, 8, 9):
        assert (found[i]["n_removed"], found[i]["class_id"], found[i]["text"]) == (0, i, text[i])
    assert found[2]["text"].strip() == prose(50, 11) and found[2]["class_id"] == 1
    assert found[3]["text"] == lines("short line", "", prose(46, 12)) and found[3]["class_id"] == 1
    for i in (5, 6):
        assert found[i]["class_id"] == 4 and found[i]["n_removed"] == 1
        assert found[i]["chars_removed"] == len(passage)
    for r in found.values():
        gone = "".join(text[r["doc_id"]][x["start"] : x["end"]] for x in r["removed"])
        assert len(gone) == r["chars_removed"] == len(text[r["doc_id"]]) - len(r["text"])
        assert r["kept_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_most_embedded_passages_of_over_fifty_words_are_found(spark):
    rows = []
    for k in range(40):
        passage = prose(55, 1000 + k)
        rows += [(2 * k, f"{prose(30, 2000 + k)} {passage} {prose(30, 3000 + k)}"), (2 * k + 1, f"{prose(25, 4000 + k)} {passage} {prose(35, 5000 + k)}")]
    found = by_id(S.drop_repeats(documents(spark, rows)))
    assert sum(found[2 * k + 1]["class_id"] == 2 * k for k in range(40)) == 40
    assert all(r["chars_removed"] in (0, len(prose(55, 1000 + r["doc_id"] // 2))) for r in found.values())
    assert all(found[2 * k]["n_removed"] == 0 for k in range(40))


def test_repeated_lines_of_every_length_from_five_words_are_found(spark):
    sizes = [5, 8, 13, 20, 25, 30, 35, 40, 44]
    rows = []
    for k, n in enumerate(sizes):
        line = prose(n, 100 + k)
        rows += [(2 * k, lines(prose(60, 200 + k), line, prose(50, 300 + k))), (2 * k + 1, lines(prose(50, 400 + k), line, prose(60, 500 + k)))]
    # The last word of thirteen changed: 8 of 10 shingles; four words are one shingle.
    rows += [(50, lines(prose(13, 600), prose(50, 601))), (51, lines(prose(50, 602), prose(12, 600) + " changed")), (52, lines("a b c d", prose(50, 603))), (53, lines("a b c d", prose(50, 604)))]
    found = by_id(S.drop_repeats(documents(spark, rows), keep_text=True))
    for k in range(len(sizes)):
        assert (found[2 * k]["n_removed"], found[2 * k + 1]["n_removed"], found[2 * k + 1]["class_id"]) == (0, 1, 2 * k)
        assert found[2 * k + 1]["text"] == lines(prose(50, 400 + k), "", prose(60, 500 + k))
    assert (found[51]["n_removed"], found[51]["class_id"]) == (1, 50)
    assert [found[k]["n_removed"] for k in (50, 52, 53)] == [0, 0, 1] and found[53]["class_id"] == 52


def test_nulls_repeats_and_empty_tables(spark):
    assert S.drop_repeats(documents(spark, [])).count() == 0
    para = prose(60, 3)
    rows = [(None, para), (None, para), (1, None), (2, ""), (3, "\n\n"), (4, para), (5, lines(para, para)), (6, lines(*["again and again"] * 400))]
    found = S.drop_repeats(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    got = {r["doc_id"]: (r["class_id"], r["n_removed"], r["n_lines"]) for r in found}
    assert got[None] == (None, 0, 1) and got[1] == (1, 0, 0) and got[3] == (3, 0, 0)
    assert got[4] == (4, 0, 1) and got[5][0] == 4 and got[5][1] in (1, 2)


def test_pieces_depend_on_nearby_words_only():
    passage = prose(70, 5)
    a, b = f"{prose(33, 6)} {passage} {prose(20, 7)}", f"{prose(50, 8)} {passage}"
    cut = [S.pieces_of(words_of([t])) for t in (a, b)]
    shared = set(cut[0][3].tolist()) & set(cut[1][3].tolist())
    total = sum(int(n) for n, v in zip(cut[0][2], cut[0][3], strict=True) if int(v) in shared)
    assert 35 <= total <= 70
    for _, at, size, _ in cut:
        assert (at[1:] == (at + size)[:-1]).all()


def key(spark, rows):
    """The order of texts of one id."""
    made = documents(spark, rows).selectExpr("text", "xxhash64(text) h").distinct().collect()
    return {r["text"]: r["h"] for r in made}


def brute(rows, order):
    """Of the lines of each component of similar ones all but the first, by all pairs: {(doc_id, text): line numbers}."""
    places = sorted({(i, order[t], at, t) for i, t in rows for at, x in enumerate(t.split("\n")) if x.split()})
    sets = [shingles(t.split("\n")[at]) for _, _, at, t in places]
    root = list(range(len(places)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(places)):
        for b in range(a):
            if jaccard(sets[a], sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    gone = {}
    for k, (i, _, at, t) in enumerate(places):
        if find(k) != k:
            gone.setdefault((i, t), set()).add(at)
    return gone


def test_lines_of_any_length_edits_and_repeated_ids_against_all_pairs(spark):
    r = random.Random(11)
    base = [prose(r.choice([1, 2, 4, 5, 7, 9, 13, 20, 24]), 7000 + k) for k in range(60)]

    def line():
        words = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            words[r.choice([0, -1, -1, len(words) // 2])] = f"edit{r.randrange(4)}"
        return " ".join(words)

    # Ids repeat with other texts and as equal rows; no line may hold a passage, whose words have a test of their own.
    texts = [lines(*(line() for _ in range(r.randrange(1, 5)))) for _ in range(150)]
    rows = [(r.randrange(90), t) for t in texts] + [(5, texts[0]), (5, texts[0]), (1, "P q r s t u v w"), (2, "A\nB\nP q r s t u v w"), (2, "hi")]
    want = brute(rows, key(spark, rows))
    got = S.drop_repeats(documents(spark, rows), keep_text=True).collect()
    assert sorted((x["doc_id"]) for x in got) == sorted(i for i, _ in rows)
    text_of = {}
    for i, t in rows:
        every = t.split("\n")
        kept = "\n".join("" if at in want.get((i, t), ()) else x for at, x in enumerate(every))
        text_of.setdefault(i, []).append((kept, len(want.get((i, t), ()))))
    same = 0
    for x in got:
        if (x["text"], x["n_removed"]) in text_of[x["doc_id"]]:
            text_of[x["doc_id"]].remove((x["text"], x["n_removed"]))
            same += 1
    # Bands miss a pair at 0.8 in one of 300 cases.
    assert same >= len(rows) - 2


def test_recall_of_pairs_at_the_threshold(spark):
    # 41 words are 37 shingles; one edit four words from an end leaves 33 of 41: just above 0.8.
    rows = []
    for k in range(150):
        words = prose(41, 9000 + k).split()
        rows.append((2 * k, " ".join(words)))
        words[3] = "edit"
        rows.append((2 * k + 1, " ".join(words)))
    assert all(0.8 <= jaccard(shingles(rows[2 * k][1]), shingles(rows[2 * k + 1][1])) < 0.81 for k in range(150))
    found = by_id(S.drop_repeats(documents(spark, rows)))
    recall = sum(found[2 * k + 1]["class_id"] == 2 * k for k in range(150)) / 150
    assert recall >= 0.98


def test_recall_of_edited_and_short_passages_inside_longer_lines(spark):
    for size, edit, least in ((55, 27, 0.95), (60, 10, 0.95), (40, None, 0.9), (30, None, 0.8)):
        rows = []
        for k in range(60):
            words = prose(size, 11000 + 100 * size + k).split()
            first = " ".join(words)
            if edit is not None:
                words[edit] = "edit"
            rows += [(2 * k, f"{prose(30, 20000 + k)} {first} {prose(33, 30000 + k)}"), (2 * k + 1, f"{prose(41, 40000 + k)} {' '.join(words)} {prose(35, 50000 + k)}")]
        found = by_id(S.drop_repeats(documents(spark, rows)))
        whole = sum(abs(found[2 * k + 1]["chars_removed"] - len(" ".join(prose(size, 11000 + 100 * size + k).split()))) <= 12 for k in range(60)) / 60
        assert whole >= least, (size, edit, whole)
        assert all(found[2 * k]["n_removed"] == 0 for k in range(60))


def test_two_passages_of_a_periodic_line_leave_the_first():
    own = "a b c d e f g h i j k l m n o p q r s t".split() * 4
    assert S.passages(own, own, 40, 70, 20, 50) == [(20, 80)]
    assert S.passages(own[:10], own[:10], 5, 5, 0, 0) == []
