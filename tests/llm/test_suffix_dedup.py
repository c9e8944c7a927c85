import hashlib
import random
from collections import Counter

import numpy as np
from helpers import documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.llm import suffix_dedup as S


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    times = Counter(r[k : k + 200] for r in raw for k in range(len(r) - 199))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - 199):
            if times[r[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, **more):
    found = S.drop_repeats(documents(spark, rows), **more).collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found)
    assert got == Counter((i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows]), strict=True))


def corpus():
    passage, other = prose(60, 1), "é" * 150 + prose(20, 2)
    rows = [(k, f"{prose(30 + k, 10 + k)} {passage} {prose(20, 40 + k)}") for k in range(8)]
    rows += [(20, prose(300, 5)), (21, prose(300, 5)), (22, prose(300, 5)[:-1]), (23, passage[:199]), (24, passage[:200]), (25, "ab" * 400), (26, "x" * 1000), (27, "x" * 150)]
    rows += [(30, other), (31, "y" + other), (32, other * 2), (40, None), (41, ""), (42, "\x00" * 250), (43, "\x00" * 199 + prose(50, 6))]
    return rows + [(50, prose(4000, 7)), (51, prose(4000, 7)[500:9000]), (None, prose(100, 8)), (None, prose(100, 8)), (60, prose(90, 9)), (60, prose(90, 9))]


def test_removes_what_all_windows_say(spark):
    check(spark, corpus())


def test_frequent_grams_go_the_other_exact_way(spark):
    check(spark, corpus(), frequent=1)
    check(spark, corpus(), frequent=4)


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(S, "RANGE", 20)
    check(spark, corpus())


def test_one_task_reads_ranges_in_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "RANGE", 20)
    monkeypatch.setattr(S, "MOST_RANGES", 3)
    monkeypatch.setattr(S, "BROADCAST_GRAMS", 0)
    check(spark, corpus(), frequent=3)


def test_empty_table(spark):
    assert S.drop_repeats(documents(spark, [])).count() == 0


def test_kept_bytes(spark):
    text = prose(80, 3)
    r = S.drop_repeats(documents(spark, [(1, "lead " + text), (2, text + " tail")]), keep_text=True).orderBy("doc_id").collect()
    assert bytes(r[0]["kept"]) == b"lead " and bytes(r[1]["kept"]) == b" tail"


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_sorts_by_multikey_quicksort(seed):
    r = random.Random(seed)
    rows = np.array([[r.choice((0, 1, 2**63)) for _ in range(4)] for _ in range(r.randrange(1, 40))], np.uint64)
    order = S.multikey_order(rows)
    assert sorted(order) == list(range(len(rows)))
    assert [tuple(rows[k]) for k in order] == sorted(map(tuple, rows))


def test_every_window_has_one_anchor_and_equal_windows_the_same(monkeypatch):
    for bits in (22, 10):
        monkeypatch.setattr(S, "PLACE_BITS", np.uint64(bits))
        raw = [t.encode() for t in (prose(400, 1), "ab" * 600, prose(400, 1)[7:], "short", "z" * 200)]
        a = S.Anchors(raw)
        seen = {}
        for k, r in enumerate(raw):
            mine = a.row == k
            windows = [(s, p) for p, lo, hi in zip(a.place[mine], a.low[mine], a.high[mine], strict=True) for s in range(lo, hi + 1)]
            assert sorted(s for s, _ in windows) == list(range(max(0, len(r) - 199)))
            for s, p in windows:
                assert s <= p <= s + 168
                if bits == 22:
                    assert seen.setdefault(r[s : s + 200], p - s) == p - s
        place, low, high, hot = S.unpacked(a.packed())
        assert (place == a.place).all() and (low == a.low).all() and (high == a.high).all() and not hot.any()
