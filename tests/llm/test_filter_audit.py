import itertools
import random
import re

import duckdb
import pyarrow as pa
import pytest
from helpers import documents, prose

from quillmesh.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int"


def mask(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text))]
    return {x for x, f in zip("ABCD", fails, strict=True) if f}


def brute(rows, labels):
    """rows: id, text, part."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out, failed = {}, []
    for i, t, p in rows:
        f = mask(t or "")
        if i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, _ in rows):
            f.add("E")
        failed.append((p or "", f, i))
    for part in {p for p, _, _ in failed}:
        docs = [(f, i) for p, f, i in failed if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, x in enumerate(order):
                gone = [(f, i) for f, i in docs if x in f and not f & set(order[:k])]
                total[x] += len(gone)
                out[part, order, k + 1] = [
                    sum(not f & set(order[: k + 1]) for f, _ in docs), len(gone), sum(x in f and bool(f & set(order[:k])) for f, _ in docs), sum(f == {x} for f, _ in docs),
                    sum(i in good for _, i in gone), sum(i in toxic for _, i in gone),
                ]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(total[order[k - 1]])
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    texts = [prose(n, n) for n in (0, 10, 49, 50, 120)] + ["", None, "a b " * 60, "AB " * 80, prose(60, 1) + " #", "x", "\x0b\x1c y", "É " * 70]
    out = [(k, r.choice(texts), r.choice(["p", "q", "", None])) for k in range(300)]
    # One text holds a third of all rows; ids repeat, are null, and don't rise with the rows.
    out += [(1000 - k, prose(55, 9), r.choice(["p", "q"])) for k in range(200)]
    out += [(5, prose(120, 120), "p"), (5, prose(120, 120), "q"), (None, "x", "p"), (None, "x", None), (None, None, "q")]
    r.shuffle(out)
    return out


LABELLED = [*((k, k % 2, k % 3 == 0) for k in range(0, 1000, 3)), (6, None, None), (6, 1, 0), (9, 0, 1), (None, 1, 1)]


def test_every_order_agrees_with_brute_force_and_sql(spark, rows):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    base = documents(spark, [(i, t) for i, t, _ in rows]).drop("source")
    docs = spark.createDataFrame([(*r[:2], p, *r[2:]) for r, (_, _, p) in zip(base.collect(), rows, strict=True)], "doc_id long, text string, source string, " + ", ".join(f"{n} {t}" for n, t in base.dtypes[2:]))
    docs = docs.withColumnsRenamed({"set_id": "mask", "h": "part", "links": "print", "spans": "edge", "root": "run"})
    labels = spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in LABELLED], LABELS)
    want = brute(rows, [(i, q, t) for i, q, t in LABELLED])
    try:
        for n in ("1", "24"):  # at 24 the copies of the hot text stand in many partitions
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            got = filter_audit.audit(docs, labels).collect()
            assert {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in got} == want and len(got) == len(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([i for i, _, _ in rows], pa.int64()), "text": [t for _, t, _ in rows], "source": [p for _, _, p in rows]}))
    con.register("labels", pa.table({"doc_id": pa.array([i for i, _, _ in LABELLED], pa.int64()), "quality": pa.array([q for _, q, _ in LABELLED], pa.int32()), "toxic": pa.array([None if t is None else int(t) for _, _, t in LABELLED], pa.int32())}))
    found = con.sql(filter_audit.SQL)
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert found.columns == names and {(r[0], r[1], r[2]): list(r[3:]) for r in found.fetchall()} == want


def batches(rows, size):
    """Sorted rows (print, text, id) in batches."""
    rows = sorted(rows, key=lambda r: (r[0], r[1], r[2] is None, r[2]))
    for k in range(0, len(rows), size):
        p, t, i = zip(*rows[k : k + size], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(["p"] * len(p)), pa.array([0] * len(p), pa.int32()), pa.array(p, pa.binary()), pa.array(t)], ["doc_id", "part", "mask", "print", "text"])


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_equal_fingerprints_of_different_texts(size):
    """Texts that share a fingerprint are told apart, in a partition and over its edges."""
    rows = [(b"f", t, i) for i, t in enumerate("abcabcaab")] + [(b"g", "y", 1), (b"g", "z", 0), (b"g", "z", 7), (b"h", "q", None), (b"h", "q", None), (b"h", "q", 3)]
    for cut in range(0, 10):
        # As ranges go: by fingerprint and id.
        ordered = sorted(rows, key=lambda r: (r[0], r[2] is None, r[2] or 0))
        marked = [x for part in (ordered[:cut], ordered[cut:]) for b in filter_audit.mark_repeats(batches(part, size)) for x in b.to_pylist()]
        edges = {}
        for x in marked:
            if x["edge"]:
                edges[x["run"]] = min(edges.get(x["run"], x["first"]), x["first"])
        repeats = sum(x["repeated"] or (x["run"] is not None and x["doc_id"] > edges[x["run"]]) for x in marked if not x["edge"])
        assert repeats == sum(any(q == p and u == t and j is not None and i is not None and j < i for q, u, j in rows) for p, t, i in rows)


def test_counters_add_up_and_other_filters(spark, rows):
    docs = spark.createDataFrame([(i, t, p) for i, t, p in rows], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], LABELS)
    conditions = {"S": lambda t: t.rlike("1"), "T": lambda t: t.rlike("2")}
    counters = filter_audit.part_counters(filter_audit.failure_masks(docs, conditions), labels)
    got = filter_audit.interactions(counters, "ST").collect()
    assert {r["filter_order"] for r in got} == {"ST", "TS"}
    for r in got:
        texts = [t or "" for _, t, p in rows if (p or "") == r["part"]]
        a, b = r["filter_order"].replace("S", "1").replace("T", "2")
        own, before = (a, None) if r["step"] == 1 else (b, a)
        assert r["removed"] == sum(own in t and (before is None or before not in t) for t in texts)
        assert r["shapley"] == sum(own in t for t in texts) * 2 - sum("1" in t and "2" in t for t in texts)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    with pytest.raises(ValueError):
        filter_audit.failure_masks(docs, {})
