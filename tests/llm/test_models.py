import zlib

import numpy as np
from helpers import by_id, documents, prose

from quillmesh.llm import labelled, quality, toxicity
from quillmesh.llm.text import words_of

BAD = ("vile", "rotten", "awful")


def toxic_rows(n, start=0):
    rows, labels = [], []
    for k in range(start, start + n):
        bad = k % 3 == 0
        words = prose(60 + k % 90, k).split()
        if bad:
            words[(7 * k) % len(words)] = BAD[k % 9 // 3]
            words[(11 * k + 3) % len(words)] = BAD[(k + 1) % 3]
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    return rows, labels


def quality_rows(n):
    rows, labels = [], []
    for k in range(n):
        good = k % 3 != 0
        text = prose(80 + k % 60, k)
        rows.append((k, text if good else " ".join(f"{w} |" if k % 2 else f"{w}%%%" for w in text.split())))
        labels.append((k, int(good)))
    return rows, labels


def labels_of(spark, rows, name):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], f"doc_id long, {name} int, text string")


def numeric(loss, params, grads):
    rng = np.random.default_rng(0)
    for k, p in params.items():
        places = np.argsort(-np.abs(grads[k]).ravel())[:3].tolist() + rng.integers(0, p.size, 2).tolist()
        for place in places:
            i = np.unravel_index(place, p.shape)
            old = p[i]
            p[i] = old + 1e-4
            up = loss()
            p[i] = old - 1e-4
            down = loss()
            p[i] = old
            assert abs((up - down) / 2e-4 - grads[k][i]) < 1e-4 + 1e-3 * abs(grads[k][i]), k


def test_gradients_of_the_recurrent_network():
    texts = [prose(70, 1), prose(20, 2), ""]
    net = toxicity.Network(labelled.frequent(texts, 1))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = toxicity.Inputs(words_of(texts), net.vocabulary)
    rows, weight = x.windows(np.arange(len(x.start))), np.linspace(-1, 1, len(x.start))
    e = net.embed(x)
    _, kept = net.forward(net.project(e), rows, keep=True)
    numeric(lambda: float((net.forward(net.project(net.embed(x)), rows)[0] * weight).sum()), net.p, net.backward(x, e, rows, kept, weight))


def test_gradients_of_the_attention_model():
    texts = [prose(150, 1), prose(20, 2), "", "a a a | | %%"]
    model = quality.Model(labelled.frequent(texts, 1))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x = quality.Bags(words_of(texts), model.vocabulary)
    weight = np.linspace(-1, 1, 4)
    _, kept = model.forward(x)
    numeric(lambda: float((model.forward(x)[0] * weight).sum()), model.p, model.backward(x, kept, weight))


def test_windows_overlap_and_cover_every_word():
    count = np.array([0, 1, 48, 49, 200])
    start, owner = toxicity.window_starts(count)
    for k, n in enumerate(count):
        mine = start[owner == k]
        assert list(mine) == list(range(0, len(mine) * toxicity.STRIDE, toxicity.STRIDE)) and mine[-1] + toxicity.WINDOW >= n
        assert len(mine) == 1 or mine[-1] + toxicity.STRIDE < n


def test_toxicity_on_held_out_rows_and_odd_rows(spark):
    rows, labels = toxic_rows(600)
    odd = [(9001, None), (9002, ""), (9003, prose(30000, 1)), (9004, prose(30000, 2) + " vile rotten " + prose(3000, 3)), (None, "vile rotten vile"), (5, rows[5][1])]
    docs = documents(spark, rows + odd)
    known = labels_of(spark, [*labels, (7, None), (None, 1), (8, labels[8][1]), (77777, 1)], "toxic")
    found = toxicity.judge_documents(docs, known)
    got = by_id(found)
    assert found.count() == len(rows) + len(odd)
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in set(held)) for i, _ in rows)
    right = sum(got[i]["predicted"] == dict(labels)[i] for i in held)
    assert right / len(held) > 0.95
    assert not got[9001]["predicted"] and not got[9002]["predicted"] and got[9004]["predicted"] and got[9004]["score"] > got[9003]["score"]
    assert got[None]["held_out"] is False and 0 <= got[None]["score"] <= 1
    assert got[9004]["worst_word"] <= 30000 < got[9004]["worst_word"] + toxicity.WINDOW + 1
    network = toxicity.fit(docs, known, labelled.remainder("doc_id", 4) != 2)
    kept = toxicity.keep_clean(docs, network)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}


def test_quality_on_held_out_rows_and_odd_rows(spark):
    rows, labels = quality_rows(500)
    odd = [(9001, None), (9002, ""), (9003, prose(30000, 1)), (None, "a | b")]
    found = quality.judge_documents(documents(spark, rows + odd), labels_of(spark, labels, "quality"))
    got = by_id(found)
    assert found.count() == len(rows) + len(odd)
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["predicted"] == dict(labels)[i] for i in held) / len(held) > 0.95
    assert got[9003]["predicted"] == 1 and all(0 <= r["score"] <= 1 for r in got.values())


def test_without_labels_or_rows(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    for module, name, score in ((toxicity, "toxic", 0.0), (quality, "quality", 0.5)):
        assert {r["score"] for r in module.judge_documents(docs, labels_of(spark, [], name)).collect()} == {score}
        assert {r["score"] for r in module.judge_documents(docs, labels_of(spark, [(1, 1)], name)).collect()} == {score}
        assert module.judge_documents(documents(spark, []), labels_of(spark, [(1, 1), (2, 0)], name)).count() == 0
