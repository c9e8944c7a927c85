import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import documents, prose

from quillmesh.llm import hidden_markov as hmm


def small_model(states=2, classes=4, seed=1):
    r = np.random.default_rng(seed)
    emit, move, start, resumed = r.random((classes, states)), r.random((states, states)), r.random(states), r.random(states)
    return hmm.Model(start / start.sum(), resumed / resumed.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def paths(m, codes, start):
    """All state paths of a sequence with their joint probabilities."""
    for path in itertools.product(range(len(start)), repeat=len(codes)):
        p = start[path[0]] * m.emit[codes[0], path[0]]
        for a, b, c in zip(path, path[1:], codes[1:], strict=False):
            p *= m.move[a, b] * m.emit[c, b]
        yield path, p


@pytest.mark.parametrize("chunk", [1, 2, 3, 100])
def test_forward_is_the_sum_over_all_paths(chunk):
    m, r = small_model(3), np.random.default_rng(2)
    texts = [r.integers(0, 4, n) for n in (1, 2, 3, 5, 7, 4, 1)]
    got = hmm.log_likelihood(np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts]))), m, chunk)
    assert np.allclose(got, [math.log(sum(p for _, p in paths(m, t, m.start))) for t in texts])


def test_long_texts_keep_their_scale():
    m = small_model(4, 50)
    codes = np.random.default_rng(3).integers(0, 50, 30_000)
    bounds = np.array([0, len(codes)])
    whole = hmm.log_likelihood(codes, bounds, m, 10**9)
    assert np.allclose(hmm.log_likelihood(codes, bounds, m), whole, rtol=1e-12) and whole[0] < -50_000


@pytest.mark.parametrize("segment", [2, 4, 100])
def test_expected_counts_are_those_of_all_paths(segment):
    m, r = small_model(2), np.random.default_rng(4)
    texts = [r.integers(0, 4, n) for n in (5, 1, 3, 6)]
    rows, want = np.zeros((4 + 2 + 3, 2)), np.zeros((4 + 2 + 3, 2))
    hmm.expected(np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts]))), m, rows, segment)
    for t in texts:
        for at in range(0, len(t), segment):
            codes, start = t[at : at + segment], m.resumed if at else m.start
            total = sum(p for _, p in paths(m, codes, start))
            for path, p in paths(m, codes, start):
                w = p / total
                want[4 + 2 + bool(at), path[0]] += w
                for s, c in zip(path, codes, strict=True):
                    want[c, s] += w
                for a, b in zip(path, path[1:], strict=False):
                    want[4 + a, b] += w
            want[8, 0] += math.log(total)
    assert np.allclose(rows, want)


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", low)


@pytest.fixture(scope="module")
def rows():
    texts = [None, "", "  ", "The the THE É é", "a\x0bb\x1cc\xa0d", prose(3000, 1), "only held out words zzz " * 3]
    out = [(k, prose(20 + k % 40, k % 70, ("alpha", "beta")), ) for k in range(150)]
    return [*out, *((200 + k, t) for k, t in enumerate(texts)), (None, "a null id"), (3, "repeated id"), (3, "repeated id"), *((400 + k, texts[k % 7]) for k in range(14))]


@pytest.mark.parametrize("frequent", [0, 30, hmm.FREQUENT])
def test_counts_and_base_scores_agree_with_brute_force(spark, rows, frequent):
    counts, texts = Counter(), 0
    for i, t in rows:
        if not crc(i):
            counts.update(tokens(t))
            texts += 1
    total, distinct = sum(counts.values()) + texts, len(counts) + 1
    docs = documents(spark, rows).withColumnsRenamed({"set_id": "key", "h": "codes", "links": "word", "score": "n"})
    got = hmm.score_documents(docs, states=3, iterations=2, frequent=frequent).collect()
    want = []
    for i, t in rows:
        have = [counts[w] for w in tokens(t)] + [texts]
        base = sum(math.log10((c + 1) / (total + distinct + 1)) for c in have)
        want.append((i, crc(i), len(have), sum(c > 0 for c in have), total, round(base, 6)))
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))) for r in got)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault((r["base_score"], r["n_tokens"]), set()).add(round(r["score"], 9))
    assert all(len(s) == 1 for s in by_text.values())  # equal texts have equal scores


def test_scores_are_those_of_the_trained_model(spark, rows):
    """The joined score against the model written out: one path sum a text, and each word's own probability."""
    docs = documents(spark, [(i, (t or "")[:40]) for i, t in rows])
    base = docs.select("doc_id", hmm.held_out(docs.doc_id).alias("held_out"), "text")
    training = base.filter("not held_out")
    counts = hmm.count_words(training)
    v = hmm.vocabulary(counts, training.count(), most=5)
    assert 0 < len(v.hash) <= 5
    coded = hmm.publish(hmm.encode(base, v))
    m, likelihoods = hmm.train(coded, v, states=2, iterations=4)
    assert likelihoods[-1] > likelihoods[0]
    assert np.allclose(m.emit.sum(0), 1) and np.allclose(m.move.sum(1), 1) and (m.emit > 0).all()
    n = {r["word"]: r["n"] for r in counts.collect()}
    place = {int(h): k for k, h in enumerate(v.hash)}
    for r in hmm.score(coded, m).collect():
        text = next((t or "")[:40] for i, t in rows if i == r["doc_id"] and len(tokens((t or "")[:40])) + 1 == r["n_tokens"])
        codes, own = [], 0.0
        for w in tokens(text):
            h = int(hmm.tokens_of([w]).hash[0])
            c = zlib.crc32(w.encode()) % hmm.CLASSES
            codes.append(place.get(h, len(v.hash) + c))
            own -= 0 if h in place else math.log10(v.class_tokens[c] + v.class_words[c] + 1)
        start = m.start
        for k, c in enumerate([*codes, v.end]):
            start = (start if k == 0 else start @ m.move) * m.emit[c]
        assert math.isclose(r["forward"], math.log10(start.sum()), rel_tol=1e-9) and math.isclose(r["within"], own, abs_tol=1e-9)
    # Every class's words, with one unseen, share exactly what the class has.
    for c in range(hmm.CLASSES):
        members = [k for w, k in n.items() if zlib.crc32(w.encode()) % hmm.CLASSES == c and int(hmm.tokens_of([w]).hash[0]) not in place]
        if members:
            assert math.isclose(sum(k + 1 for k in members) + 1, v.class_tokens[c] + v.class_words[c] + 1)


def test_model_beats_unigrams_and_odd_tables(spark):
    even = [" ".join(("red", "blue")[k % 2] for k in range(40)), " ".join(("one", "two", "three")[k % 3] for k in range(40))]
    rows = [(k, even[k % 2]) for k in range(120)]
    got = hmm.score_documents(documents(spark, rows), states=6, iterations=12).collect()
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert hmm.score_documents(documents(spark, [])).count() == 0
    only_held_out = next(k for k in range(100) if crc(k))
    (r,) = hmm.score_documents(documents(spark, [(only_held_out, "a b")]), iterations=1).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0) and math.isfinite(r["score"])
