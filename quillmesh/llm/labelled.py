"""Bounded samples of labelled texts, and what the trained models share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.text import Words, mix, words_of


def remainder(doc_id: str, by: int):
    """crc32 of the id as text, modulo ``by``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed, per_class: int, most_chars: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and weights of at most ``per_class`` labelled rows of each class, of at most ``most_chars`` characters.

    Rows are chosen by a hash of their id among those that ``allowed`` lets in; weights restore the classes' shares.
    Null labels and ids are left out, and of an id with several rows or labels the first by order counts.
    """
    known = labels.filter(allowed & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    total = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = {}
    for value in (0, 1):
        rows = known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()
        chosen |= {r["doc_id"]: value for r in rows}
    if not chosen:
        return [], np.zeros(0), np.zeros(0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.filter(F.col("doc_id").isin(list(chosen)) & (F.length("text") <= most_chars)).collect()
    found = dict(sorted(((r["doc_id"], r["text"]) for r in rows), reverse=True))
    ids = sorted(found)
    y = np.array([chosen[i] for i in ids], np.float32)
    share = {v: total[v] / max(1, int((y == v).sum())) for v in total}
    weight = np.array([share[int(v)] for v in y], np.float32)
    return [found[i] for i in ids], y, weight / weight.mean() if len(weight) else weight


class Adam:
    """Adam with clipped gradients; ``decay`` shrinks the matrices a little at each step."""

    def __init__(self, params: dict[str, np.ndarray], rate: float, decay: float = 0.0):
        self.params, self.rate, self.decay, self.step = params, rate, decay, 0
        self.first = {k: np.zeros_like(v) for k, v in params.items()}
        self.second = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads.values())))
        scale = min(1.0, 5.0 / (norm + 1e-12))
        for k, g in grads.items():
            g = g * scale
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.001 * (g * g - self.second[k])
            if g.ndim > 1:
                self.params[k] *= 1 - self.rate * self.decay
            self.params[k] -= self.rate * (self.first[k] / (1 - 0.9**self.step)) / (np.sqrt(self.second[k] / (1 - 0.999**self.step)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def frequent(texts: list[str], least: int) -> np.ndarray:
    """Hashes of the words that at least ``least`` texts hold, in order; texts are read a few at a time."""
    held = np.zeros(0, np.uint64)
    for a in range(0, len(texts), 64):
        w = words_of(texts[a : a + 64])
        held = np.concatenate([held, *(np.unique(w.hash[x:y]) for x, y in zip(w.first[:-1], w.first[1:], strict=True))])
    values, times = np.unique(held, return_counts=True)
    return values[times >= least]


def lookup(vocabulary: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """1 + the place of each word in the vocabulary; 0 for the others."""
    if not len(vocabulary):
        return np.zeros(len(hashed), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashed), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashed, at + 1, 0)


def trigrams(w: Words, which: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of some words, with a space at both ends, end to end; and where each word's begin."""
    raw = np.frombuffer(b" " + w.data + b" ", np.uint8).astype(np.uint64)
    size = w.end[which] - w.start[which]
    first = np.cumsum(size) - size
    at = np.repeat(w.start[which] - first, size) + np.arange(size.sum())
    # Beyond a word's ends lies white space (any control byte counts as a space).
    raw = np.where(raw <= 0x20, np.uint64(0x20), raw)
    code = raw[at] << np.uint64(16) | raw[at + 1] << np.uint64(8) | raw[at + 2]
    return (mix(code) % np.uint64(buckets)).astype(np.int64), first
