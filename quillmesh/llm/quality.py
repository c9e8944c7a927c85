"""Quality classifier: attention-based multiple-instance learning over the passages of a text.

Every passage (a run of words) is encoded: the mean of its words' inputs (byte trigrams, and the word itself where the
training texts hold it often enough) and six plain measures go through one hidden layer. Gated attention weights
(tanh times sigmoid) are learned from the documents' labels alone, and the weighted passage representation is scored.
Training is numpy on a bounded sample of labelled rows; scoring runs inside the tasks over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.labelled import Adam, frequent, lookup, remainder, sample, sigmoid, trigrams
from quillmesh.llm.text import Words, slices, words_of

PASSAGE, EMBED, HIDDEN, GATE, CHAR_BUCKETS, MEASURES = 64, 12, 16, 8, 4096, 6
#: Bounds of the training sample: rows of each class, characters of a text; texts that a word must be in.
PER_CLASS, MOST_CHARS, LEAST_TEXTS = 2500, 12000, 10
#: Passes over the sample, more of them for a small one so that there are STEPS at least.
EPOCHS, STEPS, BATCH, RATE = 12, 240, 64, 0.01
ALNUM = np.array([chr(b).isalnum() or b > 0x7F for b in range(256)])
DIGIT = np.array([0x30 <= b <= 0x39 for b in range(256)])


class Bags:
    """Passages of a batch: the distinct words' features, which words each passage has, and six measures of it."""

    def __init__(self, w: Words, vocabulary: np.ndarray):
        _, which, self.place = np.unique(w.hash, return_index=True, return_inverse=True)
        self.word = lookup(vocabulary, w.hash[which])
        self.char, self.char_first = trigrams(w, which, CHAR_BUCKETS)
        self.char_size = np.diff(np.append(self.char_first, len(self.char)))
        count = np.diff(w.first)
        n = np.maximum(1, -(-count // PASSAGE))
        self.owner = np.repeat(np.arange(len(count)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.first = w.first[self.owner] + at * PASSAGE
        self.size = np.clip(count[self.owner] - at * PASSAGE, 0, PASSAGE)
        self.text_first = np.cumsum(n) - n
        raw = np.frombuffer(w.data, np.uint8)
        sums = [np.concatenate(([0], np.cumsum(x))) for x in (~ALNUM[raw] & (raw > 0x20), DIGIT[raw])]
        letters = w.end - w.start
        same = [np.zeros(len(w.hash), bool) for _ in range(2)]
        for k in (1, 2):
            if len(w.hash) > k:
                same[k - 1][k:] = w.hash[k:] == w.hash[:-k]
        odd, digits = (x[w.end] - x[w.start] for x in sums)
        per = np.maximum(self.size, 1)
        total = self.sum(np.stack([same[0], same[1] & ~same[0], letters, odd, digits], axis=1).astype(np.float32))
        chars = np.maximum(total[:, 2:3], 1)
        self.measures = np.concatenate((total[:, :2] / per[:, None], total[:, 2:3] / per[:, None] / 10, total[:, 3:] / chars, np.log1p(self.size)[:, None] / 5), axis=1).astype(np.float32)

    def sum(self, values: np.ndarray) -> np.ndarray:
        """Sums of a word-wise array over each passage."""
        out = np.zeros((len(self.first), values.shape[1]), np.float32)
        some = self.size > 0
        if some.any():
            out[some] = np.add.reduceat(values, self.first[some])
        return out


class Model:
    def __init__(self, vocabulary: np.ndarray, seed: int = 13):
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary

        def some(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        wide = EMBED + MEASURES
        self.p = {
            "word": some(len(vocabulary) + 1, EMBED, scale=0.1), "char": some(CHAR_BUCKETS, EMBED, scale=0.3),
            "w": some(wide, HIDDEN, scale=0.4), "b": np.zeros(HIDDEN, np.float32), "v": some(HIDDEN, GATE, scale=0.3), "u": some(HIDDEN, GATE, scale=0.3),
            "a": some(GATE, scale=0.3), "o": some(HIDDEN, scale=0.3), "c": np.zeros(1, np.float32),
        }

    def forward(self, x: Bags) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Logits of the texts, and what the way back needs."""
        p = self.p
        e = p["word"][x.word]
        e[x.word == 0] = 0
        if len(x.char):
            e = e + np.add.reduceat(p["char"][x.char], x.char_first) / x.char_size[:, None].astype(np.float32)
        mean = x.sum(e[x.place]) / np.maximum(x.size, 1)[:, None].astype(np.float32)
        wide = np.concatenate((mean, x.measures), axis=1)
        h = np.tanh(wide @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
        weigh = (t * s) @ p["a"]
        weigh = np.exp(weigh - np.maximum.reduceat(weigh, x.text_first)[x.owner])
        weigh /= np.add.reduceat(weigh, x.text_first)[x.owner]
        bag = np.add.reduceat(weigh[:, None] * h, x.text_first)
        return bag @ p["o"] + p["c"], {"wide": wide, "h": h, "t": t, "s": s, "weigh": weigh, "bag": bag}

    def backward(self, x: Bags, k: dict[str, np.ndarray], d: np.ndarray) -> dict[str, np.ndarray]:
        p, g = self.p, {}
        g["c"], g["o"] = d.sum(keepdims=True), d @ k["bag"]
        d_bag = (d[:, None] * p["o"])[x.owner]
        d_h = k["weigh"][:, None] * d_bag
        d_weigh = (d_bag * k["h"]).sum(axis=1)
        d_weigh = k["weigh"] * (d_weigh - np.add.reduceat(k["weigh"] * d_weigh, x.text_first)[x.owner])
        g["a"] = d_weigh @ (k["t"] * k["s"])
        gate = d_weigh[:, None] * p["a"]
        d_t, d_s = gate * k["s"] * (1 - k["t"] ** 2), gate * k["t"] * k["s"] * (1 - k["s"])
        g["v"], g["u"] = k["h"].T @ d_t, k["h"].T @ d_s
        d_h = (d_h + d_t @ p["v"].T + d_s @ p["u"].T) * (1 - k["h"] ** 2)
        g["w"], g["b"] = k["wide"].T @ d_h, d_h.sum(axis=0)
        d_mean = (d_h @ p["w"].T)[:, :EMBED] / np.maximum(x.size, 1)[:, None]
        d_word = np.repeat(d_mean, x.size, axis=0)
        d_e = np.stack([np.bincount(x.place, d_word[:, i], len(x.word)) for i in range(EMBED)], axis=1)
        per_char = np.repeat(d_e / np.maximum(x.char_size, 1)[:, None], x.char_size, axis=0)
        g["word"] = np.stack([np.bincount(x.word, d_e[:, i], len(p["word"])) for i in range(EMBED)], axis=1)
        g["char"] = np.stack([np.bincount(x.char, per_char[:, i], CHAR_BUCKETS) for i in range(EMBED)], axis=1)
        g["word"][0] = 0
        return {n: v.astype(np.float32) for n, v in g.items()}

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's score, and the number of the passage that weighs most in it."""
        x = Bags(words_of(texts), self.vocabulary)
        logit, kept = self.forward(x)
        order = np.lexsort((-kept["weigh"], x.owner))
        return sigmoid(logit.astype(np.float64)), order[x.text_first] - x.text_first


def train(texts: list[str], y: np.ndarray, weight: np.ndarray, seed: int = 5) -> Model | None:
    """None where there aren't both classes."""
    if len(set(y.tolist())) < 2:
        return None
    model = Model(frequent(texts, LEAST_TEXTS))
    adam, rng = Adam(model.p, RATE), np.random.default_rng(seed)
    epochs = max(EPOCHS, -(-STEPS // -(-len(texts) // BATCH)))
    for epoch in range(epochs):
        adam.rate = RATE * (1 - epoch / epochs) + 5e-4
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            x = Bags(words_of([texts[i] for i in part]), model.vocabulary)
            logit, kept = model.forward(x)
            adam.update(model.backward(x, kept, (sigmoid(logit) - y[part]) * weight[part] / len(part)))
    return model


def fit(docs: DataFrame, labels: DataFrame, allowed, per_class: int = PER_CLASS) -> Model | None:
    return train(*sample(docs, labels, "quality", allowed, per_class, MOST_CHARS))


def score_documents(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """Score every whole text; one row per input row: doc_id, score, predicted, top_passage (the one that weighs most).

    Null and blank texts are scored as one empty passage; without a model (no labels of both classes) all scores are
    0.5. A null doc_id stays null; repeated rows give repeated rows; other columns are not looked at.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in slices(b):
                score, at = model.score(part["text"].tolist()) if model else (np.full(len(part), 0.5), np.zeros(len(part), np.int64))
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array, "score": score, "predicted": (score >= threshold).astype(np.int32), "top_passage": at})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double, predicted int, top_passage long")


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows that aren't held out (crc32 of the id modulo 3 is not 1) and score all rows."""
    model = fit(docs, labels, remainder("doc_id", 3) != 1)
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return score_documents(docs, model).select("doc_id", held, "score", "predicted", "top_passage")
