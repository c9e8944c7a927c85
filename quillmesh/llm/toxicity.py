"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word's input is the mean of the embeddings of its byte trigrams plus the embedding of the word itself, where the
training texts hold it often enough. Two gated recurrent layers read a window of words in both directions; attention
weights the states; a linear layer scores the sum. Every text is cut into windows that overlap by half, all are
scored, and the text's score is that of its worst window. All is numpy: training runs on a bounded sample of labelled
texts on the driver (a text's loss pools its windows), scoring inside the tasks over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.labelled import Adam, frequent, lookup, remainder, sample, sigmoid, trigrams
from quillmesh.llm.text import Words, slices, words_of

WINDOW, STRIDE = 48, 24
EMBED, HIDDEN, ATTEND, CHAR_BUCKETS = 8, 8, 8, 4096
#: Bounds of the training sample: rows of each class, characters of a text; texts that a word must be in.
PER_CLASS, MOST_CHARS, LEAST_TEXTS = 2500, 6000, 8
#: Passes over the sample, more of them for a small one so that there are STEPS at least.
EPOCHS, STEPS, BATCH, RATE = 8, 240, 64, 0.01
#: Against learning single texts by heart: the part of words that a training window lacks, and the weights' decay.
DROPPED, DECAY = 0.2, 0.1
#: Windows scored at once.
SCORED = 2048


def window_starts(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows and their texts; a text without words has one empty window."""
    n = np.maximum(1, -(-(count - (WINDOW - STRIDE)) // STRIDE))
    owner = np.repeat(np.arange(len(count)), n)
    return (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRIDE, owner


class Inputs:
    """Distinct words of a batch (row 0: padding) and the windows as rows of them."""

    def __init__(self, w: Words, vocabulary: np.ndarray):
        _, which, place = np.unique(w.hash, return_index=True, return_inverse=True)
        self.word = lookup(vocabulary, w.hash[which])
        self.char, self.char_first = trigrams(w, which, CHAR_BUCKETS)
        self.char_size = np.diff(np.append(self.char_first, len(self.char)))
        count = np.diff(w.first)
        self.start, self.owner = window_starts(count)
        self.left = count[self.owner] - self.start
        self.base = w.first[self.owner] + self.start
        self.place = np.append(place + 1, 0)

    def windows(self, some: np.ndarray) -> np.ndarray:
        at = self.base[some, None] + np.arange(WINDOW)
        inside = np.arange(WINDOW) < self.left[some, None]
        return self.place[np.where(inside, at, len(self.place) - 1)]


class Network:
    def __init__(self, vocabulary: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary

        def some(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "word": some(len(vocabulary) + 1, EMBED, scale=0.1), "char": some(CHAR_BUCKETS, EMBED, scale=0.3),
            "w": some(EMBED, 2 * 3 * HIDDEN, scale=0.4), "b": np.zeros(2 * 3 * HIDDEN, np.float32), "u": some(2, HIDDEN, 3 * HIDDEN, scale=0.3),
            "a": some(2 * HIDDEN, ATTEND, scale=0.3), "v": some(ATTEND, scale=0.3), "o": some(2 * HIDDEN, scale=0.3), "c": np.full(1, -2, np.float32),
        }

    def embed(self, x: Inputs) -> np.ndarray:
        e = self.p["word"][x.word]
        e[x.word == 0] = 0
        if len(x.char):
            e = e + np.add.reduceat(self.p["char"][x.char], x.char_first) / x.char_size[:, None].astype(np.float32)
        return e

    def project(self, e: np.ndarray) -> np.ndarray:
        """Gate inputs of all distinct words in both directions; padding keeps the state (its update gate is shut)."""
        out = np.empty((len(e) + 1, 2, 3 * HIDDEN), np.float32)
        out[1:] = (e @ self.p["w"] + self.p["b"]).reshape(-1, 2, 3 * HIDDEN)
        out[0] = 0
        out[0, :, :HIDDEN] = 40
        return out

    def forward(self, gates: np.ndarray, rows: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows; rows: places in ``gates``, one row a window."""
        n, steps = rows.shape
        h = np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((steps, n, 2 * HIDDEN), np.float32)
        kept = []
        for t in range(steps):
            x = np.stack((gates[rows[:, t], 0], gates[rows[:, steps - 1 - t], 1]))
            pre = h @ self.p["u"]
            zr = sigmoid(x[:, :, : 2 * HIDDEN] + pre[:, :, : 2 * HIDDEN])
            z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
            new = np.tanh(x[:, :, 2 * HIDDEN :] + r * pre[:, :, 2 * HIDDEN :])
            if keep:
                kept.append((h, z, r, new, pre[:, :, 2 * HIDDEN :]))
            h = new + z * (h - new)
            states[t, :, :HIDDEN] = h[0]
            states[steps - 1 - t, :, HIDDEN:] = h[1]
        hidden = np.tanh(states @ self.p["a"])
        weigh = hidden @ self.p["v"]
        weigh[rows.T == 0] -= 1e4
        weigh -= weigh.max(axis=0)
        np.exp(weigh, out=weigh)
        weigh /= weigh.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weigh, states)
        logit = pooled @ self.p["o"] + self.p["c"]
        return logit, {"kept": kept, "states": states, "hidden": hidden, "weigh": weigh, "pooled": pooled} if keep else {}

    def backward(self, x: Inputs, e: np.ndarray, rows: np.ndarray, c: dict, d_logit: np.ndarray) -> dict[str, np.ndarray]:
        p, g = self.p, {}
        n, steps = rows.shape
        g["c"] = d_logit.sum(keepdims=True)
        g["o"] = d_logit @ c["pooled"]
        d_pooled = d_logit[:, None] * p["o"]
        d_weigh = np.einsum("nh,tnh->tn", d_pooled, c["states"])
        d_states = c["weigh"][:, :, None] * d_pooled
        d_weigh = c["weigh"] * (d_weigh - (c["weigh"] * d_weigh).sum(axis=0))
        g["v"] = np.einsum("tn,tna->a", d_weigh, c["hidden"])
        d_hidden = d_weigh[:, :, None] * p["v"] * (1 - c["hidden"] ** 2)
        g["a"] = np.einsum("tnh,tna->ha", c["states"], d_hidden)
        d_states += d_hidden @ p["a"].T
        d_gates = np.zeros((len(e) + 1, 2 * 3 * HIDDEN), np.float32)
        d_h = np.zeros((2, n, HIDDEN), np.float32)
        g["u"] = np.zeros_like(p["u"])
        pieces = []
        for t in range(steps - 1, -1, -1):
            h, z, r, new, pre = c["kept"][t]
            d_h[0] += d_states[t, :, :HIDDEN]
            d_h[1] += d_states[steps - 1 - t, :, HIDDEN:]
            d_new = d_h * (1 - z) * (1 - new**2)
            d_z = d_h * (h - new) * z * (1 - z)
            d_r = d_new * pre * r * (1 - r)
            d_x = np.concatenate((d_z, d_r, d_new), axis=2)
            d_pre = np.concatenate((d_z, d_r, d_new * r), axis=2)
            g["u"] += h.transpose(0, 2, 1) @ d_pre
            d_h = d_h * z + d_pre @ p["u"].transpose(0, 2, 1)
            pieces.append((rows[:, t], 0, d_x[0]))
            pieces.append((rows[:, steps - 1 - t], 1, d_x[1]))
        for side in (0, 1):
            who = np.concatenate([a for a, s, _ in pieces if s == side])
            what = np.concatenate([d for _, s, d in pieces if s == side])
            for k in range(3 * HIDDEN):
                d_gates[:, side * 3 * HIDDEN + k] = np.bincount(who, what[:, k], len(d_gates))
        d_gates = d_gates[1:]
        g["w"], g["b"] = e.T @ d_gates, d_gates.sum(axis=0)
        d_e = d_gates @ p["w"].T
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        per_char = np.repeat(d_e / np.maximum(x.char_size, 1)[:, None], x.char_size, axis=0)
        for k in range(EMBED):
            g["word"][:, k] = np.bincount(x.word, d_e[:, k], len(p["word"]))
            g["char"][:, k] = np.bincount(x.char, per_char[:, k], CHAR_BUCKETS)
        g["word"][0] = 0
        return {k: v.astype(np.float32) for k, v in g.items()}

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's score, that of its worst window, and that window's first word."""
        w = words_of(texts)
        x = Inputs(w, self.vocabulary)
        gates = self.project(self.embed(x))
        logit = np.empty(len(x.start), np.float32)
        for a in range(0, len(logit), SCORED):
            part = np.arange(a, min(a + SCORED, len(logit)))
            logit[part] = self.forward(gates, x.windows(part))[0]
        order = np.lexsort((x.start, -logit, x.owner))
        first = order[np.searchsorted(x.owner[order], np.arange(len(texts)))]
        return sigmoid(logit[first].astype(np.float64)), x.start[first]


def train(texts: list[str], y: np.ndarray, weight: np.ndarray, seed: int = 5) -> Network | None:
    """None where there aren't both classes."""
    if len(set(y.tolist())) < 2:
        return None
    network = Network(frequent(texts, LEAST_TEXTS))
    adam, rng = Adam(network.p, RATE, DECAY), np.random.default_rng(seed)
    epochs = max(EPOCHS, -(-STEPS // -(-len(texts) // BATCH)))
    for epoch in range(epochs):
        adam.rate = RATE * (1 - epoch / epochs) + 1e-3
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            x = Inputs(words_of([texts[i] for i in part]), network.vocabulary)
            e = network.embed(x)
            rows = x.windows(np.arange(len(x.start)))
            rows[rng.random(rows.shape) < DROPPED] = 0
            logit, cache = network.forward(network.project(e), rows, keep=True)
            # A text's logit: the soft maximum over its windows.
            first = np.searchsorted(x.owner, np.arange(len(part)))
            top = np.maximum.reduceat(logit, first)
            raised = np.exp(logit - top[x.owner])
            total = np.add.reduceat(raised, first)
            whole = top + np.log(total)
            d_whole = (sigmoid(whole) - y[part]) * weight[part] / len(part)
            d_logit = d_whole[x.owner] * raised / total[x.owner]
            adam.update(network.backward(x, e, rows, cache, d_logit.astype(np.float32)))
    return network


def fit(docs: DataFrame, labels: DataFrame, allowed, per_class: int = PER_CLASS) -> Network | None:
    return train(*sample(docs, labels, "toxic", allowed, per_class, MOST_CHARS))


def score_documents(docs: DataFrame, network: Network | None, threshold: float = 0.3) -> DataFrame:
    """Score every whole text; one row per input row: doc_id, score, predicted, worst_word (the worst window's first word).

    Null and blank texts are scored as one empty window; without a network (no labels of both classes) all scores are
    0. A null doc_id stays null; repeated rows give repeated rows; other columns are not looked at.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in slices(b):
                score, at = network.score(part["text"].tolist()) if network else (np.zeros(len(part)), np.zeros(len(part), np.int64))
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array, "score": score, "predicted": (score >= threshold).astype(np.int32), "worst_word": at})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double, predicted int, worst_word long")


def keep_clean(docs: DataFrame, network: Network | None, threshold: float = 0.3) -> DataFrame:
    """The rows, with all their columns, whose text scores under the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in slices(b):
                yield part[network.score(part["text"].tolist())[0] < threshold] if network else part

    return docs.mapInPandas(run, docs.schema)


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows that aren't held out (crc32 of the id modulo 4 is not 2) and score all rows."""
    network = fit(docs, labels, remainder("doc_id", 4) != 2)
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return score_documents(docs, network).select("doc_id", held, "score", "predicted", "worst_word")
