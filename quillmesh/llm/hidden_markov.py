"""Language-model scores by a hidden Markov model over words, trained by Baum-Welch counts that partitions add up.

Tokens are words (runs of anything but space and the controls 0x09 to 0x0D, with A to Z in lower case) and one end a text.
Hidden states emit classes of words: a frequent word is a class of its own, all others fall into classes by a hash of the
word, and a word of such a class has its share of the class's counts, with room for one unseen word. So the model's words
grow with the corpus (each has its own probability, in a table that is joined), while what is trained and sent to the
workers, FREQUENT + CLASSES rows of STATES numbers, has a fixed size.

Training: an iteration runs forward and backward over all training texts, cut into segments of at most SEGMENT tokens that
start anew (the first of a text from one distribution, the others from another); counts of transitions and emissions are
added up by class over all partitions, and the driver divides them. Scores: the exact likelihood of the whole text, by the
scaled forward recursion. Long texts are cut into chunks whose transfer matrices are worked out side by side and then
multiplied in order, which gives the same value.

Nulls: a null text is empty (its only token is its end); a null id counts as an empty string, which isn't held out. Rows
that repeat an id are texts of their own. Without any training text every known count is 0. An empty table has no rows.
Equal 64-bit hashes of two words in one batch would count as one word; so unlikely that no vocabulary shows it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.shared import publish, release
from quillmesh.llm.text import WORD_BASE, Powers, Words, mix, slices

#: Frequent words at most, and classes of the others; with the end of a text they must fit in 16 bits.
FREQUENT, CLASSES = 49_152, 4_096
STATES, ITERATIONS = 8, 8
#: Tokens of a training segment, and of a chunk whose transfer matrix is made on its own.
SEGMENT, CHUNK = 64, 256
#: Tokens that are worked on at once.
TOKENS = 1 << 18
#: Weight of the corpus's own shares in each state's emissions, in tokens; and that of each transition.
PRIOR, PRIOR_MOVE = 200.0, 0.5

_SOLID = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_powers = Powers(WORD_BASE)
CODED = "key long, doc_id long, held_out boolean, n_tokens long, known long, base double, within double, codes binary, rare array<struct<word:string,n:int>>"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens_of(texts: list[str]) -> Words:
    """Words of a batch of texts, as this model sees them."""
    coded = [t.encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    data = b" ".join(coded) + b" "
    raw = np.frombuffer(data, np.uint8)
    sizes = np.fromiter(map(len, coded), np.int64, len(coded)) + 1
    text_start = np.cumsum(sizes) - sizes
    solid = np.zeros(len(raw) + 1, np.int8)
    solid[1:] = _SOLID[raw]
    edge = np.flatnonzero(np.diff(solid))
    start, end = edge[0::2], edge[1::2]
    up, down = _powers.upto(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    hashed = mix((total[end] - total[start]) * down[start])
    return Words(data, hashed, start, end, np.concatenate((np.searchsorted(start, text_start), [len(start)])), text_start)


def word_at(w: Words, k: int) -> str:
    return w.data[w.start[k] : w.end[k]].decode("utf-8", "surrogatepass")


def count_words(docs: DataFrame) -> DataFrame:
    """word and n of all texts: each batch adds up its own words before they are shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch, 1 << 20):
                w = tokens_of(part["text"].tolist())
                _, first, n = np.unique(w.hash, return_index=True, return_counts=True)
                yield pd.DataFrame({"word": [word_at(w, k) for k in first.tolist()], "n": n.astype(np.int64)})

    return docs.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Frequent words by hash with their counts, the sums of the other words' classes, and the totals of the training tokens."""

    hash: np.ndarray
    count: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    texts: int
    tokens: int
    words: int

    def __post_init__(self) -> None:
        self.end = len(self.hash) + CLASSES
        room = np.log10(self.tokens + self.words + 1)
        self.base = np.log10(self.count + 1.0) - room
        self.base_rare, self.base_end = -room, np.log10(self.texts + 1.0) - room
        self.share = -np.log10(self.class_tokens + self.class_words + 1.0)

    def shares(self) -> np.ndarray:
        """Of each class its part of the training tokens, none of them 0."""
        n = np.concatenate((self.count, self.class_tokens, [self.texts])) + 1.0
        return n / n.sum()


def vocabulary(counts: DataFrame, texts: int, most: int = FREQUENT) -> Vocabulary:
    """The driver's share of the counts: at most ``most`` words, all that are more frequent than any other, and sums by class."""
    # Counts in bins, whose number doesn't grow with the words: one a count at first, then 64 each doubling.
    bins = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log2("n") * 64) + 384).cast("int")
    sizes = counts.groupBy(bins.alias("bin")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens"), F.min("n").alias("least")).orderBy(F.desc("bin")).collect()
    least, room = None, most
    for r in sizes:
        room -= r["words"]
        if room < 0:
            break
        least = r["least"]
    top = [] if least is None else counts.filter(F.col("n") >= least).collect()
    w = tokens_of([r["word"] for r in top])
    hashed, n = w.hash.copy(), np.array([r["n"] for r in top], np.int64)
    order = np.argsort(hashed)
    tokens, words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in counts.groupBy((F.crc32(F.col("word").cast("binary")) % CLASSES).cast("int").alias("c")).agg(F.sum("n").alias("tokens"), F.count("*").alias("words")).collect():
        tokens[r["c"]], words[r["c"]] = r["tokens"], r["words"]
    for r in top:
        c = zlib.crc32(r["word"].encode("utf-8", "surrogatepass")) % CLASSES
        tokens[c] -= r["n"]
        words[c] -= 1
    return Vocabulary(hashed[order], n[order], tokens, words, texts, sum(r["tokens"] for r in sizes) + texts, sum(r["words"] for r in sizes) + (texts > 0))


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """Of each text: its classes in order as 16-bit numbers, the parts of its scores that the vocabulary gives, and its other words."""

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch):
                w = tokens_of(part["text"].tolist())
                at = np.minimum(np.searchsorted(v.hash, w.hash), max(0, len(v.hash) - 1))
                found = v.hash[at] == w.hash if len(v.hash) else np.zeros(len(w.hash), bool)
                codes = np.where(found, at, 0)
                others = np.flatnonzero(~found)
                # One look at each distinct other word of the slice.
                _, first, same = np.unique(w.hash[others], return_index=True, return_inverse=True)
                names = [word_at(w, k) for k in others[first].tolist()]
                classes = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) % CLASSES for x in names], np.int64)
                codes[others] = len(v.hash) + classes[same] if len(names) else 0
                base, within = np.full(len(w.hash), v.base_rare), np.zeros(len(w.hash))
                base[found] = v.base[at[found]] if len(v.hash) else 0.0
                within[others] = v.share[classes[same]] if len(names) else 0.0
                kind = np.zeros(len(w.hash), np.int64)
                kind[others] = same
                rows = []
                for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                    rare, times = np.unique(kind[a:b][~found[a:b]], return_counts=True)
                    rows.append((
                        b - a + 1, int(found[a:b].sum()) + (v.texts > 0), float(base[a:b].sum()) + v.base_end, float(within[a:b].sum()), np.append(codes[a:b], v.end).astype("<u2").tobytes(),
                        [{"word": names[k], "n": int(n)} for k, n in zip(rare.tolist(), times.tolist(), strict=True)],
                    ))
                out = pd.DataFrame(rows, columns=["n_tokens", "known", "base", "within", "codes", "rare"])
                for name in ("key", "doc_id", "held_out"):
                    out[name] = part[name].array
                yield out[[c.split()[0] for c in CODED.split(", ")]]

    return docs.withColumn("key", F.monotonically_increasing_id()).select("key", "doc_id", "held_out", "text").mapInPandas(code, CODED)


@dataclass
class Model:
    """Start, the start of later segments, transitions (from, to), and emissions (class, state)."""

    start: np.ndarray
    resumed: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def untrained(v: Vocabulary, states: int, seed: int = 11) -> Model:
    """States that differ by chance and like to stay."""
    rng = np.random.default_rng(seed)
    emit = v.shares()[:, None] * np.exp(rng.normal(0.0, 1.0, (v.end + 1, states)))
    move = np.full((states, states), 0.2 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    if states > 1:
        np.fill_diagonal(move, 0.8)
    even = np.full(states, 1 / states)
    return Model(even, even, move, emit / emit.sum(0))


def expected(codes: np.ndarray, bounds: np.ndarray, m: Model, rows: np.ndarray, segment: int = SEGMENT) -> None:
    """Add the expected counts of texts (codes[bounds[i]:bounds[i + 1]]) to ``rows``, by forward and backward over their segments.

    ``rows`` are those of the emissions, then of the transitions, of the starts, of the later starts, and the log likelihood.
    """
    states, classes, kind = len(m.start), len(m.emit), m.emit.dtype
    size = np.diff(bounds)
    per = -(-size // segment)
    text = np.repeat(np.arange(len(size)), per)
    at = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    begin = bounds[:-1][text] + at * segment
    length = np.minimum(segment, bounds[1:][text] - begin)
    order = np.argsort(-length, kind="stable")
    begin, length, first = begin[order], length[order], at[order] == 0
    active = [int(np.searchsorted(-length, -t)) for t in range(int(length.max(initial=0)))]  # segments longer than t
    forward, scale, emitted = [], [], []
    now = np.where(first[:, None], m.start, m.resumed)
    for t, n in enumerate(active):
        emission = m.emit[codes[begin[:n] + t]]
        now = (now[:n] @ m.move if t else now[:n]) * emission
        total = now.sum(1)
        now = now / total[:, None]
        forward.append(now)
        scale.append(total)
        emitted.append(emission)
    back = np.ones((len(begin), states), kind)
    share, which = [], []
    for t in reversed(range(len(active))):
        n = active[t]
        if t + 1 < len(active) and active[t + 1]:
            k = active[t + 1]
            ahead = emitted[t + 1] * back[:k] / scale[t + 1][:, None]
            rows[classes : classes + states] += m.move * (forward[t][:k].T @ ahead)
            back = np.concatenate((ahead @ m.move.T, np.ones((n - k, states), kind)))
        else:
            back = np.ones((n, states), kind)
        gamma = forward[t] * back[:n]
        share.append(gamma)
        which.append(codes[begin[:n] + t])
    if share:
        gamma, which = np.concatenate(share), np.concatenate(which)
        for k in range(states):
            rows[:classes, k] += np.bincount(which, weights=gamma[:, k], minlength=classes)
        starts = share[-1]
        rows[classes + states] += starts[first].sum(0)
        rows[classes + states + 1] += starts[~first].sum(0)
        rows[classes + states + 2, 0] += float(sum(np.log(s).sum() for s in scale))


def parts_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Rows of about TOKENS tokens with their classes end to end and their bounds."""
    for batch in batches:
        size = batch["codes"].str.len().to_numpy(np.int64) // 2
        group = (np.cumsum(size) - size) // TOKENS
        for rows in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(group)) + 1):
            if len(rows):
                part = batch.iloc[rows[0] : rows[-1] + 1]
                codes = np.frombuffer(b"".join(part["codes"].tolist()), "<u2").astype(np.int64)
                yield part, codes, np.concatenate(([0], np.cumsum(size[rows])))


def iterate(coded: DataFrame, m: Model, v: Vocabulary) -> tuple[Model, float]:
    """One Baum-Welch iteration over all training texts; the new model, and the log likelihood of the segments under the old one."""
    classes, states = m.emit.shape
    # Single precision is enough for the counts, and half the time.
    light = Model(*(x.astype(np.float32) for x in (m.start, m.resumed, m.move, m.emit)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = np.zeros((classes + states + 3, states))
        for _, codes, bounds in parts_of(batches):
            expected(codes, bounds, light, rows)
        some = np.flatnonzero(rows.any(1))
        yield pd.DataFrame({"row": some.astype(np.int32), **{f"s{k}": rows[some, k] for k in range(states)}})

    schema = "row int, " + ", ".join(f"s{k} double" for k in range(states))
    added = coded.filter("not held_out").select("codes").mapInPandas(count, schema).groupBy("row").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(states)])
    got = added.toPandas()
    rows = np.zeros((classes + states + 3, states))
    rows[got["row"].to_numpy(np.int64)] = got[[f"s{k}" for k in range(states)]].to_numpy()
    emit = rows[:classes] + PRIOR * v.shares()[:, None]
    move = rows[classes : classes + states] + PRIOR_MOVE
    start, resumed = rows[classes + states] + PRIOR_MOVE, rows[classes + states + 1] + PRIOR_MOVE
    return Model(start / start.sum(), resumed / resumed.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0)), float(rows[classes + states + 2, 0])


def train(coded: DataFrame, v: Vocabulary, states: int = STATES, iterations: int = ITERATIONS) -> tuple[Model, list[float]]:
    m, likelihoods = untrained(v, states), []
    for _ in range(iterations):
        m, value = iterate(coded, m, v)
        likelihoods.append(value)
    return m, likelihoods


def log_likelihood(codes: np.ndarray, bounds: np.ndarray, m: Model, chunk: int = CHUNK) -> np.ndarray:
    """Natural logarithms of the likelihoods of whole texts, none of them empty."""
    states = len(m.start)
    size = np.diff(bounds)
    per = -(-size // chunk)
    last = np.cumsum(per)
    text = np.repeat(np.arange(len(size)), per)
    at = np.arange(per.sum()) - np.repeat(last - per, per)
    begin = bounds[:-1][text] + at * chunk
    length = np.minimum(chunk, bounds[1:][text] - begin)

    def run(rows: np.ndarray, now: np.ndarray, fresh: bool) -> tuple[np.ndarray, np.ndarray]:
        """``now`` (row, way in, state) carried over each row's tokens: scaled, and the logarithms of what was scaled away."""
        order = np.argsort(-length[rows], kind="stable")
        longest, where = length[rows][order], begin[rows][order]
        out, logs = now.copy(), np.zeros(now.shape[:2])
        now = now[order]
        held = np.zeros(now.shape[:2])
        for t in range(int(longest.max(initial=0))):
            n = int(np.searchsorted(-longest, -t))
            if n < len(now):  # those that end here
                out[order[n : len(now)]], logs[order[n : len(now)]] = now[n:], held[n:]
                now, held = now[:n], held[:n]
            if t or not fresh:
                now = (now.reshape(-1, states) @ m.move).reshape(now.shape)
            now = now * m.emit[codes[where[:n] + t]][:, None, :]
            total = now.sum(2)
            now /= total[:, :, None]
            held = held + np.log(total)
        out[order[: len(now)]], logs[order[: len(now)]] = now, held
        return out, logs

    firsts = np.flatnonzero(at == 0)
    alpha, logs = run(firsts, np.broadcast_to(m.start, (len(firsts), 1, states)).copy(), True)
    alpha, value = alpha[:, 0], logs[:, 0]
    later = np.flatnonzero(at > 0)
    if len(later):
        ways, gone = run(later, np.broadcast_to(np.eye(states), (len(later), states, states)).copy(), False)
        by_step = np.argsort(at[later], kind="stable")
        for rows in np.split(by_step, np.flatnonzero(np.diff(at[later][by_step])) + 1):
            who = text[later[rows]]
            top = gone[rows].max(1)
            step = np.einsum("ni,nij->nj", alpha[who] * np.exp(gone[rows] - top[:, None]), ways[rows])
            total = step.sum(1)
            alpha[who] = step / total[:, None]
            value[who] += top + np.log(total)
    return value


def score(coded: DataFrame, m: Model) -> DataFrame:
    """Coded rows with ``forward``: the base-10 logarithm of the likelihood of their classes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, codes, bounds in parts_of(batches):
            yield part.drop(columns="codes").assign(forward=log_likelihood(codes, bounds, m) / np.log(10.0))

    names = ["key", "doc_id", "held_out", "n_tokens", "known", "base", "within"]
    schema = "key long, doc_id long, held_out boolean, n_tokens long, known long, base double, within double, forward double"
    return coded.select(*names, "codes").mapInPandas(run, schema)


def score_documents(docs: DataFrame, states: int = STATES, iterations: int = ITERATIONS, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score of every text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    training = rows.filter("not held_out")
    counts = publish(count_words(training))
    v = vocabulary(counts, training.count(), frequent)
    coded = publish(encode(rows, v))
    m, _ = train(coded, v, states, iterations)
    # Other words than frequent ones: what their counts add to both scores. Words that no training text has add nothing.
    pairs = coded.select("key", F.explode("rare").alias("r")).select("key", "r.word", F.col("r.n").alias("times"))
    more = pairs.join(counts, "word").groupBy("key").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"))
    joined = score(coded, m).join(more, "key", "left")
    extra = F.coalesce("more", F.lit(0.0))
    out = publish(joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + extra).alias("base_score"), (F.col("forward") + F.col("within") + extra).alias("score"),
    ))
    release(counts, coded)
    return out
