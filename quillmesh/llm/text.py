"""Words, word shingles and MinHash values of a batch of texts, as numpy arrays.

A word is a maximal run of bytes above 0x20 of the lower-cased UTF-8 text; with ``bare``, of ASCII letters and digits
and all bytes above 0x7f, so that ASCII punctuation doesn't count. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd

# Odd multipliers: the base of word hashes, the base of shingle hashes, and the finisher's two.
WORD_BASE = 0x9E3779B97F4A7C15
GRAM_BASE = 0xD6E8FEB86659FD93
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    return x


def slices(batch: pd.DataFrame, chars: int = 1 << 19) -> Iterator[pd.DataFrame]:
    """A batch's rows in order, in parts of about ``chars`` characters of text (one row at least), so that the arrays of a part stay small."""
    size = batch["text"].str.len().fillna(0).to_numpy(np.int64)
    part = (np.cumsum(size) - size) // chars
    for group in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(part)) + 1):
        if len(group):
            yield batch.iloc[group[0] : group[-1] + 1]


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], chars: int = 1 << 21) -> Iterator[pd.DataFrame]:
    """The rows of sorted batches again, in parts of whole groups of equal keys and about ``chars`` characters of text (one group at least)."""

    def weight(b: pd.DataFrame) -> int:
        return 64 * len(b) + (int(b["text"].str.len().fillna(0).sum()) if "text" in b else 0)

    held: list[pd.DataFrame] = []
    size, due = 0, chars
    for batch in batches:
        for b in slices(batch, chars) if "text" in batch else [batch] * bool(len(batch)):
            held.append(b)
            size += weight(b)
            if size < due:
                continue
            rows = pd.concat(held, ignore_index=True)
            last = np.logical_and.reduce([(rows[k] == rows[k].iloc[-1]).to_numpy() for k in keys])
            cut = int(last.argmax())
            if cut:
                yield rows.iloc[:cut]
            held = [rows.iloc[cut:]]
            size = weight(held[0])
            due = max(chars, 2 * size)
    if held:
        yield pd.concat(held, ignore_index=True)


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


_powers = Powers(WORD_BASE)


@dataclass
class Words:
    """Words of a batch: ``hash``, byte ``start`` and ``end`` in ``data``; text i has words first[i]:first[i + 1]."""

    data: bytes
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    text_start: np.ndarray


#: Bytes of bare words, in lower case.
BARE = np.array([chr(b).isalnum() or b > 0x7F for b in range(256)])


def words_of(texts: Sequence[str | None], bare: bool = False) -> Words:
    """Split a batch into words; None counts as an empty text."""
    coded = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = b" ".join(coded) + b" "
    raw = np.frombuffer(data, np.uint8)
    sizes = np.fromiter(map(len, coded), np.int64, len(coded)) + 1
    text_start = np.concatenate(([0], np.cumsum(sizes)))[: len(coded)] if coded else np.zeros(0, np.int64)
    solid = np.zeros(len(raw) + 1, np.int8)
    solid[1:] = BARE[raw] if bare else raw > 0x20
    edge = np.flatnonzero(np.diff(solid))
    start, end = edge[0::2], edge[1::2]
    up, down = _powers.upto(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    hashed = mix((total[end] - total[start]) * down[start])
    first = np.concatenate((np.searchsorted(start, text_start), [len(start)]))
    return Words(data, hashed, start, end, first, text_start)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words, and the bounds of each text's run of hashes.

    A text of 1 to n - 1 words has one gram, made of all its words; a text without words has none.
    """
    count = np.diff(w.first)
    per = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    bounds = np.concatenate(([0], np.cumsum(per)))
    at = np.repeat(w.first[:-1] - bounds[:-1], per) + np.arange(bounds[-1])
    length = np.repeat(np.minimum(count, n), per)
    total = np.zeros(len(at), np.uint64)
    factor = 1
    for k in range(n):
        factor = factor * GRAM_BASE % 2**64
        if len(at):
            some = k < length
            part = w.hash[np.minimum(at + k, len(w.hash) - 1)] * np.uint64(factor)
            total += np.where(some, part, np.uint64(0))
    return mix(total + length.astype(np.uint64)), bounds


def shingle_sets(w: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct grams in rising order, end to end, and the bounds of each text's set."""
    values, bounds = grams(w, n)
    sets = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else values), np.concatenate(([0], np.cumsum(sizes)))


def set_ids(values: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """A 128-bit hash of each set; equal sets have equal hashes; None for the empty set."""
    n = len(bounds) - 1
    some = bounds[1:] > bounds[:-1]
    out: list[bytes | None] = [None] * n
    if some.any():
        size = np.diff(bounds)[some].astype(np.uint64)
        sums = [np.add.reduceat(mix((values + np.uint64(c)) * np.uint64(m)), bounds[:-1][some]) for c, m in ((0x51, WORD_BASE), (0xA3, GRAM_BASE))]
        pair = np.column_stack([mix(sums[0] + size), mix(sums[1] ^ sums[0] * MIX_1)]).tobytes()
        for k, place in enumerate(np.flatnonzero(some).tolist()):
            out[place] = pair[16 * k : 16 * k + 16]
    return out


def minhash(values: np.ndarray, bounds: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """``count`` MinHash values of each set, one row a set; sets without members get the largest value."""
    rng = np.random.default_rng(seed)
    factor = rng.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**63, count, dtype=np.uint64)
    out = np.full((len(bounds) - 1, count), np.uint64(2**64 - 1))
    some = bounds[1:] > bounds[:-1]
    if some.any():
        at = bounds[:-1][some]
        for k in range(count):
            out[some, k] = np.minimum.reduceat((values ^ shift[k]) * factor[k], at)
    return out
