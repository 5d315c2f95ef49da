"""Vectorised text work on Arrow batches inside a task: words, their 64-bit hashes, shingles and shingle sets.

A text is its UTF-8 bytes. Words are maximal runs without the bytes 0x20 and 0x09-0x0D, after A-Z became a-z;
null texts count as empty. All arrays are bounded by SLICE_BYTES or by one text, whichever is more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that one round of numpy works on.
SLICE_BYTES = 1 << 20


def splitmix(n: int, seed: int) -> np.ndarray:
    """n well-mixed 64-bit constants from a seed."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUE = splitmix(256, 11)
_STEP = 0xD1342543DE82EF95
#: Powers of a base are kept for this many places; those of further places are products of two kept ones.
RUN = 1 << 16


class Spans:
    """Hashes of spans of a sequence of numbers, equal for equal spans wherever they stand."""

    def __init__(self, step: int):
        self.step, self.back = step, pow(step, -1, 1 << 64)
        self.steps, self.backs = self._powers(step), self._powers(self.back)

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        x = np.full(RUN, base, U)
        x[0] = 1
        return np.cumprod(x)

    def hashes(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The sum of values[i] * step ** (i - start) over start <= i < end, modulo 2 ** 64; not yet mixed."""
        acc = np.zeros(len(values) + 1, U)
        for k, at in enumerate(range(0, len(values), RUN)):
            part = values[at : at + RUN]
            acc[at + 1 : at + 1 + len(part)] = part * self.steps[: len(part)] * U(pow(self.step, k * RUN, 1 << 64))
        np.cumsum(acc, out=acc)
        far = np.array([pow(self.back, k * RUN, 1 << 64) for k in range(len(values) // RUN + 1)], U)
        return (acc[end] - acc[start]) * self.backs[start % RUN] * far[start // RUN]


_BYTES = Spans(_STEP)


@dataclass
class Texts:
    """Consecutive texts of a batch: row numbers first..first+n, their bytes and offsets."""

    first: int
    data: np.ndarray
    offs: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offs) - 1


def texts(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The column's texts in slices of about limit bytes (one text at least)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield Texts(i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j


@dataclass
class Words:
    """start, end: byte places of each word; offs: words of text i are offs[i]..offs[i+1]."""

    start: np.ndarray
    end: np.ndarray
    offs: np.ndarray


def words(t: Texts) -> Words:
    inside = ~SPACE[t.data]
    edge = t.offs[1:-1]
    edge = edge[(edge > 0) & (edge < len(inside))]
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    before[edge] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    after[edge - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, t.offs))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal bytes wherever they stand."""
    h = _BYTES.hashes(_VALUE[data], start, end)
    return mix(h + (end - start).astype(U) * U(0x9E3779B97F4A7C15))


def word_hashes(t: Texts, w: Words) -> np.ndarray:
    return span_hashes(LOWER[t.data], w.start, w.end)


def shingle_sets(t: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of width words as sorted hashes, and offsets by text.

    A text with fewer words has its whole sequence as one shingle; a text without words has none.
    """
    w = words(t)
    h = word_hashes(t, w)
    n_words = np.diff(w.offs)
    per = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    offs = np.concatenate([[0], np.cumsum(per)])
    at = np.arange(offs[-1]) - np.repeat(offs[:-1], per) + np.repeat(w.offs[:-1], per)
    last = np.repeat(w.offs[1:], per)
    acc = h[at]
    for j in range(1, width):
        ok = at + j < last
        acc = np.where(ok, mix(acc * U(_STEP) + h[np.minimum(at + j, len(h) - 1)] + U(j)), acc)
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        if b - a > 1:
            acc[a:b].sort()
    new = np.ones(len(acc), bool)
    new[1:] = acc[1:] != acc[:-1]
    new[offs[:-1][per > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return acc[new], kept[offs]
