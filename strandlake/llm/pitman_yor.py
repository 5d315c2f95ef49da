"""Language-model scores from a hierarchical Pitman-Yor model of words.

A text is its words and one end. A restaurant stands for a context: the two tokens before, the one before, or none; a
text begins after two ends. The parent of a restaurant is the one whose context is one word shorter, so that all contexts
with the same last word share a parent, and the parent of the restaurant without context is uniform over the V + 1 types
that the training texts hold or don't hold. A dish is a token, a customer one of its occurrences in training texts;
each table of a dish is a customer for that dish in the parent restaurant.

Seating (Chinese restaurant process): the state of a dish is its customers c and tables t. Given the tables of the rest of
its restaurant and the parent's probability p, t of c customers has the weight
S(c, t) * prod_{j < t} (strength + discount * (other tables + j)) * p, with the generalised Stirling number S of the
discount: every way to seat c customers at t tables. A Gibbs sweep takes all customers of every dish from their tables
and draws t from these weights, restaurant by restaurant upwards (the tables become the parent's customers) and, in the
next sweep, with the parents' new probabilities. All dishes of a restaurant are drawn at once, given its tables before.
The numbers S follow their recursion up to 4 * WINDOW customers and longer steps of it beyond; only a dish whose weights
have not fallen off by WINDOW tables is seated otherwise, its further customers one after another. Discount and strength
of each level are drawn from their weights over a grid given the seating. Predictive probabilities are averaged over SAMPLES
seatings.

On Spark: each occurrence goes, once, to a group of about GROUP occurrences that holds a share of the last words of
contexts: whole subtrees of restaurants, as packed arrays, written as a bucketed table, so that both rounds read it
without a shuffle. A last word with more occurrences than half a group is split by the dish, and a pair of such a word
and a dish with as many is split further by the word before it, and if all three have as many, by occurrence: customers
of one part share no table with those of another, and parts know of each other by their sums. Round one seats each group's customers; tables are then summed over
groups by dish, customers and tables by context for the split words, and go back to the groups that asked. The sums of
the HOT most frequent words are packed arrays that tasks add up and that are broadcast, for they go to nearly all groups;
those of the others go, packed, to ranges of hashes, where they are added up and sent back to groups that share a word. The restaurant without context depends on a dish by its customers only, so its seating is
sampled from the histogram of customers. Round two seats again, with the others' sums, and scores all occurrences,
training or not. No part of the counts is dropped: what is gathered grows with the texts.

Of a text's tokens that are frequent words the counts are summed up where the texts are dealt: a pass before has counted
these words in all training texts. So a group sends back, for each text it knows something of, one sum of log10 (in units
of SCORE_UNITS, so to within 5e-7) and the counts of the rarer words only, packed for BLOCK slices of texts together.

Before that a look at LOOK bytes of text tells which words are frequent; how occurrences are packed and dealt follows
from it, and nothing else. Words are told apart by 64-bit hashes. Null texts are empty: they consist of one end. Repeated rows count and are scored
as often as they occur; extra columns are ignored; an empty table gives an empty result. Without training texts every
count is 0 and the only type is the unseen one. A long text is cut into pieces that keep their contexts.
"""

from __future__ import annotations

import bisect
import functools
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.bytesets import SLICE_BYTES, Texts, U, mix, splitmix, texts, word_hashes, words
from strandlake.llm.spark_io import discard, durable, give_back, shared_dir, sweep

#: Occurrences in a group, about; a task holds one group at a time.
GROUP = 450_000
#: Bytes of text that are packed together.
SLICE = 4 << 20
#: Bytes of text looked at for the words whose numbers stand for them in the packed arrays, and how many those are.
LOOK = 48 << 20
HOT = 1 << 19
#: Words of one packed array of sums.
CHUNK = 1 << 13
#: Groups whose rarer words come to one range of hashes.
RANGE_GROUPS = 16
#: Slices whose texts' sums come together in one packed array of a group, and the units of their sums of log10.
BLOCK = 4
SCORE_UNITS = 1 << 20
#: Customers up to which all Stirling numbers are tabulated, and tables up to which they are known at all.
EXACT = 256
WINDOW = 1024
#: Tables up to which they are known for the restaurant without context, whose dishes have few.
ROOT_WINDOW = 128
SWEEPS = 1
SAMPLES = 2
START = ((0.8, 1.0), (0.8, 1.0), (0.8, 1.0))
DISCOUNTS = np.arange(1, 20) / 20
STRENGTHS = np.array([0.05, 0.2, 0.5, 1, 2, 5, 10, 20, 50, 200, 1000])
END = U(0x2545F4914F6CDD1D)
_FAR = splitmix(4, 909)


class Stirling:
    """log S(c, t) of one discount: S(c + 1, t) = S(c, t - 1) + (c - t * discount) S(c, t).

    t goes up to window. Up to followed = 4 * window customers the rows follow the recursion; of those beyond EXACT a
    geometric grid is kept. From there a step takes 1 / followed of the customers at once, with the ratio
    S(c, t - 1) / S(c, t) from both of its ends.
    """

    def __init__(self, discount: float, window: int):
        self.discount, self.window, self.followed, self.t = discount, window, 4 * window, np.arange(max(window, EXACT) + 1)
        self.small = np.full((EXACT + 1, EXACT + 1), -np.inf)
        self.small[0, 0] = 0
        for c in range(EXACT):
            self.small[c + 1] = self._next(self.small[c], c)
        self.grid: list[int] = []
        self.rows: list[np.ndarray] = []

    def _next(self, row: np.ndarray, c: int) -> np.ndarray:
        out = np.logaddexp(np.append(-np.inf, row[:-1]), row + np.log(np.maximum(c - self.t[: len(row)] * self.discount, 1e-300)))
        out[c + 2 :] = -np.inf
        return out

    def _follow(self) -> None:
        row = np.full(self.window + 1, -np.inf)
        row[: EXACT + 1] = self.small[EXACT][: self.window + 1]
        self.t, wanted = self.t[: self.window + 1], EXACT
        for c in range(EXACT, self.followed + 1):
            if c == wanted or c == self.followed:
                self.grid.append(c)
                self.rows.append(row)
                wanted = c + c // 64
            row = self._next(row, c)

    def _after(self, row: np.ndarray, c: int, to: int) -> np.ndarray:
        """The row of to customers from that of c; the steps are short against c / ratio, which keeps them stable."""
        while c < to:
            step = min(max(1, c // self.followed), to - c)
            ratio = self._ratio(row)
            for _ in range(2):
                out = row + step * np.log(np.maximum(c + (step - 1) / 2 - self.t * self.discount + ratio, 1e-300))
                ratio = (self._ratio(row) + self._ratio(out)) / 2
            row, c = out, c + step
        return row

    @staticmethod
    def _ratio(row: np.ndarray) -> np.ndarray:
        before = np.append(-np.inf, row[:-1])
        return np.where(np.isfinite(row), np.exp(np.minimum(before - np.where(np.isfinite(row), row, 0), 600)), 0)

    def row(self, c: int) -> np.ndarray:
        """log S(c, 1), log S(c, 2), ... up to c or window tables, or all of them up to EXACT customers."""
        if c <= EXACT:
            return self.small[c, 1 : c + 1]
        if not self.rows:
            self._follow()
        while self.grid[-1] < c:
            step = self.grid[-1] // 64
            self.rows.append(self._after(self.rows[-1], self.grid[-1], self.grid[-1] + step))
            self.grid.append(self.grid[-1] + step)
        at = bisect.bisect_right(self.grid, c) - 1
        row = self.rows[at]
        if c > self.followed:
            row = self._after(row, self.grid[at], c)
        else:
            for k in range(self.grid[at], c):
                row = self._next(row, k)
        return row[1 : min(c, self.window) + 1]


@functools.lru_cache(maxsize=32)
def stirling(discount: float, window: int = WINDOW) -> Stirling:
    return Stirling(discount, window)


def draw(customers: np.ndarray, others: np.ndarray, base: np.ndarray, discount: float, strength: float, rng: np.random.Generator, window: int = WINDOW) -> np.ndarray:
    """Tables of each dish, drawn given its customers, the other tables of its restaurant and the parent's probability."""
    numbers = stirling(discount, window)
    tables = np.minimum(customers, 1)
    many = np.flatnonzero(customers > 1)
    if not len(many):
        return tables
    many = many[np.argsort(customers[many], kind="stable")]
    size = customers[many]
    edge = np.flatnonzero(np.append(True, size[1:] != size[:-1]))
    beyond: list[np.ndarray] = []
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(size)], strict=True):
        weights = numbers.row(int(size[a]))
        step = max(1, (1 << 18) // len(weights))
        for i in range(a, b, step):
            at = many[i : min(i + step, b)]
            line = np.log(strength + discount * (others[at, None] + np.arange(len(weights)))) + np.log(base[at, None])
            np.cumsum(line, axis=1, out=line)
            line += weights
            line -= line.max(axis=1, keepdims=True)
            if size[a] > max(window, EXACT):
                beyond.append(at[line[:, -1] > -12])
            np.cumsum(np.exp(line, out=line), axis=1, out=line)
            pick = (line <= (rng.random(len(at)) * line[:, -1])[:, None]).sum(axis=1)
            tables[at] = np.minimum(pick, len(weights) - 1) + 1
    at = np.concatenate(beyond) if beyond else np.zeros(0, np.int64)
    seated = np.full(len(at), window, np.int64)
    while len(at):  # dishes that may have more tables than the window
        new = (strength + discount * (others[at] + tables[at])) * base[at]
        group = np.minimum(seated // 64, customers[at] - seated)
        tables[at] += rng.binomial(group, new / (new + seated - discount * tables[at]))
        seated += group
        left = seated < customers[at]
        at, seated = at[left], seated[left]
    return tables


def predictive(c: np.ndarray, t: np.ndarray, people: np.ndarray, tables: np.ndarray, base: np.ndarray, discount: float, strength: float) -> np.ndarray:
    """A dish's probability in its restaurant (people, tables: of the whole restaurant), given the parent's."""
    return (c - discount * t + (strength + discount * tables) * base) / (strength + people)


def binned(x: np.ndarray) -> np.ndarray:
    """Numbers to within 3 %: what depends on them only through a logarithm may be grouped so."""
    return np.where(x < 64, x, np.round(np.exp2(np.round(np.log2(np.maximum(x, 1)) * 24) / 24))).astype(np.int64)


def sample_level(seen: list[tuple[int, int, int, int]], discount: float, strength: float, rng: np.random.Generator) -> tuple[float, float]:
    """Discount and strength given a level's seating, as rows (kind, a, b, n): n dishes with a customers and b tables
    (kind 0), n restaurants with a tables (1), n restaurants with a customers (2)."""
    dishes, tables, people = ([r[1:] for r in seen if r[0] == k] for k in range(3))
    if not tables:
        return discount, strength

    def rooms(d: float, s: float) -> float:
        got = sum(n * ((a - 1) * math.log(d) + math.lgamma(s / d + a) - math.lgamma(s / d + 1)) for a, _, n in tables if a)
        return got - sum(n * (math.lgamma(s + a) - math.lgamma(s + 1)) for a, _, n in people if a)

    def choose(weights: np.ndarray) -> int:
        p = np.exp(weights - weights.max())
        return int(rng.choice(len(p), p=p / p.sum()))

    c, t, n = (np.array(x) for x in zip(*dishes, strict=True)) if dishes else (np.zeros(0, int),) * 3
    seats = np.array([float((n * stirling(d).small[c, t]).sum()) for d in DISCOUNTS])
    for _ in range(4):
        discount = float(DISCOUNTS[choose(seats + [rooms(d, strength) for d in DISCOUNTS])])
        strength = float(STRENGTHS[choose(np.array([rooms(discount, s) for s in STRENGTHS]))])
    return discount, strength


class Root:
    """The restaurant without context, from the histogram of customers by dish: (customers, dishes) pairs.

    Dishes with the same customers are alike, so their tables are drawn together, of many by a share of them; beyond
    EXACT customers, where the mean number of tables grows slowly, dishes within 3 % are drawn as one size.
    """

    def __init__(self, customers: np.ndarray, dishes: np.ndarray, types: int, rng: np.random.Generator, sweeps: int = 4):
        self.people, self.base = int((customers * dishes).sum()), 1.0 / (types + 1)
        self.customers, to = np.unique(self.size(customers), return_inverse=True)
        n = np.bincount(to, dishes, len(self.customers))
        self.discount, self.strength = START[0]
        tables, total = np.zeros(len(n)), float(n.sum())
        total_sum, kept = 0.0, 0
        for sweep in range(sweeps + SAMPLES if len(n) else 0):
            now, seen = np.zeros(len(n)), []
            for i, (c, m) in enumerate(zip(self.customers.tolist(), n.tolist(), strict=True)):
                few = int(min(m, 2000))
                t = draw(np.full(few, c), np.full(few, total - total / n.sum()), np.full(few, self.base), self.discount, self.strength, rng, ROOT_WINDOW)
                now[i] = t.mean()
                if c <= EXACT:
                    seen += [(0, c, int(k), m * int(x) / few) for k, x in zip(*np.unique(t, return_counts=True), strict=True)]
            total = float((now * n).sum())
            if sweep >= sweeps:
                tables, total_sum, kept = tables + now, total_sum + total, kept + 1
            else:
                seen += [(1, int(round(total)), 0, 1), (2, self.people, 0, 1)]
                self.discount, self.strength = sample_level(seen, self.discount, self.strength, rng)
        self.tables, self.total = tables / max(1, kept), total_sum / max(1, kept)

    @staticmethod
    def size(customers: np.ndarray) -> np.ndarray:
        return np.where(customers <= EXACT, customers, binned(customers))

    def probability(self, customers: np.ndarray) -> np.ndarray:
        """Of dishes by their customers; 0 customers: an unseen one."""
        t = self.tables[np.minimum(np.searchsorted(self.customers, self.size(customers)), len(self.customers) - 1)] if len(self.customers) else np.zeros(len(customers))
        t = np.where(customers > 0, t, 0)
        return predictive(customers, t, self.people, self.total, self.base, self.discount, self.strength)


class Subtrees:
    """The restaurants of one group, from its occurrences: hashes by number, and numbers of (second, first, dish) words,
    sorted by first, second and dish (see in_order)."""

    def __init__(self, hashes: np.ndarray, second: np.ndarray, first: np.ndarray, dish: np.ndarray, train: np.ndarray):
        many = len(hashes)
        self.hashes = hashes
        other = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))[: len(dish)]
        new = np.append(True, other[1:] | (dish[1:] != dish[:-1]))[: len(dish)]
        self.of = np.cumsum(new, dtype=np.int32) - 1  # each occurrence's triple
        triple = np.flatnonzero(new)
        pair, self.parent = np.unique(first[triple].astype(np.int64) * many + dish[triple], return_inverse=True)
        self.first, self.dish = pair // many, pair % many
        self.room = (np.cumsum(other, dtype=np.int32) - 1)[triple]
        context = np.flatnonzero(other)
        self.context = second[context], first[context]
        self.c2 = np.bincount(self.of, train, len(triple)).astype(np.int64)
        self.people2, self.more_people2, self.more_tables2 = np.bincount(self.room, self.c2, len(context)), 0, 0
        self.more_people1, self.more_tables1, self.more_c1, self.more_t1 = 0, 0, 0, 0
        self.more_c2, self.more_t2 = 0, 0
        self.t2 = np.minimum(self.c2, 1)
        self._count()
        self.t1 = np.minimum(self.c1, 1)

    def _count(self) -> None:
        self.c1 = np.bincount(self.parent, self.t2, len(self.first)).astype(np.int64)

    def rooms1(self) -> tuple[np.ndarray, np.ndarray]:
        many = len(self.hashes)
        return np.bincount(self.first, self.c1, many) + self.more_people1, np.bincount(self.first, self.t1, many) + self.more_tables1

    def rooms2(self) -> tuple[np.ndarray, np.ndarray]:
        return self.people2 + self.more_people2, np.bincount(self.room, self.t2, len(self.people2)) + self.more_tables2

    def probabilities(self, root: np.ndarray, levels) -> tuple[np.ndarray, np.ndarray]:
        """Predictive probability of each pair and each triple; root: of each word."""
        people, tables = self.rooms1()
        p1 = predictive(self.c1 + self.more_c1, self.t1 + self.more_t1, people[self.first], tables[self.first], root[self.dish], *levels[1])
        people, tables = self.rooms2()
        return p1, predictive(self.c2 + self.more_c2, self.t2 + self.more_t2, people[self.room], tables[self.room], p1[self.parent], *levels[2])

    def sweep(self, root: np.ndarray, levels, rng: np.random.Generator) -> None:
        """All customers of the longer contexts, then of the shorter."""
        p1, _ = self.probabilities(root, levels)
        _, tables = self.rooms2()
        self.t2 = draw(self.c2, tables[self.room] - self.t2, p1[self.parent], *levels[2], rng)
        self._count()
        _, tables = self.rooms1()
        self.t1 = np.minimum(self.t1, self.c1)
        self.t1 = draw(self.c1, np.maximum(tables[self.first] - self.t1, 0), root[self.dish], *levels[1], rng)

    def local_root(self) -> np.ndarray:
        """A guess of the root's probabilities from the group's own tables."""
        c = np.bincount(self.dish, self.t1, len(self.hashes))
        return predictive(c, np.minimum(c, 1), c.sum(), np.count_nonzero(c), 1.0 / (len(c) + 1), *START[0])

    def context_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the shorter contexts (one for each word) and of the longer."""
        second, first = self.context
        return mix(self.hashes ^ _FAR[1]), mix(mix(self.hashes[second] ^ _FAR[2]) + self.hashes[first])

    def pair_keys(self) -> np.ndarray:
        return pair_key(self.hashes[self.first], self.hashes[self.dish])

    def triple_keys(self) -> np.ndarray:
        return triple_key(self.hashes[self.context[0]][self.room], self.pair_keys()[self.parent])

    def seating(self) -> list[tuple[int, int, int, int, int]]:
        """(level, kind, a, b, n), as sample_level takes them."""
        out = []
        for level, c, t, people, tables in ((1, self.c1, self.t1, *self.rooms1()), (2, self.c2, self.t2, *self.rooms2())):
            for kind, a, b in ((0, c[(c > 0) & (c <= EXACT)], t[(c > 0) & (c <= EXACT)]), (1, binned(tables[people > 0]), None), (2, binned(people[people > 0]), None)):
                key, n = np.unique(a.astype(np.int64) * (EXACT + 1) + (0 if b is None else b), return_counts=True)
                out += [(level, kind, k // (EXACT + 1), k % (EXACT + 1), m) for k, m in zip(key.tolist(), n.tolist(), strict=True)]
        return out


def pair_key(first: np.ndarray, dish: np.ndarray) -> np.ndarray:
    return mix(mix(first ^ _FAR[0]) + dish)


def triple_key(second: np.ndarray, pair: np.ndarray) -> np.ndarray:
    return mix(mix(second ^ _FAR[2]) + pair)


def lines(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of texts, ends included, and their offsets by text; hashed by runs of about SLICE_BYTES."""
    found, n, i = [], [], 0
    while i < t.n:
        j = max(i + 1, int(np.searchsorted(t.offs, t.offs[i] + SLICE_BYTES, "right")) - 1)
        run = Texts(i, t.data[t.offs[i] : t.offs[j]], t.offs[i : j + 1] - t.offs[i])
        w = words(run)
        found.append(word_hashes(run, w))
        n.append(np.diff(w.offs) + 1)
        i = j
    n, found = np.concatenate(n), np.concatenate(found)
    offs = np.concatenate([[0], np.cumsum(n)])
    line = np.full(offs[-1], END, U)
    line[np.arange(len(found)) + np.repeat(np.arange(t.n), n - 1)] = found
    return line, offs


def count_words(docs: DataFrame) -> DataFrame:
    """(h, n): every distinct token of the texts with its occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch.column(0), SLICE):
                h, n = np.unique(lines(t)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def count_runs(docs: DataFrame, split: np.ndarray) -> DataFrame:
    """(h, n): the keys of pairs of neighbours whose first word is in split, and of those with the word before them, with
    their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch.column(0), SLICE):
                line, offs = lines(t)
                one, two = before(line, offs, END)
                at = np.flatnonzero(np.isin(one, split))
                pair = pair_key(one[at], line[at])
                h, n = np.unique(np.append(pair, triple_key(two[at], pair)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def before(line: np.ndarray, offs: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """The token before each token of the texts and the one before that; a text begins after two ends."""
    n = np.diff(offs)
    one = np.append(end, line[:-1])[: len(line)].astype(line.dtype)
    two = np.append(np.array([end, end], line.dtype), line[:-2])[: len(line)]
    one[offs[:-1]] = end
    two[offs[:-1][n > 1] + 1] = end
    two[offs[:-1]] = end
    return one, two


def pack(arrays: list[np.ndarray]) -> bytes:
    """Unsigned numbers of several arrays, each in the least width that holds it, compressed together."""
    parts, head = [], [len(arrays)]
    for a in arrays:
        width = next(w for w in (1, 2, 4, 8) if not len(a) or int(a.max()) < 1 << (8 * w))
        head += [width, len(a)]
        parts.append(np.ascontiguousarray(a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes())  # byte planes compress better
    raw = np.array(head, "<u4").tobytes() + b"".join(parts)
    return np.uint32(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[4:], int(np.frombuffer(data, "<u4", 1)[0]), "zstd", asbytes=True)
    many = int(np.frombuffer(raw, "<u4", 1)[0])
    head, at, out = np.frombuffer(raw, "<u4", 2 * many, 4).tolist(), 4 + 8 * many, []
    for width, n in zip(head[::2], head[1::2], strict=True):
        planes = np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel())
        at += width * n
    return out


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash; ranges are in the order of hashes."""
    return ((h >> U(32)) * U(ranges) >> U(32)).astype(np.int64)


def range_sums(table: DataFrame) -> DataFrame:
    """(bucket, key, x, y, data) of the rarer words, range by range: to each group the places (in its words of the range),
    tables and customers of those that other groups have too, packed; and with bucket -1 the range's histogram: y words of
    x tables, its customers (x = 0) and how many words have any (x = -1)."""

    def together(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py()) for x in group["data"]]
        at = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
        words_, to = np.unique(np.concatenate([np.cumsum(p[0], dtype=U) for p in parts]), return_inverse=True)
        x, y = (np.bincount(to, np.concatenate([p[k] for p in parts]), len(words_)).astype(np.int64) for k in (1, 2))
        shared, data = np.bincount(to) > 1, []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            place = np.flatnonzero(shared[to[a:b]])
            word = to[a:b][place]
            data.append(pack([np.diff(place, prepend=0), x[word], y[word]]))
        sizes, n = np.unique(x[x > 0], return_counts=True)
        told = np.concatenate([sizes, [0, -1]]), np.concatenate([n, [y.sum(), np.count_nonzero(y)]])
        many = len(sizes) + 2
        return pa.table({
            "bucket": pa.chunked_array([group["bucket"].combine_chunks().cast(pa.int32()), pa.array(np.full(many, -1, np.int32))]), "key": pa.array(np.full(len(parts) + many, key[0].as_py())),
            "x": pa.array(np.append(np.zeros(len(parts), np.int64), told[0])), "y": pa.array(np.append(np.zeros(len(parts), np.int64), told[1].astype(np.int64))), "data": pa.array([*data, *[None] * many], pa.binary()),
        })

    return table.where("kind = 7").select("bucket", "key", "data").groupBy("key").applyInArrow(together, "bucket int, key long, x long, y long, data binary")


def chunks(rank: np.ndarray, values: np.ndarray, many: int, size: int) -> list[tuple[int, bytes]]:
    """Numbers of some of the many frequent words, by rank, as packed arrays of size ranks with the arrays' numbers."""
    edge = np.searchsorted(rank, np.arange(0, many + size, size)).tolist()
    return [(int(rank[a]) // size, pack([np.diff(rank[a:b] % size, prepend=0), values[a:b]])) for a, b in zip(edge[:-1], edge[1:], strict=True) if a < b]


def frequent_counts(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """(key, part, data): the occurrences of the frequent words in a task's texts, as chunks() packs them."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.argsort(shared.value)
        known, out = shared.value[rank], np.zeros(len(rank), np.int64)
        for batch in batches if len(known) else ():
            for t in texts(batch.column(0), SLICE):
                names, n = np.unique(lines(t)[0], return_counts=True)
                at = np.minimum(np.searchsorted(known, names), len(known) - 1)
                is_hot = known[at] == names
                out[rank[at[is_hot]]] += n[is_hot]
        some = np.flatnonzero(out)
        if len(some):
            key, data = zip(*chunks(some, out[some], len(out), CHUNK), strict=True)
            part = TaskContext.get().partitionId() % 64
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array([part] * len(key), pa.int32()), pa.array(data, pa.binary())], ["key", "part", "data"])

    return docs.select("text").mapInArrow(run, "key long, part int, data binary")


def _added(parts: Iterator[list[np.ndarray]], size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for rank, x in parts:
        out[np.cumsum(rank.astype(np.int64))] += x.astype(np.int64)
    return out


def _repacked(sums: np.ndarray) -> bytes:
    at = np.flatnonzero(sums)
    return pack([np.diff(at, prepend=0), sums[at]])


def sums_here(table: DataFrame) -> DataFrame:
    """(key, part, data): a task's sums of (key, data), as chunks() packs them."""

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held[key] = held.get(key, 0) + _added([unpack(raw.as_py())], CHUNK)
        part = TaskContext.get().partitionId() % 64
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([part] * len(held), pa.int32()), pa.array([_repacked(x) for x in held.values()], pa.binary())], ["key", "part", "data"])

    return table.select("key", "data").mapInArrow(here, "key long, part int, data binary")


def frequent_sums(first: DataFrame, many: int) -> np.ndarray:
    """Sums for the many frequent words, by rank, of what tasks have found, (key, part, data).

    Few tasks add it up; the driver gets a number a frequent word.
    """

    def together(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        return pa.table({"key": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([_repacked(_added((unpack(x.as_py()) for x in group["data"]), CHUNK))], pa.binary())})

    out = np.zeros(-(-max(1, many) // CHUNK) * CHUNK, np.int64)
    for row in first.groupBy("key", "part").applyInArrow(together, "key long, data binary").groupBy("key").applyInArrow(together, "key long, data binary").collect():
        out[row["key"] * CHUNK : (row["key"] + 1) * CHUNK] = _added([unpack(bytes(row["data"]))], CHUNK)
    return out[:many]


def dealt(docs: DataFrame, kind: str, groups: int, hot: np.ndarray, split: np.ndarray, shares: np.ndarray, pairs: np.ndarray, parts: np.ndarray, times: np.ndarray) -> DataFrame:
    """(bucket, base, ids, data) from (id, text, train): the occurrences of a slice of texts by group, packed, and, with a
    bucket below 0, the slice's ids with their numbers of tokens and what the frequent ones of these bring: how many have
    training occurrences, and the sum of log10(c + 1). hot: hashes by rank, times: their training occurrences, split and
    pairs: sorted hashes of words and keys of pairs that are dealt to as many shares and parts."""
    shared = docs.sparkSession.sparkContext.broadcast((hot, split, shares, pairs, parts, times))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_, split_, shares_, pairs_, parts_, times_ = shared.value
        rank = np.argsort(hot_)
        times_ = np.append(times_, 0)  # of the others only their groups will know
        known = hot_[rank]
        base = TaskContext.get().partitionId() << 33
        for batch in batches:
            train = batch.column(2).to_numpy(zero_copy_only=False)
            for t in texts(batch.column(1), SLICE):
                line, offs = lines(t)
                n = np.diff(offs)
                names, number = np.unique(line, return_inverse=True)
                # frequent words first, by rank: neighbours in the sorted arrays then differ little
                at = np.minimum(np.searchsorted(known, names), max(0, len(known) - 1))
                is_hot = known[at] == names if len(known) else np.zeros(len(names), bool)
                code = np.where(is_hot, rank[at] if len(known) else 0, len(known))
                by_rank = np.argsort(code, kind="stable")
                new = np.empty(len(names), np.int32)
                new[by_rank] = np.arange(len(names), dtype=np.int32)
                names, code, number, few = names[by_rank], code[by_rank], new[number], int(is_hot.sum())
                many, end = len(names), int(np.flatnonzero(names == END)[0])
                told = times_[code]
                known_n, logs = (np.add.reduceat(x[number], offs[:-1]) for x in ((told > 0).astype(np.int64), np.log10(told + 1.0)))
                one, two = before(number, offs, end)
                mark = (2 * np.arange(t.n) + train[t.first : t.first + t.n]).astype(np.int32)
                bucket = (mix(names) % U(groups)).astype(np.int64)[one]
                if len(split_):
                    at = np.minimum(np.searchsorted(split_, names), len(split_) - 1)
                    wide = np.where(split_[at] == names, shares_[at], U(1))[one]
                    some = np.flatnonzero(wide > 1)
                    share = mix(line[some] ^ _FAR[3]) % wide[some]
                    if len(pairs_):
                        key = pair_key(names[one[some]], line[some])
                        at = np.minimum(np.searchsorted(pairs_, key), len(pairs_) - 1)
                        deep = np.flatnonzero(pairs_[at] == key)
                        second = names[two[some[deep]]]
                        part = U(1) + mix(second ^ _FAR[2]) % parts_[at[deep]]
                        key = triple_key(second, key[deep])
                        at = np.minimum(np.searchsorted(pairs_, key), len(pairs_) - 1)
                        deeper = np.flatnonzero(pairs_[at] == key)
                        part[deeper] += parts_.max() * (U(1) + mix(U(base) + some[deep[deeper]].astype(U) * _FAR[1]) % parts_[at[deeper]])
                        share[deep] += shares_.max() * part
                    bucket[some] = (mix(names[one[some]] + share * _FAR[0]) % U(groups)).astype(np.int64)
                order = np.argsort((bucket * many + one) * many + two)
                bucket = bucket[order]
                both = np.stack([one[order], two[order], number[order]])
                mark = np.repeat(mark, n)[order]
                place = np.empty(many, np.int32)
                cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                rows = []
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=True):
                    used = np.sort(both[:, a:b].ravel())
                    used = used[np.append(True, used[1:] != used[:-1])]
                    place[used] = np.arange(len(used), dtype=np.int32)
                    to, heads = place[both[:, a:b]], int(np.searchsorted(used, few))
                    rows.append(pack([np.diff(code[used[:heads]], prepend=0), names[used[heads:]], *(np.diff(x, prepend=0) % len(used) for x in to[:2]), to[2], mark[a:b]]))
                ids = batch.column(0)[t.first : t.first + t.n]
                of_docs = pa.ListArray.from_arrays(pa.array([0, t.n], pa.int32()), ids)
                none = pa.ListArray.from_arrays(pa.array(np.zeros(len(rows) + 1), pa.int32()), ids[:0])
                buckets = pa.array(np.append(bucket[cuts], -1 - base % groups).astype(np.int32))
                yield pa.RecordBatch.from_arrays([buckets, pa.array(np.full(len(rows) + 1, base)), pa.concat_arrays([none, of_docs]), pa.array([*rows, pack([n, known_n, logs.view(U)])], pa.binary())], ["bucket", "base", "ids", "data"])
                base += 1

    return docs.select("id", "text", "train").mapInArrow(run, f"bucket int, base long, ids array<{kind}>, data binary")


def in_order(many: int, second: np.ndarray, first: np.ndarray, dish: np.ndarray) -> np.ndarray:
    """The order that Subtrees takes occurrences in."""
    return np.argsort((first.astype(np.int64) * many + second) * many + dish)


@dataclass
class Group:
    """A group's occurrences: hashes by number (frequent words first, by rank), numbers of words, slice and mark (document
    and whether it is for training) of each, and the slices' bases."""

    hashes: np.ndarray
    frequent: np.ndarray
    second: np.ndarray
    first: np.ndarray
    dish: np.ndarray
    slice: np.ndarray
    mark: np.ndarray
    bases: np.ndarray

    @classmethod
    def of(cls, blobs: list[bytes], bases: np.ndarray, hot: np.ndarray) -> Group:
        """From what dealt() made, in order."""
        parts = [unpack(x) for x in blobs]
        codes, cold = [np.cumsum(p[0], dtype=np.int64) for p in parts], [p[1].astype(U) for p in parts]
        frequent, rare = np.unique(np.concatenate(codes)), np.unique(np.concatenate(cold))
        out: list[list] = [[], [], []]
        for p, code, rest in zip(parts, codes, cold, strict=True):
            number = np.concatenate([np.searchsorted(frequent, code), len(frequent) + np.searchsorted(rare, rest)]).astype(np.int32)
            for k in (2, 3):
                p[k] = np.cumsum(p[k], dtype=np.int64) % max(1, len(number))
            for column, x in zip(out, p[2:5], strict=True):
                column.append(number[x.astype(np.int64)])
        first, second, dish = (np.concatenate(x) for x in out)
        slice_ = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p[5]) for p in parts])
        mark = np.concatenate([p[5].astype(np.int32) for p in parts])
        order = in_order(len(frequent) + len(rare), second, first, dish)
        return cls(np.concatenate([hot[frequent], rare]), frequent, second[order], first[order], dish[order], slice_[order], mark[order], bases)

    def packed(self) -> bytes:
        step = lambda x: np.diff(x, prepend=0) % len(self.hashes)
        rare = self.hashes[len(self.frequent) :]
        return pack([np.diff(self.frequent, prepend=0), rare, step(self.first), step(self.second), step(self.dish), self.slice, self.mark, self.bases])

    @classmethod
    def unpacked(cls, data: bytes, hot: np.ndarray) -> Group:
        codes, rare, *numbers, slice_, mark, bases = unpack(data)
        frequent = np.cumsum(codes, dtype=np.int64)
        many = len(frequent) + len(rare)
        first, second, dish = ((np.cumsum(x, dtype=np.int64) % many).astype(np.int32) for x in numbers)
        return cls(np.concatenate([hot[frequent], rare.astype(U)]), frequent, second, first, dish, slice_.astype(np.int32), mark.astype(np.int32), bases.astype(np.int64))

    def tree(self) -> Subtrees:
        return Subtrees(self.hashes, self.second, self.first, self.dish, self.mark & 1)


def score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score, score; train is a Boolean column of docs."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    base = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = base.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    share = min(1.0, LOOK / max(1, size))
    # how occurrences are packed and dealt follows from a look at some texts; no count or probability hangs on it
    look = base.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    common = count_words(look).orderBy(F.desc("n"), "h").limit(HOT).toPandas()
    hashes, n = common["h"].to_numpy(np.int64).view(U), common["n"].to_numpy(np.int64) / share
    hot, groups = hashes, max(1, -(-int(n.sum()) // GROUP))
    wide = np.flatnonzero(n > GROUP / 2)
    wide = wide[np.argsort(hashes[wide])]
    split, shares = hashes[wide], (1 + n[wide] // (GROUP / 2)).astype(U)
    pairs, pair_parts = np.zeros(0, U), np.zeros(0, U)
    if len(split):
        often = count_runs(look, split).where(F.col("n") / share > GROUP / 2).toPandas()  # a few for each group
        pairs, pair_parts = often["h"].to_numpy(np.int64).view(U), (1 + often["n"].to_numpy(np.int64) / share // (GROUP / 2)).astype(U)
        order = np.argsort(pairs)
        pairs, pair_parts = pairs[order], pair_parts[order]
    shared = spark.sparkContext.broadcast((hot, split, pairs))
    ranges = -(-groups // RANGE_GROUPS)
    often_y = frequent_sums(frequent_counts(base.where("train"), hot), len(hot))

    def seat(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        try:
            return seat_group(key, group)
        finally:
            give_back()

    def seat_group(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        bucket, none = key[0].as_py(), lambda m, k: pa.nulls(m, k)
        if bucket < 0:  # ids of slices go through
            many = len(group)
            return pa.table({"bucket": group["bucket"], "kind": pa.array(np.full(many, 3, np.int32)), "key": group["base"], "x": none(many, pa.int64()), "y": none(many, pa.int64()), "ids": group["ids"], "data": group["data"]})
        hot_, split_, pairs_ = shared.value
        held = Group.of(group["data"].to_pylist(), group["base"].to_numpy(), hot_)
        hashes, tree = held.hashes, held.tree()
        rng = np.random.default_rng([7, key[0].as_py()])
        for _ in range(SWEEPS):
            tree.sweep(tree.local_root(), START, rng)
        here = np.unique(tree.dish)
        tables = np.bincount(tree.dish, tree.t1, len(hashes))[here].astype(np.int64)
        times = np.bincount(tree.dish[tree.parent], tree.c2, len(hashes))[here].astype(np.int64)
        few = int(np.searchsorted(here, len(held.frequent)))  # of the frequent words, packed by rank
        blobs = chunks(held.frequent[here[:few]], tables[:few], len(hot_), CHUNK)
        frequent, rare = len(blobs), hashes[here[few:]]
        edge = np.searchsorted(range_of(rare, ranges), np.arange(ranges + 1))
        for k in np.flatnonzero(np.diff(edge)).tolist():
            a, b = edge[k : k + 2].tolist()
            blobs.append((k, pack([np.diff(rare[a:b], prepend=U(0)), tables[few + a : few + b], times[few + a : few + b]])))
        keys, x, y, kinds = [], [], [], []
        short, long = tree.context_keys()
        for k, own, (people, seats) in ((short, np.isin(hashes, split_), tree.rooms1()), (long, np.isin(hashes[tree.context[1]], split_), tree.rooms2())):
            at = np.flatnonzero(own)
            for column, value in zip((keys, x, y, kinds), (k[at], people[at].astype(np.int64), seats[at].astype(np.int64), np.ones(len(at), np.int32)), strict=True):
                column.append(value)
        if len(pairs_):
            for key, c, tables_ in ((tree.pair_keys(), tree.c1, tree.t1), (tree.triple_keys(), tree.c2, tree.t2)):
                at = np.flatnonzero(np.isin(key, pairs_))
                for column, value in zip((keys, x, y, kinds), (key[at], c[at], tables_[at].astype(np.int64), np.full(len(at), 5, np.int32)), strict=True):
                    column.append(value)
        seen = np.array(tree.seating(), np.int64).reshape(-1, 5)
        keys += [((seen[:, 0] * 3 + seen[:, 1]) << 48 | seen[:, 2] << 10 | seen[:, 3]).view(U), np.array([k for k, _ in blobs], U), np.zeros(1, U)]
        x += [seen[:, 4], np.zeros(len(blobs) + 1, np.int64)]
        y.append(np.zeros(len(seen) + len(blobs) + 1, np.int64))
        kinds.append(np.concatenate([np.full(len(seen), 2, np.int32), np.full(frequent, 6, np.int32), np.full(len(blobs) - frequent, 7, np.int32), np.full(1, 4, np.int32)]))
        many = sum(map(len, keys))
        data = pa.concat_arrays([none(many - 1 - len(blobs), pa.binary()), pa.array([*(b for _, b in blobs), held.packed()], pa.binary())])
        return pa.table({"bucket": pa.array(np.full(many, bucket, np.int32)), "kind": np.concatenate(kinds), "key": np.concatenate(keys).view(np.int64), "x": np.concatenate(x), "y": np.concatenate(y), "ids": none(many, group.schema.field("ids").type), "data": data})

    # groups are written as a bucketed table: round two reads them without a shuffle
    name, path = f"occurrences_{uuid.uuid4().hex}", f"{shared_dir(spark)}/occurrences-{uuid.uuid4().hex}"
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seated = dealt(base, kind, groups, hot, split, shares, pairs, pair_parts, often_y).groupBy("bucket").applyInArrow(seat, f"bucket int, kind int, key long, x long, y long, ids array<{kind}>, data binary")
    seated.write.option("path", path).bucketBy(files, "bucket").sortBy("bucket").saveAsTable(name)
    sweep(spark)
    table = spark.table(name)
    table.durable_path = path
    # sums over groups come by one shuffle of a key's rows, of which there are no more than groups
    seats = table.where("kind in (1, 5)").select("bucket", "kind", "key", "x", "y")
    of_key = Window.partitionBy("kind", "key")
    added = [F.sum(c).over(of_key).alias(f"all_{c}") for c in ("x", "y")]
    sums = seats.select("*", *added, F.count("*").over(of_key).alias("many"))
    often_x = frequent_sums(sums_here(table.where("kind = 6")), len(hot))
    rarer = durable(range_sums(table), "ranges")
    hist = rarer.where("bucket = -1").groupBy("x").agg(F.sum("y").alias("n")).toPandas()  # a row for each number of tables
    rare_x, rare_n = hist["x"].to_numpy(np.int64), hist["n"].to_numpy(np.int64)
    total, types = int(often_y.sum() + rare_n[rare_x == 0].sum()), int(np.count_nonzero(often_y) + rare_n[rare_x == -1].sum())
    rare_x, rare_n = rare_x[rare_x > 0], rare_n[rare_x > 0]
    sizes, of_size = np.unique(often_x[often_x > 0], return_counts=True)
    seating = table.where("kind = 2").groupBy("key").agg(F.sum("x").alias("x")).collect()
    rng = np.random.default_rng(8)
    root = Root(np.append(rare_x, sizes), np.append(rare_n, of_size), types, rng)
    levels = [(root.discount, root.strength)]
    seen = [(r["key"] >> 48, r["key"] >> 10 & (1 << 38) - 1, r["key"] & 1023, r["x"]) for r in seating]
    for level in (1, 2):
        levels.append(sample_level([(k - 3 * level, a, b, n) for k, a, b, n in seen if k // 3 == level], *START[level], rng))

    answers = sums.where("many > 1").select("bucket", "kind", "key", F.col("all_x") - F.col("x"), F.col("all_y") - F.col("y"), F.lit(None).cast("binary")).union(rarer.where("bucket >= 0").select("bucket", F.lit(7), "key", "x", "y", "data")).toDF("b", "word", "k", "x_", "y_", "packed")
    final = spark.sparkContext.broadcast((root, levels, often_x))

    def rate(key: tuple[pa.Scalar, ...], group: pa.Table, told: pa.Table) -> pa.Table:
        try:
            return rate_group(key, group, told)
        finally:
            give_back()

    def rate_group(key: tuple[pa.Scalar, ...], group: pa.Table, told: pa.Table) -> pa.Table:
        (hot_, _, pairs_), (root_, levels_, often_x_) = shared.value, final.value
        held = Group.unpacked(group["data"][0].as_py(), hot_)
        hashes, tree = held.hashes, held.tree()
        held.second = held.first = held.dish = np.zeros(0, np.int64)
        word, k, x, y = (told[n].to_numpy() for n in ("word", "k", "x_", "y_"))

        def value(keys: np.ndarray, kind: int, column: np.ndarray) -> np.ndarray:
            some = word == kind
            have = k[some].view(U)
            order = np.argsort(have)
            out = np.zeros(len(keys), column.dtype)
            if len(have):
                at = np.minimum(np.searchsorted(have[order], keys), len(have) - 1)
                out = np.where(have[order][at] == keys, column[some][order][at], 0)
            return out

        own = np.bincount(tree.dish, tree.t1, len(hashes)).astype(np.int64), np.bincount(tree.dish[tree.parent], tree.c2, len(hashes)).astype(np.int64)
        few = len(held.frequent)
        own[0][:few] = often_x_[held.frequent]
        rare = np.unique(tree.dish)
        rare = rare[rare >= few]  # in the order in which round one sent them
        edge = np.searchsorted(range_of(hashes[rare], ranges), np.arange(ranges + 1))
        for at in np.flatnonzero(word == 7).tolist():  # of words of this group only it knows all
            place, all_x, all_y = unpack(told["packed"][at].as_py())
            number = rare[edge[k[at]] + np.cumsum(place, dtype=np.int64)]
            own[0][number], own[1][number] = all_x, all_y
        p0 = root_.probability(own[0])
        short, long = tree.context_keys()
        tree.more_people1, tree.more_tables1, tree.more_people2, tree.more_tables2 = value(short, 1, x), value(short, 1, y), value(long, 1, x), value(long, 1, y)
        if len(pairs_):
            one_, two_ = tree.pair_keys(), tree.triple_keys()
            tree.more_c1, tree.more_t1, tree.more_c2, tree.more_t2 = value(one_, 5, x), value(one_, 5, y), value(two_, 5, x), value(two_, 5, y)
        rng_ = np.random.default_rng([9, key[0].as_py()])
        p = np.zeros(len(tree.parent))
        for sweep in range(SWEEPS + SAMPLES):
            tree.sweep(p0, levels_, rng_)
            if sweep >= SWEEPS:
                p += tree.probabilities(p0, levels_)[1]
        # a row for each block of slices: of its texts the sums of log10, and the counts of their rarer words
        by_base = np.argsort(held.bases)
        bases, to = held.bases[by_base], np.empty(len(by_base), np.int64)
        to[by_base] = np.arange(len(by_base))
        docs_, to = np.unique(to[held.slice] << 32 | held.mark >> 1, return_inverse=True)
        sums_ = np.bincount(to, np.maximum(-np.log10(p / SAMPLES), 0)[tree.of], len(docs_))
        sums_ = np.round(sums_ * SCORE_UNITS).astype(np.int64)
        dish = tree.dish[tree.parent][tree.of]
        rare = np.flatnonzero(dish >= few)
        rare = rare[np.argsort(to[rare], kind="stable")]
        to, times = to[rare], own[1][dish[rare]]
        of_slice, doc = docs_ >> 32, docs_ & 0xFFFFFFFF
        block = bases[of_slice] // BLOCK
        cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        ends = np.append(cuts[1:], len(block))
        out = []
        for a, b, i, j in zip(cuts.tolist(), ends.tolist(), np.searchsorted(to, cuts).tolist(), np.searchsorted(to, ends).tolist(), strict=True):
            width = doc[a:b].max(keepdims=True) + 1
            out.append(pack([width, np.diff(bases[of_slice[a:b]] % BLOCK * width + doc[a:b], prepend=0), sums_[a:b], np.diff(to[i:j] - a, prepend=0), times[i:j]]))
        return pa.table({"block": block[cuts], "sums": pa.array(out, pa.binary())})

    parts = durable(table.where("kind = 4").groupBy("bucket").cogroup(answers.groupBy("b")).applyInArrow(rate, "block long, sums binary"), "parts")
    about = durable(table.where("kind = 3").select(F.col("key").alias("base"), "ids", "data"), "about")
    discard(rarer, table)
    spark.sql(f"drop table {name}")
    floor = math.log10(total + types + 1)

    def add(key: tuple[pa.Scalar, ...], of_docs: pa.Table, found: pa.Table) -> pa.Table:
        slices = of_docs["base"].to_numpy() % BLOCK
        n, known, logs = (np.concatenate(x) for x in zip(*(unpack(x.as_py()) for x in of_docs["data"]), strict=True))
        n, known, logs = n.astype(np.int64), known.astype(np.int64), logs.astype(U).view(float)
        ids = of_docs["ids"].combine_chunks()
        at, many = np.zeros(BLOCK, np.int64), np.diff(ids.offsets.to_numpy())
        at[slices] = np.cumsum(many) - many
        sums_ = np.zeros(len(n), np.int64)
        for raw in found["sums"]:
            width, place, x, rare, times = unpack(raw.as_py())
            place = np.cumsum(place, dtype=np.int64)
            place = at[place // int(width[0])] + place % int(width[0])
            sums_[place] += x.astype(np.int64)
            rare = place[np.cumsum(rare, dtype=np.int64)]
            np.add.at(known, rare, (times > 0).astype(np.int64))
            np.add.at(logs, rare, np.log10(times + 1.0))
        return pa.table({id_col: ids.flatten(), "n_tokens": n, "n_known": known, "train_tokens": np.full(len(n), total), "base_score": logs - n * floor, "score": -sums_ / SCORE_UNITS})

    schema = f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return about.withColumn("block", F.expr(f"base div {BLOCK}")).groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(add, schema)
