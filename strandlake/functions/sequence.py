"""Sequence columns: identity, low complexity, canonical k-mers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 64
#: Sequences that are scored at once.
SCORED = 2048
_BASE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _BASE[ord(_c)] = _BASE[ord(_c.lower())] = _i


def ani(nm: Column, length: Column) -> Column:
    """Percent identity; null where nm is null or the length is 0."""
    return (1 - nm / F.nullif(length, F.lit(0))) * 100


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, longest) base codes, 4 where there is none, and lengths; only A, C, G, T are left."""
    column = column.fill_null("").cast(pa.large_string())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]] if len(column) and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    code, row = _BASE[raw], np.repeat(np.arange(len(column)), np.diff(offs))
    ok = code < 4
    code, row = code[ok], row[ok]
    n = np.bincount(row, minlength=len(column))
    out = np.full((len(column), int(n.max(initial=0))), 4, np.uint8)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = code
    return out, n


def dust_scores(column: pa.Array) -> np.ndarray:
    """Triplet score of each sequence, bases other than A, C, G, T dropped first.

    With m triplets: 200 * pairs of equal triplets / (m (m - 1)) for m up to 64, else the most pairs in a 64-triplet
    window that ends at triplet 64 or later, over 64 * 63. 0 with fewer than two triplets.
    """
    out = np.zeros(len(column))
    for at in range(0, len(column), SCORED):
        base, n = _padded(column.slice(at, SCORED))
        out[at : at + SCORED] = _dust(base, np.maximum(n - 2, 0))
    return out


def _dust(base: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The window moves along all sequences at once; counts are those of its triplets, pairs follows from them."""
    out = np.zeros(len(m))
    if base.shape[1] < 4:
        return out
    order = np.argsort(-m, kind="stable")  # longest first: those that still go on are the first ones
    base, m = np.ascontiguousarray(base[order].T), m[order]
    word = base[:-2] * 16 + base[1:-1] * 4 + base[2:]
    going = np.searchsorted(-m, -np.arange(len(word)), "left")  # sequences with more than so many triplets
    counts = np.zeros((len(m), WINDOW), np.int16).ravel()
    pairs, late, row = np.zeros(len(m), np.int32), np.zeros(len(m), np.int32), np.arange(len(m)) * WINDOW
    for at in range(len(word)):
        n = going[at]
        if at >= WINDOW:
            old = row[:n] + word[at - WINDOW, :n]
            left = counts[old] - 1
            counts[old] = left
            pairs[:n] -= left
        new = row[:n] + word[at, :n]
        had = counts[new]
        pairs[:n] += had
        counts[new] = had + 1
        if at >= WINDOW:
            np.maximum(late[:n], pairs[:n], out=late[:n])
    score = np.where(m > WINDOW, 200.0 * late / (WINDOW * (WINDOW - 1.0)), 200.0 * pairs / np.maximum(m * (m - 1.0), 1.0))
    out[order] = np.where(m > 1, score, 0.0)
    return out


def dust(seq: Column) -> Column:
    """The rounded score of a sequence. Only the sequence goes through Arrow; other columns stay in the JVM.

    It is said not to be deterministic, which it is: a filter on the score would else compute it a second time.
    """

    @F.arrow_udf("int")
    def rounded(column: pa.Array) -> pa.Array:
        distinct = column.fill_null("").dictionary_encode()  # a read's alignments repeat its sequence
        return pa.array(np.floor(dust_scores(distinct.dictionary) + 0.5).astype(np.int32)).take(distinct.indices)

    return rounded.asNondeterministic()(seq)


def with_dust(df: DataFrame, seq: str = "seq", out: str = "dust") -> DataFrame:
    return df.withColumn(out, dust(F.col(seq)))


def _bases(column: pa.Array, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base codes of the first longest bases of all sequences one after another, 4 where it is none; lengths, offsets."""
    column = column.fill_null("").cast(pa.large_string())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    size = np.diff(offs)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]] if len(column) and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    n = np.minimum(size, longest)
    if (n < size).any():
        raw = raw[np.arange(len(raw)) - np.repeat(offs[:-1] - offs[0], size) < longest]
    return _BASE[raw], n, np.concatenate([[0], np.cumsum(n)])


def kmer_codes(column: pa.Array, k: int, longest: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of each k-mer of the first longest bases, most a row at most; a k-mer with another base has code -1.

    The code packs two bits a base of the k-mer or of its reverse complement, whichever is less. Codes of m bases give
    those of 2 m, so that k takes about twice its logarithm of steps; all sequences are one array.
    """
    if not 1 <= k <= 31:
        raise ValueError("k must be between 1 and 31")
    base, n, offs = _bases(column, longest)
    per = np.minimum(np.maximum(n - k + 1, 0), most)
    if not per.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = (base & 3).astype(np.int64)
    fwd, rev, bad, m = one, 3 - one, base > 3, 1  # of the m bases that begin at each place
    whole = None  # of those the binary digits of k so far ask for
    size, rest = 0, k
    while rest:
        if rest & 1:
            if whole is None:
                whole = (fwd, rev, bad)
            else:
                f, r, b = whole
                upto = len(base) - size - m + 1
                whole = (f[:upto] << 2 * m | fwd[size : size + upto], rev[size : size + upto] << 2 * size | r[:upto], b[:upto] | bad[size : size + upto])
            size += m
        rest >>= 1
        if rest:
            upto = max(0, len(base) - 2 * m + 1)
            fwd, rev, bad = fwd[:upto] << 2 * m | fwd[m : m + upto], rev[m : m + upto] << 2 * m | rev[:upto], bad[:upto] | bad[m : m + upto]
            m *= 2
    code = np.where(whole[2], -1, np.minimum(whole[0], whole[1]))
    row = np.repeat(np.arange(len(n)), per)
    place = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per) + np.repeat(offs[:-1], per)
    return row, code[place]


#: K-mers that a task combines before it sends them, and k-mers that a task holds at a time when it counts them.
COMBINED = 4_000_000
HELD = 4_000_000
#: Lots for each shuffle partition.
LOTS = 4


def _rows(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the number of each row among them."""
    if values.shape[1] == 1:
        names, number = np.unique(values[:, 0], return_inverse=True)
        return names[:, None], number
    names, number = np.unique(values, axis=0, return_inverse=True)
    return names, number.ravel()


def _distinct(group: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (group, code), sorted by group."""
    bits = 2 * k + 1
    if int(group.max(initial=0)) < 1 << (63 - bits):
        both = np.sort(group << bits | (code + 1))
        both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
        return both >> bits, (both & ((1 << bits) - 1)) - 1
    order = np.lexsort((code, group))
    group, code = group[order], code[order]
    new = np.append(True, (group[1:] != group[:-1]) | (code[1:] != code[:-1]))[: len(group)]
    return group[new], code[new]


def _dealt(names: np.ndarray, group: np.ndarray, code: np.ndarray, shares: int) -> np.ndarray:
    """The share that each (group, code) belongs to, from 0 to shares - 1; the same wherever it is found."""
    own = np.zeros(len(names), np.uint64)
    for c in range(names.shape[1]):
        own = (own ^ names[:, c].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        own ^= own >> np.uint64(29)
    mixed = (own[group] ^ code.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed >> np.uint64(32)) * np.uint64(shares) >> np.uint64(32)).astype(np.int64)


def _packed(names: np.ndarray, total: np.ndarray, group: np.ndarray, code: np.ndarray) -> bytes:
    return np.array([len(names), len(code)], np.int64).tobytes() + names.astype(np.int64).tobytes() + total.tobytes() + code.tobytes() + group.astype(np.int32).tobytes()


def _unpacked(raw: bytes, keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    some, many = np.frombuffer(raw, np.int64, 2).tolist()
    at = 16 + 8 * some * keys
    return np.frombuffer(raw, np.int64, some * keys, 16).reshape(some, keys), np.frombuffer(raw, np.int64, some, at), np.frombuffer(raw, np.int32, many, at + 8 * some + 8 * many).astype(np.int64), np.frombuffer(raw, np.int64, many, at + 8 * some)


def dealt_kmers(held: list[tuple[list[np.ndarray], np.ndarray, np.ndarray]], k: int, lots: int, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """(lot, part, packed) of the distinct k-mers of some rows; totals go with the first piece. held: (key columns, row,
    code) each."""
    at = np.concatenate([[0], np.cumsum([len(h[0][0]) for h in held])])
    names, number = _rows(np.stack([np.concatenate([h[0][c] for h in held]) for c in range(len(held[0][0]))], axis=1))
    group = np.concatenate([number[at[i] + h[1]] for i, h in enumerate(held)])
    total = np.bincount(group, minlength=len(names))
    group, code = _distinct(group, np.concatenate([h[2] for h in held]), k)
    share = _dealt(names, group, code, lots * parts)
    order = np.argsort(share.astype(np.uint16) if lots * parts <= 1 << 16 else share, kind="stable")  # short numbers are sorted by digits
    cut = np.searchsorted(share[order], np.arange(lots * parts + 1))
    for i in range(lots * parts):
        mine = order[cut[i] : cut[i + 1]]
        if i == 0:
            yield 0, 0, _packed(names, total, group[mine], code[mine])
        elif len(mine):
            some, to = np.unique(group[mine], return_inverse=True)
            yield i // parts, i % parts, _packed(names[some], np.zeros(len(some), np.int64), to, code[mine])


class Counter:
    """Distinct k-mers of the pieces of one part at a time; pieces are made distinct whenever HELD of them are there."""

    def __init__(self, keys: int, k: int, most: int):
        self.keys, self.k, self.most, self.largest = keys, k, most, 0
        self.pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, raw: bytes) -> None:
        self.pieces.append(_unpacked(raw, self.keys))
        self.size += len(self.pieces[-1][3])
        self.largest = max(self.largest, self.size)
        if self.size >= self.most and len(self.pieces) > 1:
            self.pieces = [self._merged()]
            self.size = len(self.pieces[0][3])

    def _merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at = np.concatenate([[0], np.cumsum([len(p[0]) for p in self.pieces])])
        names, number = _rows(np.concatenate([p[0] for p in self.pieces]))
        total = np.zeros(len(names), np.int64)
        np.add.at(total, number, np.concatenate([p[1] for p in self.pieces]))
        group, code = _distinct(number[np.concatenate([p[2] + at[i] for i, p in enumerate(self.pieces)])], np.concatenate([p[3] for p in self.pieces]), self.k)
        return names, total, group, code

    def taken(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(names, distinct, total) of the part, which is forgotten."""
        names, total, group, _ = self._merged()
        self.pieces, self.size = [], 0
        return names, np.bincount(group, minlength=len(names)), total


def kmer_total(reads: DataFrame, k: int, longest: int, most: int, seq: str = "seq") -> int:
    """How many k-mers the reads have; their distinct ones are at most as many."""
    per = F.greatest(F.least(F.length(seq), F.lit(longest)) - k + 1, F.lit(0))
    return reads.agg(F.sum(F.least(per, F.lit(most)).cast("long")).alias("n")).first()["n"] or 0


def kmer_counts(reads: DataFrame, keys: list[str], k: int, longest: int = 255, most: int = 1 << 30, seq: str = "seq", held: int | None = None) -> DataFrame:
    """(keys, distinct_kmers, total_kmers) by group of integer keys, which are not null; groups without a k-mer are absent.

    A task combines its k-mers and deals them, packed, into lots by a hash of k-mer and group: a lot holds a share of every
    group, so that no group is too large for a task. Lots are as many as shuffle partitions times LOTS. A lot has as many
    parts as keep each below held k-mers, going by the number of all k-mers, which bounds that of the distinct ones; Spark
    sorts a partition's pieces by lot and part (and spills as it does), and a task counts one part after another. So a
    worker holds no more than about twice held k-mers (16 bytes each, and as much again while they are sorted), however
    large its lots are. reads is read twice: first for its lengths.
    """
    spark = reads.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lots, bound = LOTS * shuffle, held or HELD
    parts = max(1, -(-kmer_total(reads, k, longest, most, seq) // (lots * bound)))
    kinds, width = dict(reads.dtypes), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent() -> pa.RecordBatch:
            lot, part, packed = zip(*dealt_kmers(held, k, lots, parts), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(lot, pa.int32()), pa.array(part, pa.int64()), pa.array(packed, pa.binary())], ["lot", "part", "packed"])

        for batch in batches:
            for at in range(0, len(batch), 4096):
                some = batch.slice(at, 4096)
                row, code = kmer_codes(some.column(width), k, longest, most)
                held.append(([some.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(width)], row, code))
                size += len(code)
                if size >= COMBINED:
                    yield sent()
                    held, size = [], 0
        if size:
            yield sent()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, now = Counter(width, k, 2 * bound), None

        def told() -> pa.RecordBatch:
            names, distinct, total = counter.taken()
            return pa.RecordBatch.from_arrays([*(pa.array(names[:, i]) for i in range(width)), pa.array(distinct), pa.array(total)], [*keys, "d", "t"])

        for batch in batches:
            for lot, part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if now is not None and now != (lot, part):
                    yield told()
                now = (lot, part)
                counter.add(raw.as_py())
        if now is not None:
            yield told()

    packed = reads.select(*keys, seq).mapInArrow(run, "lot int, part long, packed binary")
    counted = packed.repartition(shuffle, "lot").sortWithinPartitions("lot", "part").mapInArrow(count, ", ".join(f"`{c}` long" for c in keys) + ", d long, t long")
    out = counted.groupBy(*keys).agg(F.sum("d").alias("distinct_kmers"), F.sum("t").alias("total_kmers"))
    return out.select(*[F.col(c).cast(kinds[c]) for c in keys], "distinct_kmers", "total_kmers")
