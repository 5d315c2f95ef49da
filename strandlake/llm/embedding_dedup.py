"""Near-duplicate embeddings by randomised-rotation binary codes.

Unit vectors are turned by a random orthogonal matrix. What is stored of a turned vector is a sketch: its coordinates in
eight bits, whose signs are its binary code, the scale and the length of what eight bits leave out, and the correction
factor, the inner product of the turned vector and its code. For a turned q and a coded o, <code(o), q> / factor(o) is an
unbiased estimate of <o, q>, off by more than SIGMAS * sqrt((1 - factor^2) / (factor^2 (D - 1))) with a chance that falls
as exp(-SIGMAS^2 / 2). A pair whose upper bound is below the threshold is dropped. For the others the eight-bit
coordinates give an inner product with a strict bound (Cauchy-Schwarz on what they leave out): above it a pair links,
below it doesn't, and only pairs whose bounds hold the threshold are computed again from the vectors in double precision.

Candidates meet in buckets of equal code pieces: BITS signs of one further rotation of the sketch, in whole numbers, so
that every task gets the same ones. Tables of such pieces are added until a pair at the threshold shares one with
probability RECALL; BITS follows the number of vectors, so that buckets do not grow with it. A large bucket is split into
blocks, and each pair of blocks is a group of its own. A pair that met in an earlier table is not counted again. Postings
carry sketches; vectors go only to the blocks that ask for them. Tasks return a count and one link for each vector, never
all pairs.

Equal vectors are one class with a multiplicity. Null and zero vectors and those with null or non-finite components
link with nothing; vectors of another length than most link within their own length only. Ids are distinct: rows that
repeat id and vector are repeated and count as one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.components import components
from strandlake.llm.spark_io import discard, durable, join_counted

THRESHOLD = 0.95
RECALL = 0.999
SIGMAS = 4.5
BLOCK = 1024
SEED = 20


def plan(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a code piece and number of tables for n vectors."""
    bits = max(6, math.ceil(math.log2(max(n, 1) / 64 + 1)))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-same)))


def rotation(dim: int, k: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([SEED, k]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


@dataclass
class Sketches:
    """Of n vectors: eight-bit coordinates, scales, lengths of what they leave out, correction factors."""

    q: np.ndarray
    scale: np.ndarray
    rest: np.ndarray
    factor: np.ndarray

    @classmethod
    def of(cls, unit: np.ndarray) -> Sketches:
        turned = unit @ rotation(unit.shape[1], 0).T
        scale = np.abs(turned).max(axis=1) / 127
        q = np.rint(turned / scale[:, None]).astype(np.int8)
        rest = np.sqrt(((turned - q * scale[:, None]) ** 2).sum(axis=1))
        factor = (np.where(q >= 0, 1.0, -1.0) * turned).sum(axis=1) / math.sqrt(unit.shape[1])
        return cls(q, scale, rest + 1e-12, np.maximum(factor, 1e-9))

    def packed(self) -> list[bytes]:
        tail = np.stack([self.scale, self.rest, self.factor], axis=1)
        tail[:, 1] *= 1 + 1e-6  # stays a bound in single precision
        tail = tail.astype(np.float32)
        return [a.tobytes() + b.tobytes() for a, b in zip(self.q, tail, strict=True)]

    @classmethod
    def unpacked(cls, rows: list[bytes]) -> Sketches:
        raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
        tail = np.ascontiguousarray(raw[:, -12:]).view(np.float32).astype(np.float64)
        return cls(np.ascontiguousarray(raw[:, :-12]).view(np.int8), tail[:, 0], tail[:, 1], tail[:, 2])

    def pieces(self, bits: int, tables: int) -> np.ndarray:
        """(n, tables) code pieces: signs of consecutive coordinates under as many rotations as are needed. Sums of whole
        numbers below 2**53 are exact in any order."""
        dim, have = self.q.shape[1], np.zeros((len(self.q), 0), bool)
        k = 1
        while have.shape[1] < bits * tables:
            have = np.concatenate([have, self.q.astype(np.float64) @ np.rint(rotation(dim, k).T * (1 << 24)) > 0], axis=1)
            k += 1
        weight = 1 << np.arange(bits, dtype=np.int64)
        return np.stack([have[:, t * bits : (t + 1) * bits] @ weight for t in range(tables)], axis=1)


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Sorted batches as one table for each run of equal first n_keys columns."""
    held: list[pa.RecordBatch] = []
    mark = None
    for batch in batches:
        if not len(batch):
            continue
        key = np.stack([batch.column(i).to_numpy() for i in range(n_keys)], axis=1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(key[a].tolist())
            if held and now != mark:
                yield pa.Table.from_batches(held)
                held = []
            mark = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def block_links(s: Sketches, table: int, bits: int, left: np.ndarray, right: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, sure): index pairs that did not meet in an earlier table and link surely, or may link."""
    dim = s.q.shape[1]
    near = s.q * s.scale[:, None]
    sign = np.where(s.q[right] >= 0, 1.0, -1.0) / math.sqrt(dim)
    factor = s.factor[right]
    slack = SIGMAS * np.sqrt((1 - np.minimum(factor, 1) ** 2) / (factor**2 * max(dim - 1, 1)))
    estimate = near[left] @ sign.T / factor
    x, y = np.nonzero(estimate + slack + s.rest[left][:, None] / factor >= threshold)
    x, y = left[x], right[y]
    if same:
        x, y = x[x < y], y[x < y]
    norm = s.scale * np.sqrt((s.q.astype(np.float64) ** 2).sum(axis=1))
    out: list = []
    for i in range(0, len(x), 1 << 18):
        a, b = x[i : i + (1 << 18)], y[i : i + (1 << 18)]
        dot = np.einsum("ij,ij->i", near[a], near[b])
        off = s.rest[a] * norm[b] + s.rest[b] * norm[a] + s.rest[a] * s.rest[b] + 1e-9
        some = dot + off >= threshold
        out.append((a[some], b[some], (dot - off >= threshold)[some]))
    x, y, sure = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, [np.int64, np.int64, bool][k]) for k in range(3))
    if table and len(x):
        used = np.unique(np.concatenate([x, y]))
        code = Sketches(s.q[used], s.scale[used], s.rest[used], s.factor[used]).pieces(bits, table)
        new = ~(code[np.searchsorted(used, x)] == code[np.searchsorted(used, y)]).any(axis=1)
        x, y, sure = x[new], y[new], sure[new]
    return x, y, sure


def unit_vectors(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def local_labels(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least index of each index's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    v = vectors.select(vectors[id_col].alias("id"), vectors[vec_col].cast("array<double>").alias("v"))
    good = F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    base = v.withColumn("good", F.coalesce(good, F.lit(False)))
    keyed = base.where("good").select("id", "v", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"))
    classes = keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("many"), F.first("v").alias("v"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column(4).offsets.to_numpy())
            for dim in np.unique(size).tolist():
                part = batch.filter(pa.array(size == dim))
                unit = unit_vectors(np.asarray(part.column(4).flatten(), dtype=np.float64).reshape(-1, dim))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([x.tobytes() for x in unit], pa.binary()), pa.array(Sketches.of(unit).packed(), pa.binary())], ["h1", "h2", "rep", "many", "unit", "sketch"])

    kind = dict(base.dtypes)["id"]
    classes = durable(classes.select("h1", "h2", "rep", "many", "v").mapInArrow(draw, f"h1 long, h2 int, rep {kind}, many long, unit binary, sketch binary"), "classes")
    n = classes.count()
    bits, tables = plan(n, threshold, recall)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).to_pylist()
            size = np.array([len(x) for x in rows])
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                code = Sketches.unpacked([rows[i] for i in at.tolist()]).pieces(bits, tables)
                part = batch.take(pa.array(at))
                for t in range(tables):
                    key = (np.int64(t) << 54) | (np.int64(dim - 12) << 38) | code[:, t]
                    yield pa.RecordBatch.from_arrays([pa.array(key), *part.columns], ["key", "id", "many", "sketch"])

    posted = durable(classes.select(F.col("rep").alias("id"), "many", "sketch").mapInArrow(post, f"key long, id {kind}, many long, sketch binary"), "postings")
    held = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = join_counted(posted, held, ["key"], n * tables).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = ["key", "i", "j"]
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "many", "sketch")

    def sides(g: pa.Table) -> tuple:
        block, ids, many = (g.column(k).to_numpy() for k in (3, 4, 5))
        i, j = g.column(1)[0].as_py(), g.column(2)[0].as_py()
        left, right = (np.arange(len(ids)), np.arange(len(ids))) if i == j else (np.flatnonzero(block == i), np.flatnonzero(block == j))
        return ids, many, left, right, i == j, Sketches.unpacked(g.column(6).to_pylist())

    def linked(ids: np.ndarray, many: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        links = np.bincount(x, many[y], len(ids)) + np.bincount(y, many[x], len(ids))
        has = np.flatnonzero(links)
        return ids[has], links[has].astype(np.int64), ids[local_labels(len(ids), x, y)[has]]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links that the sketches make sure of, and the members of a block that need their vectors."""
        names = ["id", "links", "other", *place, "block"]
        for g in grouped(batches, 3):
            if len(g) < 2:
                continue
            ids, many, left, right, same, s = sides(g)
            key = g.column(0)[0].as_py()
            x, y, sure = block_links(s, key >> 54, bits, left, right, same, threshold)
            if len(x):
                done, links, other = linked(ids, many, x[sure], y[sure])
                ask = np.unique(np.concatenate([x[~sure], y[~sure]]))
                a, b = len(done), len(ask)
                none = lambda m, k: pa.nulls(m, k)
                columns = [pa.array(np.concatenate([done, ids[ask]])), pa.concat_arrays([pa.array(links), none(b, pa.int64())]), pa.concat_arrays([pa.array(other), none(b, pa.array(other).type)])]
                columns += [pa.concat_arrays([none(a, v.type), v]) for v in (g.column(k).combine_chunks().take(pa.array(ask)) for k in range(4))]
                yield pa.RecordBatch.from_arrays(columns, names)

    parted = rows.repartition(*place).sortWithinPartitions(*place)
    first = durable(parted.mapInArrow(meet, f"id {kind}, links long, other {kind}, key long, i int, j int, block int"), "met")
    asked = first.where("key is not null").select(*place, "block", "id").join(classes.select(F.col("rep").alias("id"), "many", "sketch", "unit"), "id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, 3):
            ids, many, left, right, same, s = sides(g)
            unit = np.frombuffer(b"".join(g.column(7).to_pylist()), np.float64).reshape(len(ids), -1)
            x, y, sure = block_links(s, g.column(0)[0].as_py() >> 54, bits, left, right, same, threshold)
            x, y = x[~sure], y[~sure]
            ok = np.concatenate([np.einsum("ij,ij->i", unit[x[k : k + (1 << 18)]], unit[y[k : k + (1 << 18)]]) for k in range(0, len(x), 1 << 18)] or [np.zeros(0)]) >= threshold
            if ok.any():
                done, links, other = linked(ids, many, x[ok], y[ok])
                yield pa.RecordBatch.from_arrays([pa.array(done), pa.array(links), pa.array(other)], ["id", "links", "other"])

    asked = asked.select(*place, "block", "id", "many", "sketch", "unit").repartition(*place).sortWithinPartitions(*place)
    second = durable(asked.mapInArrow(verify, f"id {kind}, links long, other {kind}"), "links")
    found = first.where("links is not null").select("id", "links", "other").union(second)
    discard(posted)
    comp = components(found, "id", "other")
    count = found.groupBy("id").agg(F.sum("links").alias("links"))
    digest = ["h1", "h2"]
    of_class = classes.select(*digest, "rep", "many", F.col("many").alias("n")).join(count.withColumnRenamed("id", "rep"), "rep", "left").join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    of_class = of_class.select(*digest, "n", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked_ = join_counted(keyed.select("id", *digest), of_class, digest, n).select("id", "n_links", "component_id")
    alone = base.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked_.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
