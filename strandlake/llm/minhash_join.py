"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

1. Each text becomes its set of word shingles, and a signature of COORDS coordinates (least value of each of COORDS
   hash functions over the set). Texts with equal sets are one class from here on.
2. Classes are posted under each (coordinate, value). Two sets at the threshold agree in a number of coordinates,
   matches, or more but for a chance of MISSED, so (prefix principle) they meet among the COORDS - matches + 1 rarest
   postings of each: postings are ordered by how many classes they hold, and only that prefix is kept. Frequent values,
   and with them long lists, drop out; a class whose prefix holds no shared posting is skipped altogether.
3. Lists with the same classes count once. Classes whose longest list is a large one meet there first, in blocks that
   share a few representatives of the list: that connects large groups without comparing block with block.
4. Then all lists whose classes are not all connected are merged: within a task, block against block, collisions of the
   whole signatures are counted (one byte a coordinate). Links that span the pairs with that many collisions
   join the classes to families, and each class goes once, with its full set (64 bits a shingle), to its family, where
   the pairs are confirmed. A task returns links that span what it found, never all pairs: a group of copies gives as
   many rows as it has members. Full sets are made only of the texts that go to a family, in the task that sends them.

A link is 100 * intersection >= threshold * union of the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.bytesets import U, mix, shingle_sets, splitmix, texts
from strandlake.llm.components import components
from strandlake.llm.spark_io import discard, durable, join_counted

WIDTH = 5
THRESHOLD = 80
COORDS = 48
#: The chance that two sets at the threshold agree in fewer coordinates than are asked for.
MISSED = 1.5e-5
REPRESENTATIVES = 8
BLOCK = 1024
PLACE = ["key", "i", "j", "block"]
_A = splitmix(COORDS, 101) | U(1)
_B = splitmix(COORDS, 202)


def least_matches(threshold: int) -> int:
    """Coordinates in which two sets at the threshold agree but for a chance of MISSED: 26 at 80."""
    p, below, m = threshold / 100, 0.0, 0
    while m < COORDS and (below := below + comb(COORDS, m) * p**m * (1 - p) ** (COORDS - m)) <= MISSED:
        m += 1
    return max(1, m)


def signatures(sets: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, COORDS) 32-bit minima; every text here has a shingle."""
    out = np.empty((len(offs) - 1, COORDS), np.uint32)
    step = max(1, (1 << 16) // max(1, len(sets) // max(1, len(offs) - 1)))
    for i in range(0, len(offs) - 1, step):
        j = min(i + step, len(offs) - 1)
        part, at = sets[offs[i] : offs[j]], offs[i:j] - offs[i]
        for c in range(COORDS):
            out[i:j, c] = np.minimum.reduceat((((part ^ _B[c]) * _A[c]) >> U(32)).astype(np.uint32), at)
    return out


def sketch(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n_shingles, d1, d2, sig): the set's size, a 128-bit digest of the set, and the signature as bytes."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch.column(1)):
                sets, offs = shingle_sets(t, width)
                n = np.diff(offs)
                full = np.flatnonzero(n)
                d1, d2 = np.zeros(t.n, U), np.zeros(t.n, U)
                sig: list = [None] * t.n
                if len(full):
                    at = offs[full]
                    d1[full] = np.add.reduceat(mix(sets ^ U(0x5851F42D4C957F2D)), at)
                    d2[full] = np.add.reduceat(mix(sets + U(0x14057B7EF767814F)), at)
                    packed = signatures(sets, np.append(at, len(sets)))
                    for i, row in zip(full.tolist(), packed, strict=True):
                        sig[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[t.first : t.first + t.n], pa.array(n, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(sig, pa.binary())],
                    ["id", "n_shingles", "d1", "d2", "sig"],
                )

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"id {kind}, n_shingles long, d1 long, d2 long, sig binary")


def with_sets(rows: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """rows (key, i, j, block, id, component) with short, a byte of each coordinate, and shingles, the text's whole set
    as sorted 64-bit numbers. docs is (id, text); each text is read once, however many rows it has."""
    mine = rows.groupBy("id").agg(F.collect_list(F.struct("key", "i", "j", "block", "component")).alias("to"))  # at most a row for each block of a list

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch.column(1)):
                sets, offs = shingle_sets(t, width)
                short = signatures(sets, offs).astype(np.uint8)
                to = batch.column(2)[t.first : t.first + t.n]
                of = pa.array(np.repeat(np.arange(t.n), np.diff(to.offsets.to_numpy())))
                raw = pa.array([sets[a:b].tobytes() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], pa.large_binary())
                small = pa.array([x.tobytes() for x in short], pa.binary())
                where, ids = to.flatten(), batch.column(0)[t.first : t.first + t.n].take(of)
                for k in range(0, len(of), 512):  # sets may be long
                    part = slice(k, k + 512)
                    fields = [where.field(x)[part] for x in range(4)]
                    yield pa.RecordBatch.from_arrays([*fields, ids[part], where.field(4)[part], small.take(of[part]), raw.take(of[part]).cast(pa.binary())], [*PLACE, "id", "component", "short", "shingles"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*PLACE, "id", "component"]) + ", short binary, shingles binary"
    return docs.join(mine, "id").select("id", "text", "to").mapInArrow(run, schema)


def postings(classes: DataFrame, matches: int) -> DataFrame:
    """(key, id, n_shingles, sig, held): each class under the rarest of its postings that others share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, COORDS)
            key = mix(sig.astype(U) + (np.arange(COORDS, dtype=U) << U(40)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), COORDS)), pa.array(key.view(np.int64).ravel())], ["id", "key"])

    every = classes.select("id", "sig").mapInArrow(run, "id long, key long")
    held = every.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    shared = every.join(held, "key")
    # a class's postings are COORDS at most
    mine = shared.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("held", "key"))).alias("p"))
    prefix = F.size("p") - (matches - 1)  # COORDS - matches + 1 places, less the COORDS - size(p) taken by unshared values
    return mine.where(prefix > 0).select("id", F.explode(F.slice("p", 1, prefix)).alias("p")).select("id", "p.key", "p.held")


def span_block(ids: np.ndarray, component: np.ndarray, sig: np.ndarray, sets: list[bytes], left: np.ndarray, right: np.ndarray, threshold: int, matches: int) -> list[tuple[int, int]]:
    """Links that span what the pairs left x right of a block connect."""
    n = np.array([len(x) // 8 for x in sets])
    offs = np.concatenate([[0], np.cumsum(n)])
    values, dense = np.unique(np.frombuffer(b"".join(sets), U), return_inverse=True)
    flag = np.zeros(len(values), bool)
    label, found = component.copy(), []
    right = right[np.argsort(n[right], kind="stable")]
    sizes = n[right]
    for x in left.tolist():
        lo = np.searchsorted(sizes, -(-threshold * n[x] // 100))
        hi = np.searchsorted(sizes, n[x] * 100 // threshold, "right")
        y = right[lo:hi]
        y = y[label[y] != label[x]]
        if len(y):
            y = y[(sig[y] == sig[x]).sum(axis=1) >= matches]
        if not len(y):
            continue
        flag[dense[offs[x] : offs[x + 1]]] = True
        for one in y.tolist():
            if label[one] == label[x]:
                continue
            both = int(np.count_nonzero(flag[dense[offs[one] : offs[one + 1]]]))
            if 100 * both >= threshold * (n[x] + n[one] - both):
                found.append((int(ids[x]), int(ids[one])))
                label[label == label[one]] = label[x]
        flag[dense[offs[x] : offs[x + 1]]] = False
    return found


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Sorted batches as one frame for each run of equal (key, i, j)."""
    held: list[pd.DataFrame] = []
    mark = None
    for batch in batches:
        part = batch.to_pandas()
        at = part[["key", "i", "j"]].to_numpy()
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(part)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(at[a].tolist())
            if held and now != mark:
                yield pd.concat(held, ignore_index=True)
                held = []
            mark = now
            held.append(part.iloc[a:b])
    if held:
        yield pd.concat(held, ignore_index=True)


def colliding(rows: DataFrame, matches: int) -> DataFrame:
    """(a, b) from rows (key, i, j, block, id, short): links that span the pairs with that many collisions or more.

    short has a byte of each coordinate. A block gives fewer links than it has rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in runs(batches):
            block, ids = g["block"].to_numpy(), g["id"].to_numpy()
            sig = np.frombuffer(b"".join(g["short"]), np.uint8).reshape(-1, COORDS)
            label, found = np.arange(len(g)), []
            right = np.flatnonzero(block == g["j"].iloc[0])
            for x in np.flatnonzero(block == g["i"].iloc[0]).tolist():
                y = right[label[right] != label[x]]
                y = y[(sig[y] == sig[x]).sum(axis=1) >= matches]
                old, one = np.unique(label[y], return_index=True)
                if len(old):
                    found.append((np.full(len(one), ids[x]), ids[y[one]]))
                    label[np.isin(label, old)] = label[x]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["a", "b"])

    parted = rows.select("key", "i", "j", "block", "id", "short").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return parted.mapInArrow(run, "a long, b long").distinct()


def spanning_links(rows: DataFrame, threshold: int) -> DataFrame:
    """(a, b) from rows (key, i, j, block, id, component, short, shingles); block i of a list meets block j."""

    def meet(g: pd.DataFrame) -> pa.RecordBatch:
        g = g.drop_duplicates("id")
        i, j = int(g["i"].iloc[0]), int(g["j"].iloc[0])
        block = g["block"].to_numpy()
        # block -1: the list's representatives, which every block meets
        left, right = (np.arange(len(g)), np.arange(len(g))) if i == j else (np.flatnonzero(block == i), np.flatnonzero(block == j))
        sig = np.frombuffer(b"".join(g["short"]), np.uint8).reshape(-1, COORDS)
        got = span_block(g["id"].to_numpy(), g["component"].to_numpy(), sig, g["shingles"].tolist(), left, right, threshold, least_matches(threshold))
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(meet, runs(batches))

    parted = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return parted.mapInArrow(run, "a long, b long").distinct()


def short_signatures(classes: DataFrame) -> DataFrame:
    """(id, short): the lowest byte of each coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, COORDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary())], ["id", "short"])

    return classes.select("id", "sig").mapInArrow(run, "id long, short binary")


def near_links(posted: DataFrame, classes: DataFrame, docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """(a, b): links that span the components of classes; docs is (id, text)."""
    lists = posted.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("f")).where("n > 1")
    lists = lists.groupBy("n", "f").agg(F.min("key").alias("key")).select("key", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    member = durable(posted.select("id", "key").join(lists, "key"), "lists")
    block = F.pmod(F.xxhash64("id", F.lit(9)), F.col("blocks")).cast("int")

    longest = member.where(F.col("blocks") > 1).groupBy("id").agg(F.max(F.struct("n", "key", "blocks")).alias("x")).select("id", "x.key", "x.blocks")
    first = None
    comp = classes.sparkSession.createDataFrame([], "node long, component long")
    if not longest.isEmpty():
        reps = longest.groupBy("key").agg(*[F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), F.col("id").alias("r"))).alias(f"r{k}") for k in range(REPRESENTATIVES)], F.first("blocks").alias("blocks"))
        reps = reps.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.array_distinct(F.array(*[F.col(f"r{k}.r") for k in range(REPRESENTATIVES)])).alias("r")).select(F.explode("r").alias("id"), "key", "i")
        rows = longest.select("id", "key", block.alias("i"), block.alias("block")).union(reps.select("id", "key", "i", F.lit(-1).alias("block")))
        rows = rows.select("key", "i", F.col("i").alias("j"), "block", "id", F.col("id").alias("component"))
        first = durable(spanning_links(with_sets(rows, docs, width), threshold), "links")
        comp = durable(components(first, "a", "b"), "components")
    placed = member.join(comp.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    torn = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    rows = placed.join(torn, "key", "left_semi").select("key", "id", "blocks", block.alias("block"))
    met = durable(colliding(_against_blocks(rows).join(short_signatures(classes), "id"), least_matches(threshold)), "met")
    family = durable(components(met, "a", "b"), "families").select(F.col("node").alias("id"), F.col("component").alias("key"))
    size = family.groupBy("key").agg(F.count("*").alias("n")).select("key", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = _against_blocks(join_counted(family, size, ["key"], family.count()).select("key", "id", "blocks", block.alias("block")))
    rows = rows.join(comp.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    second = durable(spanning_links(with_sets(rows.select("key", "i", "j", "block", "id", "component"), docs, width), threshold), "links")
    discard(member, met)
    return second if first is None else first.union(second)


def _against_blocks(rows: DataFrame) -> DataFrame:
    """(key, i, j, block, id) from (key, id, blocks, block): every block of a group against every other and itself."""
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: id, n_shingles, component_id (least id reachable by links), kept (id = component_id).

    Ids are distinct integers. Texts without words have n_shingles 0 and stand alone; a repeated id with the same text
    gives a repeated row; a document without id is linked with nothing and kept, its component_id null. Extra columns are
    ignored, an empty table gives an empty result; texts of any length are compared by their whole sets.
    """
    base = durable(sketch(docs, id_col, text_col, width), "sketch")
    worded = base.where("n_shingles > 0 and id is not null")
    digest = ["d1", "d2", "n_shingles"]
    # equal sets: one class, whose representative is the least id
    classes = durable(worded.groupBy(*digest).agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.min_by("sig", "id").alias("sig")), "classes")
    single = classes.select(F.col("rep").alias("id"), "n_shingles", "sig")
    posted = durable(postings(single.where(100 * F.col("n_shingles") >= threshold * (F.col("n_shingles") + 1)), least_matches(threshold)), "postings")  # a smaller set is linked to equal ones only
    found = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where("id is not null")
    found = found.join(posted.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    comp = durable(components(near_links(posted, single, found, width, threshold), "a", "b"), "components")
    of_class = classes.select(*digest, "rep", "n").join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select(*digest, "n", F.coalesce("component", "rep").alias("component"))
    placed = join_counted(worded.select("id", *digest), of_class, digest, worded.count()).select("id", "n_shingles", "component")
    out = placed.unionByName(base.where("n_shingles = 0 or id is null").select("id", "n_shingles", F.col("id").alias("component")))
    discard(posted)
    return out.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
