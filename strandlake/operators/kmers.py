"""First records of reads, and the distinct k-mers of groups of them.

Alignments cross the shuffle once, as packed batches. All records of a group go to one lot, where its reads are told apart
and its k-mers counted at once, so that sequences are moved and k-mers are not. Large groups are dealt to all lots by read;
their sequences are kept in the table, those that begin another sequence of the group are dropped (their k-mers are all in
it), and the k-mers of the rest are dealt by sequence.kmer_counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from strandlake.functions.sequence import HELD, _distinct, kmer_codes, kmer_counts
from strandlake.shared import durable

#: Rows of a lot, and rows that a task packs at a time.
ROWS = 250_000
#: K-mers that are sorted at a time.
SORTED = 400_000
#: Bases that decide where a sequence is compared with others.
HEAD = 32
_CODEC = "zstd"


def per_read(k: int, longest: int, most: int, seq: str = "seq") -> Column:
    """K-mers of a sequence."""
    return F.least(F.greatest(F.least(F.length(seq), F.lit(longest)) - k + 1, F.lit(0)), F.lit(most)).cast("long")


def sizes(kmers: Column) -> list[Column]:
    """Aggregates that read_table takes of each group: k-mers and rows, repeated reads included."""
    return [F.coalesce(F.sum(kmers), F.lit(0)).alias("kmers"), F.count("*").alias("rows")]


def _packed(batch: pa.RecordBatch) -> bytes:
    raw = batch.serialize()
    return raw.size.to_bytes(8, "little") + pa.compress(raw, _CODEC, asbytes=True)


def _unpacked(raw: memoryview | bytes, schema: pa.Schema) -> pa.RecordBatch:
    return pa.ipc.read_record_batch(pa.py_buffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), _CODEC, asbytes=True)), schema)


def _through_lots(df: DataFrame, lots: int, once: Callable[[pa.Table], pa.Table], end: Callable[[pa.Table], Iterator[pa.RecordBatch]], out: str) -> DataFrame:
    """Deals rows by their first column, lot, and runs end over the rows of each lot; once thins them out before."""
    schema = to_arrow_schema(df.schema)
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            rows = once(pa.Table.from_batches(held).combine_chunks())
            lot = rows.column(0).to_numpy()
            order = np.argsort(lot, kind="stable")
            rows, lot = rows.take(pa.array(order)).combine_chunks(), lot[order]
            cut = np.flatnonzero(np.append(True, lot[1:] != lot[:-1])[: len(lot)]).tolist()
            some = [(int(lot[a]), _packed(pa.RecordBatch.from_struct_array(rows.slice(a, b - a).to_struct_array().combine_chunks()))) for a, b in zip(cut, [*cut[1:], len(lot)], strict=True)]
            for at in range(0, len(some), 500):
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some[at : at + 500]], pa.int64()), pa.array([x[1] for x in some[at : at + 500]], pa.binary())], ["lot", "packed"])

        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= ROWS:
                yield from sent()
                held, size = [], 0
        if size:
            yield from sent()

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for lot, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and lot != now:
                    yield from end(once(pa.Table.from_batches(held).combine_chunks()))
                    held = []
                now = lot
                held.append(_unpacked(raw.as_buffer().to_pybytes(), schema))
        if held:
            yield from end(once(pa.Table.from_batches(held).combine_chunks()))

    dealt = df.mapInArrow(send, "lot long, packed binary").repartition(min(shuffle, lots), "lot").sortWithinPartitions("lot")
    return dealt.mapInArrow(ended, out)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers that are the same for the same values; -1 for null."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy().astype(np.int64)
    one = column.combine_chunks().dictionary_encode()
    one = one.combine_chunks() if isinstance(one, pa.ChunkedArray) else one
    return one.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _place(column: pa.ChunkedArray) -> np.ndarray:
    """The place of each value in order; equal values in any."""
    one = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    fields = one.flatten() if pa.types.is_struct(one.type) else [one]
    table = pa.table(list(fields), names=[str(i) for i in range(len(fields))])
    order = pc.sort_indices(table, sort_keys=[(str(i), "ascending") for i in range(len(fields))], null_placement="at_start").to_numpy()
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def _first(rows: pa.Table, keys: list[str]) -> pa.Table:
    """The first record, by ord, of each read of a group; sorted by group, reads with the same name together."""
    columns = [_codes(rows.column(c)) for c in (*keys, "qname")]
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    if not new.all():
        read = np.cumsum(new) - 1
        many = np.bincount(read) > 1
        again = many[read]  # only records of repeated reads are compared
        place = np.zeros(len(order), np.int64)
        place[again] = _place(rows.column("ord").take(pa.array(order[again])))
        least = np.lexsort((place, read))
        order = order[least][np.append(True, read[least][1:] != read[least][:-1])]
    return rows.take(pa.array(order))


def group_counts(group: np.ndarray, seq: pa.Array, k: int, longest: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct and all k-mers of groups 0, 1, ...; rows are sorted by group, and no group is parted."""
    groups = int(group[-1]) + 1 if len(group) else 0
    distinct, total = np.zeros(groups, np.int64), np.zeros(groups, np.int64)
    size = np.minimum(np.maximum(np.minimum(pc.fill_null(pc.binary_length(seq), 0).to_numpy(zero_copy_only=False).astype(np.int64), longest) - k + 1, 0), most)
    begins = np.searchsorted(group, np.arange(groups + 1))
    upto = np.concatenate([[0], np.cumsum(size)])[begins]
    a = 0
    while a < groups:
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + SORTED, "right")) - 1)
        rows = slice(begins[a], begins[b])
        held_group, held_code = [], []
        for at in range(rows.start, rows.stop, 512):  # few enough for their codes to stay in the processor's cache
            row, code = kmer_codes(seq.slice(at, min(512, rows.stop - at)), k, longest, most)
            held_group.append(group[at + row] - a)
            held_code.append(code)
        if held_code:
            of = np.concatenate(held_group)
            total[a:b] = np.bincount(of, minlength=b - a)
            distinct[a:b] = np.bincount(_distinct(of, np.concatenate(held_code), k)[0], minlength=b - a)
        a = b
    return distinct, total


def read_table(df: DataFrame, keys: list[str], k: int, longest: int, most: int, sized: DataFrame) -> DataFrame:
    """(keys, qname, qlen, distinct, total, seq): the first record, by ord, of each read in a group of integer keys, written.

    A row of each group has the numbers of its k-mers in distinct and total. Of a large group (by sized: keys and what
    sizes() says) total is found in several rows, to be summed, and seq is there, for counts() to find the distinct ones.
    """
    spark = df.sparkSession
    large = sized.where((F.col("kmers") > HELD) | (F.col("rows") > ROWS)).select(*keys, F.lit(True).alias("large"))
    found = sized.agg(F.sum("rows").alias("rows"), F.sum(((F.col("kmers") > HELD) | (F.col("rows") > ROWS)).cast("long")).alias("large")).first()
    lots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (found["rows"] or 0) // ROWS + 1)
    if found["large"]:
        df = df.join(F.broadcast(large) if found["large"] <= 100_000 else large, keys, "left").withColumn("large", F.coalesce("large", F.lit(False)))
    else:
        df = df.withColumn("large", F.lit(False))
    lot = F.pmod(F.when(F.col("large"), F.xxhash64("qname")).otherwise(F.xxhash64(*keys)), F.lit(lots))
    kinds = dict(df.dtypes)
    dealt = df.select(lot.alias("lot"), *keys, "qname", "ord", "qlen", "large", "seq")

    def end(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        large = rows.column("large").to_numpy()
        columns = [_codes(rows.column(c)) for c in keys]
        new = np.zeros(len(rows), bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        group = np.cumsum(new) - 1
        seq = rows.column("seq").combine_chunks()
        seq = seq.chunk(0) if isinstance(seq, pa.ChunkedArray) else seq
        size = np.minimum(np.maximum(np.minimum(pc.fill_null(pc.utf8_length(seq), 0).to_numpy(zero_copy_only=False).astype(np.int64), longest) - k + 1, 0), most)
        total = np.bincount(group, size, len(new)).astype(np.int64)[group]
        whole = np.flatnonzero(~large)
        distinct = np.zeros(len(new), np.int64)
        if len(whole):
            own, number = np.unique(group[whole], return_inverse=True)
            counted, every = group_counts(number, seq.take(pa.array(whole)), k, longest, most)
            at = np.flatnonzero(new)[own]
            distinct[at], total[at] = counted, every
        by = np.lexsort((_codes(rows.column("qname")), large)) if large.any() else np.arange(len(new))  # a read's sequence once more costs little beside itself
        out = [*(rows.column(c) for c in keys), rows.column("qname"), rows.column("qlen"), pa.array(distinct, mask=~new | large), pa.array(total, mask=~new), pc.if_else(pa.array(large), seq, pa.scalar(None, seq.type))]
        table = pa.table(out, names=[*keys, "qname", "qlen", "distinct", "total", "seq"]).take(pa.array(by))
        yield from table.combine_chunks().to_batches(max_chunksize=20_000)

    said = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), f"qname {kinds['qname']}", f"qlen {kinds['qlen']}", "distinct long", "total long", "seq string"])
    out = durable(_through_lots(dealt, lots, lambda rows: _first(rows, keys), end, said), "reads", packed=True)
    out.large = bool(found["large"])
    return out


def _maximal(rows: pa.Table, keys: list[str]) -> pa.Table:
    """Without the sequences that begin another sequence of their group, or equal it."""
    coded = rows.column("seq").combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    texts, last, open_ = coded.dictionary.take(pa.array(order)).to_pylist(), np.arange(len(order)), []
    for i, text in enumerate(texts):  # last: the place of the last sequence that begins with this one
        while open_ and not text.startswith(texts[open_[-1]]):
            last[open_.pop()] = i - 1
        open_.append(i)
    for i in open_:
        last[i] = len(texts) - 1
    own = rank[coded.indices.to_numpy()]
    columns = [_codes(rows.column(c)) for c in keys]
    by = np.lexsort((own, *columns[::-1]))
    same = np.ones(max(len(by) - 1, 0), bool)
    for c in columns:
        same &= c[by][1:] == c[by][:-1]
    # the sequences that begin with one stand right behind it
    drop = np.append(same & (own[by][1:] <= last[own[by]][:-1]), False)[: len(by)]
    return rows.take(pa.array(by[~drop]))


def maximal(df: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """(keys, seq): the first longest bases of sequences, without most that begin another of their group. Which k-mers a
    group has stays the same. Sequences meet by their first HEAD bases, and very common beginnings only whole."""
    cut = df.select(*keys, F.substring("seq", 1, longest).alias("seq")).withColumn("head", F.xxhash64(F.substring("seq", 1, HEAD)))
    spark = df.sparkSession
    common = durable(cut.groupBy("head").agg(F.count("*").alias("n")).where(F.col("n") > ROWS).select("head", F.lit(True).alias("common")), "heads")
    if many := common.count():
        cut = cut.join(F.broadcast(common) if many <= 100_000 else common, "head", "left").withColumn("head", F.when(F.col("common"), F.xxhash64("seq")).otherwise(F.col("head")))
    lots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), cut.count() // ROWS + 1)
    kinds = dict(df.dtypes)
    dealt = cut.select(F.pmod("head", F.lit(lots)).alias("lot"), *keys, "seq")
    end = lambda rows: rows.select([*keys, "seq"]).combine_chunks().to_batches(max_chunksize=20_000)
    return _through_lots(dealt, lots, lambda rows: _maximal(rows, keys), end, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "seq string"]))


def counts(table: DataFrame, keys: list[str], k: int, longest: int, most: int) -> DataFrame:
    """(keys, distinct_kmers, total_kmers) from read_table; groups without a k-mer are absent."""
    sums = table.where("total is not null").groupBy(*keys).agg(F.sum("distinct").alias("distinct_kmers"), F.sum("total").alias("total_kmers"))
    if table.large:
        few = durable(maximal(table.where("seq is not null"), keys, min(longest, most + k - 1)), "sequences", packed=True)
        dealt = kmer_counts(few, keys, k, longest, most).select(*keys, F.col("distinct_kmers").alias("dealt"))
        sums = sums.join(dealt, keys, "left").withColumn("distinct_kmers", F.coalesce("distinct_kmers", "dealt")).drop("dealt")
    return sums.where("total_kmers > 0")
