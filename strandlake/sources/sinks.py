"""Writers: statistics tables, distributions, SAM and BAM records as they came, accession tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.sequence import ani
from strandlake.operators.selection import renumber
from strandlake.shared import hadoop_path
from strandlake.sources.bam import END_OF_FILE, Blocked, header_bytes, patched
from strandlake.sources.headers import InputFile, Inputs


def write_tsv(df: DataFrame, path: str, digits: int = 6) -> None:
    """Tab-separated parts with a header; doubles with digits decimals."""
    cols = [F.format_string(f"%.{digits}f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_distributions(lengths: DataFrame, anis: DataFrame, inputs: Inputs, base: str) -> None:
    """Two tables a file, as base.NAME.rlen.dists.txt and base.NAME.ani.dists.txt, or without NAME for one input. The
    counts of all files (256 lengths and at most 1,001 identities each) are made in one job and kept while they are written."""
    lengths, anis = lengths.persist(), anis.persist()
    for f in inputs.files:
        own = base if len(inputs.files) == 1 else f"{base}.{f.path.rsplit('/', 1)[-1]}.{f.number}"
        write_tsv(lengths.where(F.col("file_no") == f.number).drop("file_no").orderBy("length").coalesce(1), f"{own}.rlen.dists.txt")
        write_tsv(anis.where(F.col("file_no") == f.number).drop("file_no").orderBy("ani").coalesce(1), f"{own}.ani.dists.txt", 1)
    lengths.unpersist()
    anis.unpersist()


def with_ani(df: DataFrame) -> DataFrame:
    """Adds an, the identity as a float; write_sam and write_bam make it the tag AN."""
    return df.withColumn("an", ani(F.col("nm"), F.col("qlen")).cast("float"))


def kept_header(df: DataFrame, inputs: Inputs, file: InputFile, more: list[str]) -> list[str]:
    """The header's lines without the references that df, records of the file, has lost. A header is one dictionary of the
    references, so it is made on the driver; more: lines put before the program's own."""
    used = df.where("tid >= 0").select("tid").distinct()
    sq = [r["line"] for r in inputs.reference_lines(file).join(used, "tid", "left_semi").orderBy("tid").collect()]
    rest = {k: [x for x in file.lines if x.startswith(k)] for k in ("@HD", "@RG", "@PG", "@CO")}
    before = {f for x in rest["@PG"] for f in x.split("\t") if f.startswith("PP:")}
    last = [f[3:] for x in rest["@PG"] for f in x.split("\t") if f.startswith("ID:") and f"PP:{f[3:]}" not in before]
    program = "@PG\tID:strandlake\tPN:strandlake" + (f"\tPP:{last[-1]}" if last else "")
    return [*rest["@HD"], *sq, *rest["@RG"], *rest["@PG"], program, *rest["@CO"], *more]


def _tags(df: DataFrame, tags: list[str]) -> dict[str, Column]:
    return {t: F.col(t).cast("float" if t == "an" else "int") for t in tags}


def sam_lines(df: DataFrame, tags: list[str]) -> DataFrame:
    """The records' own lines, in order; the columns in tags (xt, xr, an) take the place of those tags."""
    line = F.decode("raw", "UTF-8")
    for t, c in _tags(df, tags).items():
        name = t.upper()
        value = F.concat(F.lit(f"\t{name}:{'f' if t == 'an' else 'i'}:"), c.cast("string"))
        line = F.when(c.isNull(), line).otherwise(F.concat(F.regexp_replace(line, f"\t{name}:[^\t]*", ""), value))
    return df.orderBy("ord").select(line.alias("value"))


def write_sam(df: DataFrame, path: str, header: list[str], tags: list[str] | None = None) -> None:
    """path/header and path/records as text, of one file's records; records stay distributed and are the input's lines."""
    df.sparkSession.createDataFrame([(x,) for x in header], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    sam_lines(df, tags or []).write.mode("overwrite").text(f"{path}/records")


def renumbered_records(df: DataFrame, tags: list[str]) -> DataFrame:
    """(raw, new_tid, new_mate, tags) in order, with dense reference numbers; a mate's reference that is gone becomes none."""
    dense = renumber(df.where("tid >= 0"))
    rows = df.join(dense, "tid", "left").join(dense.select(F.col("tid").alias("mate"), F.col("new_tid").alias("new_mate")), "mate", "left").orderBy("ord")
    none = F.lit(-1).cast("long")
    return rows.select("raw", F.coalesce("new_tid", none).cast("int").alias("new_tid"), F.coalesce("new_mate", none).cast("int").alias("new_mate"), *[c.alias(t) for t, c in _tags(df, tags).items()])


def _with_sizes(batch: pa.RecordBatch) -> bytes:
    """The records with their sizes before them and new reference numbers, all of a batch at once."""
    raw = batch.column(0).cast(pa.large_binary())
    offs = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    size = np.diff(offs)
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    start = offs[:-1] - offs[0] + 4 * np.arange(len(raw))
    out = np.empty(len(data) + 4 * len(raw), np.uint8)
    kept = np.ones(len(out), bool)
    number = lambda at, x: out.__setitem__(at[:, None] + np.arange(4), x.astype("<i4").view(np.uint8).reshape(-1, 4))
    kept[start[:, None] + np.arange(4)] = False
    out[kept] = data
    number(start, size)
    number(start + 4, batch.column(1).to_numpy())
    number(start + 24, batch.column(2).to_numpy())
    return out.tobytes()


def _tagged(batch: pa.RecordBatch) -> bytes:
    extra = [(name, code) for name, code in (("xt", "i"), ("xr", "i"), ("an", "f")) if name in batch.schema.names]
    out = []
    for row in batch.to_pylist():
        tags = {n.upper().encode(): n.upper().encode() + c.encode() + struct.pack("<" + c, row[n]) for n, c in extra if row[n] is not None}
        raw = patched(row["raw"], row["new_tid"], row["new_mate"], tags)
        out.append(struct.pack("<i", len(raw)) + raw)
    return b"".join(out)


def write_bam(df: DataFrame, path: str, header: list[str], tags: list[str] | None = None, whole: bool = False) -> None:
    """BAM files of the records' own bytes of one input file, in order: path is a folder of files, each a BAM by itself.

    The columns in tags (xt, xr, an) take the place of those tags. Tasks pack the blocks; Spark's text writer puts them
    into the folder, in any store and with its own commit, so a lost task leaves nothing: a row is a run of blocks, and
    what ends a line is the empty block that also ends a file. whole: without headers but in the first part, and the
    parts joined to one file (see join_parts).
    """
    part = lambda x, k: next(f[3:] for f in x.split("\t") if f.startswith(k))
    references = [(part(x, "SN:"), int(part(x, "LN:"))) for x in header if x.startswith("@SQ")]
    head = df.sparkSession.sparkContext.broadcast(header_bytes("\n".join(header) + "\n", references))
    plain = not tags

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, out = TaskContext.get().partitionId() == 0, Blocked()
        if first or not whole:
            out.write(head.value)
            out.flush()
        for batch in batches:
            out.write(_with_sizes(batch) if plain else _tagged(batch))
            if out.size >= 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array([out.taken()], pa.binary())], ["value"])
        out.flush()
        if out.size:
            yield pa.RecordBatch.from_arrays([pa.array([out.taken()], pa.binary())], ["value"])

    rows = renumbered_records(df, tags or [])
    packed = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    folder = f"{path.rstrip('/')}.parts"
    packed.write.mode("overwrite").option("encoding", "ISO-8859-1").option("lineSep", END_OF_FILE.decode("latin-1")).text(folder)
    head.unpersist()
    put_in_place(df.sparkSession, folder, path, whole)


def put_in_place(spark: SparkSession, folder: str, path: str, whole: bool) -> None:
    """Renames the parts to BAM files and the folder to path; or joins them to one file, in order. A store that can
    concatenate by itself does; in any other the bytes are copied one part after another, a small piece at a time."""
    jvm = spark.sparkContext._jvm
    fs, at = hadoop_path(spark, folder)
    parts = sorted((x.getPath() for x in fs.listStatus(at) if x.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    to = jvm.org.apache.hadoop.fs.Path(path)
    if not whole:
        for k, p in enumerate(parts):
            fs.rename(p, jvm.org.apache.hadoop.fs.Path(f"{folder}/part-{k:05d}.bam"))
        fs.delete(to, True)
        if not fs.rename(at, to):
            raise OSError(f"{path} can't be put in place")
        return
    if parts:
        try:
            array = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(parts) - 1)
            for k, p in enumerate(parts[1:]):
                array[k] = p
            if len(parts) > 1:
                fs.concat(parts[0], array)
            made = parts[0]
        except UnsupportedOperationException:
            made = jvm.org.apache.hadoop.fs.Path(f"{folder}/_whole")
            out = fs.create(made, True)
            for p in parts:
                f = fs.open(p)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(f, out, 1 << 20, False)
                f.close()
            out.close()
        fs.delete(to, True)
        if not fs.rename(made, to):
            raise OSError(f"{path} can't be put in place")
    fs.delete(at, True)


def write_accessions(df: DataFrame, path: str) -> None:
    """The accession table: Parquet where path ends in .parquet, else text with a header line; either can be read again."""
    if path.rstrip("/").endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    else:
        write_tsv(df, path)
