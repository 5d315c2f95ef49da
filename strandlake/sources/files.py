"""Readers of SAM and BAM files, taxonomy dumps and statistics tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.schema import ALIGNMENT
from strandlake.sources.bam import SPLIT, BamDataSource, described
from strandlake.sources.headers import InputFile, Inputs, open_inputs
from strandlake.sources.store import as_spark_says, open_lines


def _reference_bases(cigar: Column) -> Column:
    """Aligned reference bases of a CIGAR: the lengths of M, D, N, = and X."""
    sizes = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))


def _tag(name: str) -> Column:
    value = F.regexp_extract("value", rf"\t{name}:[iIcCsS]:(-?\d+)", 1)
    return F.when(value != "", value.cast("int"))


def _packed_lines(spark: SparkSession, files: list[InputFile]) -> DataFrame:
    """(file_no, ord, value) of text whose name doesn't tell whether it is gzip; one task a file."""
    schema = pa.schema([("file_no", pa.int32()), ("ord", pa.int64()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_lines(path) as f:
                    at = 0
                    while lines := f.readlines(4 << 20):
                        value = pa.array([x.rstrip(b"\r\n").decode(errors="replace") for x in lines])
                        yield pa.RecordBatch.from_arrays([pa.array([number] * len(lines), pa.int32()), pa.array(range(at, at + len(lines)), pa.int64()), value], schema=schema)
                        at += len(lines)

    rows = spark.createDataFrame([(f.number, f.path) for f in files], "file_no int, path string").repartition(len(files), "file_no")
    return rows.mapInArrow(run, "file_no int, ord long, value string")


def _lines(inputs: Inputs, files: list[InputFile]) -> DataFrame:
    """(file, file_no, ord, value) of text files; order within a file is that of the lines."""
    spark = inputs.spark
    plain, packed = [f for f in files if f.by_spark], [f for f in files if not f.by_spark]
    parts = []
    if plain:
        text = spark.read.text([f.path for f in plain]).select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("ord"), "value")
        if len(plain) == 1:
            text = text.withColumn("file_no", F.lit(plain[0].number))
        else:
            text = text.join(F.broadcast(spark.createDataFrame([(as_spark_says(spark, f.path), f.number) for f in plain], "path string, file_no int")), "path")
        parts.append(text.select("file_no", "ord", "value"))
    if packed:
        parts.append(_packed_lines(spark, packed))
    # a header line is null before it goes, so that no filter can be put before it that reads it as a record
    record = F.when(~F.col("value").startswith("@") & (F.col("value") != ""), F.col("value"))
    return reduce(DataFrame.union, parts).join(inputs.paths(), "file_no").select("file", "file_no", "ord", record.alias("value")).where(F.col("value").isNotNull())


def read_sam(inputs: Inputs, files: list[InputFile], raw: bool = False) -> DataFrame:
    """Alignments of SAM files."""
    f = F.split("value", "\t")
    get = lambda i: F.get(f, F.lit(i))
    seq = F.when(get(9) == "*", "").otherwise(get(9))
    pos = get(3).cast("long") - 1
    cigar = _reference_bases(get(5))
    rname = F.nullif(get(2), F.lit("*"))
    out = _lines(inputs, files).select(
        "file", "file_no", "ord", get(0).alias("qname"), get(1).cast("int").alias("flag"), rname.alias("rname"), pos.alias("pos"), (pos + F.greatest(cigar, F.lit(1))).alias("end_pos"),
        F.length(seq).cast("int").alias("qlen"), seq.alias("seq"), _tag("NM").alias("nm"), _tag("AS").alias("as_score"), _tag("XT").alias("xt"), _tag("XR").alias("xr"),
        F.when(get(6) == "=", rname).otherwise(F.nullif(get(6), F.lit("*"))).alias("mate_name"), (F.encode("value", "UTF-8") if raw else F.lit(None).cast("binary")).alias("raw"),
    )
    refs = inputs.names()
    mates = refs.select("file_no", F.col("rname").alias("mate_name"), F.col("tid").alias("mate"))
    out = out.join(refs, ["file_no", "rname"], "left").join(mates, ["file_no", "mate_name"], "left")
    return out.withColumns({"tid": F.coalesce("tid", F.lit(-1)), "mate": F.coalesce("mate", F.lit(-1))})


def read_bam(inputs: Inputs, files: list[InputFile], raw: bool = False, split: int = SPLIT) -> DataFrame:
    """Alignments of BAM files, in ranges of split bytes; names and lengths of references come from the inputs' table."""
    inputs.spark.dataSource.register(BamDataSource)
    records = inputs.spark.read.format("bam").option("files", described([f.where for f in files])).option("raw", str(raw).lower()).option("split", split).load()
    return records.join(inputs.names().select("ref", "rname", "ref_len"), "ref", "left")


def read_alignments(spark: SparkSession, paths: str | list[str] | Inputs, raw: bool = False, split: int = SPLIT) -> DataFrame:
    """SAM text or BAM files, told apart by what they hold; all files of a kind are one scan. raw keeps each record's own
    bytes. Within a file tid counts its own references; ref tells references of all files apart."""
    inputs = paths if isinstance(paths, Inputs) else open_inputs(spark, paths)
    bams, rest = [f for f in inputs.files if f.is_bam], [f for f in inputs.files if not f.is_bam]
    out = ([read_sam(inputs, rest, raw)] if rest else []) + ([read_bam(inputs, bams, raw, split)] if bams else [])
    return reduce(DataFrame.union, (df.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in ALIGNMENT.split(", ")]) for df in out))


def file_list(spark: SparkSession, path: str) -> list[str]:
    """The paths in a list file, one a line, blank lines skipped; a list of inputs is short."""
    return [r["value"].strip() for r in spark.read.text(path).where(F.trim("value") != "").collect()]


def _dump(spark: SparkSession, path: str) -> DataFrame:
    fields = F.split(F.regexp_replace("value", "\t", ""), r"\|")
    return spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("ord"), fields.alias("f"))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(taxid, parent, rank); of repeated taxids the last line counts."""
    rows = _dump(spark, path).select("ord", F.get("f", F.lit(0)).cast("long").alias("taxid"), F.get("f", F.lit(1)).cast("long").alias("parent"), F.get("f", F.lit(2)).alias("rank"))
    return rows.groupBy("taxid").agg(F.max_by(F.struct("parent", "rank"), "ord").alias("x")).select("taxid", "x.parent", "x.rank")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(taxid, name): scientific names; of several the first line counts."""
    rows = _dump(spark, path).where(F.get("f", F.lit(3)) == "scientific name")
    return rows.groupBy(F.get("f", F.lit(0)).cast("long").alias("taxid")).agg(F.min_by(F.get("f", F.lit(1)), "ord").alias("name"))


def read_acc2tax(spark: SparkSession, path: str) -> DataFrame:
    """(accession, taxid, ord): second and third word of each line after a file's first; blank lines are skipped.

    A path that ends in .parquet is a table that write_accessions made: it is read as it is, for fast reloading.
    """
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path).select("accession", F.col("taxid").cast("long").alias("taxid"), F.monotonically_increasing_id().alias("ord"))
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("ord"), F.split(F.trim("value"), r"[ \t]+").alias("f"))
    heads = F.broadcast(rows.groupBy("file").agg(F.min("ord").alias("head")))  # one row a file
    rows = rows.join(heads, "file").where((F.col("ord") != F.col("head")) & (F.size("f") > 2))
    return rows.select(F.get("f", F.lit(1)).alias("accession"), F.get("f", F.lit(2)).cast("long").alias("taxid"), "ord")


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """A statistics table with a header line."""
    return spark.read.csv(path, sep="\t", header=True, inferSchema=True)


def load_taxonomy(spark: SparkSession, acc2tax: str, names: str, nodes: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(acc2tax, nodes, names); nodes and names must be as many."""
    n, m = read_nodes(spark, nodes), read_names(spark, names)
    if n.count() != m.count():
        raise ValueError("nodes and names differ in number")
    return read_acc2tax(spark, acc2tax), n, m
