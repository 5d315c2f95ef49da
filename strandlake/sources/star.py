"""The order tables seen as alignments: order lines are alignments of reads (orders) to references (parts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The longest read of the view: a read is the first qlen bases of its document's whole text.
LONGEST = 300
#: References and reads' sequences that are broadcast (about 40 and 300 bytes each); more are joined by shuffles.
FEW_REFERENCES, FEW_SEQUENCES = 2_000_000, 50_000
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz.", "acgtacgtacgtacgtacgtacgtacn"
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _few(df: DataFrame, n: int, most: int) -> DataFrame:
    return F.broadcast(df) if n <= most else df


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("tid"), F.concat(F.lit("ACC"), F.col("p_partkey").cast("string")).alias("rname"), (F.lit(40).cast("long") * F.col("p_size")).alias("ref_len"))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord is a tuple that orders the records of a read; no numbering over all rows is needed."""
    docs = _table(spark, sf_dir, "documents")
    plain = F.regexp_replace(F.lower("text"), "[^a-z.]", "")
    dna = docs.select("doc_id", F.upper(F.translate(F.substring(plain, 1, LONGEST), LETTERS, BASES)).alias("dna"))
    ref_len = F.lit(40).cast("long") * F.col("p_size")
    nm = F.round(F.col("l_discount") * 100).cast("long")
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_size")
    line = _table(spark, sf_dir, "lineitem").join(_few(part, part.count(), FEW_REFERENCES), F.col("l_partkey") == F.col("p_partkey"))
    base = line.select(
        F.struct(*ORDER).alias("ord"), F.col("l_orderkey").alias("qname"), F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 53 == 0, 4).otherwise(0).alias("flag"), F.col("l_partkey").alias("tid"), ref_len.alias("ref_len"),
        ((F.col("l_orderkey") * 7919 + F.col("l_suppkey") * 613 + F.col("l_linenumber") * 31) % ref_len).alias("pos"), (30 + (F.col("l_orderkey") * 13) % 271).alias("qlen"), nm.alias("nm"),
        F.when(F.col("l_linenumber") == 7, None).otherwise(F.round(F.col("l_tax") * 100).cast("long") - nm).alias("as_score"),
    )
    many = docs.count()
    placed = base.withColumn("doc_id", F.col("qname") % many).join(_few(dna, many, FEW_SEQUENCES), "doc_id")
    return placed.select("ord", "qname", "flag", "tid", "ref_len", "pos", (F.col("pos") + F.least(F.col("qlen"), F.col("ref_len") - F.col("pos"))).alias("end_pos"), "qlen", "nm", "as_score", F.substr("dna", F.lit(1), F.col("qlen").cast("int")).alias("seq"))


def two_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(alignments, references) as of two files: odd reads are in the second, which numbers its references backwards."""
    many = reference(spark, sf_dir).agg(F.count("*").alias("many"))
    turned = lambda no, tid: F.when(no == 0, tid).otherwise(F.col("many") - tid)
    ref = F.shiftleft(F.col("file_no").cast("long"), 32) + F.col("tid")
    alns = alignments(spark, sf_dir).withColumn("file_no", (F.col("qname") % 2).cast("int")).join(many)
    alns = alns.withColumn("tid", turned(F.col("file_no"), F.col("tid"))).drop("many").withColumn("ref", ref)
    refs = reference(spark, sf_dir).join(many).withColumn("file_no", F.explode(F.array(F.lit(0), F.lit(1))))
    return alns, refs.withColumn("tid", turned(F.col("file_no"), F.col("tid"))).drop("many").withColumn("ref", ref)


def taxnode(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (_table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    species = s.select((100000 + F.col("s_suppkey")).alias("taxid"), (1000 + F.col("s_nationkey").cast("long")).alias("parent"), F.lit("species").alias("rank"))
    genus = n.select((1000 + F.col("n_nationkey").cast("long")).alias("taxid"), (10 + F.col("n_regionkey").cast("long")).alias("parent"), F.when(F.col("n_nationkey") % 5 == 0, "clade").otherwise("genus").alias("rank"))
    family = r.select((10 + F.col("r_regionkey").cast("long")).alias("taxid"), F.lit(1).cast("long").alias("parent"), F.lit("family").alias("rank"))
    return species.union(genus).union(family).union(spark.range(1, 2).select(F.col("id").alias("taxid"), F.col("id").alias("parent"), F.lit("no rank").alias("rank")))


def taxname(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (_table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    out = s.select((100000 + F.col("s_suppkey")).alias("taxid"), F.col("s_name").alias("name"))
    out = out.union(n.select(1000 + F.col("n_nationkey").cast("long"), "n_name")).union(r.select(10 + F.col("r_regionkey").cast("long"), "r_name"))
    return out.union(spark.range(1, 2).select("id", F.lit("root")))


def acc2tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = _table(spark, sf_dir, "supplier").agg(F.count("*").alias("many"))
    p = _table(spark, sf_dir, "part").where("p_partkey % 17 != 0").join(many)
    return p.select(F.concat(F.lit("ACC"), F.col("p_partkey").cast("string")).alias("accession"), (100000 + F.col("p_partkey") % F.col("many")).alias("taxid"))
