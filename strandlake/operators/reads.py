"""Statistics of reads and of alignments by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.sequence import ani

CLIP = 255


def first_records(df: DataFrame, keys: list[str], seq: bool = False) -> DataFrame:
    """(keys, qname, qlen) of the first record, by ord, of each read in a group, with seq if asked for. Combined before the shuffle."""
    value = F.struct("qlen", "seq") if seq else F.struct("qlen")
    first = df.groupBy(*keys, "qname").agg(F.min_by(value, "ord").alias("r"))
    return first.select(*keys, "qname", "r.*")


def length_histogram(reads: DataFrame, keys: list[str]) -> DataFrame:
    return reads.groupBy(*keys, F.least("qlen", F.lit(CLIP)).cast("long").alias("length")).agg(F.count("*").alias("n"))


def read_lengths(reads: DataFrame, keys: list[str], least_for_variance: int = 2) -> DataFrame:
    """num_reads, mean, stdev (0 below least_for_variance reads), min and max of unclipped lengths."""
    n = F.count("*")
    sd = F.when(n >= least_for_variance, F.sqrt(F.coalesce(F.var_samp("qlen"), F.lit(0.0)))).otherwise(0.0)
    return reads.groupBy(*keys).agg(n.alias("num_reads"), F.avg("qlen").alias("mean_readl"), sd.alias("stdev_readl"), F.min("qlen").cast("long").alias("readl_min"), F.max("qlen").cast("long").alias("readl_max"))


def median_mode(reads: DataFrame, keys: list[str]) -> DataFrame:
    """Upper median and smallest mode of clipped lengths, from at most 256 counts a group."""
    hist = length_histogram(reads, keys)
    by = Window.partitionBy(*keys)
    walk = hist.withColumn("upto", F.sum("n").over(by.orderBy("length").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(by))
    return walk.groupBy(*keys).agg(
        F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("length"))).alias("median_readl"),
        F.max_by("length", F.struct("n", -F.col("length"))).alias("mode_readl"),
    )


def alignment_stats(df: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """num_alns and the identity, edit-distance and low-complexity figures of a group's alignments; more: further aggregates."""
    d = df.withColumn("ani", ani(F.col("nm"), F.col("qlen")))
    sd = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    dust = [F.avg("dust").alias("mdust"), sd("dust").alias("stdev_dust")] if "dust" in df.columns else []
    plain = d.groupBy(*keys).agg(F.count("*").alias("num_alns"), F.avg("nm").alias("mean_alnnm"), F.avg("ani").alias("mean_alnani"), sd("ani").alias("stdev_alnani"), *dust, *more)
    return plain.join(median_identity(d, keys), keys, "left")


def median_identity(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, median_alnani): from the number of alignments of each identity, so that a group is a few rows."""
    few = df.where("ani is not null").groupBy(*keys, "ani").agg(F.count("*").alias("n"))
    return few.groupBy(*keys).agg(F.percentile("ani", F.lit(0.5), F.col("n")).alias("median_alnani"))


def duplicity(kmers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, duplicity): distinct canonical k-mers over all; groups without a k-mer are absent (their figure is 0)."""
    return kmers.select(*keys, (F.col("distinct_kmers") / F.col("total_kmers")).alias("duplicity"))
