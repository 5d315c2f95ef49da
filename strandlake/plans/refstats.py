"""Statistics by reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.config import StatConfig
from strandlake.operators import coverage as cov
from strandlake.operators import kmers as km
from strandlake.operators import reads as rd
from strandlake.operators.filters import alignment_filter, plain_filter
from strandlake.operators.taxonomy import accessions
from strandlake.plans import compact, held, holding, part
from strandlake.plans.counters import Counters
from strandlake.schema import REFSTATS
from strandlake.shared import discard, sweep


def refstats(alns: DataFrame, cfg: StatConfig | None = None, key: str = "tid", seen: Counters | None = None) -> DataFrame:
    """One row by reference with cfg.minreads reads or more; alns has key, ref_len and the alignment columns.

    key numbers the references: tid within one file, ref over several, whose references are never put together.
    alns is read twice: for a table of alignments without names and sequences, and for the first records of reads, which
    cross the shuffle once. Depths and identities leave their tasks as sums by place and by identity. Each part of the
    result is written before the next one begins, so that shuffle files and tables that are done with leave the disk; what
    is returned is a table.
    """
    cfg, seen = cfg or StatConfig(), seen or Counters()
    keys, bounds, spark = [key], (cfg.ksize, rd.CLIP, 1 << 30), alns.sparkSession
    base = compact(seen.passed(alignment_filter(seen.records(alns), cfg)), keys, bounds)
    alone = part(rd.alignment_stats(base, keys, F.first("ref_len").alias("ref_len"), *km.sizes(F.col("kmers"))), "alone")
    segs, table = cov.swept(base, keys)
    discard(base)
    basic = part(cov.basic(segs, keys), "depths")
    bins = part(cov.bins_of(segs, alone.select(key, "ref_len"), keys), "bins")
    hist = part(cov.bin_histogram(segs, bins, keys), "histogram")
    discard(table)
    shape = part(cov.shape(hist, keys), "shape")
    first = km.read_table(plain_filter(alns, cfg), keys, *bounds, alone.select(key, "kmers", "rows"))
    sweep(spark)
    lengths = part(seen.groups(rd.read_lengths(first, keys)), "lengths")
    middle, repeats = part(rd.median_mode(first, keys), "middle"), part(rd.duplicity(km.counts(first, keys, *bounds), keys), "duplicity")
    out = lengths.where(F.col("num_reads") >= cfg.minreads)
    for one in (middle, alone):
        out = out.join(one, keys)
    for one in (basic, shape, repeats):
        out = out.join(one, keys, "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("covbases", "depthsum", "sumsq")} | {"duplicity": F.coalesce("duplicity", F.lit(0.0))}
    zero |= {c: F.coalesce(c, F.lit(0.0)) for c in ("entropy", "gini", "norm_entropy", "norm_gini")}
    out = out.withColumns(zero).withColumns(cov.figures(F.col("ref_len"))).withColumn("Length", F.col("ref_len"))
    out = part(seen.kept(out.select(key, *REFSTATS), {"alns": "num_alns", "reads": "num_reads"}), "refstats")
    discard(first, alone, basic, bins, hist, shape, lengths, middle, repeats)
    return holding(out, out)


def with_taxid(stats: DataFrame, reference: DataFrame, acc2tax: DataFrame, key: str = "tid", more: tuple[str, ...] = ()) -> DataFrame:
    """Adds Id, the reference's name, and taxID, 0 where the accession is unknown; more: further columns of reference."""
    names = reference.select(key, F.col("rname").alias("Id"), *more).join(accessions(acc2tax).withColumnRenamed("accession", "Id"), "Id", "left")
    return holding(stats.join(names.select(key, "Id", *more, F.coalesce("taxid", F.lit(0)).alias("taxID")), key).select(*more, "Id", "taxID", *REFSTATS), *held(stats))


def summary(alns: DataFrame, stats: DataFrame, cfg: StatConfig | None = None, every_record: bool = False, key: str = "tid") -> DataFrame:
    """alns and reads that pass the row filters (reads summed over references), and the same of the surviving references.

    every_record: alns counts all records instead, as for input sorted by coordinate. Where the statistics are made
    anyway, Counters has these figures from the same pass.
    """
    base = alignment_filter(alns, cfg or StatConfig())
    every = base.agg(F.count("*").alias("alns"), F.countDistinct(key, "qname").alias("reads"))
    if every_record:
        every = every.drop("alns").join(alns.agg(F.count("*").alias("alns")))
    return every.join(stats.agg(F.coalesce(F.sum("num_alns"), F.lit(0)).alias("passed_alns"), F.coalesce(F.sum("num_reads"), F.lit(0)).alias("passed_reads"), F.count("*").alias("passed_refs")))


def filter_alignments(alns: DataFrame, stats: DataFrame, cfg: StatConfig | None = None, key: str = "tid") -> DataFrame:
    """The alignments that pass the row filters and lie on a surviving reference."""
    return alignment_filter(alns, cfg or StatConfig()).join(stats.select(key), key, "left_semi")
