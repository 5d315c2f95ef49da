"""Statistics by taxon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.config import StatConfig
from strandlake.functions.sequence import ani
from strandlake.operators import coverage as cov
from strandlake.operators import kmers as km
from strandlake.operators import reads as rd
from strandlake.operators.filters import alignment_filter, plain_filter
from strandlake.operators.taxonomy import resolve
from strandlake.plans import compact, held, holding, part
from strandlake.plans.counters import Counters
from strandlake.schema import TAXSTATS
from strandlake.shared import discard, few, sweep


def by_taxon(alns: DataFrame, names: DataFrame, cfg: StatConfig, key: str = "tid", by: tuple[str, ...] = (), seen: Counters | None = None) -> DataFrame:
    """alns has taxid; null taxids take no part. Coverage is summed over the references of a taxon.

    key numbers the references; by: further integer columns, such as file_no, whose values are kept apart.
    """
    keys, seen = [*by, "taxid"], seen or Counters()
    row, spark, bounds = _rows(cfg), alns.sparkSession, (cfg.ksize, rd.CLIP, rd.CLIP - cfg.ksize)
    known, pairs = alns.where("taxid is not null"), [*keys, key]
    base = compact(seen.passed(alignment_filter(known, row)), pairs, bounds)
    alone = part(rd.alignment_stats(base, keys, *km.sizes(F.col("kmers"))), "alone")
    refs = base.groupBy(*pairs).agg(F.first("ref_len").alias("ref_len"))
    refs = part(refs.groupBy(*keys).agg(F.count("*").alias("num_accessions"), F.sum("ref_len").alias("total_length")), "references")
    segs, table = cov.swept(base, pairs)
    discard(base)
    pooled = part(cov.basic(segs, pairs).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("covbases", "depthsum", "sumsq")]), "depths")
    discard(table)
    first = km.read_table(plain_filter(known, row), keys, *bounds, alone.select(*keys, "kmers", "rows"))
    sweep(spark)
    middle, repeats = part(rd.median_mode(first, keys), "middle"), part(rd.duplicity(km.counts(first, keys, *bounds), keys), "duplicity")
    out = rd.read_lengths(first, keys, 3).where(F.col("num_reads") >= cfg.minreads).join(alone.where(F.col("mean_alnani") >= cfg.minmani) if cfg.minmani > 0 else alone, keys)
    for one in (middle, refs):
        out = out.join(one, keys)
    for one in (pooled, repeats):
        out = out.join(one, keys, "left")
    out = out.join(names.select("taxid", "name"), "taxid", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("covbases", "depthsum", "sumsq")} | {"duplicity": F.coalesce("duplicity", F.lit(0.0))}
    length = F.col("total_length")
    out = out.withColumns(zero).withColumns(cov.figures(length, F.col("covbases") / length)).select(*by, *TAXSTATS)
    return holding(seen.kept(out, {"refs": "num_accessions", "alns": "num_alns"}), first, alone, refs, pooled, middle, repeats)


def _rows(cfg: StatConfig) -> StatConfig:
    """What cfg asks of single alignments."""
    return StatConfig(minreflen=max(cfg.minreflen, 1), minalnas=cfg.minalnas, maxdust=cfg.maxdust)


def taxstats(alns: DataFrame, reference: DataFrame, acc2tax: DataFrame, nodes: DataFrame, names: DataFrame, cfg: StatConfig | None = None, key: str = "tid", by: tuple[str, ...] = (), seen: Counters | None = None) -> DataFrame:
    """One row by taxon at cfg.rank (and by the columns by); alignments of references without a known taxon are left out."""
    cfg = cfg or StatConfig()
    at = resolve(reference, acc2tax, nodes, cfg.rank, key).where("rank_taxid is not null").select(key, F.col("rank_taxid").alias("taxid"))
    seen = seen or Counters()
    return by_taxon(seen.records(alns).join(few(at), key), names, cfg, key, by, seen)


def taxstats_from_tags(alns: DataFrame, names: DataFrame, cfg: StatConfig | None = None, key: str = "tid", by: tuple[str, ...] = ()) -> DataFrame:
    """The same from alignments that already have their taxon in xr; null and absent xr are left out."""
    return by_taxon(alns.withColumn("taxid", F.col("xr").cast("long")), names, cfg or StatConfig(), key, by)


def summary(alns: DataFrame, resolved: DataFrame, cfg: StatConfig | None = None, key: str = "tid") -> DataFrame:
    """All records, distinct reads that pass, and reads, references and alignments of the taxa that survive the group filters.

    Alignments are counted by taxon and read, and by taxon and reference: no other figure of a taxon is made.
    """
    cfg = cfg or StatConfig()
    at = resolved.where("rank_taxid is not null").select(key, F.col("rank_taxid").alias("taxid"))
    base = plain_filter(alns.join(few(at), key), _rows(cfg))
    ident = ani(F.col("nm"), F.col("qlen"))
    reads = part(base.groupBy("taxid", "qname").agg(F.count("*").alias("n"), F.sum(ident).alias("ani"), F.count(ident).alias("anis")), "reads", packed=True)
    kept = reads.groupBy("taxid").agg(F.count("*").alias("num_reads"), F.sum("n").alias("num_alns"), (F.sum("ani") / F.nullif(F.sum("anis"), F.lit(0))).alias("mani")).where(F.col("num_reads") >= cfg.minreads)
    kept = part((kept.where(F.col("mani") >= cfg.minmani) if cfg.minmani > 0 else kept).select("taxid", "num_alns"), "taxa")
    refs = base.select("taxid", key).distinct().join(kept, "taxid", "left_semi").agg(F.count("*").alias("passed_refs"))
    in_ = kept.select("taxid", F.lit(1).alias("in"))
    each = reads.select("taxid", "qname").join(few(in_), "taxid", "left").groupBy("qname").agg(F.max("in").alias("in"))
    out = alns.agg(F.count("*").alias("alns")).join(each.agg(F.count("*").alias("reads"), F.count("in").alias("passed_reads")))
    out = out.join(kept.agg(F.coalesce(F.sum("num_alns"), F.lit(0)).alias("passed_alns"))).join(refs).join(kept.agg(F.count("*").alias("passed_taxa")))
    return holding(out.select("alns", "reads", "passed_reads", "passed_alns", "passed_refs", "passed_taxa"), reads, kept)


def read_totals(stats: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, reads, passed_reads): distinct reads that pass the row filters, and those of the surviving taxa, from the table
    of first records that the plan of stats keeps; the alignments are not read again."""
    reads = next(x for x in held(stats) if hasattr(x, "durable_path"))
    kept = stats.select(*by, "taxid").withColumn("in", F.lit(True))
    each = reads.select(*by, "taxid", "qname").join(kept, [*by, "taxid"], "left").groupBy(*by, "qname").agg(F.max("in").alias("in"))
    return each.groupBy(*by).agg(F.count("*").alias("reads"), F.count("in").alias("passed_reads"))
