"""Statistics by file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.sequence import ani
from strandlake.operators import coverage as cov
from strandlake.operators import reads as rd
from strandlake.operators.filters import mapped
from strandlake.schema import BAMSTATS


def bamstats(alns: DataFrame, key: str = "file") -> DataFrame:
    """One row by file. Length figures are of lengths clipped at 255; vreadl is a standard deviation."""
    base = alns.where(mapped())
    keys = [key]
    first = rd.first_records(base, keys)
    clipped = F.least("qlen", F.lit(rd.CLIP))
    lengths = first.groupBy(key).agg(F.count("*").alias("tread"), F.avg(clipped).alias("mreadl"), F.sqrt(F.coalesce(F.var_samp(clipped), F.lit(0.0))).alias("vreadl"))
    both = base.groupBy(key).agg(F.count("*").alias("aln"), F.avg(ani(F.col("nm"), F.col("qlen"))).alias("mani"), F.avg("nm").alias("mnm"))
    total = base.groupBy(key, "tid").agg(F.first("ref_len").alias("ref_len")).groupBy(key).agg(F.sum("ref_len").alias("tbases"))
    covered = cov.basic(cov.segments(base, [key, "tid"]), [key, "tid"]).groupBy(key).agg(F.sum("covbases").alias("covbases"))
    out = both.join(lengths, key).join(rd.median_mode(first, keys), key).join(total, key).join(covered, key, "left")
    out = out.withColumn("covbases", F.coalesce("covbases", F.lit(0))).withColumn("covbreath", F.col("covbases") / F.nullif(F.col("tbases"), F.lit(0)))
    return out.withColumn("name", F.element_at(F.split(key, "/"), -1)).withColumnsRenamed({"median_readl": "mdreadl", "mode_readl": "moreadl"}).select(*BAMSTATS)


def read_length_distribution(alns: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, length, n) for 0 to 255, zeros included."""
    hist = rd.length_histogram(rd.first_records(alns.where(mapped()), list(by)), list(by))
    every = alns.sparkSession.range(rd.CLIP + 1).select(F.col("id").alias("length"))
    if by:
        every = hist.select(*by).distinct().withColumn("length", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rd.CLIP).cast("long"))))
    return every.join(hist, [*by, "length"], "left").select(*by, "length", F.coalesce("n", F.lit(0)).alias("n"))


def ani_distribution(alns: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, ani, n): identities cut to a tenth of a percent."""
    a = F.floor(ani(F.col("nm"), F.col("qlen")) * 10) / 10
    return alns.where(mapped()).select(*by, a.alias("ani")).where("ani is not null").groupBy(*by, "ani").agg(F.count("*").alias("n"))
