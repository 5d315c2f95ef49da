"""Selection of alignments within a read, and of alignments by surviving references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandlake.functions.sequence import ani


def scored(df: DataFrame, minani: float = 90.0, maxani: float = 100.0) -> DataFrame:
    """Adds score, the identity over the aligned reference bases, and inside, whether it is within the bounds."""
    d = df.withColumn("score", ani(F.col("nm"), F.col("end_pos") - F.col("pos")))
    return d.withColumn("inside", F.coalesce(F.col("score").between(minani, maxani), F.lit(False)))


def alnfilt(df: DataFrame, mode: str = "ALLTOP", minani: float = 90.0, maxani: float = 100.0, pct: float = 0.9, strict: bool = False, seed: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The alignments a read keeps: ALLTOP all best, RNDTOP one of the best, PCTTOP those from pct of the best, ALL.

    strict drops a read that has any alignment out of bounds. RNDTOP takes the first of the best by ord, or with a seed the
    one whose md5 of seed and ord is least: any of them with the same chance, and always the same one. by: further columns
    that tell reads apart, such as file_no. One shuffle by read; unmapped records take no part.
    """
    if mode not in ("ALLTOP", "RNDTOP", "PCTTOP", "ALL"):
        raise ValueError(f"unknown mode {mode}")
    s = scored(df.where(F.col("flag").bitwiseAND(4) == 0), minani, maxani)
    w = Window.partitionBy(*by, "qname")
    if strict:
        s = s.withColumn("out", F.max(~F.col("inside")).over(w)).where(~F.col("out")).drop("out")
    s = s.where("inside and score > 0")
    if mode in ("ALLTOP", "PCTTOP"):
        s = s.withColumn("best", F.max("score").over(w)).where(F.col("score") >= F.col("best") * (pct if mode == "PCTTOP" else 1.0)).drop("best")
    elif mode == "RNDTOP":
        kind = s.schema["ord"].dataType
        parts = [F.col("ord").getField(n) for n in kind.names] if isinstance(kind, StructType) else [F.col("ord")]
        drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])) if seed is not None else F.lit("")
        # the best by score, then by draw, then by ord: one row a read by map-side aggregation
        best = s.groupBy(*by, "qname").agg(F.min_by(F.struct(*s.columns), F.struct(-F.col("score"), drawn, "ord")).alias("one"))
        s = best.select("one.*")
    return s.drop("inside")


def reassign_weights(df: DataFrame) -> DataFrame:
    """weight: shifted score by aligned base, scaled to sum 1 within a read, to 12 digits (sums depend on the order of rows)."""
    w = Window.partitionBy("qname")
    raw = (F.col("as_score") - F.min("as_score").over(w) + 1) / F.nullif(F.col("end_pos") - F.col("pos"), F.lit(0))
    return df.withColumn("raw", raw).withColumn("weight", F.round(F.col("raw") / F.sum("raw").over(w), 12)).drop("raw")


#: References numbered in one task.
RANGE = 1 << 16


def renumber(df: DataFrame, by: str = "tid") -> DataFrame:
    """(tid, new_tid): dense numbers from 0 in the order of tid, or (by="first") of the first alignment by ord.

    References are numbered within ranges of RANGE values of tid, or of ord (of its first field, if it is a struct); what
    stands before a range comes from the counts of ranges, the only rows that one task orders.
    """
    refs = df.select("tid").distinct() if by == "tid" else df.groupBy("tid").agg(F.min("ord").alias("ord"))
    name = "tid" if by == "tid" else "ord"
    order, kind = F.col(name), refs.schema[name].dataType
    lead = order.getField(kind.names[0]) if isinstance(kind, StructType) else order
    ranged = refs.withColumn("range", F.floor(lead / RANGE))
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    return ranged.withColumn("place", place).join(before, "range").select("tid", (F.col("before") + F.col("place")).cast("long").alias("new_tid"))


def alnfilt_summary(df: DataFrame, kept: DataFrame, key: str = "tid") -> DataFrame:
    """alns, queries and references, before and after."""
    one = lambda d, p: d.agg(F.count("*").alias(f"{p}alns"), F.countDistinct("qname").alias(f"{p}queries"), F.countDistinct(key).alias(f"{p}refs"))
    return one(df, "").join(one(kept, "passed_"))
