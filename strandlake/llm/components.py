"""Connected components of a link table, as grouped minima only.

Alternates large-star and small-star steps until the links no longer change: every node then points at the least node
of its component. A hub's neighbours are never gathered in one group: a hub's minimum is pre-aggregated before the
shuffle, and the few hubs with more than a fixed share of all links get theirs by broadcast. The links after each
round are written to the shared folder; those of the round before are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm import spark_io
from strandlake.llm.spark_io import discard, durable

#: Rounds grow with the logarithm of the longest path; this many mean something is wrong.
MOST_ROUNDS = 40


def _with_least(rows: DataFrame, total: int) -> DataFrame:
    """rows (u, v) with m, the least v of each u. Hubs, fewer than HOT_SHARE, get theirs by broadcast; the others' rows
    meet in a window."""
    own = F.min("v").over(Window.partitionBy("u"))
    if total <= spark_io.LEAST_HOT:
        return rows.withColumn("m", own)
    hubs = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).where(F.col("n") > max(spark_io.LEAST_HOT, total // spark_io.HOT_SHARE))
    tried = rows.join(F.broadcast(hubs.select("u", "m")), "u", "left")
    return tried.where("m is not null").unionByName(tried.where("m is null").select("u", "v").withColumn("m", own))


def _large_star(e: DataFrame, total: int) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _with_least(both, 2 * total).withColumn("m", F.least("u", "m"))
    return least.where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame, total: int) -> DataFrame:
    """Of the rows of u, the least goes on as (u, m), the others as (v, m)."""
    return _with_least(e, total).select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for each node that has a link to another; component is the least node of its component.

    Nulls and self-links are ignored, repeated links count once, no links give an empty table.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    e = links.select(high.alias("u"), low.alias("v")).where("u != v").distinct()
    e = durable(e, "links")

    def mark(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(e)
    if before[0]:
        for _ in range(MOST_ROUNDS):
            old, e = e, durable(_small_star(_large_star(e, before[0]), before[0]), "links")
            discard(old)
            now = mark(e)
            if now == before:
                break
            before = now
        else:
            raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("u")).distinct().select("u", F.col("u").alias("v"))
    return e.union(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
