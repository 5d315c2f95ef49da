"""Coverage of references by alignments: a sweep over interval ends, then bins of covered bases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.shared import durable

#: Bases in a stripe. A long reference is swept stripe by stripe, so that no task holds more than one.
STRIPE = 1 << 22


def events(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p, d): net change of depth at each position; combined before the shuffle."""
    ends = F.explode(F.array(F.struct(F.col("pos").alias("p"), F.lit(1).alias("d")), F.struct(F.col("end_pos").alias("p"), F.lit(-1).alias("d")))).alias("e")
    return df.select(*keys, ends).groupBy(*keys, F.col("e.p").alias("p")).agg(F.sum("e.d").alias("d"))


def segments(df: DataFrame, keys: list[str], stripe: int = STRIPE) -> DataFrame:
    """(keys, p, length, depth): stretches of equal depth above 0.

    Depth is a running sum within a stripe plus the sum over earlier stripes of the group.
    """
    ev = events(df, keys).withColumn("stripe", F.floor(F.col("p") / stripe))
    by_stripe = Window.partitionBy(*keys).orderBy("stripe")
    totals = ev.groupBy(*keys, "stripe").agg(F.sum("d").alias("sum_d"), F.min("p").alias("first_p"))
    totals = totals.withColumn("before", F.coalesce(F.sum("sum_d").over(by_stripe.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("next_p", F.lead("first_p").over(by_stripe))
    inside = Window.partitionBy(*keys, "stripe").orderBy("p")
    run = ev.withColumn("run", F.sum("d").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("lead_p", F.lead("p").over(inside))
    both = run.join(totals.select(*keys, "stripe", "before", "next_p"), [*keys, "stripe"])
    out = both.select(*keys, "p", (F.coalesce("lead_p", "next_p") - F.col("p")).alias("length"), (F.col("run") + F.col("before")).alias("depth"))
    return out.where((F.col("depth") > 0) & (F.col("length") > 0))


#: Alignments whose ends a task combines at a time.
COMBINED = 500_000


def _combined(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p, d) of integer keys: events() combined within tasks only, so that the shuffle after it can be chosen."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            n, own = len(rows), rows.select(keys)
            ends = pa.concat_tables([own, own]).append_column("p", pa.chunked_array([*rows.column("pos").chunks, *rows.column("end_pos").chunks])).append_column("d", pa.array(np.repeat(np.array([1, -1]), n)))
            yield from ends.group_by([*keys, "p"]).aggregate([("d", "sum")]).rename_columns([*keys, "p", "d"]).to_batches(max_chunksize=20_000)

        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= COMBINED:
                yield from sent()
                held, size = [], 0
        if size:
            yield from sent()

    ends = df.select(*keys, F.col("pos").cast("long").alias("pos"), F.col("end_pos").cast("long").alias("end_pos"))
    return ends.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "p long", "d long"]))


def swept(df: DataFrame, keys: list[str], stripe: int = STRIPE) -> tuple[DataFrame, DataFrame]:
    """What segments() gives, from a table that is written, and that table. keys are integers.

    Ends are shuffled once, by group and stripe. Of groups that end within a stripe, which are most, the table has the
    depths; what stands before a stripe, and where the next begins, is joined to the others only.
    """
    ev = _combined(df, keys).withColumn("stripe", F.floor(F.col("p") / stripe)).repartition(*keys, "stripe").groupBy(*keys, "stripe", "p").agg(F.sum("d").alias("d"))
    inside = Window.partitionBy(*keys, "stripe").orderBy("p")
    run = ev.withColumn("run", F.sum("d").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("lead_p", F.lead("p").over(inside))
    table = durable(run.select(*keys, "stripe", "p", "run", "lead_p"), "stretches", packed=True)
    by_stripe = Window.partitionBy(*keys).orderBy("stripe")
    # a stripe whose last depth is 0 hands nothing on: the stretch up to the next one has no depth
    totals = table.groupBy(*keys, "stripe").agg(F.max(F.when(F.col("lead_p").isNull(), F.col("run"))).alias("sum_d"), F.min("p").alias("first_p")).where((F.col("sum_d") != 0) | (F.col("stripe") > 0))
    totals = totals.withColumn("before", F.coalesce(F.sum("sum_d").over(by_stripe.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("next_p", F.lead("first_p").over(by_stripe))
    fixed = durable(totals.where("before != 0 or sum_d != 0").select(*keys, "stripe", "before", "next_p"), "stripes")
    n = fixed.count()
    both = table.withColumns({"before": F.lit(0).cast("long"), "next_p": F.lit(None).cast("long")})
    if n:
        both = table.join(F.broadcast(fixed) if n <= 100_000 else fixed, [*keys, "stripe"], "left").withColumn("before", F.coalesce("before", F.lit(0)))
    out = both.select(*keys, "p", (F.coalesce("lead_p", "next_p") - F.col("p")).alias("length"), (F.col("run") + F.col("before")).alias("depth"))
    return out.where((F.col("depth") > 0) & (F.col("length") > 0)), table


def basic(segs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, covbases, depthsum, sumsq)."""
    length, depth = F.col("length"), F.col("depth")
    return segs.groupBy(*keys).agg(F.sum(length).alias("covbases"), F.sum(length * depth).alias("depthsum"), F.sum(length * depth * depth).alias("sumsq"))


def quartiles(segs: DataFrame, keys: list[str], stripe: int = STRIPE) -> DataFrame:
    """(keys, covbases, q1, q3): where the covered bases reach a quarter and three quarters of their number.

    Sums by stripe tell the stripes that hold the two places; only those are walked through, each for itself.
    """
    striped = segs.withColumn("stripe", F.floor(F.col("p") / stripe))
    sums = striped.groupBy(*keys, "stripe").agg(F.sum("length").alias("own"))
    w = Window.partitionBy(*keys)
    sums = sums.withColumn("before", F.coalesce(F.sum("own").over(w.orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("own").over(w))
    t1, t3 = F.floor(F.col("n") / 4), F.floor(3 * F.col("n") / 4)
    holds = lambda t: ((F.col("before") < t) | ((t == 0) & (F.col("before") == 0))) & (F.col("before") + F.col("own") >= t)
    walk = striped.join(sums.where(holds(t1) | holds(t3)).select(*keys, "stripe", "before", "n"), [*keys, "stripe"])
    upto = F.sum("length").over(Window.partitionBy(*keys, "stripe").orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    walk = walk.withColumn("upto", F.col("before") + upto)
    place = lambda t: F.min(F.when(F.col("upto") >= t, F.struct("upto", (F.col("p") + t - (F.col("upto") - F.col("length"))).alias("q"))))["q"]
    return walk.groupBy(*keys).agg(F.first("n").alias("covbases"), place(t1).alias("q1"), place(t3).alias("q3"))


def cube_root(n: Column) -> Column:
    """Exact where n is a cube, so that a bin's edge never hangs on the last bit of a library's power function."""
    near = F.round(F.cbrt(n))
    return F.when(near * near * near == n, near).otherwise(F.cbrt(n))


def bin_width(q1: Column, q3: Column, n: Column, ref_len: Column) -> Column:
    """Freedman-Diaconis; Sturges below 100 bases; 100 where that is under one base."""
    wide = 2.0 * (q3 - q1) / cube_root(n.cast("double"))
    return F.when(ref_len < 100, ref_len / F.ceil(F.log2(n.cast("double")) + 1)).when(wide < 1, 100.0).otherwise(wide)


def bins_of(segs: DataFrame, lengths: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ref_len, covbases, q1, q3, width, n_bins); lengths is (keys, ref_len)."""
    q = quartiles(segs, keys).join(lengths, keys)
    return q.withColumn("width", bin_width(F.col("q1"), F.col("q3"), F.col("covbases"), F.col("ref_len"))).withColumn("n_bins", F.ceil(F.col("ref_len") / F.col("width")))


def _edge(b: Column, width: Column) -> Column:
    """The least position p with floor(p / width) >= b, by the same division that places a position."""
    guess = F.ceil(b * width)
    return F.when(F.floor((guess - 1) / width) >= b, guess - 1).when(F.floor(guess / width) < b, guess + 1).otherwise(guess)


def bin_histogram(segs: DataFrame, bins: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, bins): how many bins hold value covered bases, empty bins included. No row for a base is made."""
    last = F.col("n_bins") - 1
    place = lambda p: F.least(F.floor(p / F.col("width")), last)
    seg = segs.join(bins.select(*keys, "width", "n_bins"), keys).withColumn("e", F.col("p") + F.col("length"))
    each = seg.withColumn("b", F.explode(F.sequence(place(F.col("p")), place(F.col("e") - 1))))
    upper = F.when(F.col("b") >= last, F.col("e")).otherwise(F.least("e", _edge(F.col("b") + 1, F.col("width"))))
    filled = each.withColumn("got", upper - F.greatest(F.col("p"), _edge(F.col("b"), F.col("width")))).groupBy(*keys, "b").agg(F.sum("got").alias("value")).where("value > 0")
    counts = filled.groupBy(*keys, "value").agg(F.count("*").alias("bins"))
    some = counts.groupBy(*keys).agg(F.sum("bins").alias("some"))
    empty = bins.join(some, keys, "left").select(*keys, F.lit(0).cast("long").alias("value"), (F.col("n_bins") - F.coalesce("some", F.lit(0))).cast("long").alias("bins")).where("bins > 0")
    return counts.select(*keys, F.col("value").cast("long"), "bins").union(empty)


def shape(hist: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, entropy, norm_entropy, gini, norm_gini, tad80) of a histogram of values."""
    w = Window.partitionBy(*keys)
    asc = w.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    v, k = F.col("value").cast("double"), F.col("bins").cast("double")
    walk = hist.withColumn("n", F.sum("bins").over(w)).withColumn("below", F.coalesce(F.sum("bins").over(asc), F.lit(0))).withColumn("mass", F.coalesce(F.sum(F.col("value") * F.col("bins")).over(asc), F.lit(0)))
    cut = F.ceil(F.col("n") / 10)
    top = F.when(F.col("below") == 0, F.col("below") + F.col("bins")).otherwise(F.least(F.col("below") + F.col("bins"), F.col("n") - cut))
    walk = walk.withColumn("kept", F.greatest(F.lit(0), top - F.greatest(F.col("below"), cut)))
    p = k / F.col("n")
    agg = walk.groupBy(*keys).agg(
        (-F.sum(p * F.log2(p))).alias("entropy"), F.count("*").alias("distinct"), F.first("n").alias("n"), F.sum(v * k).alias("total"),
        F.sum(k * (v * F.col("below") - F.col("mass"))).alias("spread"), (F.sum(v * F.col("kept")) / F.nullif(F.sum("kept"), F.lit(0))).alias("tad80"),
    )
    # 2 * spread / (2 n^2 mean), mean = total / n
    gini = F.when(F.col("total") == 0, 0.0).otherwise(F.col("spread") / (F.col("n") * F.nullif(F.col("total"), F.lit(0.0))))
    flat = F.when(F.col("n") <= 1, 0.0).otherwise(gini * F.col("n") / F.nullif(F.col("n") - 1, F.lit(0)))
    return agg.select(*keys, F.abs("entropy").alias("entropy"), F.when(F.col("distinct") == 1, 1.0).otherwise(F.abs("entropy") / F.nullif(F.log2(F.col("distinct").cast("double")), F.lit(0.0))).alias("norm_entropy"), gini.alias("gini"), flat.alias("norm_gini"), "tad80")


def figures(length: Column, exposure: Column | None = None) -> dict[str, Column]:
    """Figures from covbases, depthsum, sumsq. exposure: what the expected breadth follows; mean depth if None."""
    cov, depth, sq = F.col("covbases"), F.col("depthsum"), F.col("sumsq")
    mean, on = depth / length, F.coalesce(depth / F.nullif(cov, F.lit(0)), F.lit(0.0))
    breadth = cov / length
    expected = -F.expm1(-(mean if exposure is None else exposure))
    sd = F.sqrt(F.greatest(F.lit(0.0), F.coalesce(sq / F.nullif(cov, F.lit(0)), F.lit(0.0)) - on * on))
    return {
        "num_covbases": cov, "mean_cov": mean, "breath_cov": breadth, "exp_breath": expected, "breath_ratio": F.when(expected <= 0, 1.0).otherwise(breadth / F.nullif(expected, F.lit(0.0))),
        "mean_covcovered": on, "stdev_covcovered": sd, "evenness_cov": F.when(on == 0, 0.0).otherwise(sd / F.nullif(on, F.lit(0.0))), "site_density": 1000 * breadth,
    }
