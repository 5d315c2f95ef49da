"""Small helpers shared by the corpus operators: durable intermediate tables and table access."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.shared import discard, durable, shared_dir, sweep  # noqa: F401

#: Bytes and rows of one Arrow batch handed to a Python worker; a text longer than that is a batch of its own.
ARROW_BYTES = 4 << 20
ARROW_ROWS = 2000
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark (the folder may be in any store Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tuned(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches in bytes and rows, so that a worker's memory does not follow the length of texts.

    Only the registered queries call it, on the session they are given; tighter settings of the session stay.
    """
    for key, most in ((_BYTES, ARROW_BYTES), (_ROWS, ARROW_ROWS)):
        have = spark.conf.get(key, None)
        if have is None or not have.isdigit() or not 0 < int(have) <= most:
            spark.conf.set(key, str(most))
    return spark


def give_back() -> None:
    """Returns a worker's freed memory to the machine: Spark keeps workers, and they would keep all that they once had."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


#: A join key with more than 1 / HOT_SHARE of all rows is hot; there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000
#: Rows of one key that a task may have in any case.
LEAST_HOT = 20_000


def join_counted(left: DataFrame, right: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """left joined to right (inner or left), whose key is unique and whose column n says how many of total rows of left
    have it.

    Rows with a hot key stay where they are: their part of right, fewer than HOT_SHARE rows, is broadcast. So no task
    gets more than 1 / HOT_SHARE of left by one key. Nulls in the key join nothing.
    """
    more = [c for c in right.columns if c not in on and c != "n"]
    if total <= LEAST_HOT:
        return left.join(right.drop("n"), on, how).select(*left.columns, *more)
    least = max(LEAST_HOT, total // HOT_SHARE)
    hot = F.broadcast(right.where(F.col("n") > least).select(*on, *more, F.lit(True).alias("__hot")))
    tried = left.join(hot, on, "left")
    cold = tried.where("__hot is null").select(left.columns).join(right.where(F.col("n") <= least).select(*on, *more), on, how)
    return tried.where("__hot").select(*left.columns, *more).unionByName(cold.select(*left.columns, *more))


def crc_mod(doc_id: str, modulus: int):
    """crc32 of the id written as text, modulo: the stated train and held-out split."""
    return F.crc32(F.col(doc_id).cast("string")) % F.lit(modulus)
