"""Comparison of two statistics tables on their first column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cmpstat(one: DataFrame, two: DataFrame, p: int, q: int, names: tuple[str, str] = ("file1", "file2")) -> DataFrame:
    """(Id, name1, name2): column p of one beside column q of two for the keys of both, in two's rows. Of a key that one
    repeats the last row counts."""
    rows = one.select(F.col(one.columns[0]).alias("Id"), F.col(one.columns[p]).alias("value"), F.monotonically_increasing_id().alias("ord"))
    a = rows.groupBy("Id").agg(F.max_by("value", "ord").alias(names[0]))
    b = two.select(F.col(two.columns[0]).alias("Id"), F.col(two.columns[q]).alias(names[1]))
    return b.join(a, "Id").select("Id", *names)


def unmatched(one: DataFrame, two: DataFrame) -> DataFrame:
    """Keys of two that one lacks."""
    return two.select(F.col(two.columns[0]).alias("Id")).join(one.select(F.col(one.columns[0]).alias("Id")), "Id", "left_anti")
