"""Plans that put the operators together.

A plan writes what it reads several times as tables in the shared folder: alignments without names and sequences, first
records of reads, stretches of depth. release(result) frees what is left of them once the result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from strandlake.operators.kmers import per_read
from strandlake.shared import discard, durable, sweep


def holding(df: DataFrame, *kept: DataFrame) -> DataFrame:
    df.kept = kept
    return df


def held(df: DataFrame) -> tuple[DataFrame, ...]:
    return getattr(df, "kept", ())


def release(df: DataFrame) -> None:
    """Frees what the plan of df keeps on the executors and in the shared folder."""
    for one in held(df):
        if hasattr(one, "durable_path"):
            discard(one)
        else:
            one.unpersist()


def compact(alns: DataFrame, keys: list[str], bounds: tuple[int, int, int]) -> DataFrame:
    """Filtered alignments without names and sequences, and the number of their k-mers, written. bounds: k, longest, most."""
    columns = dict.fromkeys([*keys, "ref_len", "pos", "end_pos", "qlen", "nm", "dust"])
    return durable(alns.select(*columns, per_read(*bounds).cast("int").alias("kmers")), "alignments", packed=True)


def part(df: DataFrame, label: str, packed: bool = False) -> DataFrame:
    """A part of a result, written; the shuffle files it took go."""
    out = durable(df, label, packed)
    sweep(df.sparkSession)
    return out
