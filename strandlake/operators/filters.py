"""Row filters on alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.config import StatConfig
from strandlake.functions.sequence import with_dust


def mapped() -> Column:
    return F.col("flag").bitwiseAND(4) == 0


def long_enough(minreflen: int) -> Column:
    return F.col("ref_len") >= minreflen


def scored(minalnas: int | None) -> Column:
    """A missing score passes."""
    return F.lit(True) if minalnas is None else F.col("as_score").isNull() | (F.col("as_score") >= minalnas)


def _cheap(df: DataFrame, cfg: StatConfig) -> DataFrame:
    return df.where(mapped() & long_enough(cfg.minreflen) & scored(cfg.minalnas))


def alignment_filter(df: DataFrame, cfg: StatConfig) -> DataFrame:
    """Alignments that pass, with their rounded low-complexity score in dust. The cheap filters run before the score."""
    return with_dust(_cheap(df, cfg)).where(F.col("dust") <= cfg.maxdust)


def plain_filter(df: DataFrame, cfg: StatConfig) -> DataFrame:
    """The same alignments, without dust where no score is too high: 100 is the most."""
    return _cheap(df, cfg) if cfg.maxdust >= 100 else alignment_filter(df, cfg).drop("dust")
