"""Run totals of a plan, counted in the pass that makes its statistics.

Each figure is an observed aggregate of a table of the plan: of the records read, of the alignments that pass the row
filters, of the groups before the group filters, and of the result. They are there once the result has been written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Counters:
    """on=False observes nothing."""

    def __init__(self, on: bool = False):
        self.on, self.observed = on, {}

    def _watch(self, df: DataFrame, name: str, figures: dict[str, Column]) -> DataFrame:
        if not self.on:
            return df
        self.observed[name] = Observation()
        return df.observe(self.observed[name], *[F.coalesce(c, F.lit(0)).cast("long").alias(k) for k, c in figures.items()])

    def records(self, df: DataFrame) -> DataFrame:
        return self._watch(df, "records", {"records": F.count(F.lit(1))})

    def passed(self, df: DataFrame) -> DataFrame:
        return self._watch(df, "passed", {"alns": F.count(F.lit(1))})

    def groups(self, df: DataFrame) -> DataFrame:
        return self._watch(df, "groups", {"reads": F.sum("num_reads")})

    def kept(self, df: DataFrame, sums: dict[str, str]) -> DataFrame:
        return self._watch(df, "kept", {"groups": F.count(F.lit(1)), **{f"passed_{k}": F.sum(c) for k, c in sums.items()}})

    def totals(self) -> dict[str, int]:
        """All figures; waits for the result to be written."""
        return {k: n for one in self.observed.values() for k, n in one.get.items()}
