"""Thresholds shared by the statistics plans."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class StatConfig:
    """minalnas None means no score threshold; minmani is a percentage (0 to 100)."""

    minreads: int = 1
    minreflen: int = 0
    minmani: float = 0.0
    minalnas: int | None = None
    maxdust: int = 100
    ksize: int = 17
    rank: str = "genus"
