"""Measures a consumer derives from summary rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def standard_error(field: str) -> Column:
    """Standard error of the mean of ``field``: ``stdev / sqrt(count)``."""
    return F.col(f"`stdev_{field}`") / F.sqrt(F.col("count"))


def reduction_factor(summary: DataFrame, n_statistics: int, by: tuple[str, ...] = ()) -> DataFrame:
    """How many times fewer values are stored than came in.

    ``R = window_size * f_in / N``; over many windows that is the number of
    messages divided by (summary rows x statistics per row).
    """
    if n_statistics < 1:
        raise ValueError("n_statistics must be at least 1.")
    ratio = F.sum("count") / (F.count(F.lit(1)) * F.lit(float(n_statistics)))
    return summary.groupBy(*by).agg(ratio.alias("reduction_factor"))


def expected_reduction_factor(window_size_seconds: float, frequency_hz: float, n_statistics: int) -> float:
    """The same ratio for a steady input of ``frequency_hz``."""
    return window_size_seconds * frequency_hz / n_statistics
