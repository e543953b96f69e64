"""Statistics of descriptions over event-time windows: the sums are a monoid, so a stream adds them up window by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_statistics(df: DataFrame, time: str, window: str, target, descriptions: list, watermark: str = "10 minutes") -> DataFrame:
    """window, and size and positives of each description of a binary target; for batch and streaming tables alike."""
    rows = target.inputs(df).withWatermark(time, watermark)
    covers = [d.column() for d in descriptions]
    sums = [a.alias(f"{k}_{i}") for i, c in enumerate(covers) for k, a in target.aggregates(c).items()]
    return rows.groupBy(F.window(time, window)).agg(F.count("*").alias("rows"), *sums)
