"""Small report building blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metric_rows(summary: DataFrame, value: str, metrics: Sequence[tuple[str, Column]]) -> DataFrame:
    """One labelled row per metric from a one-row summary.

    The summary is computed once; a union of one branch per metric would compute
    it once per branch. Values are double, so counts and ratios share a column.
    """
    pairs = [
        F.struct(F.lit(label).alias("metric"), column.cast("double").alias(value))
        for label, column in metrics
    ]
    return summary.select(F.inline(F.array(*pairs)))


def optional_in(frame: DataFrame, column: str, wanted: Sequence) -> DataFrame:
    """Rows whose column is in the list; all rows when the list is empty."""
    return frame.where(F.col(column).isin(list(wanted))) if wanted else frame


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result
