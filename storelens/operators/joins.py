"""Joins that hold when one key owns a large share of the rows.

A side is broadcast only after its size was measured. Beyond the bound the join
shuffles and adaptive execution splits the partitions of hot keys (see the
settings in session.py), so no fact is read beforehand to look for them. Steps
that need all rows of a key in order cut it into slots (see cuts.py).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 * 1024 * 1024

# Rows one task should order.
HOT_ROWS = 1_000_000


def value_bytes(frame: DataFrame) -> Column:
    """Size of a row's values as text, plus 16."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in frame.columns]
    return sum(texts[1:], texts[0]).cast("long") + 16


def measured_bytes(frame: DataFrame) -> int:
    """Size of all values as text, plus 16 bytes a row. Runs one aggregate job."""
    return frame.agg(F.coalesce(F.sum(value_bytes(frame)), F.lit(0))).first()[0]


def fits_broadcast(frame: DataFrame, max_bytes: int | None = None) -> bool:
    return measured_bytes(frame) <= (BROADCAST_BYTES if max_bytes is None else max_bytes)


def row_part(columns: list[str], pieces: Column) -> Column:
    """A part number that a rerun of the same task gives again.

    The task number is hashed too, so equal rows read by different tasks part.
    """
    return F.pmod(F.xxhash64(*columns, F.spark_partition_id()), pieces)


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi join (inner, left, left_semi, left_anti) of keys of one type.

    The left side's hot partitions are split, and their partners repeated, by
    adaptive execution once it has seen the shuffle.
    """
    kinds = [[dict(side.dtypes)[key] for key in on] for side in (left, right)]
    if kinds[0] != kinds[1]:
        raise ValueError(f"join keys {on} have types {kinds[0]} and {kinds[1]}")
    return left.join(right, on, how)


def guarded_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    max_bytes: int | None = None,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Broadcasts `right` when its measured size allows it, else shuffles.

    `bound` is a frame at least as large as `right` that is cheaper to measure.
    """
    if fits_broadcast(right if bound is None else bound, max_bytes):
        return left.join(F.broadcast(right), on, how)
    return skew_join(left, right, on, how)


def distinct_keys(members: DataFrame, key: str) -> DataFrame:
    return members.select(key).where(F.col(key).isNotNull()).distinct()


@dataclass(frozen=True)
class Cohort:
    """Keys of some members, never null, and whether they were found small enough to broadcast."""

    keys: DataFrame
    key: str
    small: bool


def cohort(members: DataFrame, key: str, max_bytes: int | None = None) -> Cohort:
    """Measures the members once, for all joins with them."""
    keys = members.select(key).where(F.col(key).isNotNull())
    return Cohort(keys, key, fits_broadcast(keys, max_bytes))


def in_cohort(facts: DataFrame, members: Cohort) -> DataFrame:
    """Facts whose key is among the members; never repeats a fact."""
    if members.small:
        return facts.join(F.broadcast(members.keys), members.key, "left_semi")
    return skew_join(facts, members.keys.distinct(), [members.key], "left_semi")


def mark_cohort(facts: DataFrame, members: Cohort, flag: str) -> DataFrame:
    """All facts with a boolean column telling whether the key is among the members."""
    marked = members.keys.distinct().withColumn(flag, F.lit(True))
    if members.small:
        joined = facts.join(F.broadcast(marked), members.key, "left")
    else:
        joined = skew_join(facts, marked, [members.key], "left")
    return joined.withColumn(flag, F.coalesce(flag, F.lit(False)))
