"""Cutting the rows of hot keys into ordered slots.

Rows sorted by key and order columns are cut into ranges of even size. A key
that lies in one range stays whole; one that reaches over several is cut where
the ranges meet. The places come from a sample of bounded size, so nothing is
counted or listed per key, and they are constants of the plan, so a task run
again deals its rows the same way.
"""

from __future__ import annotations

import math
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from storelens.operators import joins

# Ranges at most, and sampled rows for each: what a cut table can hold.
RANGES = 4096
SAMPLED = 16


def cut_table(rows: DataFrame, keys: list[str], order: list[str], floor: int | None = None, count: DataFrame | None = None) -> DataFrame | None:
    """Key columns and `_cuts`, ascending structs of `order`, of the keys that reach over several ranges.

    Ranges have about `floor` rows (HOT_ROWS), or a share of 1 / RANGES where that
    is more; None if all rows fit one range, which one count tells. The count is
    taken over `count`, a frame with about as many rows that is cheaper to read.
    """
    least = max(1, joins.HOT_ROWS if floor is None else floor)
    total = (rows if count is None else count).count()
    ranges = min(RANGES, math.ceil(total / least))
    if ranges <= 1:
        return None
    seen = rows.select(*keys, *order)
    share = min(1.0, ranges * SAMPLED / total)
    sample = (seen if share == 1.0 else seen.sample(share, 7)).orderBy(*keys, *order).collect()
    places = sorted({len(sample) * i // ranges for i in range(1, ranges)}) if sample else []
    listed = []
    for _, own in groupby((sample[i] for i in places), key=lambda r: tuple(r[: len(keys)])):
        own = list(own)
        listed.append((*own[0][: len(keys)], [tuple(r[len(keys) :]) for r in own]))
    fields = list(seen.schema.fields)
    kinds = [StructField(f"_key{i}", f.dataType) for i, f in enumerate(fields[: len(keys)])]
    place = StructType([StructField(f.name, f.dataType) for f in fields[len(keys) :]])
    return rows.sparkSession.createDataFrame(listed, StructType([*kinds, StructField("_cuts", ArrayType(place))]))


def none_reaches(bound: DataFrame, floor: int | None = None) -> bool:
    """Whether no value of the frame's columns has more rows than one range; one aggregate, whose tasks pass on a row a value."""
    least = max(1, joins.HOT_ROWS if floor is None else floor)
    counts = bound.na.drop().groupBy(*bound.columns).agg(F.count(F.lit(1)).alias("_n"))
    return (counts.agg(F.max("_n")).first()[0] or 0) <= least


def slot_counts(cuts: DataFrame, keys: list[str]) -> DataFrame:
    """The cut keys and each of their slots, 0 to the number of cuts; at most 2 * RANGES rows."""
    named = [F.col(f"_key{i}").alias(k) for i, k in enumerate(keys)]
    return cuts.select(*named, F.explode(F.sequence(F.lit(0), F.size("_cuts"))).alias("_slot"))


def with_slot(rows: DataFrame, cuts: DataFrame | None, keys: list[str], order: list[str], only_cut: bool = False) -> DataFrame:
    """Adds `_slot`, the number of cuts of its key that a row stands behind; null for keys without cuts.

    Null keys equal each other. `only_cut` leaves the rows of other keys out.
    """
    if cuts is None:
        found = rows.withColumn("_slot", F.lit(None).cast(IntegerType()))
        return found.where(F.lit(False)) if only_cut else found
    same = _same(keys)
    joined = rows.join(F.broadcast(cuts), same, "inner" if only_cut else "left")
    place = F.struct(*order)
    slot = F.when(F.col("_cuts").isNotNull(), F.size(F.filter("_cuts", lambda cut: cut < place)))
    return joined.withColumn("_slot", slot).drop("_cuts", *(f"_key{i}" for i in range(len(keys))))


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for i, key in enumerate(keys):
        out = out & F.col(key).eqNullSafe(F.col(f"_key{i}"))
    return out
