"""Joins of moments with the intervals of their key that hold them.

An interval's length puts it into a class, whose bins are at least as wide as
its intervals are long, so an interval lies in at most two bins. A moment looks
into one bin per class in use. The join is an equality of key, class and bin:
neither a listing of every day of an interval nor all intervals of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.operators import joins
from storelens.operators.joins import value_bytes

# Bins grow eightfold from class to class, the smallest being 2^36 microseconds (19 hours).
LEAST_BITS, STEP_BITS = 36, 3


def _micros(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp"))


def _bits(length: Column) -> Column:
    """Class of an interval, as the number of bits of its bins; exact for every length."""
    needed = F.greatest(F.length(F.bin(length - 1)), F.lit(LEAST_BITS))
    return (F.ceil((needed - LEAST_BITS) / F.lit(STEP_BITS)) * STEP_BITS + LEAST_BITS).cast("int")


def moments_in_intervals(
    moments: DataFrame,
    intervals: DataFrame,
    keys: list[str],
    moment: str,
    starts: str,
    ends: str,
    first: Column,
    past: Column,
    max_bytes: int | None = None,
) -> DataFrame:
    """Inner join of moments in [first, past) with the intervals of their keys with starts <= moment < ends.

    `first` and `past` are timestamp_ntz constants; moments must lie between
    them. No start or no end is open. Intervals without a part in [first, past)
    meet nothing, nor do null keys. The listed intervals, at most two rows each,
    are weighed and their classes found by one small job; they are broadcast if
    they fit, else both sides are shuffled.
    """
    begin = F.greatest(F.col(starts), first)
    end = F.least(F.coalesce(F.col(ends), past), past)
    own = intervals.where(F.col(starts).isNotNull() & (begin < end))
    bits = _bits(_micros(end) - _micros(begin)).alias("_bits")

    placed = own.select("*", bits, _micros(begin).alias("_from"), (_micros(end) - 1).alias("_to"))
    bins = F.expr("array_distinct(array(shiftright(_from, _bits), shiftright(_to, _bits)))")
    listed = placed.withColumn("_bin", F.explode(bins)).drop("_from", "_to")

    look = placed.agg(F.collect_set("_bits").alias("classes"), F.sum(value_bytes(placed) * 2).alias("size")).first()
    bound = joins.BROADCAST_BYTES if max_bytes is None else max_bytes
    if (look["size"] or 0) <= bound:
        listed = F.broadcast(listed)

    probes = [
        F.struct(F.lit(n).alias("_bits"), F.shiftright(_micros(F.col(moment)), n).alias("_bin")) for n in sorted(look["classes"])
    ]
    none = F.array().cast("array<struct<_bits:int,_bin:bigint>>")
    looking = moments.withColumn("_probe", F.explode(F.array(*probes) if probes else none))
    looking = looking.select(*moments.columns, "_probe._bits", "_probe._bin")
    joined = looking.join(listed, [*keys, "_bits", "_bin"])
    holds = (F.col(starts) <= F.col(moment)) & (F.col(moment) < F.coalesce(F.col(ends), past))
    return joined.where(holds).drop("_bits", "_bin")
