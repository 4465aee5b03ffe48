"""Moments in intervals against plain loops, broadcast and shuffled."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from storelens.operators.intervals import LEAST_BITS, STEP_BITS, _bits, moments_in_intervals
from storelens.plans import eligibility

FIRST, PAST = dt.datetime(2020, 1, 1), dt.datetime(2024, 1, 1)
SPAN = int((PAST - FIRST).total_seconds())


def joined(moments, intervals, max_bytes=None):
    return moments_in_intervals(
        moments, intervals, ["store"], "at", "begins", "ends", F.lit(FIRST).cast("timestamp_ntz"), F.lit(PAST).cast("timestamp_ntz"), max_bytes
    )


def cases():
    rng = random.Random(11)
    points = [(i, rng.choice([1, 1, 1, 2, None]), FIRST + dt.timedelta(seconds=rng.randrange(SPAN // 3600) * 3600)) for i in range(400)]
    points.append((900, 1, None))
    ranges = []
    for i in range(300):
        length = rng.choice([0, 1, 3600, 86400, 20 * 86400, 400 * 86400, 3000 * 86400])
        begins = FIRST + dt.timedelta(seconds=rng.randrange(-SPAN // 3600, SPAN // 3600) * 3600)
        ranges.append((i, rng.choice([1, 1, 2, 3, None]), begins, rng.choice([begins + dt.timedelta(seconds=length)] * 5 + [None])))
    # On the edge of the window, backwards, and exactly as long as a bin.
    wide = dt.timedelta(microseconds=1 << LEAST_BITS)
    ranges += [(500, 1, PAST, None), (501, 1, FIRST - wide, FIRST), (502, 1, PAST, FIRST), (503, 1, None, PAST), (504, 1, FIRST, FIRST + wide), (505, 2, dt.datetime(1, 1, 1), dt.datetime(9999, 12, 31))]
    return points, ranges


@pytest.mark.parametrize("max_bytes", [None, -1])
def test_equals_plain_loop(spark, max_bytes):
    points, ranges = cases()
    moments = spark.createDataFrame(points, "id bigint, store bigint, at timestamp_ntz").repartition(4)
    intervals = spark.createDataFrame(ranges, "campaign bigint, store bigint, begins timestamp_ntz, ends timestamp_ntz").repartition(3)
    found = joined(moments, intervals, max_bytes)
    assert set(found.columns) == {"id", "store", "at", "campaign", "begins", "ends"}
    wanted = sorted(
        (i, c) for i, s, at in points for c, t, b, e in ranges
        if s is not None and at is not None and s == t and b is not None and b <= at and (e is None or at < e)
    )
    assert sorted((r["id"], r["campaign"]) for r in found.collect()) == wanted and len(wanted) > 1000


@pytest.mark.parametrize("max_bytes", [None, -1])
def test_empty_sides(spark, max_bytes):
    points, ranges = cases()
    moments = spark.createDataFrame(points, "id bigint, store bigint, at timestamp_ntz")
    intervals = spark.createDataFrame(ranges, "campaign bigint, store bigint, begins timestamp_ntz, ends timestamp_ntz")
    assert joined(moments.limit(0), intervals, max_bytes).collect() == []
    assert joined(moments, intervals.limit(0), max_bytes).collect() == []


def test_an_interval_lies_in_two_bins_at_most(spark):
    lengths = sorted({1, 2, *(n + d for n in (1 << b for b in range(30, 57)) for d in (-1, 0, 1))})
    frame = spark.createDataFrame([(n,) for n in lengths], "n bigint").withColumn("bits", _bits(F.col("n")))
    for row in frame.collect():
        assert (1 << row["bits"]) >= row["n"] and (row["bits"] - LEAST_BITS) % STEP_BITS == 0
        assert row["bits"] == LEAST_BITS or (1 << (row["bits"] - STEP_BITS)) < row["n"]


def test_campaigns_are_not_listed_by_day(spark):
    views = spark.createDataFrame([], "view_id string, event_date timestamp_ntz, store_id bigint, consumer_id bigint")
    campaigns = spark.createDataFrame([(1, 1, FIRST, None)], "campaign_id bigint, store_id bigint, starts_at timestamp_ntz, ends_at timestamp_ntz")
    plan = eligibility.with_campaigns(views, campaigns, FIRST, PAST, -1)._jdf.queryExecution().toString()
    assert "sequence(" not in plan and "SortMergeJoin" in plan
