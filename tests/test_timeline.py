"""Ordered operations against plain loops, with and without cut timelines."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from storelens.operators import timeline
from storelens.operators.cuts import cut_table, with_slot
from storelens.operators.timeline import last_before, running_numbers, validity_ranges

BASE = dt.datetime(2024, 1, 1)
FLOORS = [None, 0]


def moments(rng, n, keys):
    """Times on a coarse grid, so that ties within and across the sides are common."""
    return [
        (rng.choice(keys), rng.choice([1, 2]), BASE + dt.timedelta(minutes=20 * rng.randrange(60)), i)
        for i in range(n)
    ]


@pytest.mark.parametrize("floor", FLOORS)
@pytest.mark.parametrize("inclusive", [False, True])
def test_last_before(spark, floor, inclusive):
    rng = random.Random(5)
    left = moments(rng, 150, [1, 1, 1, 2, 3, None]) + [(1, 1, None, 900)]
    right = moments(rng, 80, [1, 1, 2, 4, None]) + [(1, 1, None, 901)]
    schema = "a bigint, b bigint, {t} timestamp_ntz, {i} bigint"
    result = last_before(
        spark.createDataFrame(left, schema.format(t="seen", i="view")).repartition(5),
        spark.createDataFrame(right, schema.format(t="done", i="act")).repartition(5),
        ["a", "b"],
        "seen",
        "done",
        ["act"],
        inclusive=inclusive,
        floor=floor,
        heat=spark.createDataFrame(left, schema.format(t="seen", i="view")) if inclusive else None,
    ).collect()
    expected = {}
    for a, b, seen, view in left:
        earlier = [
            (done, act)
            for a2, b2, done, act in right
            if None not in (a, a2, seen, done)
            and (a, b) == (a2, b2)
            and (done < seen or (inclusive and done == seen))
        ]
        expected[view] = max(earlier, default=None)
    assert len(result) == len(left)
    assert {r["view"]: r["last"] and tuple(r["last"]) for r in result} == expected


@pytest.mark.parametrize("floor", FLOORS)
def test_running_numbers(spark, floor):
    rows = moments(random.Random(8), 200, [1, 1, 1, 2, 3])
    frame = spark.createDataFrame(rows, "owner bigint, shop bigint, at timestamp_ntz, id bigint").repartition(5)
    result = running_numbers(
        frame, "owner", {"in_shop": ["shop"], "overall": []}, "at", ["id"], next_time="then", floor=floor
    )
    assert result.columns == ["owner", "shop", "at", "id", "in_shop", "overall", "then"]
    ordered = sorted(rows, key=lambda r: (r[2], r[3]))
    expected = {}
    for owner, shop, at, id_ in rows:
        mine = [r for r in ordered if r[0] == owner]
        shops = [r[3] for r in mine if r[1] == shop]
        overall = [r[3] for r in mine].index(id_)
        then = mine[overall + 1][2] if overall + 1 < len(mine) else None
        expected[id_] = (shops.index(id_) + 1, overall + 1, then)
    assert {r["id"]: (r["in_shop"], r["overall"], r["then"]) for r in result.collect()} == expected


@pytest.mark.parametrize("floor", FLOORS)
def test_validity_ranges(spark, floor):
    hours = [0, 0.5, 0.5, 3, 30]
    rows = [(1, BASE + dt.timedelta(hours=h), i) for i, h in enumerate(hours)] + [(2, BASE, 9)]
    frame = spark.createDataFrame(rows, "id bigint, updated timestamp_ntz, v int")
    result = validity_ranges(frame, "id", "updated", ["v"], floor=floor).orderBy("id", "v").collect()
    assert [r["version_number"] for r in result] == [1, 2, 3, 4, 5, 1]
    times = [r[1] for r in rows[:5]]
    assert [r["valid_to"] for r in result] == times[1:] + [None, None]
    assert [r["is_current"] for r in result] == [False] * 4 + [True, True]
    assert all(r["valid_from"] == r["updated"] for r in result)


def test_one_owner_and_one_instant_are_numbered_by_several_tasks(spark):
    """A hot owner's rows at one instant and without a time lie in several ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check_one_owner(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def check_one_owner(spark):
    frame = spark.range(4000).select(
        F.lit(1).cast("bigint").alias("owner"),
        F.when(F.col("id") % 2 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("at"),
        "id",
    ).repartition(5)
    found = running_numbers(frame, "owner", {"n": []}, "at", ["id"], next_time="then", floor=100)
    parts = found.withColumn("task", F.spark_partition_id())
    assert parts.where("at is null").select("task").distinct().count() > 1
    assert parts.where("at is not null").select("task").distinct().count() > 1
    rows = sorted(found.collect(), key=lambda r: r["n"])
    assert [r["n"] for r in rows] == list(range(1, 4001))
    assert [r["id"] for r in rows] == [*range(1, 4000, 2), *range(0, 4000, 2)]


def task_counts(frame, where):
    parts = frame.withColumn("task", F.spark_partition_id()).where(where)
    return [r["count"] for r in parts.groupBy("task").count().collect()]


@pytest.mark.parametrize("inclusive", [False, True])
def test_a_hot_key_and_a_hot_instant_lie_in_several_tasks(spark, inclusive):
    """One key has almost all rows, a third of them at one instant; acts lie around and at it."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        at = F.when(F.col("id") % 3 == 0, F.lit(5000)).otherwise(F.col("id"))
        moment = F.timestamp_add("SECOND", at, F.lit(BASE).cast("timestamp_ntz"))
        left = spark.range(9000).select(F.lit(1).cast("bigint").alias("k"), moment.alias("seen"), "id").union(
            spark.range(9000, 9040).select("id", F.lit(BASE).cast("timestamp_ntz"), "id")
        ).repartition(5)
        acts = [(1, BASE + dt.timedelta(seconds=s), s) for s in (0, 1, 3000, 4999, 5000, 5000, 5001, 8000)] + [(9000, BASE, 1)]
        right = spark.createDataFrame(acts, "k bigint, done timestamp_ntz, act bigint")
        found = last_before(left, right, ["k"], "seen", "done", ["act"], inclusive=inclusive, floor=300)
        instant = F.col("seen") == F.lit(BASE + dt.timedelta(seconds=5000)).cast("timestamp_ntz")
        assert len(task_counts(found, instant)) > 2 and max(task_counts(found, F.col("k") == 1)) < 5000
        plain = last_before(left, right, ["k"], "seen", "done", ["act"], inclusive=inclusive)
        assert "Broadcast" not in plain._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("floor, looked", [(None, False), (400, False), (100, True)])
def test_sides_whose_bound_fits_a_range_are_not_looked_at(spark, monkeypatch, floor, looked):
    """The bound counts by one of two keys; 200 rows of a value reach over a range of 100. Null keys count for nothing."""
    seen = []
    monkeypatch.setattr(timeline, "cut_table", lambda *a, **k: seen.append(a) or cut_table(*a, **k))
    at = F.timestamp_add("SECOND", F.col("id"), F.lit(BASE).cast("timestamp_ntz"))
    key = F.when(F.col("id") < 1000, F.col("id") % 10)
    left = spark.range(1800).select(key.alias("k"), F.lit(1).alias("m"), at.alias("seen"), "id")
    right = spark.range(1400).select(key.alias("k"), F.lit(1).alias("m"), at.alias("done"))
    bound = left.select("k").unionByName(right.select("k"))
    found = last_before(left, right, ["k", "m"], "seen", "done", floor=floor, bound=bound)
    plain = last_before(left, right, ["k", "m"], "seen", "done")
    assert (len(seen) == 2) == looked
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))


def test_next_time_is_that_of_the_next_row_also_without_a_time(spark):
    frame = spark.range(300).select(
        (F.col("id") % 2).alias("owner"), F.when(F.col("id") % 5 > 1, F.timestamp_add("SECOND", F.col("id"), F.lit(BASE).cast("timestamp_ntz"))).alias("at"), "id"
    ).repartition(3)
    plain, cut = (
        sorted(map(str, running_numbers(frame, "owner", {"n": []}, "at", ["id"], next_time="then", floor=floor).collect())) for floor in (None, 10)
    )
    assert plain == cut


def test_keys_that_fit_a_range_are_not_cut(spark):
    rows = spark.range(2000).select(F.when(F.col("id") < 1000, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id")
    cuts = cut_table(rows, ["k"], ["id"], floor=100)
    listed = {r["_key0"]: r["_cuts"] for r in cuts.collect()}
    assert 5 <= len(listed[-1]) <= 10 and all(len(c) == 1 for k, c in listed.items() if k != -1)
    slots = with_slot(rows, cuts, ["k"], ["id"]).where("k = -1").groupBy("_slot").count().collect()
    assert len(slots) == len(listed[-1]) + 1 and max(r["count"] for r in slots) < 300
    assert cut_table(rows, ["k"], ["id"]) is None and cut_table(rows.limit(0), ["k"], ["id"], floor=0) is None
