"""Scalars, report blocks, role casting and the query log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from role_frames import metrics

from storelens.functions import scalars as s
from storelens.operators.metrics import metric_rows, optional_in, union_all
from storelens.plans.history import history_by_user
from storelens.sources.roles import conform


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_safe_ratio(spark):
    assert value(spark, s.safe_ratio(F.lit(1), F.lit(4))) == 0.25
    assert value(spark, s.safe_ratio(F.lit(1), F.lit(0))) == 0.0
    assert value(spark, s.safe_ratio(F.lit(None).cast("int"), F.lit(0))) is None
    assert value(spark, s.safe_ratio(F.lit(1), F.lit(None).cast("int"))) is None


def test_search_label_and_surface(spark):
    none = F.lit(None).cast("string")
    assert value(spark, s.search_label(F.lit(" Taco "), F.lit("X"))) == "Taco"
    assert value(spark, s.search_label(F.lit("  "), F.lit("X"))) == ""
    assert value(spark, s.search_label(none, F.lit(" LUNCH"))) == " lunch"
    assert value(spark, s.product_surface(none)) == "carousel"
    assert value(spark, s.product_surface(F.lit(""))) == "search"


def test_optional_list(spark):
    frame = spark.range(4)
    assert optional_in(frame, "id", []).count() == 4
    assert optional_in(frame, "id", [1, 9]).count() == 1
    none = F.array().cast("array<bigint>")
    assert frame.where(s.in_optional_list("id", none)).count() == 4
    assert frame.where(s.in_optional_list("id", F.array(F.lit(2).cast("bigint")))).count() == 1


def test_windows_are_pushed_to_the_scan(spark, tmp_path):
    frame = spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "t timestamp_ntz")
    frame.write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    for condition in (s.day_window("t", "2024-01-01", "2024-01-02"), s.date_part_between("t", "2024-01-01", "2024-01-02")):
        plan = read.where(condition)._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(t," in plan and "LessThan(t," in plan
        assert read.where(condition).count() == 1


def test_overlap(spark):
    def day(n):
        return F.lit(dt.date(2024, 1, n))

    none = F.lit(None).cast("date")
    first, last, active = s.overlap([day(1), day(3)], [day(9), none])
    assert (value(spark, first), value(spark, last), value(spark, active)) == (dt.date(2024, 1, 3), dt.date(2024, 1, 9), True)
    assert value(spark, s.overlap([day(1), day(5)], [day(5), day(9)])[2]) is False
    assert value(spark, s.overlap([day(1)], [none])[2]) is True


def test_zone_time_and_query_text(spark):
    summer = F.lit(dt.datetime(2024, 7, 1, 5)).cast("timestamp_ntz")
    assert value(spark, s.zone_time(summer, "America/Los_Angeles")) == dt.datetime(2024, 6, 30, 22)
    assert value(spark, s.normalised_query(F.lit("  Café--au  LAIT! "))) == "café au lait"
    assert value(spark, s.normalised_query(F.lit("हिन्दी, text"))) == "हिन्दी text"


def test_metric_rows_share_one_pass(spark):
    summary = spark.range(3).agg(F.count("id").alias("n"), F.sum("id").alias("s"))
    rows = metric_rows(summary, "v", [("n", F.col("n")), ("ratio", s.safe_ratio("s", "n"))])
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Range") == 1
    assert metrics(rows) == {"n": 3.0, "ratio": 1.0}


def test_union_all(spark):
    assert union_all([spark.range(2), spark.range(2), spark.range(1)]).count() == 5


def test_conform_casts_keys(spark):
    raw = spark.createDataFrame([("12", "n/a", "7"), ("x", "3", None)], "store_id string, business_id string, name string")
    rows = conform(raw, "stores").collect()
    assert [tuple(r) for r in rows] == [(12, None, "7"), (None, 3, None)]


def test_history_by_user(spark):
    since, until = dt.datetime(2019, 5, 4, 3, 2), dt.datetime(2019, 6, 1, 0, 30)
    rows = [
        ("ANN", since, "first"),
        ("ANN", until, "last"),
        ("ANN", since - dt.timedelta(microseconds=1), "early"),
        ("ANN", until + dt.timedelta(microseconds=1), "late"),
        ("BOB", since, "other"),
        ("ANN", dt.datetime(2019, 5, 20), "middle"),
    ]
    bounds = ("2019-05-04 05:02:00 +0200", "2019-05-31 19:30:00 -0500")
    for kind in ("timestamp_ntz", "timestamp"):
        log = spark.createDataFrame(rows, "user_name string, end_time timestamp_ntz, query_text string")
        log = log.withColumn("end_time", F.col("end_time").cast(kind))
        found = history_by_user(log, "ANN", *bounds).collect()
        assert [r["query_text"] for r in found] == ["last", "middle", "first"]
