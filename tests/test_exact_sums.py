"""Sums of amounts have the same bits whatever the order and the partitions."""

from __future__ import annotations

import datetime as dt
import random
from fractions import Fraction

import pytest
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F
from role_frames import metrics, role_tables

from storelens.functions.scalars import exact_sum
from storelens.plans import ads, fees, overview
from storelens.sources.roles import conform

NOON = dt.datetime(2024, 3, 1, 12)
# Sums of such amounts as doubles differ with the order: the large one swallows cents of the small ones.
AMOUNTS = [random.Random(i).choice([0.01, 0.1, 0.07, 33.33, 9_007_199_254.74, 123_456_789.123456]) for i in range(3000)]


def exactly(amounts) -> float:
    return float(sum(Fraction(str(a)) for a in amounts))


def dealt(frame, n):
    return frame.repartition(n, F.xxhash64("n", F.lit(n)))


@pytest.mark.parametrize("n", [1, 8, 211])
def test_the_same_bits_from_any_partitions(spark, n):
    rows = [{"store_id": i % 7, "consumer_id": i % 50, "ads_fee": a, "promotion_fee": a, "created_at": NOON} for i, a in enumerate(AMOUNTS)]
    orders = [
        {"delivery_id": str(i), "store_id": i % 7, "business_id": 9, "creator_id": i, "subtotal": a, "created_at": NOON}
        for i, a in enumerate(AMOUNTS)
    ]
    tables = role_tables(
        spark,
        stores=[{"store_id": s, "business_id": 9 if s < 4 else 8, "name": "x"} for s in range(7)],
        availability=[{"store_id": 1, "consumer_id": c} for c in range(25)],
        ad_fees=rows,
        promo_fees=rows,
        deliveries=orders,
    )
    for role in ("ad_fees", "promo_fees", "deliveries"):
        frame = getattr(tables, role)
        setattr(tables, role, dealt(frame.withColumn("n", F.monotonically_increasing_id()), n).drop("n"))
    days = ("2024-03-01", "2024-03-01")
    assert overview.business_overview(tables, 9, *days).first()["sales"] == exactly(AMOUNTS) / 100
    reach = exactly(a for i, a in enumerate(AMOUNTS) if i % 50 < 25) / 100
    brand = exactly(a for i, a in enumerate(AMOUNTS) if i % 7 < 4) / 100
    rival = exactly(a for i, a in enumerate(AMOUNTS) if i % 7 >= 4) / 100
    for report in (fees.ads_fee_share, fees.promo_fee_share):
        assert list(metrics(report(tables, 9, [8], *days)).values()) == [reach, brand, rival]
    for report in (fees.ads_fee_per_store, fees.promo_fee_per_store):
        assert list(metrics(report(tables, 9, [8], *days)).values()) == [reach / 7, brand / 4, rival / 3]


@pytest.mark.parametrize("n", [1, 8, 211])
def test_measures_have_the_same_bits(spark, n):
    rows = [(i, a, NOON + dt.timedelta(days=i % 5), i % 3) for i, a in enumerate(AMOUNTS)]
    rows = dealt(spark.createDataFrame(rows, "n long, sales double, at timestamp_ntz, k long"), n)
    day = dt.date(2024, 3, 1)
    part = rows.select(F.lit(1).alias("campaign_id"), F.lit(day).alias("day"), "sales", F.col("sales").alias("cost"), F.lit(1).alias("orders"))
    found = ads.campaign_performance([part]).first()
    assert (found["sales"], found["cost"], found["orders"]) == (exactly(AMOUNTS), exactly(AMOUNTS), 3000)
    assert found["aov"] == exactly(AMOUNTS) / 3000

    orders = rows.select(F.col("n").alias("delivery_id"), F.lit(day).alias("active_date"), F.lit("c").alias("cohort"), "sales")
    none = orders.select("delivery_id").limit(0)
    assert ads.attached_orders(orders, none, none, none).first()["store_sales"] == exactly(AMOUNTS)

    deliveries = rows.select(
        F.lit(1).alias("store_id"), F.col("k").alias("consumer_id"), F.col("at").alias("created_at"),
        F.col("n").alias("delivery_id"), F.col("sales").alias("subtotal"),
    )
    first = ads.reorder_retention(deliveries).where(F.col("active_date") == F.lit(day)).first()
    assert first["sales"] == exactly(a for i, a in enumerate(AMOUNTS) if i % 5 == 0)
    assert first["reorder_sales_30"] == exactly(a for i, a in enumerate(AMOUNTS) if i % 5)


def test_odd_amounts(spark):
    def total(values, kind="double"):
        return spark.createDataFrame([(v,) for v in values], f"a {kind}").agg(exact_sum("a").alias("s")).first()["s"]

    assert total([]) is None and total([None]) is None
    assert float(total([None, 0.1, 0.2])) == 0.3
    assert float(total([float("nan"), 1.5, float("inf"), -float("inf")])) == 1.5
    assert float(total([0.0000004, 0.0000006])) == 0.000001
    assert float(total([999_999_999_999.0] * 1000)) == 999_999_999_999_000.0
    with pytest.raises(ArithmeticException, match="NUMERIC_VALUE_OUT_OF_RANGE"):
        total([1e12])


def test_decimals_of_the_raw_table_stay(spark):
    raw = spark.createDataFrame([(1, 2, "9007199254740993.01")], "store_id int, consumer_id int, fee string").select(
        "store_id", "consumer_id", F.col("fee").cast("decimal(38,2)").alias("ads_fee"), F.lit(NOON).cast("timestamp_ntz").alias("created_at")
    )
    kinds = dict(conform(raw, "ad_fees").dtypes)
    assert kinds["ads_fee"] == "decimal(38,2)" and kinds["store_id"] == "bigint"
