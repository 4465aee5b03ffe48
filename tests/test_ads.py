"""Ad measures on small frames, the shuffled paths included."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from storelens.plans import ads
from storelens.sources import star

T0 = dt.datetime(2024, 1, 1, 10)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def listed(frame):
    return sorted([tuple(r) for r in frame.collect()], key=str)


def test_dedup_keeps_the_first_received(spark):
    rows = [("a", 3, "z"), ("a", 1, "y"), ("a", 1, "x"), ("b", 2, None), ("b", 2, None)]
    frame = spark.createDataFrame(rows, "id string, received int, v string")
    result = ads.dedup_events(frame, "id", "received")
    assert result.columns == frame.columns
    assert listed(result) == [("a", 1, "x"), ("b", 2, None)]


def test_dedup_keeps_rows_without_key_and_puts_missing_times_last(spark):
    rows = [(None, 1, "p"), (None, 1, "p"), ("a", None, "q"), ("a", 5, "r"), ("b", None, "s")]
    frame = spark.createDataFrame(rows, "id string, received int, v string")
    found = sorted(map(str, map(tuple, ads.dedup_events(frame, "id", "received").collect())))
    assert found == sorted(map(str, [(None, 1, "p"), (None, 1, "p"), ("a", 5, "r"), ("b", None, "s")]))


@pytest.mark.parametrize("floor", [None, 0])
def test_order_sequence_and_acquired(spark, floor):
    rows = [
        (1, 7, 1, 10, 100, 5, at(0), 1.0),
        (2, 7, 2, 10, 100, 5, at(60), 1.0),
        (3, 7, 1, 10, 100, 5, at(200), 1.0),
        (4, 7, 3, 11, 100, 6, at(300), 1.0),
        (5, 8, 1, 10, 100, 5, at(10), 1.0),
    ]
    schema = (
        "delivery_id bigint, consumer_id bigint, store_id bigint, business_id bigint, business_group_id bigint, "
        "campaign_id bigint, created_at timestamp_ntz, subtotal double"
    )
    numbered = ads.order_sequence(spark.createDataFrame(rows, schema), floor=floor)
    names = ["delivery_id", "store_cx_rn", "business_cx_rn", "business_group_cx_rn", "cx_rn"]
    assert listed(numbered.select(*names)) == [
        (1, 1, 1, 1, 1),
        (2, 1, 2, 2, 2),
        (3, 2, 3, 3, 3),
        (4, 1, 1, 4, 4),
        (5, 1, 1, 1, 1),
    ]
    day = T0.date()
    members = spark.createDataFrame([(7, day), (7, day), (8, day - dt.timedelta(days=1))], "consumer_id bigint, day date")
    assert listed(ads.consumers_acquired(numbered, members)) == [(5, day, 2, 0, 2, 1, 0), (6, day, 1, 0, 1, 1, 0)]
    later = ads.consumers_acquired(numbered.where("delivery_id = 3"), members)
    assert listed(later) == [(5, day, 0, 1, 1, 0, 1)]


def test_reorder_retention(spark):
    days = [0, 30, 31, 100]
    rows = [(i, 1, 7, T0 + dt.timedelta(days=d), 10.0) for i, d in enumerate(days)]
    rows += [(9, 1, 8, T0, 5.0), (10, 1, 8, T0 + dt.timedelta(hours=1), 5.0)]
    schema = "delivery_id bigint, store_id bigint, consumer_id bigint, created_at timestamp_ntz, subtotal double"
    result = ads.reorder_retention(spark.createDataFrame(rows, schema))
    first = result.where(F.col("active_date") == T0.date()).first().asDict()
    assert (first["cxs"], first["deliveries"], first["sales"]) == (2, 3, 20.0)
    assert [first[f"reorder_deliv_{n}"] for n in ("30", "60", "90", "since")] == [1, 2, 2, 3]
    assert [first[f"reorder_sales_{n}"] for n in ("30", "60", "90", "since")] == [10.0, 20.0, 20.0, 30.0]
    assert [first[f"cx_reordered_{n}"] for n in ("30", "60", "90", "since")] == [1, 1, 1, 1]
    assert first["reorder_rate_since"] == 1.0 and first["cx_reordered_30_rate"] == 0.5


def test_histories_are_dealt_out_by_rows(spark, monkeypatch):
    """3,000 rows at 100 to a task are 30 tasks, whatever their bytes; results are the same, also for a hot pair and nulls."""
    frame = spark.range(3000).select(
        F.col("id").alias("delivery_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("store_id"),
        F.when(F.col("id") % 5 > 0, F.when(F.col("id") < 900, F.lit(1)).otherwise(F.col("id") % 40)).alias("consumer_id"),
        F.timestamp_add("HOUR", (F.col("id") * 37 % 4000).cast("int"), F.lit(T0).cast("timestamp_ntz")).alias("created_at"),
        (F.col("id") % 11).cast("double").alias("subtotal"),
    )
    plain = listed(ads.reorder_retention(frame))
    monkeypatch.setattr(ads, "RETENTION_ROWS", 100)
    for heat in (None, spark.range(3000)):
        dealt = ads.reorder_retention(frame, heat=heat)
        assert "hashpartitioning(store_id" in (plan := dealt._jdf.queryExecution().toString()) and ", 30), REPARTITION_BY_NUM" in plan
        assert listed(dealt) == plain


def test_lines_of_orders_are_dealt_out_by_rows(spark, monkeypatch):
    tables = star.StarTables(spark, "/root/testdata/sf0.001")
    plain = listed(tables.numbered_orders)
    monkeypatch.setattr(star, "SUMMED_ROWS", 500)
    dealt = star.StarTables(spark, "/root/testdata/sf0.001").numbered_orders
    tasks = -(-tables.raw("lineitem").count() // 500)
    assert f", {tasks}), REPARTITION_BY_NUM" in dealt._jdf.queryExecution().toString() and tasks > 5
    assert listed(dealt) == plain


def test_view_to_conversion(spark):
    views = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c"), (None, "d")], "impression_event_id bigint, s string")
    clicks = spark.createDataFrame(
        [(11, 1, at(5)), (12, 1, at(3)), (12, 1, at(3)), (13, 2, at(1)), (14, None, at(1))],
        "click_event_id bigint, impression_event_id bigint, click_timestamp timestamp_ntz",
    )
    orders = spark.createDataFrame(
        [(21, 11, at(9)), (22, 11, at(8)), (23, None, at(1))],
        "delivery_id bigint, click_event_id bigint, order_timestamp timestamp_ntz",
    )
    carts = spark.createDataFrame([(12,), (12,), (None,)], "click_event_id bigint")
    result = ads.view_to_conversion(views, clicks, carts, orders)
    picked = result.select("impression_event_id", "is_clicked", "click_event_id", "is_added_to_cart", "is_converted", "delivery_id")
    assert listed(picked) == sorted(
        [(1, 1, 12, 1, 1, 22), (1, 1, 12, 1, 1, 22), (2, 1, 13, 0, 0, None), (3, 0, None, 0, 0, None), (None, 0, None, 0, 0, None)],
        key=str,
    )


def test_clicks_without_id_are_clicks(spark):
    views = spark.createDataFrame([(1,)], "impression_event_id bigint")
    clicks = spark.createDataFrame([(None, 1, at(5))], "click_event_id bigint, impression_event_id bigint, click_timestamp timestamp_ntz")
    carts = spark.createDataFrame([(None,)], "click_event_id bigint")
    orders = spark.createDataFrame([(9, None, at(6))], "delivery_id bigint, click_event_id bigint, order_timestamp timestamp_ntz")
    row = ads.view_to_conversion(views, clicks, carts, orders).first()
    assert (row["is_clicked"], row["is_added_to_cart"], row["is_converted"], row["click_timestamp"]) == (1, 0, 0, at(5))


def test_request_funnel(spark):
    def stage(rows, key, parent):
        return spark.createDataFrame(rows, f"{key} string, {parent} string")

    result = ads.request_funnel(
        spark.createDataFrame([("r1", "home"), ("r2", "home"), ("r2", "home"), ("r3", "list")], "request_id string, product_surface string"),
        stage([("a1", "r1"), ("a2", "r1"), ("a2", "r1"), ("a3", "r3"), ("a4", "gone")], "auction_id", "request_id"),
        stage([("i1", "a1"), ("i2", "a2"), ("i3", "a3"), ("i4", None)], "impression_id", "auction_id"),
        stage([("c1", "i1"), ("c2", "i1"), ("c3", "i4")], "click_id", "impression_id"),
        stage([("d1", "c2"), ("d2", "c3")], "delivery_id", "click_id"),
    )
    assert result.columns == ["product_surface", "requests", "auctions_won", "impressions", "clicks", "orders"]
    assert listed(result) == [("home", 2, 2, 2, 2, 1), ("list", 1, 1, 1, 0, 0)]


@pytest.mark.parametrize("floor", [None, 0])
def test_last_click_attribution(spark, floor):
    orders = spark.createDataFrame(
        [(1, 7, 1, at(100)), (2, 7, 1, at(30)), (3, 7, 2, at(100)), (4, 7, 1, at(2000))],
        "delivery_id bigint, consumer_id bigint, store_id bigint, ordered_at timestamp_ntz",
    )
    clicks = spark.createDataFrame(
        [(7, 1, at(10), 50), (7, 1, at(30), 51), (7, 1, at(30), 52), (8, 2, at(90), 53)],
        "consumer_id bigint, store_id bigint, clicked_at timestamp_ntz, click_id bigint",
    )
    result = ads.last_click_attribution(orders, clicks, 24, floor=floor)
    picked = result.select("delivery_id", "click_id", "lag_minutes", "lag_hours", "is_attributed")
    assert listed(picked) == [(1, 52, 70, 1, 1), (2, 52, 0, 0, 1), (3, None, None, None, 0), (4, None, None, None, 0)]


def test_campaign_performance(spark):
    views = spark.createDataFrame([(1, "d", 1), (1, "d", 1), (2, "d", 1)], "campaign_id int, day string, impressions int")
    clicks = spark.createDataFrame([(1, "d", 1, 0.5)], "campaign_id int, day string, clicks int, cost double")
    orders = spark.createDataFrame([(1, "d", 1, 8.0)], "campaign_id int, day string, orders int, sales double")
    rows = listed(ads.campaign_performance([views, clicks, orders]))
    assert rows == [(1, "d", 2, 1, 1, 8.0, 0.5, 0.5, 1.0, 8.0, 0.5, 16.0), (2, "d", 1, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]


def test_top_list_ranks_in_the_tasks_before_the_shuffle(spark):
    rows = [("g", i) for i in "aaabbbccdef"] + [("h", "z"), ("h", None)]
    result = ads.top_list(spark.createDataFrame(rows, "g string, item string"), "g", "item", 3)
    assert listed(result) == [("g", ["a", "b", "c"]), ("h", ["z"])]
    assert "WindowGroupLimit" in result._jdf.queryExecution().executedPlan().toString()


def test_attached_orders(spark):
    deliveries = spark.createDataFrame(
        [(1, "d", "x", 5.0), (2, "d", "x", 7.0), (3, "d", "y", 1.0)],
        "delivery_id int, active_date string, cohort string, sales double",
    )
    marks = spark.createDataFrame([(1,), (1,), (9,)], "delivery_id int")
    promos = spark.createDataFrame([(1,), (2,)], "delivery_id int")
    banners = spark.createDataFrame([(3,), (None,)], "delivery_id int")
    result = ads.attached_orders(deliveries, marks, promos, banners)
    assert listed(result) == [("d", "x", 2, 12.0, 1, 2, 2, 0), ("d", "y", 1, 1.0, 0, 0, 0, 1)]


def test_attached_orders_without_day_or_id_and_repeated(spark):
    deliveries = spark.createDataFrame(
        [(1, None, "x", 5.0), (None, "d", "x", 7.0), (None, "d", "x", 1.0), (2, "d", "a", 9.0), (2, "d", "b", 2.0)],
        "delivery_id int, active_date string, cohort string, sales double",
    )
    marks = spark.createDataFrame([(1,), (None,)], "delivery_id int")
    found = ads.attached_orders(deliveries, marks, marks.limit(0), marks.limit(0)).collect()
    rows = {(r["active_date"], r["cohort"]): (r["store_orders"], r["store_sales"], r["paid_ads_attach_store_orders"]) for r in found}
    assert rows == {(None, "x"): (1, 5.0, 1), ("d", "x"): (2, 8.0, 0), ("d", "b"): (1, 2.0, 0)}


def test_request_volume(spark):
    rows = spark.createDataFrame([("d", "top", "f"), ("d", "top", "f"), ("d", "low", None)], "active_date string, placement string, feature_id string")
    assert listed(ads.request_volume(rows)) == [("d", "low", None, 1), ("d", "top", "f", 2)]


@pytest.mark.parametrize("max_bytes", [None, -1])
def test_membership_active_range(spark, max_bytes):
    members = spark.createDataFrame(
        [("m1", 1, at(0), at(10)), ("m2", 1, at(50), None), ("m3", 1, at(200), at(300)), ("m4", 9, at(0), at(1))],
        "id string, campaign_id int, member_start timestamp_ntz, member_end timestamp_ntz",
    )
    campaigns = spark.createDataFrame([(1, at(5), at(100))], "campaign_id int, campaign_start timestamp_ntz, campaign_end timestamp_ntz")
    result = ads.membership_active_range(members, campaigns, max_bytes)
    assert listed(result.select("id", "active_start", "active_end")) == [("m1", at(5), at(10)), ("m2", at(50), at(100))]


@pytest.mark.parametrize("max_bytes", [None, -1])
def test_allocate_fee_spreads_all_of_it(spark, max_bytes):
    fees = spark.createDataFrame([(1, 6.0), (1, 4.0), (2, 9.0), (3, 1.0)], "campaign_id int, fee double")
    lines = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0), (2, "c", 0.0), (7, "d", 1.0)], "campaign_id int, line string, w double")
    result = ads.allocate_fee(fees, lines, "w", max_bytes)
    assert listed(result.select("line", "fee_alloc")) == [("a", 2.5), ("b", 7.5), ("c", 0.0)]


def apportioned_plainly(fees, lines):
    shares = {}
    for campaign in {c for c, _ in fees if c is not None} & {c for c, *_ in lines}:
        fee = sum(f or 0 for c, f in fees if c == campaign)
        own = sorted((line, max(w or 0, 0)) for c, line, w in lines if c == campaign)
        if not any(w for _, w in own):
            own = [(line, 1) for line, _ in own]
        whole = sum(w for _, w in own)
        floors = {line: abs(fee) * w // whole for line, w in own}
        left = abs(fee) - sum(floors.values())
        first = sorted(own, key=lambda x: (-(abs(fee) * x[1] % whole), x[0]))[:left]
        for line, _ in own:
            shares[line] = (1 if fee >= 0 else -1) * (floors[line] + (line in [x for x, _ in first]))
    return shares


@pytest.mark.parametrize("max_bytes, floor", [(None, None), (-1, None), (-1, 50)])
def test_apportioned_fees_sum_to_the_fee(spark, max_bytes, floor):
    fees = [(1, 1000), (1, 1), (2, 7), (3, 100), (4, -1000), (5, 9), (6, 5), (7, 10**15 + 7), (8, None), (None, 3), (9, 0)]
    lines = [(1, k, 3 + k % 4) for k in range(400)] + [(2, 1000 + k, 1) for k in range(3)] + [(3, 2000 + k, 0) for k in range(7)]
    lines += [(4, 3000 + k, k) for k in range(9)] + [(6, 4000, None), (6, 4001, -5), (6, 4002, 2)] + [(7, 5000 + k, 10**12 + k) for k in range(11)]
    lines += [(8, 6000, 1), (None, 6001, 1), (9, 6002, 1), (99, 6003, 1)]
    made = spark.createDataFrame(fees, "campaign_id int, fee_cents long"), spark.createDataFrame(lines, "campaign_id int, line int, w long").repartition(5)
    found = ads.apportion_fee(*made, "w", ["line"], max_bytes, **({"floor": floor} if floor else {}))
    assert found.columns == ["campaign_id", "line", "w", "fee_alloc_cents"]
    wanted = apportioned_plainly([f for f in fees if f[1] is not None], lines)
    rows = found.collect()
    assert len(rows) == len(wanted) and {r["line"]: r["fee_alloc_cents"] for r in rows} == wanted
    for campaign, fee in ((1, 1001), (3, 100), (4, -1000), (6, 5), (7, 10**15 + 7)):
        assert sum(r["fee_alloc_cents"] for r in rows if r["campaign_id"] == campaign) == fee
    assert ads.apportion_fee(made[0], made[1].limit(0), "w", ["line"]).collect() == []
