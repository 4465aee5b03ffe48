"""Reports on small tables with answers worked out by hand."""

from __future__ import annotations

import datetime as dt
import functools
import random

import pytest
from pyspark.sql import functions as F
from role_frames import metrics, role_tables

from storelens.plans import engagement, fees, overview, visibility

D0, D1 = "2024-03-01", "2024-03-02"
FIRST = dt.datetime(2024, 3, 1)
LAST = dt.datetime(2024, 3, 2, 23, 59, 59, 999999)
PAST = dt.datetime(2024, 3, 3)
NOON = dt.datetime(2024, 3, 1, 12)


def store(store_id, business_id, name=None):
    return {"store_id": store_id, "business_id": business_id, "name": name or f"S{store_id}"}


STORES = [store(1, 7), store(2, 7), store(3, 8), store(4, 9)]


def near(store_id, *consumers):
    return [{"store_id": store_id, "consumer_id": c} for c in consumers]


def view(id, consumer, store_id, at=NOON, **more):
    return {
        "id": id,
        "consumer_id": consumer,
        "store_id": store_id,
        "event_date": at,
        "product_name": "Lunch",
        "card_position": 2.0,
        **more,
    }


def test_store_list(spark):
    rows = overview.store_list(role_tables(spark, stores=STORES), 7).collect()
    assert sorted(map(tuple, rows)) == [(1, "S1"), (2, "S2")]


def test_window_takes_last_day_whole_and_not_the_next_midnight(spark):
    shown = [view("a", 1, 1, FIRST), view("b", 1, 1, LAST), view("c", 1, 1, PAST)]
    tables = role_tables(spark, stores=STORES, availability=near(1, 1), impressions=shown)
    values = list(metrics(visibility.impression_share(tables, 7, D0, D1)).values())
    assert values == [2.0, 2.0, 1.0]


def test_overview_counts_the_same_days_and_cancelled_orders(spark):
    def order(delivery_id, at, store_id=1, cancelled=None):
        return {
            "delivery_id": delivery_id,
            "store_id": store_id,
            "business_id": 7,
            "creator_id": 5,
            "subtotal": 1000.0,
            "created_at": at,
            "cancelled_at": cancelled,
        }

    deliveries = [order(1, FIRST), order(2, LAST, 2, LAST), order(3, PAST), order(None, FIRST)]
    tables = role_tables(spark, stores=STORES, deliveries=deliveries)
    assert tuple(overview.business_overview(tables, 7, D0, D1).first()) == (2, 2, 30.0)
    # The only consumer's other order is cancelled, but one is not.
    assert engagement.consumers_ordered(tables, 7, D0, D1).first()[0] == 1
    only_cancelled = role_tables(spark, stores=STORES, deliveries=[order(2, LAST, 2, LAST)])
    assert engagement.consumers_ordered(only_cancelled, 7, D0, D1).first()[0] == 0


def test_impression_share_counts_ids_of_eligible_consumers(spark):
    shown = [
        view("a", 1, 1),
        view(None, 1, 1),  # no id, not counted
        view("b", 1, 3),
        view("c", 2, 3),
        view("d", 99, 1),  # not eligible
        view("e", None, 1),
    ]
    availability = near(1, 1, 2, 2, None) + near(3, 99)
    tables = role_tables(spark, stores=STORES, availability=availability, impressions=shown)
    result = visibility.impression_share(tables, 7, D0, D1)
    assert result.dtypes == [("metric", "string"), ("impressions", "double")]
    assert [tuple(r) for r in result.collect()] == [
        (visibility.IMPRESSION_LABELS[0], 1.0),
        (visibility.IMPRESSION_LABELS[1], 3.0),
        (visibility.IMPRESSION_LABELS[2], 1 / 3),
    ]
    assert visibility.IMPRESSION_LABELS[1].endswith(" ")


def test_reach_counts_known_consumers_once(spark):
    availability = near(1, 1, 1, 2, None) + near(2, 2, 3)
    shown = [view("a", 1, 2), view("b", 1, 1), view("c", 9, 1), view("d", 2, 3), view("e", None, 1)]
    tables = role_tables(spark, stores=STORES, availability=availability, impressions=shown)
    assert list(metrics(visibility.consumer_reach(tables, 7, D0, D1)).values()) == [3.0, 1.0, 1 / 3]


def test_no_impressions_give_zero_ratios(spark):
    tables = role_tables(spark, stores=STORES, availability=near(1, 1))
    assert list(metrics(visibility.impression_share(tables, 7, D0, D1)).values()) == [0.0, 0.0, 0.0]
    assert list(metrics(visibility.consumer_reach(tables, 7, D0, D1)).values()) == [1.0, 0.0, 0.0]
    nobody = role_tables(spark, stores=STORES)
    assert list(metrics(visibility.consumer_reach(nobody, 7, D0, D1)).values()) == [0.0, 0.0, 0.0]


def test_keyword_rank_labels(spark):
    shown = [
        view("a", 1, 1, search_term="Taco"),  # term without clean term: product name, still search
        view("b", 1, 1, search_term="  ", search_term_clean="  "),
        view("c", 1, 1, product_name=None, search_term="x", search_term_clean="x"),  # dropped
        view("d", 1, 1, search_term="t", search_term_clean=" Taco "),
        view("e", 2, 1, search_term="t", search_term_clean="taco", card_position=None),
        view("f", 1, 2, search_term="t", search_term_clean="taco", card_position=5.0),
        view("g", 2, 3, search_term="t", search_term_clean="taco"),
        view("h", 2, 3, search_term=None),  # never on the brand: not listed
    ]
    tables = role_tables(spark, stores=STORES, availability=near(1, 1, 2), impressions=shown)
    result = visibility.keyword_rank(tables, 7, D0, D1)
    assert result.columns == [
        "product_name",
        "product_surface",
        "brand_average_card_position",
        "brand_impressions_from_eligible_cx",
        "total_impressions_from_eligible_cx",
        "impression_share_from_eligible_cx",
        "brand_impression_unique_cx_ct",
        "total_impression_unique_cx_ct",
        "unique_cx_share",
    ]
    assert [tuple(r) for r in result.collect()] == [
        ("taco", "search", 5.0, 2, 3, 2 / 3, 2, 2, 1.0),
        ("", "search", 2.0, 1, 1, 1.0, 1, 1, 1.0),
        ("Taco", "search", 2.0, 1, 1, 1.0, 1, 1, 1.0),
        ("lunch", "search", 2.0, 1, 1, 1.0, 1, 1, 1.0),
    ]


def test_consumers_impressed_and_visited(spark):
    shown = [view("a", 1, 1), view("b", 1, 2), view("c", 2, 3), view("d", 3, 1, PAST)]

    def load(user, store_id, at=NOON):
        return {"user_id": user, "store_id": store_id, "timestamp": at}

    loads = [[load(1, 1), load(2, 2)], [load(1, 2), load(3, 3), load(4, 1, PAST), load(None, 1)]]
    tables = role_tables(spark, stores=STORES, impressions=shown, page_loads=loads)
    assert engagement.consumers_impressed(tables, 7, D0, D1).first()[0] == 1
    assert engagement.consumers_visited(tables, 7, D0, D1).first()[0] == 2


def test_items_added(spark):
    def add(user, item, store_id=1, at=NOON):
        return {"user_id": user, "item_name": item, "store_id": store_id, "timestamp": at}

    adds = [[add(1, "tea"), add(1, "tea")], [add(2, "tea"), add(2, None)], [add(3, "bun"), add(4, "bun", 3)]]
    tables = role_tables(spark, stores=STORES, cart_adds=adds)
    rows = engagement.items_added_by_consumers(tables, 7, D0, D1).collect()
    assert [tuple(r) for r in rows] == [("tea", 2), ("bun", 1)]
    assert engagement.unique_items_added(tables, 7, D0, D1).first()[0] == 2
    assert engagement.consumers_added_item(tables, 7, D0, D1).first()[0] == 3


@pytest.fixture(params=[True, False], ids=["broadcast", "shuffled"])
def cart_path(request, monkeypatch):
    """Stores small enough to broadcast, and not, with every cart crowded."""
    if not request.param:
        from storelens.operators import joins

        monkeypatch.setattr(joins, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(joins, "HOT_ROWS", 0)
        monkeypatch.setattr(engagement, "CROWDED_CART", 0)
    return request.param


def test_items_ordered(spark, cart_path):
    def delivery(delivery_id, cart, core, store_id=1):
        return {
            "delivery_id": delivery_id,
            "store_id": store_id,
            "order_cart_uuid": cart,
            "is_filtered_core": core,
        }

    def checkout(cart, user, at=NOON):
        return {"order_uuid": cart, "user_id": user, "timestamp": at}

    deliveries = [
        delivery(1, "A", True),
        delivery(1, "A", True),  # a copy
        delivery(2, "B", True),
        delivery(3, "C", None),
        delivery(4, "D", False),
        delivery(5, "E", True, 3),
        delivery(6, "F", True),
        delivery(7, None, True),
    ]
    items = [(1, "tea"), (1, "tea"), (1, None), (2, "tea"), (2, "bun"), (3, "x"), (4, "y"), (5, "z"), (6, "late"), (7, "n")]
    checkouts = [
        [checkout("A", 1), checkout("A", 1), checkout("B", 2), checkout("C", 3)],
        [checkout("D", 4), checkout("E", 5), checkout("F", 6, PAST), checkout(None, 7), checkout("A", 1)],
    ]
    tables = role_tables(
        spark,
        stores=STORES,
        deliveries=deliveries,
        order_items=[{"delivery_id": d, "item_name": i} for d, i in items],
        checkouts=checkouts,
    )
    rows = engagement.items_ordered_by_consumers(tables, 7, D0, D1).collect()
    assert [tuple(r) for r in rows] == [("tea", 2), (None, 1), ("bun", 1)]
    assert engagement.unique_items_ordered(tables, 7, D0, D1).first()[0] == 2


@pytest.mark.parametrize("floor", [None, 0, 6])
def test_items_of_crowded_carts(spark, floor, monkeypatch):
    """Cart ids shared by many consumers and items, against a plain loop."""
    from storelens.operators import joins

    if floor is not None:
        monkeypatch.setattr(engagement, "CROWDED_CART", floor)
        monkeypatch.setattr(joins, "HOT_ROWS", floor)
    rng = random.Random(2)
    carts = ["A"] * 12 + ["B"] * 8 + list("CDEFGH")
    names = ["tea", "bun", "pie", "jam", None, "fig", "nut"]
    bought = [(rng.choice(carts), rng.choice([*range(9), None])) for _ in range(60)]
    placed = [(i, rng.choice([*carts, "Z"])) for i in range(40)]
    lines = [(rng.randrange(40), rng.choice(names)) for _ in range(60)]
    tables = role_tables(
        spark,
        stores=STORES,
        deliveries=[
            {"delivery_id": i, "store_id": 1, "order_cart_uuid": c, "is_filtered_core": True} for i, c in placed
        ],
        order_items=[{"delivery_id": i, "item_name": n} for i, n in lines],
        checkouts=[[{"order_uuid": c, "user_id": u, "timestamp": NOON} for c, u in bought], []],
    )
    wanted = {}
    for cart, user in bought:
        for delivery, placed_cart in placed:
            for line_delivery, name in lines:
                if cart == placed_cart and delivery == line_delivery:
                    wanted.setdefault(name, set()).add(user)
    rows = engagement.items_ordered_by_consumers(tables, 7, D0, D1).collect()
    assert dict(map(tuple, rows)) == {name: len(users - {None}) for name, users in wanted.items()}
    assert len(rows) == len(wanted)


def test_a_hundred_thousand_crowded_carts_share_items(spark):
    carts = spark.range(100_000).withColumn("order_uuid", F.concat(F.lit("c"), "id"))
    of = {"all": "true", "same": "true", None: "true", "even": "id % 2 = 0", "odd": "id % 2 = 1", "one": "id = 7", "odd again": "id % 2 = 1"}
    listed = [carts.where(c).select("order_uuid", F.lit(n).cast("string").alias("item_name")) for n, c in of.items()]
    items = functools.reduce(lambda a, b: a.union(b), listed).repartition(8)
    buyers = carts.select("order_uuid", (F.col("id") % 5000).alias("user_id")).union(
        carts.select("order_uuid", F.when(F.col("id") % 3 == 0, F.col("id") % 7000))
    )
    few = spark.createDataFrame([("x", "even", 1), ("z", "lone", 900_000), ("y", "one", 900_001)], "order_uuid string, item_name string, user_id long")
    found = engagement._by_item_of_crowded_carts(
        items.union(few.select("order_uuid", "item_name")), buyers.union(few.select("order_uuid", "user_id")), carts.select("order_uuid")
    )
    plain = items.join(buyers, "order_uuid").union(few).groupBy("item_name").agg(F.countDistinct("user_id"))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, map(tuple, plain.collect())))
    assert "collect_" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_items_of_one_sum_and_other_carts_are_told_apart(spark):
    held = spark.createDataFrame(
        [(c, i) for i, own in {"a": "12", "b": "34", "c": "12", "d": "1", "e": "34", "f": "56"}.items() for c in own], "order_uuid string, item string"
    )
    for digests in (None, [F.lit(0)], [F.xxhash64("order_uuid") % 2]):
        sets = dict(map(tuple, engagement._shared_sets(held, digests).collect()))
        assert sets["a"] == sets["c"] == "a" and sets["d"] == "d"
        # Whoever shares a set has the same carts.
        own = {"a": "12", "b": "34", "c": "12", "d": "1", "e": "34", "f": "56"}
        assert all(own[item] == own[name] for item, name in sets.items())
        if digests is None:
            assert sets == {"a": "a", "b": "b", "c": "a", "d": "d", "e": "b", "f": "f"}


def fee(consumer, store_id, amount, at=NOON):
    return {
        "consumer_id": consumer,
        "store_id": store_id,
        "ads_fee": amount,
        "promotion_fee": amount,
        "created_at": at,
    }


FEES = [
    fee(1, 1, 100.0),
    fee(1, 3, 300.0),
    fee(9, 1, 50.0),  # consumer out of reach
    fee(9, 3, 500.0),
    fee(1, 4, 700.0, PAST),
    fee(None, 4, 900.0),
    fee(1, 77, 1000.0),  # store missing from the dimension
]


@pytest.mark.parametrize("kind", ["ads", "promo"])
def test_fee_reports(spark, kind):
    share = getattr(fees, f"{kind}_fee_share")
    per_store = getattr(fees, f"{kind}_fee_per_store")
    tables = role_tables(
        spark, stores=STORES + [store(5, 8), store(6, 8)], availability=near(1, 1), ad_fees=FEES, promo_fees=FEES
    )
    assert list(metrics(share(tables, 7, [8], D0, D1)).values()) == [14.0, 1.5, 8.0]
    # Reach: 14 over 3 stores with rows; brand: 1.5 over its 2 stores; rival: 8 over its 3 stores.
    assert list(metrics(per_store(tables, 7, [8], D0, D1)).values()) == [14 / 3, 0.75, 8 / 3]
    # No rivals named: every store of the dimension, the brand's own included.
    assert list(metrics(share(tables, 7, [], D0, D1)).values()) == [14.0, 1.5, 18.5]
    assert list(metrics(per_store(tables, 7, [], D0, D1)).values())[2] == pytest.approx(18.5 / 6)


def test_no_fee_rows_give_null(spark):
    tables = role_tables(spark, stores=STORES, availability=near(1, 1))
    assert list(metrics(fees.ads_fee_share(tables, 7, [8], D0, D1)).values()) == [None, None, None]
    assert list(metrics(fees.ads_fee_per_store(tables, 7, [8], D0, D1)).values()) == [None, None, None]


def test_repeated_store_rows_count_as_stores_but_do_not_repeat_fees(spark):
    tables = role_tables(spark, stores=[store(1, 7), store(1, 7)], ad_fees=[fee(1, 1, 400.0)])
    assert list(metrics(fees.ads_fee_share(tables, 7, [], D0, D1)).values()) == [None, 4.0, 4.0]
    assert list(metrics(fees.ads_fee_per_store(tables, 7, [], D0, D1)).values()) == [None, 2.0, 2.0]
