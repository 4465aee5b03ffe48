"""Reports on ordered items over tables bucketed by cart."""

from __future__ import annotations

import datetime as dt
import random
from types import SimpleNamespace

import pytest
from role_frames import role_tables

from storelens.plans import engagement
from storelens.sources.by_cart import cart_checkouts, cart_lines, tables_by_cart, write_by_cart
from storelens.sources.star import StarTables

SF = "/root/testdata/sf0.001"
DAYS = ("1997-01-01", "1997-12-31")
REPORTS = (engagement.items_ordered_by_consumers, engagement.unique_items_ordered)


def keep_by_cart(spark, tables, folder, name, **options):
    write_by_cart(tables, f"{name}_lines", f"{name}_checkouts", 8, str(folder), **options)
    roles = {r: getattr(tables, r) for r in ("stores", "deliveries", "order_items", "checkouts")}
    return SimpleNamespace(**roles, by_cart=tables_by_cart(spark, f"{name}_lines", f"{name}_checkouts"))


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def below_joins(plan: str) -> list[str]:
    """The lines of a plan's tree that lie below its sort-merge joins."""
    lines, found = plan.splitlines(), []
    for i, line in enumerate(lines):
        if "SortMergeJoin" in line:
            depth = line.index("SortMergeJoin")
            for other in lines[i + 1 :]:
                at = len(other) - len(other.lstrip(" :+-*()0123456789"))
                if at <= depth:
                    break
                found.append(other)
    return found


def test_no_shuffle_under_the_joins_and_the_same_answers(spark, tmp_path, no_broadcast):
    plain = StarTables(spark, SF)
    kept = keep_by_cart(spark, plain, tmp_path, "star_by_cart")
    for report in REPORTS:
        expected, found = report(plain, 15, *DAYS), report(kept, 15, *DAYS)
        below = below_joins(found._jdf.queryExecution().executedPlan().toString())
        assert sum("FileScan" in x and "Bucketed: true" in x for x in below) == 2
        assert not [x for x in below if "Exchange" in x and "Broadcast" not in x]
        shuffled = below_joins(expected._jdf.queryExecution().executedPlan().toString())
        assert [x for x in shuffled if "Exchange hashpartitioning" in x]
        assert found.columns == expected.columns and found.collect() == expected.collect() != []


def odd_tables(spark, seed=3):
    """Repeated rows, deliveries of several carts and stores, and nulls in every column."""
    draw = random.Random(seed)

    def one(*values):
        return draw.choice([*values, None])

    def moment():
        return one(dt.datetime(1997, 5, 1), dt.datetime(1998, 5, 1))

    carts, ids = [f"c{i}" for i in range(9)], [f"d{i}" for i in range(9)]
    deliveries = [
        {"delivery_id": one(*ids), "store_id": one(1, 2, 3), "order_cart_uuid": one(*carts), "is_filtered_core": one(True, True, False)}
        for _ in range(40)
    ]
    items = [{"delivery_id": one(*ids), "item_name": one("a", "b", "c", "")} for _ in range(40)]
    checkouts = [[{"order_uuid": one(*carts), "user_id": one(*range(6)), "timestamp": moment()} for _ in range(15)] for _ in range(2)]
    stores = [{"store_id": s, "business_id": b, "name": "x"} for s, b in ((1, 15), (2, 15), (2, 15), (3, 8))]
    return role_tables(spark, stores=stores, deliveries=deliveries, order_items=items, checkouts=checkouts)


def test_odd_rows_answer_the_same(spark, tmp_path):
    tables = odd_tables(spark)
    kept = keep_by_cart(spark, tables, tmp_path, "odd_by_cart")
    for report in REPORTS:
        expected = report(tables, 15, *DAYS).collect()
        assert report(kept, 15, *DAYS).collect() == expected != []


def test_crowded_carts_answer_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(engagement, "CROWDED_CART", 2)
    tables = odd_tables(spark, seed=4)
    kept = keep_by_cart(spark, tables, tmp_path, "crowded_by_cart")
    assert REPORTS[0](kept, 15, *DAYS).collect() == REPORTS[0](tables, 15, *DAYS).collect() != []


def test_a_hot_cart_is_refused_and_empty_tables_are_not(spark, tmp_path):
    tables = odd_tables(spark)
    with pytest.raises(ValueError, match="more than 3"):
        write_by_cart(tables, "hot_lines", "hot_checkouts", 8, str(tmp_path), max_rows=3)
    assert not spark.catalog.tableExists("hot_lines")
    empty = role_tables(spark)
    kept = keep_by_cart(spark, empty, tmp_path, "empty_by_cart")
    assert REPORTS[0](kept, 15, *DAYS).collect() == []
    assert REPORTS[1](kept, 15, *DAYS).first()["unique_item_count"] == 0
    assert cart_lines(empty).count() == cart_checkouts(empty).count() == 0
