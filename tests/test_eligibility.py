"""Eligibility rules on hand-made rows."""

from __future__ import annotations

import datetime as dt

import pytest

from storelens.plans import eligibility
from storelens.sources.contracts import contract_findings, contract_from_yaml

NOON = dt.datetime(2024, 3, 10, 12)
START, END = "2024-03-01", "2024-03-31"

IMPRESSIONS = "view_id string, event_date timestamp_ntz, store_id bigint, consumer_id bigint"
ORDERS = "consumer_id bigint, store_id bigint, created_at timestamp_ntz"
MEMBERS = "consumer_id bigint, day date"
CAMPAIGNS = (
    "campaign_id bigint, store_id bigint, is_classic int, is_new_store_consumers int, is_member int, "
    "is_winback int, winback_days int, starts_at timestamp_ntz, ends_at timestamp_ntz"
)


def campaign(id, classic=0, new=0, member=0, winback=0, days=None, store=1, start=None, end=None):
    return (id, store, classic, new, member, winback, days, start or dt.datetime(2024, 1, 1), end)


def run(spark, impressions, orders, members, campaigns):
    return eligibility.promo_eligibility(
        spark.createDataFrame(impressions, IMPRESSIONS),
        spark.createDataFrame(orders, ORDERS),
        spark.createDataFrame(members, MEMBERS),
        spark.createDataFrame(campaigns, CAMPAIGNS),
        START,
        END,
    )


@pytest.mark.parametrize("floor", [None, 0])
def test_last_order_is_strictly_before(spark, floor):
    impressions = [("a", NOON, 1, 1), ("b", NOON, 1, 2), ("c", NOON, 2, 1)]
    orders = [(1, 1, NOON), (1, 1, NOON - dt.timedelta(days=3)), (1, 1, NOON - dt.timedelta(days=9))]
    result = eligibility.with_last_order(
        spark.createDataFrame(impressions, IMPRESSIONS), spark.createDataFrame(orders, ORDERS), floor=floor
    )
    found = {r["view_id"]: (r["last_order_date"], r["days_since_last_order"]) for r in result.collect()}
    assert found == {"a": (dt.date(2024, 3, 7), "3"), "b": (None, None), "c": (None, None)}


def test_membership_is_of_the_day(spark):
    impressions = [("a", NOON, 1, 1), ("b", NOON + dt.timedelta(days=1), 1, 1), ("c", NOON, 1, None)]
    members = [(1, NOON.date()), (1, NOON.date()), (2, NOON.date())]
    result = eligibility.with_membership(
        spark.createDataFrame(impressions, IMPRESSIONS), spark.createDataFrame(members, MEMBERS)
    )
    assert sorted((r["view_id"], r["cx_is_member"]) for r in result.collect()) == [("a", 1), ("b", 0), ("c", 0)]


def test_days_of_a_member_are_packed(spark):
    """A month is a row or two, before and after 1970, with copies and nulls; a consumer with null days alone has none."""
    first = dt.date(1969, 12, 1)
    days = {1: [first + dt.timedelta(i) for i in range(0, 60, 2)], 2: [dt.date(2024, 2, 29)], 3: [None], None: [first]}
    listed = [(c, d) for c, own in days.items() for d in own] * 3
    members = spark.createDataFrame(listed, MEMBERS).repartition(4)
    spans = eligibility.member_spans(members).collect()
    assert sum(r["consumer_id"] == 1 for r in spans) <= 2 and not any(r["consumer_id"] == 3 for r in spans)
    when = [dt.datetime.combine(first, dt.time(23)) + dt.timedelta(i) for i in range(-70, 140)] + [dt.datetime(2024, 2, 29), dt.datetime(2024, 3, 1), None]
    views = [(f"{c} {i}", x, 1, c) for c in (1, 2, 3, None) for i, x in enumerate(when)]
    found = eligibility.with_membership(spark.createDataFrame(views, IMPRESSIONS), members)
    assert found.columns == ["consumer_id", "view_id", "event_date", "store_id", "cx_is_member"]
    assert dict(found.dtypes)["cx_is_member"] == "int"
    flags = {r["view_id"]: r["cx_is_member"] for r in found.collect()}
    assert flags == {v: int(c is not None and x is not None and x.date() in days[c]) for v, x, _, c in views}


@pytest.mark.parametrize("limits", [{}, {"max_bytes": -1}])
def test_campaigns_active_at_the_impression(spark, limits):
    impressions = [("a", NOON, 1, 1), ("b", dt.datetime(2024, 4, 1), 1, 1), ("c", NOON, 2, 1)]
    campaigns = [
        campaign(1, start=NOON, end=NOON + dt.timedelta(seconds=1)),
        campaign(2, end=NOON),  # just over
        campaign(3, start=NOON + dt.timedelta(microseconds=1)),  # not yet
        campaign(4, start=dt.datetime(2020, 5, 31)),  # long running, open end
        campaign(5, start=dt.datetime(2024, 3, 20), end=dt.datetime(2024, 3, 21)),
        campaign(6, store=3),
        campaign(7, start=dt.datetime(2024, 3, 9), end=dt.datetime(2025, 1, 1)),
    ]
    result = eligibility.with_campaigns(
        spark.createDataFrame(impressions, IMPRESSIONS),
        spark.createDataFrame(campaigns, CAMPAIGNS),
        START,
        END,
        **limits,
    )
    assert sorted((r["view_id"], r["campaign_id"]) for r in result.collect()) == [("a", 1), ("a", 4), ("a", 7)]


def test_flags(spark):
    impressions = [("new", NOON, 1, 1), ("old", NOON, 1, 2), ("member", NOON, 1, 3)]
    orders = [(2, 1, NOON - dt.timedelta(days=30))]
    members = [(3, NOON.date())]
    campaigns = [
        campaign(1),
        campaign(2, classic=1),
        campaign(3, new=1),
        campaign(4, member=1),
        campaign(5, winback=1),
        campaign(6, winback=1, days=30),
        campaign(7, winback=1, days=31),
        campaign(8, classic=1, new=1),
        campaign(9, classic=None, new=None, member=None, winback=None),
    ]
    result = run(spark, impressions, orders, members, campaigns)
    let_in = {}
    for row in result.collect():
        let_in.setdefault(row["campaign_id"], set())
        if row["cx_eligible"] == 1:
            let_in[row["campaign_id"]].add(row["view_id"])
    assert let_in == {
        1: {"new", "old", "member"},
        2: {"new", "old"},
        3: {"new", "member"},
        4: {"member"},
        5: {"old"},
        6: {"old"},
        7: set(),
        8: {"new"},
        9: {"new", "old", "member"},
    }


def test_contract_holds(spark):
    result = run(spark, [("a", NOON, 1, 1)], [], [], [campaign(1)])
    assert contract_findings(result.schema, eligibility.ELIGIBILITY) == []
    assert len(result.columns) == 18
    assert all(f.metadata["comment"] for f in result.schema)
    swapped = result.select("event_date", "view_id", *result.columns[2:-1])
    findings = contract_findings(swapped.schema, eligibility.ELIGIBILITY)
    assert findings == ["view_id: position 1", "event_date: position 0", "cx_eligible: missing"]


def test_contract_from_yaml():
    pytest.importorskip("yaml")
    text = """
column_definitions:
  - name: "VIEW_ID"
    type: "text"
    comment: "an id "
  - name: "SEEN"
    type: "timestamp_ntz"
  - name: "FLAG"
    type: "number"
    comment: "0/1"
"""
    schema = contract_from_yaml(text)
    assert schema.simpleString() == "struct<view_id:string,seen:timestamp_ntz,flag:bigint>"
    assert [f.metadata["comment"] for f in schema] == ["an id", "", "0/1"]


def test_result_holds_against_a_contract_with_other_names(spark):
    """A contract in text, with its own names for some columns and one integer type."""
    names = {"cx_is_subscriber": "cx_is_member", "is_subscriber": "is_member", "is_subscriber_eligible": "is_member_eligible"}
    theirs = {here: there for there, here in names.items()}
    words = {"bigint": "number", "string": "text", "timestamp_ntz": "timestamp_ntz", "date": "date"}
    lines = [
        f"  - name: {theirs.get(f.name, f.name).upper()}\n    type: {words[f.dataType.simpleString()]}\n    comment: c"
        for f in eligibility.ELIGIBILITY
    ]
    wanted = contract_from_yaml("column_definitions:\n" + "\n".join(lines))
    empty = spark.createDataFrame([], eligibility.ELIGIBILITY)
    assert contract_findings(empty.schema, wanted, names) == []
    found = contract_findings(empty.schema, wanted)
    assert "cx_is_subscriber: missing" in found and "cx_is_member: not in contract" in found
