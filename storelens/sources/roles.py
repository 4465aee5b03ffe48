"""The tables a report reads, by role, and how raw tables are brought to that shape."""

from __future__ import annotations

from collections.abc import Mapping
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.sources.days import DayColumn, day_of

# Fixed column contracts. Join keys are one type everywhere, although the raw
# tables store the same id as a number in one place and as text in another.
EVENT = {"user_id": "bigint", "store_id": "bigint", "timestamp": "timestamp_ntz"}
ROLES = {
    "stores": {"store_id": "bigint", "business_id": "bigint", "name": "string"},
    "availability": {"store_id": "bigint", "consumer_id": "bigint"},
    "impressions": {
        "id": "string",
        "event_date": "timestamp_ntz",
        "consumer_id": "bigint",
        "store_id": "bigint",
        "product_name": "string",
        "search_term": "string",
        "search_term_clean": "string",
        "card_position": "double",
    },
    "page_loads": EVENT,
    "cart_adds": {**EVENT, "item_name": "string"},
    "checkouts": {"order_uuid": "string", "user_id": "bigint", "timestamp": "timestamp_ntz"},
    "deliveries": {
        "delivery_id": "string",
        "store_id": "bigint",
        "business_id": "bigint",
        "creator_id": "bigint",
        "subtotal": "double",
        "created_at": "timestamp_ntz",
        "cancelled_at": "timestamp_ntz",
        "order_cart_uuid": "string",
        "is_filtered_core": "boolean",
    },
    "order_items": {"delivery_id": "string", "item_name": "string"},
    "ad_fees": {
        "store_id": "bigint",
        "consumer_id": "bigint",
        "ads_fee": "double",
        "created_at": "timestamp_ntz",
    },
    "promo_fees": {
        "store_id": "bigint",
        "consumer_id": "bigint",
        "promotion_fee": "double",
        "created_at": "timestamp_ntz",
    },
    "query_log": {"user_name": "string", "end_time": "timestamp_ntz", "query_text": "string"},
}


# Amounts stay decimals where the raw table has decimals, so that sums of them are exact.
AMOUNTS = ("subtotal", "ads_fee", "promotion_fee")


def conform(frame: DataFrame, role: str, day: DayColumn | None = None) -> DataFrame:
    """The role's columns in contract order and type; text that is no number becomes null.

    A column that already has the contract's type is passed as it is, so filters
    on it still reach the file scan. With `day`, the day of the row's partition
    comes along for the reports' filters.
    """
    types = dict(frame.dtypes)
    columns = []
    for name, wanted in ROLES[role].items():
        column = F.col(name)
        fits = types[name] == wanted or (name in AMOUNTS and types[name].startswith("decimal"))
        columns.append(column if fits else column.try_cast(wanted).alias(name))
    return frame.select(*columns, *([day_of(day)] if day else []))


# Roles read from several tables of one shape.
SEVERAL_SOURCES = ("page_loads", "cart_adds", "checkouts")


def role_tables(
    spark: SparkSession, names: Mapping[str, str | list[str]], days: Mapping[str, DayColumn] | None = None
) -> SimpleNamespace:
    """The reports' input from catalogue tables: role to table name, or to a list of them.

    `days` names, by role, the column its tables are partitioned by, where they are.
    """
    tables, days = {}, days or {}
    for role, name in names.items():
        if role in SEVERAL_SOURCES:
            sources = [name] if isinstance(name, str) else name
            tables[role] = [conform(spark.table(source), role, days.get(role)) for source in sources]
        else:
            tables[role] = conform(spark.table(name), role, days.get(role))
    return SimpleNamespace(**tables)
