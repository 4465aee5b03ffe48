"""Brand overview: its stores, and their orders and sales."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.scalars import Day, cents, exact_sum
from storelens.operators.joins import Cohort, cohort
from storelens.sources.days import on_dates


def brand_stores(tables, business_id: int) -> Cohort:
    """Store ids of one business, measured once for all reports over the same tables."""
    known = tables.__dict__.setdefault("_brand_stores", {})
    if business_id not in known:
        known[business_id] = cohort(tables.stores.where(F.col("business_id") == business_id), "store_id")
    return known[business_id]


def store_list(tables, business_id: int) -> DataFrame:
    return tables.stores.where(F.col("business_id") == business_id).select(
        "store_id", F.col("name").alias("store_name")
    )


def business_overview(tables, business_id: int, start: Day, end: Day) -> DataFrame:
    """Stores with deliveries, deliveries, and sales; cancelled orders count too."""
    rows = on_dates(tables.deliveries, "created_at", start, end).where(F.col("business_id") == business_id)
    return rows.agg(
        F.countDistinct("store_id").alias("store_count"),
        F.count("delivery_id").alias("orders"),
        cents(exact_sum("subtotal")).alias("sales"),
    )
