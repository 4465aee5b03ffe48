"""Ordered items and checkouts kept by cart, so that reports on ordered items join them without a shuffle.

Two tables, bucketed alike by the cart's id: `lines`, the items of all deliveries
with the delivery's cart, store and core flag (the join of deliveries and items,
made once), and `checkouts`, those of all sources. Only rows with a cart id are
in them, as no join finds others; the role tables stay beside them. Reports use
them when the tables have them as `by_cart`.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.operators.joins import HOT_ROWS, skew_join
from storelens.operators.metrics import union_all

CART = "order_uuid"


def cart_lines(tables) -> DataFrame:
    """order_uuid, store_id, is_filtered_core, item_name: the items of each delivery once per copy of the item."""
    placed = tables.deliveries.where(F.col("order_cart_uuid").isNotNull()).select(
        "delivery_id", F.col("order_cart_uuid").alias(CART), "store_id", "is_filtered_core"
    )
    lines = skew_join(tables.order_items, placed.distinct(), ["delivery_id"])
    return lines.select(CART, "store_id", "is_filtered_core", "item_name")


def cart_checkouts(tables) -> DataFrame:
    rows = [source.drop("_day") for source in tables.checkouts]
    return union_all(rows).where(F.col(CART).isNotNull())


def _write(frame: DataFrame, name: str, buckets: int, folder: str | None, max_rows: int) -> None:
    """One file a bucket. A bucket is read by one task, so a cart of too many rows is refused before it is written."""
    largest = frame.groupBy(CART).count().agg(F.max("count")).first()[0] or 0
    if largest > max_rows:
        raise ValueError(f"a cart has {largest} rows, more than {max_rows}: keep these tables as they are")
    writer = frame.repartition(buckets, CART).write.format("parquet").bucketBy(buckets, CART).sortBy(CART)
    (writer if folder is None else writer.option("path", f"{folder}/{name}")).saveAsTable(name)


def write_by_cart(
    tables, lines: str, checkouts: str, buckets: int, folder: str | None = None, max_rows: int = HOT_ROWS
) -> None:
    """Writes both as new catalogue tables; `folder` is where, else the warehouse.

    Choose `buckets` so that one of the larger table, the rows a task reads, stays
    near 200 MB.
    """
    _write(cart_lines(tables), lines, buckets, folder, max_rows)
    _write(cart_checkouts(tables), checkouts, buckets, folder, max_rows)


def tables_by_cart(spark: SparkSession, lines: str, checkouts: str) -> SimpleNamespace:
    """What write_by_cart() wrote, for the `by_cart` attribute of a report's tables."""
    return SimpleNamespace(lines=spark.table(lines), checkouts=spark.table(checkouts))
