"""Brand engagement: consumers and items along view, visit, add to cart and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.scalars import Day
from storelens.operators.checkpoints import checkpointed
from storelens.operators.joins import distinct_keys, in_cohort, skew_join
from storelens.operators.metrics import union_all
from storelens.plans.overview import brand_stores
from storelens.sources.days import in_days

# Checkouts of one cart id, counted exactly, beyond which its consumers are no longer paired with its items.
CROWDED_CART = 1000


def _in_days_of_all(sources: list[DataFrame], start: Day, end: Day) -> DataFrame:
    return union_all([in_days(source, "timestamp", start, end) for source in sources])


def _on_brand(tables, facts: DataFrame, business_id: int) -> DataFrame:
    return in_cohort(facts, brand_stores(tables, business_id))


def consumers_impressed(tables, business_id: int, start: Day, end: Day) -> DataFrame:
    shown = in_days(tables.impressions, "event_date", start, end)
    rows = _on_brand(tables, shown, business_id)
    return rows.agg(F.countDistinct("consumer_id").alias("unique_cx_count"))


def consumers_visited(tables, business_id: int, start: Day, end: Day) -> DataFrame:
    loads = _in_days_of_all(tables.page_loads, start, end)
    rows = _on_brand(tables, loads, business_id)
    return rows.agg(F.countDistinct("user_id").alias("unique_cx_ct"))


def _brand_adds(tables, business_id: int, start: Day, end: Day) -> DataFrame:
    adds = _in_days_of_all(tables.cart_adds, start, end)
    return _on_brand(tables, adds, business_id)


def consumers_added_item(tables, business_id: int, start: Day, end: Day) -> DataFrame:
    rows = _brand_adds(tables, business_id, start, end)
    return rows.agg(F.countDistinct("user_id").alias("unique_cx_count"))


def consumers_ordered(tables, business_id: int, start: Day, end: Day) -> DataFrame:
    """Consumers with an order that was not cancelled."""
    kept = in_days(tables.deliveries, "created_at", start, end).where(F.col("cancelled_at").isNull())
    rows = _on_brand(tables, kept, business_id)
    return rows.agg(F.countDistinct("creator_id").alias("unique_cx_count"))


def _by_item(pairs: DataFrame, user: str) -> DataFrame:
    counts = pairs.groupBy("item_name").agg(F.countDistinct(user).alias("unique_cx_count"))
    return counts.orderBy(F.desc("unique_cx_count"), "item_name")


def items_added_by_consumers(tables, business_id: int, start: Day, end: Day) -> DataFrame:
    """Consumers per item added to the cart; adds without an item name are left out."""
    rows = _brand_adds(tables, business_id, start, end)
    return _by_item(rows.where(F.col("item_name").isNotNull()), "user_id")


def unique_items_added(tables, business_id: int, start: Day, end: Day) -> DataFrame:
    rows = _brand_adds(tables, business_id, start, end)
    return rows.agg(F.countDistinct("item_name").alias("unique_item_count"))


def _carts(tables, business_id: int) -> DataFrame:
    """Brand deliveries and their carts, each pair once.

    How they are joined is left to adaptive execution, which knows their size
    when it has built them; they are not run beforehand to be measured.
    """
    core = tables.deliveries.where(F.col("is_filtered_core"))
    carts = (
        _on_brand(tables, core, business_id)
        .where(F.col("order_cart_uuid").isNotNull() & F.col("delivery_id").isNotNull())
        .select(F.col("order_cart_uuid").alias("order_uuid"), "delivery_id")
    )
    return carts.distinct()


def _checkouts(tables, start: Day, end: Day) -> DataFrame:
    return _in_days_of_all(tables.checkouts, start, end)


def _kept_by_cart(tables, business_id: int, start: Day, end: Day) -> tuple[DataFrame, DataFrame] | None:
    """Brand items by cart and the days' checkouts from tables bucketed by cart, where there are such."""
    kept = getattr(tables, "by_cart", None)
    if kept is None:
        return None
    lines = _on_brand(tables, kept.lines.where(F.col("is_filtered_core")), business_id)
    return lines.select("order_uuid", "item_name"), in_days(kept.checkouts, "timestamp", start, end)


def items_ordered_by_consumers(tables, business_id: int, start: Day, end: Day) -> DataFrame:
    """Consumers per item checked out; an item without a name keeps its row.

    Only which consumer met which item matters, so each step keeps distinct rows:
    copies of a checkout, delivery or item row never multiply in the joins. Tables
    bucketed by cart are joined as they lie.
    """
    if kept := _kept_by_cart(tables, business_id, start, end):
        items, checkouts = kept[0].distinct(), kept[1]
        buyers = checkouts.select("order_uuid", "user_id").distinct()
    else:
        carts = _carts(tables, business_id)
        checkouts = _checkouts(tables, start, end)
        bought = skew_join(checkouts, carts, ["order_uuid"], "left_semi")
        buyers = bought.select("order_uuid", "user_id").distinct()
        lines = skew_join(tables.order_items, carts, ["delivery_id"])
        items = lines.select("order_uuid", "item_name").distinct()
    crowded = checkouts.groupBy("order_uuid").count().where(F.col("count") > CROWDED_CART).select("order_uuid")
    if not crowded.isEmpty():
        return _by_item_of_crowded_carts(items, buyers, crowded)
    return _by_item(items.join(buyers, "order_uuid").select("item_name", "user_id"), "user_id")


def _by_item_of_crowded_carts(items: DataFrame, buyers: DataFrame, crowded: DataFrame) -> DataFrame:
    """The same when a cart id was used by very many consumers.

    Such a cart gives each of its items the same consumers, so they are counted
    once per set of crowded carts that items share, not once per item. A set is
    never held in one row: items are taken to share one when two sums of hashes
    and the number of their carts agree, and held to it cart by cart; an item
    that differs after all has a set of its own. A set bears the name of its first item.
    Consumers an item has from other carts are added where the set does not hold them.
    """
    key = F.when(F.col("item_name").isNull(), "").otherwise(F.concat(F.lit("="), "item_name"))
    items = items.select("order_uuid", key.alias("item"))

    def part(frame: DataFrame, in_crowded: bool) -> DataFrame:
        return skew_join(frame, crowded, ["order_uuid"], "left_semi" if in_crowded else "left_anti")

    held = checkpointed(part(items, True))
    sets = checkpointed(_shared_sets(held))
    members = skew_join(held.withColumnRenamed("item", "set"), sets.select("set").distinct(), ["set"], "left_semi")
    crowd = skew_join(members, part(buyers, True), ["order_uuid"]).where(F.col("user_id").isNotNull())
    crowd = checkpointed(crowd.select("set", "user_id").distinct())
    sizes = crowd.groupBy("set").agg(F.count(F.lit(1)).alias("consumers"))
    of_sets = sets.join(sizes, "set", "left").select("item", F.coalesce("consumers", F.lit(0)).alias("consumers"))

    pairs = part(items, False).join(part(buyers, False), "order_uuid").select("item", "user_id").distinct()
    placed = skew_join(pairs, sets, ["item"], "left")
    others = placed.join(crowd.withColumn("held", F.lit(True)), ["set", "user_id"], "left").select(
        "item", F.when(F.col("held").isNull() & F.col("user_id").isNotNull(), 1).otherwise(0).cast("long").alias("consumers")
    )
    counts = of_sets.unionByName(others).groupBy("item").agg(F.sum("consumers").alias("unique_cx_count"))
    name = F.when(F.col("item") != "", F.expr("substring(item, 2)")).alias("item_name")
    return counts.select(name, "unique_cx_count").orderBy(F.desc("unique_cx_count"), "item_name")


def _shared_sets(held: DataFrame, digests: list[Column] | None = None) -> DataFrame:
    """Each item with `set`, the first of the items that have the same carts, from distinct pairs of cart and item."""
    if digests is None:
        digests = [F.xxhash64("order_uuid"), F.xxhash64(F.lit("second"), "order_uuid")]
    name = [f"_sum{i}" for i in range(len(digests))] + ["_carts"]
    sums = [F.sum(d.cast("decimal(38,0)")).alias(n) for d, n in zip(digests, name)]
    named = held.groupBy("item").agg(*sums, F.count(F.lit(1)).alias("_carts"))
    first = named.groupBy(*name).agg(F.min("item").alias("set"))
    taken = checkpointed(skew_join(named, first, name).select("item", "set"))
    # As sizes agree, an item has the set's carts unless one of its own is not among them.
    led = skew_join(held, taken.where("item <> set"), ["item"])
    theirs = held.withColumnRenamed("item", "set")
    odd = led.join(theirs, ["set", "order_uuid"], "left_anti").select("item", F.lit(True).alias("odd")).distinct()
    return taken.join(odd, "item", "left").select("item", F.when(F.col("odd"), F.col("item")).otherwise(F.col("set")).alias("set"))


def unique_items_ordered(tables, business_id: int, start: Day, end: Day) -> DataFrame:
    """Distinct items checked out. Nothing of the checkout is kept, so semi joins suffice."""
    if kept := _kept_by_cart(tables, business_id, start, end):
        bought = kept[0].join(kept[1], "order_uuid", "left_semi")
        return bought.agg(F.countDistinct("item_name").alias("unique_item_count"))
    carts = _carts(tables, business_id)
    orders = distinct_keys(_checkouts(tables, start, end), "order_uuid")
    bought = carts.join(orders, "order_uuid", "left_semi").select("delivery_id").distinct()
    items = skew_join(tables.order_items, bought, ["delivery_id"], "left_semi")
    return items.agg(F.countDistinct("item_name").alias("unique_item_count"))
