"""Ad and promotion measures that the column catalogue names without a formula.

Every formula here is ours. Each input is reduced by its own key before it meets
another, so rows that are many per key never multiply.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.scalars import EXACT, exact_sum, overlap, safe_ratio
from storelens.operators.joins import guarded_join, skew_join
from storelens.operators.metrics import union_all
from storelens.operators.timeline import last_before, running_numbers


def dedup_events(events: DataFrame, key: str, received_at: str) -> DataFrame:
    """The first received row per key; ties go to the smallest other values.

    A row without a time comes after all others of its key; rows without a key are
    events of their own and stay. A minimum of whole rows, so copies collapse
    before the shuffle.
    """
    rest = [c for c in events.columns if c not in (key, received_at)]
    alone = F.when(F.col(key).isNull(), F.monotonically_increasing_id()).alias("_alone")
    row = F.struct(F.col(received_at).isNull().alias("_late"), received_at, *rest)
    first = events.groupBy(key, alone).agg(F.min(row).alias("_row"))
    return first.select(*[F.col(key) if c == key else F.col(f"_row.{c}") for c in events.columns])


def order_sequence(deliveries: DataFrame, **cut) -> DataFrame:
    """Numbers each consumer's orders at the store, the business, its group, and overall."""
    levels = {
        "store_cx_rn": ["store_id"],
        "business_cx_rn": ["business_id"],
        "business_group_cx_rn": ["business_group_id"],
        "cx_rn": [],
    }
    return running_numbers(deliveries, "consumer_id", levels, "created_at", ["delivery_id"], **cut)


def consumers_acquired(numbered: DataFrame, memberships: DataFrame) -> DataFrame:
    """Per campaign and day: consumers whose first order at the store it was, and all others; and of both, those
    listed as members on that day."""
    per_consumer = numbered.groupBy("campaign_id", F.to_date("created_at").alias("day"), "consumer_id").agg(
        (F.min("store_cx_rn") == 1).alias("is_new")
    )
    listed = memberships.select("consumer_id", F.to_date("day").alias("day"), F.lit(True).alias("is_member")).distinct()
    per_consumer = skew_join(per_consumer, listed, ["consumer_id", "day"], "left")
    is_new, is_member = F.col("is_new"), F.col("is_member")
    return per_consumer.groupBy("campaign_id", "day").agg(
        F.count(F.when(is_new, 1)).alias("new_cx_acquired"),
        F.count(F.when(~is_new, 1)).alias("existing_cx_acquired"),
        F.count(F.lit(1)).alias("total_cx_acquired"),
        F.count(F.when(is_new & is_member, 1)).alias("new_member_cx_acquired"),
        F.count(F.when(~is_new & is_member, 1)).alias("existing_member_cx_acquired"),
    )


RETENTION_DAYS = (30, 60, 90)
# Rows of a consumer's history that one task should sort, look ahead in and sum.
RETENTION_ROWS = 250_000


def reorder_retention(deliveries: DataFrame, heat: DataFrame | None = None) -> DataFrame:
    """Per store and day: later orders, and their sales, of that day's consumers at the same store.

    Sales are exact sums, given as doubles. Rows are first summed per consumer, store and day, so a consumer's history at
    a store is at most one row per calendar day, whatever the number of orders. Histories are dealt out by number of
    rows, as a task holds several times what its shuffled rows take; `heat` is a frame with about as many rows as
    `deliveries` that is cheaper to count.
    """
    tasks = max(1, math.ceil((deliveries if heat is None else heat).count() / RETENTION_ROWS))
    daily = (
        deliveries.groupBy("store_id", "consumer_id", F.to_date("created_at").alias("active_date"))
        .agg(F.count("delivery_id").alias("deliveries"), exact_sum("subtotal").alias("sales"))
        .withColumn("_at", F.unix_date("active_date"))
        .repartition(tasks, "store_id", "consumer_id")
    )
    history = Window.partitionBy("store_id", "consumer_id").orderBy("_at")
    spans = {str(days): history.rangeBetween(1, days) for days in RETENTION_DAYS}
    spans["since"] = history.rangeBetween(1, Window.unboundedFollowing)
    for name, span in spans.items():
        daily = daily.withColumn(f"_again_{name}", F.coalesce(F.sum("deliveries").over(span), F.lit(0)))
        daily = daily.withColumn(f"_sales_{name}", F.sum("sales").over(span))
    totals = [
        F.count(F.lit(1)).alias("cxs"),
        F.sum("deliveries").alias("deliveries"),
        F.sum("sales").cast("double").alias("sales"),
    ]
    for name in spans:
        again = F.col(f"_again_{name}")
        totals.append(F.sum(again).alias(f"reorder_deliv_{name}"))
        totals.append(F.coalesce(F.sum(f"_sales_{name}").cast("double"), F.lit(0.0)).alias(f"reorder_sales_{name}"))
        totals.append(F.count(F.when(again > 0, 1)).alias(f"cx_reordered_{name}"))
    result = daily.groupBy("store_id", "active_date").agg(*totals)
    for name in spans:
        result = result.withColumn(f"reorder_rate_{name}", safe_ratio(f"reorder_deliv_{name}", "deliveries"))
        result = result.withColumn(f"cx_reordered_{name}_rate", safe_ratio(f"cx_reordered_{name}", "cxs"))
    return result


def view_to_conversion(impressions: DataFrame, clicks: DataFrame, carts: DataFrame, orders: DataFrame) -> DataFrame:
    """Each impression with its first click and first order, and 0/1 flags for click, cart and order.

    A click without an id leads to no cart and no order; such clicks stay out of
    the joins, so they do not meet in one task.
    """
    ordered = orders.groupBy("click_event_id").agg(
        F.min(F.struct("order_timestamp", "delivery_id")).alias("_order")
    )
    added = carts.select("click_event_id").distinct().withColumn("_added", F.lit(True))
    followed = clicks.groupBy("impression_event_id", "click_event_id").agg(F.min("click_timestamp").alias("click_timestamp"))
    known = followed.where(F.col("click_event_id").isNotNull())
    known = known.join(ordered, "click_event_id", "left").join(added, "click_event_id", "left")
    lost = followed.where(F.col("click_event_id").isNull())
    answers = (
        known.unionByName(lost, allowMissingColumns=True)
        .groupBy("impression_event_id")
        .agg(
            F.min(F.struct("click_timestamp", "click_event_id")).alias("_click"),
            F.max("_added").alias("_added"),
            F.min("_order").alias("_order"),
        )
    )
    joined = skew_join(impressions, answers, ["impression_event_id"], "left")
    return joined.select(
        *impressions.columns,
        F.col("_click").isNotNull().cast("int").alias("is_clicked"),
        F.col("_click.click_event_id").alias("click_event_id"),
        F.col("_click.click_timestamp").alias("click_timestamp"),
        F.col("_added").isNotNull().cast("int").alias("is_added_to_cart"),
        F.col("_order").isNotNull().cast("int").alias("is_converted"),
        F.col("_order.delivery_id").alias("delivery_id"),
        F.col("_order.order_timestamp").alias("order_timestamp"),
    )


def request_funnel(
    requests: DataFrame, wins: DataFrame, impressions: DataFrame, clicks: DataFrame, orders: DataFrame
) -> DataFrame:
    """Per surface: requests, and the auctions won, impressions, clicks and orders they led to.

    Counted from the end: each stage is summed by the id of the stage before it,
    then joined one to one, so a request with very many auctions stays one row.
    """
    below: DataFrame | None = None
    sums: list[str] = []
    stages = [
        ("orders", orders, "delivery_id", "click_id"),
        ("clicks", clicks, "click_id", "impression_id"),
        ("impressions", impressions, "impression_id", "auction_id"),
        ("auctions_won", wins, "auction_id", "request_id"),
    ]
    for name, frame, key, parent in stages:
        rows = frame.groupBy(key).agg(F.min(parent).alias(parent))
        if below is not None:
            rows = rows.join(below, key, "left")
        below = rows.where(F.col(parent).isNotNull()).groupBy(parent).agg(
            F.count(F.lit(1)).alias(name), *[F.sum(c).alias(c) for c in sums]
        )
        sums.append(name)
    surfaces = requests.groupBy("request_id").agg(F.min("product_surface").alias("product_surface"))
    counts = surfaces.join(below, "request_id", "left").groupBy("product_surface").agg(
        F.count(F.lit(1)).alias("requests"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in reversed(sums)],
    )
    return counts


def last_click_attribution(orders: DataFrame, clicks: DataFrame, limit_hours: int, **cut) -> DataFrame:
    """Orders with the consumer's latest click on the store at or before them, if recent enough."""
    found = last_before(
        orders,
        clicks,
        ["consumer_id", "store_id"],
        "ordered_at",
        "clicked_at",
        ["click_id"],
        inclusive=True,
        **cut,
    )
    seconds = F.timestamp_diff("SECOND", F.col("last.clicked_at"), F.col("ordered_at"))
    recent = F.col("last").isNotNull() & (seconds <= limit_hours * 3600)
    return found.select(
        *orders.columns,
        F.when(recent, F.col("last.click_id")).alias("click_id"),
        F.when(recent, F.floor(seconds / 60)).alias("lag_minutes"),
        F.when(recent, F.floor(seconds / 3600)).alias("lag_hours"),
        F.coalesce(recent, F.lit(False)).cast("int").alias("is_attributed"),
    )


COUNTS, MONEY = ("impressions", "clicks", "orders"), ("sales", "cost")


def campaign_performance(parts: list[DataFrame]) -> DataFrame:
    """Per campaign and day: sums of the measures and their ratios.

    Each part has campaign_id, day and any of the measures; all parts are summed
    in one grouping instead of being joined. Counts are whole numbers and amounts
    decimals while they are summed.
    """
    padded = []
    for part in parts:
        columns = [
            (F.col(m) if m in part.columns else F.lit(0)).cast(kind).alias(m)
            for measures, kind in ((COUNTS, "bigint"), (MONEY, EXACT))
            for m in measures
        ]
        padded.append(part.select("campaign_id", "day", *columns))
    sums = union_all(padded).groupBy("campaign_id", "day").agg(
        *[F.sum(m).alias(m) for m in COUNTS], *[exact_sum(m).cast("double").alias(m) for m in MONEY]
    )
    return sums.select(
        "campaign_id",
        "day",
        *COUNTS,
        *MONEY,
        safe_ratio("clicks", "impressions").alias("click_through_rate"),
        safe_ratio("orders", "clicks").alias("conversion_rate"),
        safe_ratio("sales", "orders").alias("aov"),
        safe_ratio("cost", "orders").alias("cost_per_order"),
        safe_ratio("sales", "cost").alias("roas"),
    )


def top_list(rows: DataFrame, group: str, item: str, size: int = 5) -> DataFrame:
    """The group's most frequent items as an array, most frequent first, ties by name.

    Rows are counted first; each task then passes on at most `size` items a group.
    """
    counts = rows.where(F.col(item).isNotNull()).groupBy(group, item).agg(F.count(F.lit(1)).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_n"), item))
    best = counts.withColumn("_rank", rank).where(F.col("_rank") <= size)
    listed = best.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_rank", item))).alias("_top"))
    return listed.select(group, F.col(f"_top.{item}").alias(f"top_{item}s"))


def attached_orders(
    deliveries: DataFrame, ad_orders: DataFrame, promo_orders: DataFrame, banner_orders: DataFrame
) -> DataFrame:
    """Per day and cohort: orders and sales, and orders with a paid ad, a promotion, either, or a banner ad.

    Several rows of one delivery are one order, with the values of the greatest
    row. A delivery without an id is an order of its own without a mark; one
    without a day is counted under no day.
    """
    values = ("active_date", "cohort", "sales")
    marks = ("ad", "promo", "banner")
    rows = deliveries.select(
        "delivery_id",
        F.when(F.col("delivery_id").isNull(), F.monotonically_increasing_id()).alias("_alone"),
        F.struct(F.lit(True).alias("there"), *values).alias("_row"),
        *[F.lit(0).alias(mark) for mark in marks],
    )
    for frame, own in zip((ad_orders, promo_orders, banner_orders), marks):
        marked = frame.where(F.col("delivery_id").isNotNull()).select(
            "delivery_id",
            F.lit(None).cast("bigint").alias("_alone"),
            F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"),
            *[F.lit(int(mark == own)).alias(mark) for mark in marks],
        )
        rows = rows.unionByName(marked)
    per_order = rows.groupBy("delivery_id", "_alone").agg(F.max("_row").alias("_row"), *[F.max(m).alias(m) for m in marks])
    known = per_order.where("_row.there").select(*[f"_row.{c}" for c in values], *marks)
    return known.groupBy("active_date", "cohort").agg(
        F.count(F.lit(1)).alias("store_orders"),
        exact_sum("sales").cast("double").alias("store_sales"),
        F.sum("ad").alias("paid_ads_attach_store_orders"),
        F.sum("promo").alias("paid_promotion_attach_store_orders"),
        F.sum(F.greatest("ad", "promo")).alias("paid_ads_promotion_attach_store_orders"),
        F.sum("banner").alias("paid_banner_ads_attach_store_orders"),
    )


def request_volume(requests: DataFrame) -> DataFrame:
    """Requests per day, placement and feature."""
    return requests.groupBy("active_date", "placement", "feature_id").agg(
        F.count(F.lit(1)).alias("total_requests")
    )


def membership_active_range(
    memberships: DataFrame, campaigns: DataFrame, max_bytes: int | None = None
) -> DataFrame:
    """Memberships with the time during which both they and their campaign are active."""
    ranges = campaigns.select("campaign_id", "campaign_start", "campaign_end")
    joined = guarded_join(memberships, ranges, ["campaign_id"], "inner", max_bytes)
    start, end, active = overlap(["member_start", "campaign_start"], ["member_end", "campaign_end"])
    return joined.where(active).select(
        *memberships.columns, start.alias("active_start"), end.alias("active_end")
    )


def allocate_fee(
    fees: DataFrame, lines: DataFrame, weight: str, max_bytes: int | None = None
) -> DataFrame:
    """Spreads each campaign's lump fee over its lines by weight, as `fee_alloc`.

    Weights are summed by campaign before they are joined back; a window over the
    campaign would put all its lines into one task.
    """
    weights = lines.groupBy("campaign_id").agg(F.sum(weight).alias("_weights"))
    lump = fees.groupBy("campaign_id").agg(F.sum("fee").alias("_fee")).join(weights, "campaign_id")
    joined = guarded_join(lines, lump, ["campaign_id"], "inner", max_bytes, bound=fees)
    return joined.select(*lines.columns, (F.col("_fee") * safe_ratio(weight, "_weights")).alias("fee_alloc"))


def apportion_fee(
    fees: DataFrame, lines: DataFrame, weight: str, ties: list[str], max_bytes: int | None = None, **cut
) -> DataFrame:
    """Spreads each campaign's `fee_cents` over its lines in whole cents, as `fee_alloc_cents`; shares sum to the fee.

    `fee_cents` and `weight` are whole numbers. A line gets its share rounded down; the cents left over go one each
    to the largest remainders, ties by the columns `ties`. Null and negative weights count as 0, and where all of a
    campaign's do, its lines share equally. A negative fee is spread as its amount, with the sign put back. A fee
    without lines and a line without a fee are left out.

    Products are decimals of 38 digits, sums whole numbers, so no result depends on the order of rows. Lines are
    ranked in ranges of (campaign, remainder), so a campaign with most lines is not in one task.
    """
    known = F.greatest(F.coalesce(F.col(weight).cast("bigint"), F.lit(0)), F.lit(0))
    weights = lines.groupBy("campaign_id").agg(F.sum(known).alias("_sum"), F.count(F.lit(1)).alias("_lines"))
    lump = fees.groupBy("campaign_id").agg(F.sum(F.col("fee_cents").cast("bigint")).alias("_fee")).where(F.col("_fee").isNotNull())
    lump = lump.join(weights, "campaign_id").withColumn("_whole", F.when(F.col("_sum") > 0, F.col("_sum")).otherwise(F.col("_lines")))
    joined = guarded_join(lines, lump, ["campaign_id"], "inner", max_bytes, bound=fees)
    own = F.when(F.col("_sum") > 0, known).otherwise(F.lit(1).cast("bigint"))
    amount = F.abs("_fee").cast("decimal(19,0)") * own.cast("decimal(19,0)")
    over = amount % F.col("_whole").cast("decimal(19,0)")
    parts = joined.select(
        *lines.columns, "_fee", "_whole", over.cast("bigint").alias("_over"),
        ((amount - over) / F.col("_whole")).cast("bigint").alias("_share"),
    )
    # The largest remainder comes first.
    parts = parts.withColumn("_lack", F.col("_whole") - F.col("_over"))
    left = parts.groupBy("campaign_id").agg((F.abs(F.first("_fee")) - F.sum("_share")).alias("_left"))
    ranked = running_numbers(parts, "campaign_id", {"_place": []}, "_lack", ties, **cut)
    spread = guarded_join(ranked, left, ["campaign_id"], "inner", max_bytes, bound=fees)
    cents = F.col("_share") + (F.col("_place") <= F.col("_left")).cast("bigint")
    return spread.select(*lines.columns, (F.signum("_fee").cast("bigint") * cents).alias("fee_alloc_cents"))
