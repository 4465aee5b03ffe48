"""All registered queries, over role tables built from the star schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.functions.scalars import normalised_query, zone_time
from storelens.operators.timeline import validity_ranges
from storelens.plans import ads, definitions, eligibility, engagement, fees, history, overview, visibility
from storelens.sources.star import StarTables

BUSINESS = 15
RIVALS = [1, 18]
EVENT_DAYS = ("2024-01-05", "2024-01-20")
ORDER_DAYS = ("1997-01-01", "1997-12-31")
ALL_DAYS = ("1995-01-01", "2001-12-31")
LOG_RANGE = ("2024-01-03 00:00:00 -0700", "2024-01-24 12:30:00 -0700")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _register(name: str, build: Callable[[StarTables], DataFrame], rounded: tuple[str, ...] = (), digits: int = 4) -> None:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        result = build(StarTables(spark, folder))
        for column in rounded:
            result = result.withColumn(column, F.round(column, digits))
        return result

    query.__name__ = name
    QUERIES[name] = query


# Reports.
_register("store_list", lambda t: overview.store_list(t, BUSINESS))
_register("business_overview", lambda t: overview.business_overview(t, BUSINESS, *ORDER_DAYS), ("sales",))
_register("impression_share", lambda t: visibility.impression_share(t, BUSINESS, *EVENT_DAYS), ("impressions",))
_register("consumer_reach", lambda t: visibility.consumer_reach(t, BUSINESS, *EVENT_DAYS), ("unique_cx_ct",))
_register(
    "keyword_rank",
    lambda t: visibility.keyword_rank(t, BUSINESS, *EVENT_DAYS),
    ("brand_average_card_position", "impression_share_from_eligible_cx", "unique_cx_share"),
)
for _report, _days in (
    (engagement.consumers_impressed, EVENT_DAYS),
    (engagement.consumers_visited, EVENT_DAYS),
    (engagement.consumers_added_item, EVENT_DAYS),
    (engagement.consumers_ordered, ORDER_DAYS),
    (engagement.items_added_by_consumers, EVENT_DAYS),
    (engagement.items_ordered_by_consumers, ORDER_DAYS),
    (engagement.unique_items_added, EVENT_DAYS),
    (engagement.unique_items_ordered, ORDER_DAYS),
):
    _register(_report.__name__, lambda t, r=_report, d=_days: r(t, BUSINESS, *d))
for _report, _value in (
    (fees.ads_fee_share, "total_ads_fee"),
    (fees.promo_fee_share, "total_promo_fee"),
    (fees.ads_fee_per_store, "ads_fee_per_store"),
    (fees.promo_fee_per_store, "promo_fee_per_store"),
):
    for _suffix, _rivals in (("", RIVALS), ("_no_rivals_named", [])):
        _register(
            _report.__name__ + _suffix,
            lambda t, r=_report, v=_rivals: r(t, BUSINESS, v, *ORDER_DAYS),
            (_value,),
        )

# Query log and schema jobs.
_register("history_by_user", lambda t: history.history_by_user(t.query_log, "USER_8", *LOG_RANGE))


def _definitions(t: StarTables) -> DataFrame:
    return t.text_definitions.unionByName(t.part_definitions(new=True))


_register("ddl_body_range", lambda t: definitions.ddl_body_range(_definitions(t)))
_register("ddl_columns", lambda t: definitions.ddl_columns(_definitions(t)))
_register("ddl_types", lambda t: definitions.ddl_types(_definitions(t)))
_register("ddl_findings", lambda t: definitions.ddl_findings(_definitions(t)))
_register(
    "ddl_compare",
    lambda t: definitions.ddl_compare(t.part_definitions(new=True), t.part_definitions(new=False)),
)
_register("catalog_fields", lambda t: definitions.catalog_fields(t.catalog))
_register("catalog_schemas", lambda t: definitions.catalog_schemas(t.priced_catalog))
_register("catalog_checks", lambda t: definitions.catalog_checks(t.catalog, t.known_tables))

# Eligibility.
_register("last_order_before_view", lambda t: eligibility.with_last_order(t.store_views, t.past_orders, bound=t.lines_by_store))
_register("membership_on_view", lambda t: eligibility.with_membership(t.store_views, t.memberships))
_register(
    "campaigns_on_view", lambda t: eligibility.with_campaigns(t.store_views, t.campaigns, *ALL_DAYS)
)
_register(
    "promo_eligibility",
    lambda t: eligibility.promo_eligibility(
        t.store_views, t.past_orders, t.memberships, t.campaigns, *ALL_DAYS, bound=t.lines_by_store
    ),
)

# Ad measures.
_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _line_events(t: StarTables) -> DataFrame:
    line = F.concat_ws("-", "l_orderkey", "l_linenumber")
    return t.raw("lineitem").select(
        line.alias("event_key"), F.col("l_shipdate").alias("received_at"), "l_partkey", "l_suppkey"
    )


_register("dedup_events", lambda t: ads.dedup_events(_line_events(t), "event_key", "received_at"))
_register(
    "version_history",
    lambda t: validity_ranges(
        t.raw("lineitem").select(*_LINE, "l_shipdate"), "l_partkey", "l_shipdate", ["l_orderkey", "l_linenumber", "l_suppkey"]
    ).drop("l_shipdate"),
)


def _order_sequence(t: StarTables) -> DataFrame:
    return ads.order_sequence(t.numbered_orders, heat=t.past_orders)


_register("order_sequence", _order_sequence, ("subtotal",))
_register("consumers_acquired", lambda t: ads.consumers_acquired(_order_sequence(t), t.memberships))
_register(
    "reorder_retention",
    lambda t: ads.reorder_retention(t.numbered_orders, heat=t.raw("lineitem")),
    (
        "sales",
        *[f"reorder_sales_{d}" for d in ("30", "60", "90", "since")],
        *[f"reorder_rate_{d}" for d in ("30", "60", "90", "since")],
        *[f"cx_reordered_{d}_rate" for d in ("30", "60", "90", "since")],
    ),
)
_register(
    "view_to_conversion",
    lambda t: ads.view_to_conversion(
        t.ad_views,
        t.ad_clicks.select("click_event_id", "impression_event_id", "click_timestamp"),
        t.ad_carts.select("click_event_id"),
        t.ad_orders.select("delivery_id", "click_event_id", "order_timestamp"),
    ),
)
_register(
    "request_funnel",
    lambda t: ads.request_funnel(
        t.ad_requests,
        t.funnel_stage("auction_id", "request_id", True, F.col("l_returnflag") != "R"),
        t.funnel_stage("impression_id", "auction_id", False, F.col("l_linestatus") == "F"),
        t.funnel_stage("click_id", "impression_id", False, F.col("l_discount") >= 0.05),
        t.funnel_stage("delivery_id", "click_id", False, F.col("l_tax") >= 0.04),
    ),
)
_register(
    "last_click_attribution",
    lambda t: ads.last_click_attribution(
        t.ad_orders.select("delivery_id", "consumer_id", "store_id", F.col("order_timestamp").alias("ordered_at")),
        t.ad_clicks.select(
            "consumer_id", "store_id", F.col("click_timestamp").alias("clicked_at"), F.col("click_event_id").alias("click_id")
        ),
        7 * 24,
    ),
)


def _campaign_parts(t: StarTables) -> list[DataFrame]:
    views = t.ad_views.select(
        F.col("store_id").alias("campaign_id"), F.to_date("impression_timestamp").alias("day"), F.lit(1).alias("impressions")
    )
    clicks = t.ad_clicks.select(
        F.col("store_id").alias("campaign_id"),
        F.to_date("click_timestamp").alias("day"),
        F.lit(1).alias("clicks"),
        (F.col("value") / 10).alias("cost"),
    )
    orders = t.ad_orders.select(
        F.col("store_id").alias("campaign_id"),
        F.to_date("order_timestamp").alias("day"),
        F.lit(1).alias("orders"),
        F.col("value").alias("sales"),
    )
    return [views, clicks, orders]


_register(
    "campaign_performance",
    lambda t: ads.campaign_performance(_campaign_parts(t)),
    ("sales", "cost", "click_through_rate", "conversion_rate", "aov", "cost_per_order", "roas"),
    digits=8,
)
_register(
    "top_items",
    lambda t: ads.top_list(
        t.raw("lineitem")
        .join(t.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("l_suppkey").alias("store_id"), F.col("p_name").alias("item")),
        "store_id",
        "item",
    ).withColumn("top_items", F.array_join("top_items", ",")),
)


def _attached(t: StarTables) -> DataFrame:
    orders = t.raw("orders").select(
        F.col("o_orderkey").alias("delivery_id"),
        F.to_date("o_orderdate").alias("active_date"),
        F.col("o_orderpriority").alias("cohort"),
        F.col("o_totalprice").alias("sales"),
    )
    lines = t.raw("lineitem").withColumn("delivery_id", F.col("l_orderkey"))
    return ads.attached_orders(
        orders,
        lines.where(F.col("l_discount") >= 0.08),
        lines.where(F.col("l_tax") >= 0.06),
        lines.where(F.col("l_quantity") >= 45),
    )


_register("attached_orders", _attached, ("store_sales",))
_register(
    "request_volume",
    lambda t: ads.request_volume(
        t.raw("events").select(
            F.to_date("ts").alias("active_date"), F.col("event_type").alias("placement"), F.col("props").alias("feature_id")
        )
    ),
)
_register(
    "zone_event_time",
    lambda t: t.raw("events").select(
        "event_id", "ts", zone_time("ts", "America/Los_Angeles").alias("zone_ts")
    ),
)


def _active_ranges(t: StarTables) -> DataFrame:
    first, last = F.least("o_orderdate", "l_shipdate"), F.greatest("o_orderdate", "l_shipdate")
    members = t.order_lines.select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        F.col("l_partkey").alias("campaign_id"),
        first.alias("member_start"),
        last.alias("member_end"),
    )
    campaigns = t.campaigns.select(
        "campaign_id", F.col("starts_at").alias("campaign_start"), F.col("ends_at").alias("campaign_end")
    )
    return ads.membership_active_range(members, campaigns)


_register("membership_active_range", _active_ranges)
_register(
    "normalised_query",
    lambda t: t.raw("documents").select("doc_id", normalised_query("text").alias("normalised")),
)
_register(
    "allocate_fee",
    lambda t: ads.allocate_fee(
        t.raw("part").select(F.col("p_partkey").alias("campaign_id"), F.col("p_retailprice").alias("fee")),
        t.raw("lineitem").select(
            "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("campaign_id"), "l_extendedprice"
        ),
        "l_extendedprice",
    ),
    ("fee_alloc",),
)
_register(
    "apportion_fee",
    lambda t: ads.apportion_fee(
        t.raw("part").select(F.col("p_partkey").alias("campaign_id"), F.round(F.col("p_retailprice") * 100).cast("bigint").alias("fee_cents")),
        t.raw("lineitem").select(
            F.col("l_partkey").alias("campaign_id"), "l_orderkey", "l_linenumber",
            F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price_cents"),
        ),
        "price_cents",
        ["l_orderkey", "l_linenumber"],
    ),
)
_register(
    "zone_order_time",
    lambda t: t.raw("orders")
    .select("o_orderkey", F.timestamp_add("HOUR", F.pmod("o_orderkey", F.lit(24)).cast("int"), F.col("o_orderdate").cast("timestamp_ntz")).alias("ordered_at"))
    .withColumn("zone_ts", zone_time("ordered_at", "America/Los_Angeles")),
)
