"""Role tables built from an order star schema (orders, lineitem, supplier, part, events)."""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.functions.scalars import exact_sum
from storelens.sources.roles import conform

# Lines that one task should join with their orders and sum.
SUMMED_ROWS = 250_000


def _delivery_id(order: str, store: str) -> Column:
    """Order and store with a separator, so no two pairs share an id."""
    return F.concat_ws("-", order, store)


class StarTables:
    """Role tables over one folder of parquet files; each is built when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """The table's frame; its file footers are read once."""
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._raw[name]

    @cached_property
    def order_lines(self) -> DataFrame:
        return self.raw("lineitem").join(
            self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey")
        )

    @cached_property
    def stores(self) -> DataFrame:
        frame = self.raw("supplier").select(
            F.col("s_suppkey").alias("store_id"),
            F.col("s_nationkey").cast("bigint").alias("business_id"),
            F.col("s_name").alias("name"),
        )
        return conform(frame, "stores")

    @cached_property
    def availability(self) -> DataFrame:
        frame = self.order_lines.select(
            F.col("l_suppkey").alias("store_id"), F.col("o_custkey").alias("consumer_id")
        )
        return conform(frame, "availability")

    @cached_property
    def events(self) -> DataFrame:
        store = F.regexp_extract("props", "([0-9]+)", 1).try_cast("bigint")
        return self.raw("events").withColumn("store_id", store)

    @cached_property
    def impressions(self) -> DataFrame:
        searched = F.col("event_type").isin("view", "click")
        term = F.when(searched, F.concat(F.lit(" "), "event_type", F.lit(" ")))
        frame = self.events.select(
            F.col("event_id").alias("id"),
            F.col("ts").alias("event_date"),
            F.col("user_id").alias("consumer_id"),
            "store_id",
            F.when(F.col("event_type") != "error", F.upper("event_type")).alias("product_name"),
            term.alias("search_term"),
            term.alias("search_term_clean"),
            F.col("value").alias("card_position"),
        )
        return conform(frame, "impressions")

    @cached_property
    def page_loads(self) -> list[DataFrame]:
        """Two sources: loads of the first and of the second half of the day."""
        loads = self.events.where(F.col("event_type") == "view").withColumnRenamed("ts", "timestamp")
        hour = F.hour("timestamp")
        return [conform(loads.where(part), "page_loads") for part in (hour < 12, hour >= 12)]

    @cached_property
    def cart_adds(self) -> list[DataFrame]:
        """Three sources: adds of the night, the day and the evening."""
        part = self.raw("part")
        items = part.select("p_partkey", F.col("p_name").alias("item_name"))
        clicks = (
            self.events.where(F.col("event_type") == "click")
            .withColumn("p_partkey", F.pmod("event_id", part.agg(F.count("*")).scalar()))
            .withColumnRenamed("ts", "timestamp")
        )
        adds = clicks.join(items, "p_partkey")
        hour = F.hour("timestamp")
        parts = (hour < 8, (hour >= 8) & (hour < 16), hour >= 16)
        return [conform(adds.where(part), "cart_adds") for part in parts]

    @cached_property
    def deliveries(self) -> DataFrame:
        """One delivery per order and store.

        Business, store and date are grouping columns, so filters on them reach
        the scans and fewer lines are shuffled.
        """
        lines = self.order_lines.join(self.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        keys = ("l_orderkey", "l_suppkey", "s_nationkey", "o_custkey", "o_orderdate", "o_orderstatus")
        frame = (
            lines.groupBy(*keys)
            .agg(exact_sum("l_extendedprice").cast("double").alias("subtotal"))
            .select(
                _delivery_id("l_orderkey", "l_suppkey").alias("delivery_id"),
                F.col("l_suppkey").alias("store_id"),
                F.col("s_nationkey").alias("business_id"),
                F.col("o_custkey").alias("creator_id"),
                "subtotal",
                F.col("o_orderdate").alias("created_at"),
                F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("cancelled_at"),
                F.col("l_orderkey").alias("order_cart_uuid"),
                (F.col("o_orderstatus") == "F").alias("is_filtered_core"),
            )
        )
        return conform(frame, "deliveries")

    @cached_property
    def order_items(self) -> DataFrame:
        frame = (
            self.raw("lineitem")
            .join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                _delivery_id("l_orderkey", "l_suppkey").alias("delivery_id"),
                F.col("p_name").alias("item_name"),
            )
        )
        return conform(frame, "order_items")

    @cached_property
    def checkouts(self) -> list[DataFrame]:
        """Two sources: urgent orders and all others."""
        orders = self.raw("orders").withColumns(
            {
                "order_uuid": F.col("o_orderkey"),
                "user_id": F.col("o_custkey"),
                "timestamp": F.col("o_orderdate"),
            }
        )
        urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
        return [conform(orders.where(part), "checkouts") for part in (urgent, ~urgent)]

    def _fees(self, rate: str, name: str, role: str) -> DataFrame:
        frame = self.order_lines.select(
            F.col("l_suppkey").alias("store_id"),
            F.col("o_custkey").alias("consumer_id"),
            (F.col("l_extendedprice") * F.col(rate)).alias(name),
            F.col("o_orderdate").alias("created_at"),
        )
        return conform(frame, role)

    @cached_property
    def ad_fees(self) -> DataFrame:
        return self._fees("l_discount", "ads_fee", "ad_fees")

    @cached_property
    def promo_fees(self) -> DataFrame:
        return self._fees("l_tax", "promotion_fee", "promo_fees")

    @cached_property
    def query_log(self) -> DataFrame:
        frame = self.events.select(
            F.concat(F.lit("USER_"), "user_id").alias("user_name"),
            F.col("ts").alias("end_time"),
            F.concat_ws(" ", "event_type", "props").alias("query_text"),
        )
        return conform(frame, "query_log")

    # Inputs of the eligibility rules.

    @cached_property
    def store_views(self) -> DataFrame:
        return self.order_lines.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("view_id"),
            F.col("l_shipdate").alias("event_date"),
            F.col("l_suppkey").alias("store_id"),
            F.col("o_custkey").alias("consumer_id"),
        )

    @cached_property
    def past_orders(self) -> DataFrame:
        return self.order_lines.select(
            F.col("o_custkey").alias("consumer_id"),
            F.col("l_suppkey").alias("store_id"),
            F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def lines_by_store(self) -> DataFrame:
        """The store of each row of `store_views` and of `past_orders`, both being order lines."""
        stores = self.raw("lineitem").select(F.col("l_suppkey").alias("store_id"))
        return stores.unionByName(stores)

    @cached_property
    def memberships(self) -> DataFrame:
        """Members are consumers in the 30 days from an urgent order on, one row per day."""
        day = F.to_date("o_orderdate")
        urgent = self.raw("orders").where(F.col("o_orderpriority") == "1-URGENT")
        return urgent.select(
            F.col("o_custkey").alias("consumer_id"),
            F.explode(F.sequence(day, F.date_add(day, 29))).alias("day"),
        )

    @cached_property
    def campaigns(self) -> DataFrame:
        """One campaign per part; its kind is the part's type, its days follow size and price."""
        start = F.date_add(F.lit("1995-01-01").cast("date"), F.col("p_size") * 40)
        length = F.floor(F.col("p_retailprice") - 890).cast("int")

        def on(kind: str) -> Column:
            return (F.col("p_type") == kind).cast("int")

        return self.raw("part").select(
            F.col("p_partkey").alias("campaign_id"),
            F.pmod("p_partkey", self.raw("supplier").agg(F.count("*")).scalar()).alias("store_id"),
            on("ECONOMY").alias("is_classic"),
            on("STANDARD").alias("is_new_store_consumers"),
            on("PROMO").alias("is_member"),
            on("LARGE").alias("is_winback"),
            F.when((F.col("p_type") == "LARGE") & (F.col("p_size") > 10), F.col("p_size") * 10).alias(
                "winback_days"
            ),
            start.cast("timestamp_ntz").alias("starts_at"),
            F.when(F.col("p_brand") != "Brand#2", F.date_add(start, length).cast("timestamp_ntz")).alias(
                "ends_at"
            ),
        )

    # Inputs of the ad measures.

    def _events_of(self, kind: str) -> DataFrame:
        return self.events.where(F.col("event_type") == kind)

    @cached_property
    def ad_views(self) -> DataFrame:
        return self._events_of("view").select(
            F.col("event_id").alias("impression_event_id"),
            F.col("user_id").alias("consumer_id"),
            "store_id",
            F.col("ts").alias("impression_timestamp"),
        )

    @cached_property
    def ad_clicks(self) -> DataFrame:
        """A click belongs to the event just before it."""
        return self._events_of("click").select(
            F.col("event_id").alias("click_event_id"),
            (F.col("event_id") - 1).alias("impression_event_id"),
            F.col("user_id").alias("consumer_id"),
            "store_id",
            F.col("ts").alias("click_timestamp"),
            "value",
        )

    @cached_property
    def ad_carts(self) -> DataFrame:
        """Items put into a cart: sign-ups stand for them; one belongs to the event just before it."""
        return self._events_of("signup").select((F.col("event_id") - 1).alias("click_event_id"))

    @cached_property
    def ad_orders(self) -> DataFrame:
        """An order belongs to the event just before it."""
        return self._events_of("purchase").select(
            F.col("event_id").alias("delivery_id"),
            (F.col("event_id") - 1).alias("click_event_id"),
            F.col("user_id").alias("consumer_id"),
            "store_id",
            F.col("ts").alias("order_timestamp"),
            "value",
        )

    @cached_property
    def ad_requests(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("request_id"), F.col("o_orderpriority").alias("product_surface")
        )

    def funnel_stage(self, key: str, parent: str, parent_is_request: bool, condition: Column) -> DataFrame:
        """Order lines that meet a condition, as one stage of the request funnel."""
        line = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        above = F.col("l_orderkey") if parent_is_request else line
        return self.raw("lineitem").where(condition).select(line.alias(key), above.alias(parent))

    @cached_property
    def numbered_orders(self) -> DataFrame:
        """Deliveries for order sequences: business = nation, business group = region."""
        stores = self.raw("supplier").join(
            self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey")
        )
        # Dealt out by number of rows: a task that sums lines holds several times what its shuffled rows take.
        lines = self.raw("lineitem")
        tasks = max(1, math.ceil(lines.count() / SUMMED_ROWS))
        order_lines = lines.repartition(tasks, "l_orderkey").join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        return (
            order_lines.groupBy("l_orderkey", "l_suppkey", "o_custkey", "o_orderdate")
            .agg(exact_sum("l_extendedprice").cast("double").alias("subtotal"), F.min("l_partkey").alias("campaign_id"))
            .join(stores, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(
                _delivery_id("l_orderkey", "l_suppkey").alias("delivery_id"),
                F.col("o_custkey").alias("consumer_id"),
                F.col("l_suppkey").alias("store_id"),
                F.col("s_nationkey").alias("business_id"),
                F.col("n_regionkey").alias("business_group_id"),
                "campaign_id",
                F.col("o_orderdate").alias("created_at"),
                "subtotal",
            )
        )

    # Inputs of the schema jobs.

    @cached_property
    def text_definitions(self) -> DataFrame:
        """One table definition per document, with the whole document as a column comment."""
        ddl = F.concat(
            F.lit("CREATE TABLE DOC_"),
            "doc_id",
            F.lit(" (\n\tDOC_ID NUMBER(38,0) NOT NULL COMMENT 'key, fixed', \n\tBODY TEXT COMMENT '"),
            "text",
            F.lit("', \n\tLANG_"),
            F.upper("lang"),
            F.lit(" VARCHAR(16), \n\tN_CHARS NUMBER(38, 0)\n)"),
        )
        return self.raw("documents").select(
            F.concat(F.lit("DOC_"), "doc_id").alias("table_name"), ddl.alias("ddl")
        )

    def part_definitions(self, new: bool) -> DataFrame:
        """One definition per part; the new version of some differs from the old one by size."""
        size = F.col("p_size")
        name = F.regexp_replace(F.upper("p_name"), " ", "_")
        price = F.when(size < 10, "FLOAT").otherwise("number(38,0)") if new else F.lit("NUMBER(38,0)")
        pair = F.concat(name, F.lit("_ID TEXT COMMENT 'id, "), "p_name", F.lit("', \n\t"), F.lit("PRICE "), price)
        swapped = F.concat(F.lit("PRICE "), price, F.lit(", \n\t"), name, F.lit("_ID TEXT"))
        columns = F.when(size.between(10, 15), swapped).otherwise(pair) if new else pair
        extra = F.when(size.between(16, 20), ", LISTED DATE").otherwise("") if new else F.lit("")
        twice = F.when(size.between(21, 25), ", PRICE FLOAT").otherwise("")
        renamed = F.when(size.between(26, 30), ", KIND_NEW TEXT") if new else F.when(
            size.between(26, 30), ", KIND TEXT"
        )
        closing = F.when(size.between(31, 32), "").otherwise(")") if new else F.lit(")")
        untyped = F.when(size.between(33, 35), ", LOOSE").otherwise("")
        ddl = F.concat(
            F.lit("create table PART_"),
            "p_partkey",
            F.lit(" ("),
            columns,
            extra,
            twice,
            F.coalesce(renamed, F.lit("")),
            untyped,
            closing,
        )
        return self.raw("part").select(
            F.concat(F.lit("PART_"), "p_partkey").alias("table_name"), ddl.alias("ddl")
        )

    @cached_property
    def catalog(self) -> DataFrame:
        """A column catalogue: tables are orders, columns their items, types follow the part."""
        kind = F.when(F.col("p_size") <= 7, "NUMBER")
        for limit, name in ((14, "TEXT"), (21, "BOOLEAN"), (28, "TIMESTAMP_NTZ"), (35, "FLOAT"), (42, "DATE")):
            kind = kind.when(F.col("p_size") <= limit, name)
        return (
            self.raw("lineitem")
            .join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.concat(F.lit("ORDER_"), "l_orderkey").alias("table_name"),
                F.concat_ws("_", F.regexp_replace(F.upper("p_name"), " ", "_"), "p_brand").alias("column_name"),
                F.col("l_linenumber").alias("ordinal"),
                kind.otherwise("ARRAY").alias("data_type"),
            )
        )

    @cached_property
    def priced_catalog(self) -> DataFrame:
        """The catalogue with names that say what a number is."""
        said = F.when(F.col("data_type") == "NUMBER", "_PRICE").when(F.col("data_type") == "FLOAT", "_RATE").otherwise("")
        return self.catalog.withColumn("column_name", F.concat("column_name", said))

    @cached_property
    def known_tables(self) -> DataFrame:
        return self.raw("orders").select(F.concat(F.lit("ORDER_"), "o_orderkey").alias("table_name"))
