"""Brand visibility: who could see the brand's stores, who did, and for which terms.

Eligible consumers are those to whom a store of the brand is available. They may
be many, so they are never broadcast. Impressions are summed per consumer before
they meet them, or, where the sums are finer, joined with hot consumers split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.scalars import Day, product_surface, safe_ratio, search_label
from storelens.operators.joins import Cohort, distinct_keys, in_cohort, mark_cohort, skew_join
from storelens.operators.metrics import metric_rows
from storelens.plans.overview import brand_stores
from storelens.sources.days import in_days

# The labels readers of the reports know, one with a trailing blank.
IMPRESSION_LABELS = (
    "Impressions on the Business from Eligible Cx",
    "Total Impressions from Eligible Cx ",
    "Impressions on the Busines as a Share of Total Impressions from Eligible Cx",
)
REACH_LABELS = (
    "Total Cx within Radius",
    "Cx within Radius Reached",
    "Cx Reached as a Share of Total Cx within Radius",
)


def eligible_consumers(tables, brand: Cohort) -> DataFrame:
    """Consumers to whom a store of the brand is available, each once, at any time."""
    return distinct_keys(in_cohort(tables.availability, brand), "consumer_id")


def _shown(tables, start: Day, end: Day) -> DataFrame:
    return in_days(tables.impressions, "event_date", start, end)


def impression_share(tables, business_id: int, start: Day, end: Day) -> DataFrame:
    """Impressions on the business, all impressions, and their ratio, from eligible consumers."""
    brand = brand_stores(tables, business_id)
    per_consumer = (
        mark_cohort(_shown(tables, start, end), brand, "on_brand")
        .groupBy("consumer_id")
        .agg(
            F.count("id").alias("shown"),
            F.count(F.when(F.col("on_brand"), F.col("id"))).alias("shown_brand"),
        )
    )
    eligible = per_consumer.join(eligible_consumers(tables, brand), "consumer_id", "left_semi")
    summary = eligible.agg(
        F.coalesce(F.sum("shown"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("shown_brand"), F.lit(0)).alias("brand"),
    )
    values = (F.col("brand"), F.col("total"), safe_ratio("brand", "total"))
    return metric_rows(summary, "impressions", list(zip(IMPRESSION_LABELS, values)))


def consumer_reach(tables, business_id: int, start: Day, end: Day) -> DataFrame:
    """Eligible consumers, those with an impression on the business, and their ratio."""
    brand = brand_stores(tables, business_id)
    viewers = distinct_keys(in_cohort(_shown(tables, start, end), brand), "consumer_id")
    reached = viewers.withColumn("reached", F.lit(True))
    summary = (
        eligible_consumers(tables, brand)
        .join(reached, "consumer_id", "left")
        .agg(F.count("consumer_id").alias("eligible"), F.count("reached").alias("reached"))
    )
    values = (F.col("eligible"), F.col("reached"), safe_ratio("reached", "eligible"))
    return metric_rows(summary, "unique_cx_ct", list(zip(REACH_LABELS, values)))


def keyword_rank(tables, business_id: int, start: Day, end: Day) -> DataFrame:
    """Search terms and carousels that showed the brand, by impressions on it.

    One scan: rows are summed per term, surface and consumer, tasks first, before
    they meet the eligible consumers, so a consumer with very many rows is a few;
    distinct consumers are then plain counts. A term the brand was never shown for
    is left out.
    """
    brand = brand_stores(tables, business_id)
    shown = _shown(tables, start, end).where(F.col("product_name").isNotNull())
    rows = mark_cohort(shown, brand, "on_brand").select(
        "consumer_id",
        search_label("search_term_clean", "product_name").alias("product_name"),
        product_surface("search_term").alias("product_surface"),
        "on_brand",
        F.col("id").isNotNull().alias("counts"),
        F.when(F.col("on_brand"), F.col("card_position")).alias("position"),
    )
    per_consumer = rows.where(F.col("consumer_id").isNotNull()).groupBy("product_name", "product_surface", "consumer_id").agg(
        F.count_if("counts").alias("shown"),
        F.count_if(F.col("counts") & F.col("on_brand")).alias("shown_brand"),
        F.sum("position").alias("position_sum"),
        F.count("position").alias("position_count"),
        F.max("on_brand").alias("on_brand"),
    )
    eligible = skew_join(per_consumer, eligible_consumers(tables, brand), ["consumer_id"], "left_semi")
    terms = (
        eligible.groupBy("product_name", "product_surface")
        .agg(
            F.sum("shown").alias("shown"),
            F.sum("shown_brand").alias("shown_brand"),
            F.sum("position_sum").alias("position_sum"),
            F.sum("position_count").alias("position_count"),
            F.count("consumer_id").alias("consumers"),
            F.count(F.when(F.col("on_brand"), F.col("consumer_id"))).alias("consumers_brand"),
            F.max("on_brand").alias("on_brand"),
        )
        .where("on_brand")
    )
    position = F.col("position_sum") / F.nullif(F.col("position_count"), F.lit(0))
    return terms.select(
        "product_name",
        "product_surface",
        position.alias("brand_average_card_position"),
        F.col("shown_brand").alias("brand_impressions_from_eligible_cx"),
        F.col("shown").alias("total_impressions_from_eligible_cx"),
        safe_ratio("shown_brand", "shown").alias("impression_share_from_eligible_cx"),
        F.col("consumers_brand").alias("brand_impression_unique_cx_ct"),
        F.col("consumers").alias("total_impression_unique_cx_ct"),
        safe_ratio("consumers_brand", "consumers").alias("unique_cx_share"),
    ).orderBy(F.desc("brand_impressions_from_eligible_cx"), "product_name", "product_surface")
