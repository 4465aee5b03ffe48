"""Ad and promotion fees of a brand, its rivals, and all stores its consumers can use.

One scan serves all three rows of a report. Fee rows are shuffled once, to meet
the eligible consumers, with hot consumers split; they are then summed per store
before they are shuffled again, and only those sums meet the store dimension, so
nothing is broadcast and neither a store's nor a rival list's size matters. Sums
are exact decimals until the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.scalars import EXACT, Day, cents, exact_sum, safe_ratio
from storelens.operators.joins import skew_join
from storelens.operators.metrics import metric_rows, optional_in
from storelens.plans.overview import brand_stores
from storelens.plans.visibility import eligible_consumers
from storelens.sources.days import in_days

# The labels readers of the reports know.
ADS_FEE_LABELS = (
    "Mx within Cx Radius Total Ads Fee",
    "Business Total Ads Fee",
    "Competitor Businesses Total Ads Fee",
)
PROMO_FEE_LABELS = (
    "Mx within Cx Radius Total Promo Fee",
    "Business Total Promo Fee",
    "Competitor Businesses Total Promo Fee",
)
ADS_PER_STORE_LABELS = (
    "Mx within Cx Radius Ads Fee per Store",
    "Business Ads Fee per Store",
    "Competitor Businesses Ads Fee per Store",
)
PROMO_PER_STORE_LABELS = (
    "Mx within Cx Radius Promo Fee per Store",
    "Business Promo Fee per Store",
    "Competitor Businesses Promo Fee per Store",
)


def _store_roles(tables, business_id: int, rivals: Sequence[int]) -> DataFrame:
    """Per store id: how many rows of it the brand and the rivals have.

    With no rivals named, every store counts as a rival's, the brand's own included.
    """
    rival_rows = optional_in(tables.stores, "business_id", rivals).select(
        "store_id", F.lit(0).alias("brand"), F.lit(1).alias("rival")
    )
    brand_rows = tables.stores.where(F.col("business_id") == business_id).select(
        "store_id", F.lit(1).alias("brand"), F.lit(0).alias("rival")
    )
    return (
        rival_rows.unionByName(brand_rows)
        .where(F.col("store_id").isNotNull())
        .groupBy("store_id")
        .agg(F.sum("brand").alias("brand_rows"), F.sum("rival").alias("rival_rows"))
    )


def _fee_summary(
    tables, fees: DataFrame, fee: str, business_id: int, rivals: Sequence[int], start: Day, end: Day
) -> DataFrame:
    """One row: fee sums and store counts of the reach, the brand and the rivals."""
    brand = brand_stores(tables, business_id)
    eligible = eligible_consumers(tables, brand).withColumn("eligible", F.lit(True))
    rows = in_days(fees, "created_at", start, end).select(
        "consumer_id", "store_id", F.col(fee).cast(EXACT).alias("fee")
    )
    per_store = (
        skew_join(rows, eligible, ["consumer_id"], "left")
        .groupBy("store_id")
        .agg(
            exact_sum("fee").alias("fee"),
            exact_sum(F.when(F.col("eligible"), F.col("fee"))).alias("reach_fee"),
            F.max("eligible").alias("in_reach"),
        )
    )
    joined = per_store.join(_store_roles(tables, business_id, rivals), "store_id", "full")
    is_brand, is_rival = F.col("brand_rows") > 0, F.col("rival_rows") > 0
    return joined.agg(
        cents(F.sum("reach_fee")).alias("reach_fee"),
        cents(F.sum(F.when(is_brand, F.col("fee")))).alias("brand_fee"),
        cents(F.sum(F.when(is_rival, F.col("fee")))).alias("rival_fee"),
        F.count(F.when(F.col("in_reach"), F.col("store_id"))).alias("reach_stores"),
        F.sum("brand_rows").alias("brand_stores"),
        F.sum("rival_rows").alias("rival_stores"),
    )


def _totals() -> tuple[Column, ...]:
    return tuple(F.col(f"{who}_fee") for who in ("reach", "brand", "rival"))


def _per_store() -> tuple[Column, ...]:
    """The reach divides by stores with fee rows, brand and rivals by all their stores."""
    return tuple(safe_ratio(f"{who}_fee", f"{who}_stores") for who in ("reach", "brand", "rival"))


def ads_fee_share(tables, business_id: int, rivals: Sequence[int], start: Day, end: Day) -> DataFrame:
    summary = _fee_summary(tables, tables.ad_fees, "ads_fee", business_id, rivals, start, end)
    return metric_rows(summary, "total_ads_fee", list(zip(ADS_FEE_LABELS, _totals())))


def promo_fee_share(tables, business_id: int, rivals: Sequence[int], start: Day, end: Day) -> DataFrame:
    summary = _fee_summary(tables, tables.promo_fees, "promotion_fee", business_id, rivals, start, end)
    return metric_rows(summary, "total_promo_fee", list(zip(PROMO_FEE_LABELS, _totals())))


def ads_fee_per_store(tables, business_id: int, rivals: Sequence[int], start: Day, end: Day) -> DataFrame:
    summary = _fee_summary(tables, tables.ad_fees, "ads_fee", business_id, rivals, start, end)
    return metric_rows(summary, "ads_fee_per_store", list(zip(ADS_PER_STORE_LABELS, _per_store())))


def promo_fee_per_store(tables, business_id: int, rivals: Sequence[int], start: Day, end: Day) -> DataFrame:
    summary = _fee_summary(tables, tables.promo_fees, "promotion_fee", business_id, rivals, start, end)
    return metric_rows(summary, "promo_fee_per_store", list(zip(PROMO_PER_STORE_LABELS, _per_store())))
