"""Which consumers were eligible for which store campaigns when they saw a store.

The rules are known in words only; where the words leave a choice, the docstring
of the step says what was chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.scalars import Day
from storelens.operators.intervals import moments_in_intervals
from storelens.operators.joins import skew_join
from storelens.operators.timeline import last_before
from storelens.sources.contracts import conform_to, contract
from storelens.sources.days import in_days

# Fixed column order and types of the result.
ELIGIBILITY = contract(
    ("view_id", "string", "impression id"),
    ("event_date", "timestamp_ntz", "when the impression happened, UTC"),
    ("store_id", "string", "store shown"),
    ("consumer_id", "string", "consumer it was shown to"),
    ("cx_is_member", "bigint", "1 if the consumer was a member that day"),
    ("last_order_date", "date", "day of the consumer's latest earlier order at the store"),
    ("days_since_last_order", "string", "days from that order to the impression"),
    ("campaign_id", "bigint", "campaign of the store active at the impression"),
    ("is_classic", "bigint", "1 if the campaign is for non-members only"),
    ("is_new_store_consumers", "bigint", "1 if it is for consumers new to the store only"),
    ("is_member", "bigint", "1 if it is for members only"),
    ("is_winback", "bigint", "1 if it is for consumers who ordered at the store before"),
    ("winback_days", "bigint", "days without an order a win-back campaign asks for"),
    ("is_classic_eligible", "bigint", "1 if the non-member setting lets the consumer in"),
    ("is_new_store_consumers_eligible", "bigint", "1 if the new-to-store setting does"),
    ("is_winback_eligible", "bigint", "1 if the win-back setting does"),
    ("is_member_eligible", "bigint", "1 if the member setting does"),
    ("cx_eligible", "bigint", "1 if all four settings do"),
)


# Days of a member packed into one number.
SPAN_BITS = 6
SPAN = 1 << SPAN_BITS


def with_last_order(impressions: DataFrame, orders: DataFrame, **cut) -> DataFrame:
    """Adds `last_order_date` and `days_since_last_order`.

    Only orders strictly before the impression count; one at the same instant does not.
    """
    placed = orders.select("consumer_id", "store_id", F.col("created_at").alias("ordered_at"))
    found = last_before(
        impressions, placed, ["consumer_id", "store_id"], "event_date", "ordered_at", **cut
    )
    dated = found.withColumn("last_order_date", F.to_date("last.ordered_at")).drop("last")
    days = F.datediff("event_date", "last_order_date").cast("string")
    return dated.withColumn("days_since_last_order", days)


def member_spans(memberships: DataFrame) -> DataFrame:
    """consumer_id, `_span` and `_days`: the days of a consumer, `SPAN` of them to a row, as bits of a number."""
    day = F.unix_date(F.to_date("day"))
    placed = memberships.select("consumer_id", F.shiftright(day, SPAN_BITS).alias("_span"), F.pmod(day, F.lit(SPAN)).alias("_bit"))
    listed = placed.where(F.col("_bit").isNotNull())
    return listed.groupBy("consumer_id", "_span").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_days"))


def with_membership(impressions: DataFrame, memberships: DataFrame) -> DataFrame:
    """Adds `cx_is_member`: 1 if the consumer is listed as a member on the impression's day.

    Days are packed before they are shuffled, so a month of membership is a row or two.
    """
    shown = F.unix_date(F.to_date("event_date"))
    dated = impressions.withColumn("_span", F.shiftright(shown, SPAN_BITS))
    joined = skew_join(dated, member_spans(memberships), ["consumer_id", "_span"], "left")
    listed = F.getbit("_days", F.pmod(shown, F.lit(SPAN))).cast("int")
    return joined.withColumn("cx_is_member", F.coalesce(listed, F.lit(0))).drop("_span", "_days")


def with_campaigns(
    impressions: DataFrame,
    campaigns: DataFrame,
    start: Day,
    end: Day,
    max_bytes: int | None = None,
) -> DataFrame:
    """One row per impression in the days and campaign of its store then active.

    Active means starts_at <= impression < ends_at; no end is open. A campaign
    is at most two rows of the join, however long it runs, and an impression
    meets only campaigns whose bin of the calendar holds it.
    """
    first = F.lit(start).cast("timestamp_ntz")
    past = F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
    shown = in_days(impressions, "event_date", start, end)
    found = moments_in_intervals(
        shown, campaigns, ["store_id"], "event_date", "starts_at", "ends_at", first, past, max_bytes
    )
    return found.drop("starts_at", "ends_at")


def _required(setting: str, met: Column) -> Column:
    """1 unless the setting is on and its condition is not met."""
    return F.when((F.col(setting) == 1) & ~met, 0).otherwise(1)


def with_eligibility(rows: DataFrame) -> DataFrame:
    """Adds one flag per setting and their product.

    Win-back asks for an earlier order at least `winback_days` ago; a missing
    threshold is 0.
    """
    member = F.col("cx_is_member") == 1
    ordered = F.col("last_order_date").isNotNull()
    away = F.coalesce(
        F.col("days_since_last_order").cast("int") >= F.coalesce("winback_days", F.lit(0)),
        F.lit(False),
    )
    flags = {
        "is_classic_eligible": _required("is_classic", ~member),
        "is_new_store_consumers_eligible": _required("is_new_store_consumers", ~ordered),
        "is_winback_eligible": _required("is_winback", ordered & away),
        "is_member_eligible": _required("is_member", member),
    }
    product = F.lit(1)
    for name in flags:
        product = product * F.col(name)
    return rows.withColumns(flags).withColumn("cx_eligible", product)


def promo_eligibility(
    impressions: DataFrame,
    orders: DataFrame,
    memberships: DataFrame,
    campaigns: DataFrame,
    start: Day,
    end: Day,
    **cut,
) -> DataFrame:
    """The full result, one row per impression in the days and active campaign."""
    shown = in_days(impressions, "event_date", start, end)
    earlier = orders.where(F.col("created_at") < F.date_add(F.lit(end).cast("date"), 1))
    of_days = F.to_date("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    known = with_last_order(with_membership(shown, memberships.where(of_days)), earlier, heat=shown, **cut)
    rows = with_campaigns(known, campaigns, start, end)
    return conform_to(with_eligibility(rows), ELIGIBILITY)
