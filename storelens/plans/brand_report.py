"""The whole brand report: all seventeen parts for one business and one range of days."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame

from storelens.functions.scalars import Day
from storelens.plans import engagement, fees, overview, visibility

DAILY = (
    overview.business_overview,
    visibility.impression_share,
    visibility.consumer_reach,
    visibility.keyword_rank,
    engagement.consumers_impressed,
    engagement.consumers_visited,
    engagement.consumers_added_item,
    engagement.consumers_ordered,
    engagement.items_added_by_consumers,
    engagement.items_ordered_by_consumers,
    engagement.unique_items_added,
    engagement.unique_items_ordered,
)
AGAINST_RIVALS = (
    fees.ads_fee_share,
    fees.promo_fee_share,
    fees.ads_fee_per_store,
    fees.promo_fee_per_store,
)


def brand_report(
    tables, business_id: int, rivals: Sequence[int], start: Day, end: Day
) -> Iterator[tuple[str, DataFrame]]:
    """Name and frame of each part in reading order, built when it is asked for."""
    yield "store_list", overview.store_list(tables, business_id)
    for part in DAILY:
        yield part.__name__, part(tables, business_id, start, end)
    for part in AGAINST_RIVALS:
        yield part.__name__, part(tables, business_id, rivals, start, end)
