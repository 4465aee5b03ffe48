"""All parts together, and the columns each of them promises."""

from __future__ import annotations

from role_frames import role_tables

from storelens.plans.brand_report import brand_report

COLUMNS = {
    "store_list": ["store_id:bigint", "store_name:string"],
    "business_overview": ["store_count:bigint", "orders:bigint", "sales:double"],
    "impression_share": ["metric:string", "impressions:double"],
    "consumer_reach": ["metric:string", "unique_cx_ct:double"],
    "keyword_rank": [
        "product_name:string",
        "product_surface:string",
        "brand_average_card_position:double",
        "brand_impressions_from_eligible_cx:bigint",
        "total_impressions_from_eligible_cx:bigint",
        "impression_share_from_eligible_cx:double",
        "brand_impression_unique_cx_ct:bigint",
        "total_impression_unique_cx_ct:bigint",
        "unique_cx_share:double",
    ],
    "consumers_impressed": ["unique_cx_count:bigint"],
    "consumers_visited": ["unique_cx_ct:bigint"],
    "consumers_added_item": ["unique_cx_count:bigint"],
    "consumers_ordered": ["unique_cx_count:bigint"],
    "items_added_by_consumers": ["item_name:string", "unique_cx_count:bigint"],
    "items_ordered_by_consumers": ["item_name:string", "unique_cx_count:bigint"],
    "unique_items_added": ["unique_item_count:bigint"],
    "unique_items_ordered": ["unique_item_count:bigint"],
    "ads_fee_share": ["metric:string", "total_ads_fee:double"],
    "promo_fee_share": ["metric:string", "total_promo_fee:double"],
    "ads_fee_per_store": ["metric:string", "ads_fee_per_store:double"],
    "promo_fee_per_store": ["metric:string", "promo_fee_per_store:double"],
}


def test_parts_and_their_columns(spark):
    tables = role_tables(spark)
    found = {
        name: [f"{column}:{kind}" for column, kind in frame.dtypes]
        for name, frame in brand_report(tables, 7, [], "2024-01-01", "2024-01-31")
    }
    assert found == COLUMNS
    assert list(found) == list(COLUMNS)
