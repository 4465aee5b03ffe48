"""DuckDB text for the registered queries, written apart from the Spark code.

Reports keep the shape "one common table expression per step, one scan per
number", which the Spark plans do not, so the two check each other.
"""

from __future__ import annotations

ROLES = {
    "stores": "SELECT s_suppkey AS store_id, s_nationkey AS business_id, s_name AS name FROM supplier",
    "store": "SELECT store_id FROM stores WHERE business_id = 15",
    "availability": """SELECT l_suppkey AS store_id, o_custkey AS consumer_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "near": """SELECT DISTINCT consumer_id FROM availability
        WHERE store_id IN (SELECT store_id FROM store)""",
    "impressions": """SELECT CAST(event_id AS VARCHAR) AS id, ts AS event_date, user_id AS consumer_id,
        TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS store_id, value AS card_position,
        CASE WHEN event_type <> 'error' THEN upper(event_type) END AS product_name,
        CASE WHEN event_type IN ('view', 'click') THEN ' ' || event_type || ' ' END AS search_term,
        CASE WHEN event_type IN ('view', 'click') THEN ' ' || event_type || ' ' END AS search_term_clean
        FROM events""",
    "shown": """SELECT * FROM impressions WHERE event_date >= TIMESTAMP '2024-01-05'
        AND event_date < TIMESTAMP '2024-01-20' + INTERVAL 1 DAY""",
    "loads": """SELECT user_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS store_id, ts
        FROM events WHERE event_type = 'view'""",
    "adds": """SELECT user_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS store_id, ts, p_name AS item_name
        FROM events JOIN part ON p_partkey = event_id % (SELECT count(*) FROM part) WHERE event_type = 'click'""",
    "deliveries": """SELECT l_orderkey || '-' || l_suppkey AS delivery_id, l_suppkey AS store_id,
        s_nationkey AS business_id, o_custkey AS creator_id, subtotal, o_orderdate AS created_at,
        CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS cancelled_at,
        l_orderkey AS order_cart_uuid, o_orderstatus = 'F' AS is_filtered_core
        FROM (SELECT l_orderkey, l_suppkey, sum(l_extendedprice) AS subtotal FROM lineitem GROUP BY ALL)
        JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey""",
    "order_items": """SELECT l_orderkey || '-' || l_suppkey AS delivery_id, p_name AS item_name
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "checkouts": "SELECT o_orderkey AS order_uuid, o_custkey AS user_id, o_orderdate AS ts FROM orders",
    "bought": """SELECT i.item_name, c.user_id FROM checkouts c
        JOIN deliveries d ON c.order_uuid = d.order_cart_uuid JOIN order_items i ON d.delivery_id = i.delivery_id
        WHERE d.store_id IN (SELECT store_id FROM store) AND d.is_filtered_core
        AND c.ts >= TIMESTAMP '1997-01-01' AND c.ts < TIMESTAMP '1997-12-31' + INTERVAL 1 DAY""",
    "fees": """SELECT l_suppkey AS store_id, o_custkey AS consumer_id, l_extendedprice * l_discount AS ads_fee,
        l_extendedprice * l_tax AS promotion_fee FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-12-31' + INTERVAL 1 DAY""",
    "views": """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS view_id,
        l_shipdate AS event_date, l_suppkey AS store_id, o_custkey AS consumer_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "past": """SELECT DISTINCT o_custkey AS consumer_id, l_suppkey AS store_id, o_orderdate AS created_at
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "prior_order": """SELECT v.consumer_id, v.store_id, v.event_date, max(p.created_at) AS last_at
        FROM (SELECT DISTINCT consumer_id, store_id, event_date FROM views) v
        JOIN past p ON p.consumer_id = v.consumer_id AND p.store_id = v.store_id AND p.created_at < v.event_date
        GROUP BY ALL""",
    "dated": """SELECT v.*, CAST(a.last_at AS DATE) AS last_order_date,
        CAST(date_diff('day', a.last_at, v.event_date) AS VARCHAR) AS days_since_last_order
        FROM views v LEFT JOIN prior_order a USING (consumer_id, store_id, event_date)""",
    "membership": """SELECT DISTINCT o_custkey AS consumer_id, CAST(o_orderdate AS DATE) + CAST(d AS INTEGER) AS day
        FROM orders, range(30) r(d) WHERE o_orderpriority = '1-URGENT'""",
    "ranges": """SELECT p_partkey AS campaign_id, p_partkey % (SELECT count(*) FROM supplier) AS store_id,
        CAST(p_type = 'ECONOMY' AS INTEGER) AS is_classic,
        CAST(p_type = 'STANDARD' AS INTEGER) AS is_new_store_consumers,
        CAST(p_type = 'PROMO' AS INTEGER) AS is_member, CAST(p_type = 'LARGE' AS INTEGER) AS is_winback,
        CASE WHEN p_type = 'LARGE' AND p_size > 10 THEN p_size * 10 END AS winback_days,
        CAST(DATE '1995-01-01' + p_size * 40 AS TIMESTAMP) AS starts_at,
        CASE WHEN p_brand <> 'Brand#2' THEN CAST(DATE '1995-01-01' + p_size * 40
            + CAST(floor(p_retailprice - 890) AS INTEGER) AS TIMESTAMP) END AS ends_at FROM part""",
    "actions": """SELECT event_id, user_id AS consumer_id, event_type, ts, value,
        TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS store_id FROM events""",
    "placed": """SELECT l_orderkey || '-' || l_suppkey AS delivery_id, o_custkey AS consumer_id,
        l_suppkey AS store_id, s_nationkey AS business_id, n_regionkey AS business_group_id,
        min(l_partkey) AS campaign_id, o_orderdate AS created_at, sum(l_extendedprice) AS subtotal
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey
        GROUP BY l_orderkey, l_suppkey, o_custkey, s_nationkey, n_regionkey, o_orderdate""",
    "numbered": """SELECT *, row_number() OVER (PARTITION BY consumer_id, store_id ORDER BY created_at, delivery_id) AS store_cx_rn,
        row_number() OVER (PARTITION BY consumer_id, business_id ORDER BY created_at, delivery_id) AS business_cx_rn,
        row_number() OVER (PARTITION BY consumer_id, business_group_id ORDER BY created_at, delivery_id) AS business_group_cx_rn,
        row_number() OVER (PARTITION BY consumer_id ORDER BY created_at, delivery_id) AS cx_rn FROM placed""",
    "doc_ddl": """SELECT 'DOC_' || doc_id AS table_name, 'CREATE TABLE DOC_' || doc_id || ' (' || chr(10) || chr(9)
        || 'DOC_ID NUMBER(38,0) NOT NULL COMMENT ''key, fixed'', ' || chr(10) || chr(9) || 'BODY TEXT COMMENT '''
        || text || ''', ' || chr(10) || chr(9) || 'LANG_' || upper(lang) || ' VARCHAR(16), ' || chr(10) || chr(9)
        || 'N_CHARS NUMBER(38, 0)' || chr(10) || ')' AS ddl FROM documents""",
    "part_pieces": """SELECT p_partkey, p_size, replace(upper(p_name), ' ', '_') AS n, p_name,
        CASE WHEN p_size < 10 THEN 'FLOAT' ELSE 'number(38,0)' END AS new_price,
        CASE WHEN p_size BETWEEN 21 AND 25 THEN ', PRICE FLOAT' ELSE '' END AS twice,
        CASE WHEN p_size BETWEEN 33 AND 35 THEN ', LOOSE' ELSE '' END AS untyped FROM part""",
    "new_ddl": """SELECT 'PART_' || p_partkey AS table_name, 'create table PART_' || p_partkey || ' ('
        || CASE WHEN p_size BETWEEN 10 AND 15 THEN 'PRICE ' || new_price || ', ' || chr(10) || chr(9) || n || '_ID TEXT'
           ELSE n || '_ID TEXT COMMENT ''id, ' || p_name || ''', ' || chr(10) || chr(9) || 'PRICE ' || new_price END
        || CASE WHEN p_size BETWEEN 16 AND 20 THEN ', LISTED DATE' ELSE '' END || twice
        || CASE WHEN p_size BETWEEN 26 AND 30 THEN ', KIND_NEW TEXT' ELSE '' END || untyped
        || CASE WHEN p_size BETWEEN 31 AND 32 THEN '' ELSE ')' END AS ddl FROM part_pieces""",
    "old_ddl": """SELECT 'PART_' || p_partkey AS table_name, 'create table PART_' || p_partkey || ' ('
        || n || '_ID TEXT COMMENT ''id, ' || p_name || ''', ' || chr(10) || chr(9) || 'PRICE NUMBER(38,0)' || twice
        || CASE WHEN p_size BETWEEN 26 AND 30 THEN ', KIND TEXT' ELSE '' END || untyped || ')' AS ddl FROM part_pieces""",
    "ddls": "SELECT * FROM doc_ddl UNION ALL SELECT * FROM new_ddl",
    "catalog": """SELECT 'ORDER_' || l_orderkey AS table_name,
        replace(upper(p_name), ' ', '_') || '_' || p_brand AS column_name, l_linenumber AS ordinal,
        CASE WHEN p_size <= 7 THEN 'NUMBER' WHEN p_size <= 14 THEN 'TEXT' WHEN p_size <= 21 THEN 'BOOLEAN'
             WHEN p_size <= 28 THEN 'TIMESTAMP_NTZ' WHEN p_size <= 35 THEN 'FLOAT' WHEN p_size <= 42 THEN 'DATE'
             ELSE 'ARRAY' END AS data_type FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "line_ids": """SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS line
        FROM lineitem""",
}


def _with(roles: str, body: str, extra: str = "") -> str:
    steps = [f"{name} AS ({ROLES[name]})" for name in roles.split()]
    if extra:
        steps.append(extra)
    return f"WITH {', '.join(steps)} {body}"


def _parsed(source: str, dropped: str, prefix: str) -> str:
    """Steps that read a table of definitions down to (table_name, ordinal, column_name, data_type)."""
    return f"""
    {prefix}pieces AS (SELECT table_name, ddl, unnest(regexp_extract_all(ddl, '[()]|[^()]+')) AS piece,
        generate_subscripts(regexp_extract_all(ddl, '[()]|[^()]+'), 1) AS i FROM {source}),
    {prefix}depths AS (SELECT table_name, piece, sum(length(piece)) OVER w - length(piece) AS pos,
        sum(CASE piece WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER w AS depth FROM {prefix}pieces
        WINDOW w AS (PARTITION BY table_name ORDER BY i ROWS UNBOUNDED PRECEDING)),
    {prefix}bounds AS (SELECT table_name, CAST(min(pos) FILTER (piece = '(') AS INTEGER) AS s,
        CAST(min(pos) FILTER (piece = ')' AND depth = 0) AS INTEGER) AS e FROM {prefix}depths GROUP BY table_name),
    {prefix}flat AS (SELECT table_name, regexp_replace(replace(replace(substr(ddl, s + 2, e - s - 1), chr(10), ''),
        chr(9), ''), '{dropped}', '', 'gs') AS body FROM {source} JOIN {prefix}bounds USING (table_name)
        WHERE e IS NOT NULL),
    {prefix}entries AS (SELECT table_name, unnest(string_split(body, ', ')) AS entry,
        generate_subscripts(string_split(body, ', '), 1) - 1 AS ordinal FROM {prefix}flat),
    {prefix}words AS (SELECT table_name, ordinal,
        regexp_extract_all(entry, '[^\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+') AS w FROM {prefix}entries),
    {prefix}cols AS (SELECT table_name, ordinal, w[1] AS column_name, w[2] AS data_type FROM {prefix}words),
    {prefix}judged AS (SELECT table_name, CASE WHEN count(*) > count(column_name) THEN 'empty_column'
        WHEN count(*) > count(DISTINCT column_name) THEN 'duplicate_column'
        WHEN count(*) > count(data_type) THEN 'missing_type' END AS finding, count(*) AS n
        FROM {prefix}cols GROUP BY table_name),
    {prefix}found AS (SELECT table_name, CASE WHEN e IS NULL THEN 'not_a_definition' ELSE finding END AS finding, n
        FROM {prefix}bounds LEFT JOIN {prefix}judged USING (table_name))"""


_COMMENT = "COMMENT ?''.*?''"
_DDLS = "doc_ddl part_pieces new_ddl ddls"
_DAY97 = "created_at >= TIMESTAMP '1997-01-01' AND created_at < TIMESTAMP '1997-12-31' + INTERVAL 1 DAY"
_DAY24 = "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' + INTERVAL 1 DAY"
_BRAND = "store_id IN (SELECT store_id FROM store)"
_NEAR = "consumer_id IN (SELECT consumer_id FROM near)"

# zone_event_time: all events lie in one winter month, so the zone is 8 hours behind.
ORACLE_SQL: dict[str, str] = {
    "store_list": "SELECT s_suppkey AS store_id, s_name AS store_name FROM supplier WHERE s_nationkey = 15",
    "business_overview": _with(
        "deliveries",
        """SELECT count(DISTINCT store_id) AS store_count, count(delivery_id) AS orders,
        round(sum(subtotal / 100), 4) AS sales FROM deliveries WHERE business_id = 15
        AND CAST(created_at AS DATE) >= DATE '1997-01-01' AND CAST(created_at AS DATE) <= DATE '1997-12-31'""",
    ),
    "impression_share": _with(
        "stores store availability near impressions shown",
        """SELECT 'Impressions on the Business from Eligible Cx' AS metric, CAST(brand AS DOUBLE) AS impressions FROM b
        UNION ALL SELECT 'Total Impressions from Eligible Cx ', CAST(total AS DOUBLE) FROM t
        UNION ALL SELECT 'Impressions on the Busines as a Share of Total Impressions from Eligible Cx',
        CASE WHEN (SELECT total FROM t) = 0 THEN 0 ELSE round(brand / (SELECT total FROM t), 4) END FROM b""",
        f"""t AS (SELECT count(id) AS total FROM shown WHERE {_NEAR}),
        b AS (SELECT count(id) AS brand FROM shown WHERE {_NEAR} AND {_BRAND})""",
    ),
    "consumer_reach": _with(
        "stores store availability near impressions shown",
        """SELECT 'Total Cx within Radius' AS metric, CAST(count(consumer_id) AS DOUBLE) AS unique_cx_ct FROM near
        UNION ALL SELECT 'Cx within Radius Reached', CAST(n AS DOUBLE) FROM r
        UNION ALL SELECT 'Cx Reached as a Share of Total Cx within Radius',
        CASE WHEN (SELECT count(consumer_id) FROM near) = 0 THEN 0
        ELSE round(n / (SELECT count(consumer_id) FROM near), 4) END FROM r""",
        f"r AS (SELECT count(DISTINCT consumer_id) AS n FROM shown WHERE {_NEAR} AND {_BRAND})",
    ),
    "keyword_rank": _with(
        "stores store availability near impressions shown",
        """SELECT b.product_name, b.product_surface, round(b.position, 4) AS brand_average_card_position,
        b.n AS brand_impressions_from_eligible_cx, t.n AS total_impressions_from_eligible_cx,
        CASE WHEN t.n = 0 THEN 0 ELSE round(b.n / t.n, 4) END AS impression_share_from_eligible_cx,
        b.cx AS brand_impression_unique_cx_ct, t.cx AS total_impression_unique_cx_ct,
        CASE WHEN t.cx = 0 THEN 0 ELSE round(b.cx / t.cx, 4) END AS unique_cx_share
        FROM b LEFT JOIN t ON b.product_name = t.product_name AND b.product_surface = t.product_surface
        ORDER BY 4 DESC, 1, 2""",
        f"""terms AS (SELECT *, coalesce(trim(search_term_clean), lower(product_name)) AS label,
            CASE WHEN search_term IS NULL THEN 'carousel' ELSE 'search' END AS surface
            FROM shown WHERE product_name IS NOT NULL AND {_NEAR}),
        b AS (SELECT label AS product_name, surface AS product_surface, count(id) AS n,
            count(DISTINCT consumer_id) AS cx, avg(card_position) AS position FROM terms WHERE {_BRAND} GROUP BY 1, 2),
        t AS (SELECT label AS product_name, surface AS product_surface, count(id) AS n,
            count(DISTINCT consumer_id) AS cx FROM terms GROUP BY 1, 2)""",
    ),
    "consumers_impressed": _with(
        "stores store impressions shown",
        f"SELECT count(DISTINCT consumer_id) AS unique_cx_count FROM shown WHERE {_BRAND}",
    ),
    "consumers_visited": _with(
        "stores store loads",
        f"SELECT count(DISTINCT user_id) AS unique_cx_ct FROM loads WHERE {_BRAND} AND {_DAY24}",
    ),
    "consumers_added_item": _with(
        "stores store adds",
        f"SELECT count(DISTINCT user_id) AS unique_cx_count FROM adds WHERE {_BRAND} AND {_DAY24}",
    ),
    "consumers_ordered": _with(
        "stores store deliveries",
        f"""SELECT count(DISTINCT creator_id) AS unique_cx_count FROM deliveries
        WHERE {_BRAND} AND {_DAY97} AND cancelled_at IS NULL""",
    ),
    "items_added_by_consumers": _with(
        "stores store adds",
        f"""SELECT item_name, count(DISTINCT user_id) AS unique_cx_count FROM adds
        WHERE {_BRAND} AND {_DAY24} AND item_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1""",
    ),
    "unique_items_added": _with(
        "stores store adds",
        f"SELECT count(DISTINCT item_name) AS unique_item_count FROM adds WHERE {_BRAND} AND {_DAY24}",
    ),
    "items_ordered_by_consumers": _with(
        "stores store deliveries order_items checkouts bought",
        "SELECT item_name, count(DISTINCT user_id) AS unique_cx_count FROM bought GROUP BY 1 ORDER BY 2 DESC, 1",
    ),
    "unique_items_ordered": _with(
        "stores store deliveries order_items checkouts bought",
        "SELECT count(DISTINCT item_name) AS unique_item_count FROM bought",
    ),
    "history_by_user": """SELECT 'USER_' || user_id AS user_name, ts AS end_time, event_type || ' ' || props AS query_text
        FROM events WHERE user_id = 8 AND ts >= TIMESTAMP '2024-01-03 07:00:00' AND ts <= TIMESTAMP '2024-01-24 19:30:00'
        ORDER BY 2 DESC""",
    "ddl_body_range": _with(
        _DDLS,
        """SELECT table_name, CASE WHEN e IS NOT NULL THEN s END AS "start", e AS "end",
        CASE WHEN e IS NULL THEN 'not_a_definition' END AS finding FROM bounds""",
        _parsed("ddls", _COMMENT, ""),
    ),
    "ddl_columns": _with(
        _DDLS,
        """SELECT table_name, CAST(ordinal AS INTEGER) AS ordinal, column_name FROM cols JOIN found USING (table_name)
        WHERE finding IS NULL OR finding = 'missing_type'""",
        _parsed("ddls", _COMMENT, ""),
    ),
    "ddl_types": _with(
        _DDLS,
        "SELECT table_name, column_name, data_type FROM cols JOIN found USING (table_name) WHERE finding IS NULL",
        _parsed("ddls", _COMMENT, ""),
    ),
    "ddl_findings": _with(
        _DDLS,
        "SELECT table_name, finding FROM found WHERE finding IS NOT NULL",
        _parsed("ddls", _COMMENT, ""),
    ),
    "ddl_compare": _with(
        "part_pieces new_ddl old_ddl",
        """SELECT table_name, finding, CAST(NULL AS VARCHAR) AS column_name FROM tables WHERE finding IS NOT NULL
        UNION ALL SELECT table_name, 'missing_in_old', column_name FROM pairs WHERE old_at IS NULL
        UNION ALL SELECT table_name, 'type_mismatch', column_name FROM pairs WHERE old_type <> new_type
        UNION ALL SELECT table_name, 'position_mismatch', column_name FROM pairs WHERE old_at <> new_at""",
        _parsed("new_ddl", "''.*?''", "n_")
        + ","
        + _parsed("old_ddl", "''.*?''", "o_")
        + """, tables AS (SELECT table_name, CASE WHEN n.table_name IS NULL OR o.table_name IS NULL THEN 'only_on_one_side'
            WHEN n.finding IS NOT NULL THEN n.finding WHEN o.finding IS NOT NULL THEN o.finding
            WHEN n.n <> o.n THEN 'count_mismatch' END AS finding
            FROM n_found n FULL JOIN o_found o USING (table_name)),
        pairs AS (SELECT table_name, n.column_name, upper(n.data_type) AS new_type, upper(o.data_type) AS old_type,
            n.ordinal AS new_at, o.ordinal AS old_at FROM n_cols n LEFT JOIN o_cols o USING (table_name, column_name)
            WHERE table_name IN (SELECT table_name FROM tables WHERE finding IS NULL))""",
    ),
    "catalog_fields": _with(
        "catalog",
        """SELECT table_name, ordinal, column_name, CASE data_type WHEN 'NUMBER' THEN 'bigint' WHEN 'TEXT' THEN 'string'
        WHEN 'BOOLEAN' THEN 'boolean' WHEN 'TIMESTAMP_NTZ' THEN 'timestamp_ntz' WHEN 'FLOAT' THEN 'double'
        WHEN 'DATE' THEN 'date' ELSE 'array<string>' END AS spark_type FROM catalog""",
    ),
    "catalog_schemas": _with(
        "catalog",
        """SELECT table_name, string_agg('`' || column_name || '` ' || spark_type, ', ' ORDER BY ordinal, column_name, spark_type) AS ddl
        FROM (SELECT table_name, ordinal, column_name || CASE data_type WHEN 'NUMBER' THEN '_PRICE' WHEN 'FLOAT' THEN '_RATE' ELSE '' END
            AS column_name, CASE data_type WHEN 'NUMBER' THEN 'decimal(38,6)' WHEN 'TEXT' THEN 'string'
            WHEN 'BOOLEAN' THEN 'boolean' WHEN 'TIMESTAMP_NTZ' THEN 'timestamp_ntz' WHEN 'FLOAT' THEN 'double'
            WHEN 'DATE' THEN 'date' ELSE 'array<string>' END AS spark_type FROM catalog) GROUP BY table_name""",
    ),
    "catalog_checks": _with(
        "catalog",
        """SELECT 'ORDER_' || o_orderkey AS subject, 'empty_table' AS finding, '' AS detail FROM orders
        WHERE 'ORDER_' || o_orderkey NOT IN (SELECT table_name FROM catalog)
        UNION ALL SELECT table_name, 'ordinal_gap', CAST(before + 1 AS VARCHAR)
        FROM (SELECT table_name, ordinal, coalesce(lag(ordinal) OVER (PARTITION BY table_name ORDER BY ordinal), 0) AS before
            FROM (SELECT DISTINCT table_name, ordinal FROM catalog)) WHERE ordinal > before + 1
        UNION ALL SELECT table_name, 'duplicate_ordinal', CAST(ordinal AS VARCHAR) FROM catalog
        GROUP BY table_name, ordinal HAVING count(*) > 1
        UNION ALL SELECT table_name, 'duplicate_column', column_name FROM catalog
        GROUP BY table_name, column_name HAVING count(*) > 1
        UNION ALL SELECT column_name, 'mixed_types', CAST(count(DISTINCT data_type) AS VARCHAR) FROM catalog
        GROUP BY column_name HAVING count(DISTINCT data_type) > 1""",
    ),
    "last_order_before_view": _with("views past prior_order dated", "SELECT * FROM dated"),
    "membership_on_view": _with(
        "views membership",
        """SELECT v.*, CASE WHEN m.day IS NULL THEN 0 ELSE 1 END AS cx_is_member FROM views v
        LEFT JOIN membership m ON m.consumer_id = v.consumer_id AND m.day = CAST(v.event_date AS DATE)""",
    ),
    "campaigns_on_view": _with(
        "views ranges",
        """SELECT v.*, r.campaign_id, r.is_classic, r.is_new_store_consumers, r.is_member, r.is_winback, r.winback_days
        FROM views v JOIN ranges r ON r.store_id = v.store_id AND r.starts_at <= v.event_date
        AND (r.ends_at IS NULL OR v.event_date < r.ends_at)
        WHERE v.event_date >= TIMESTAMP '1995-01-01' AND v.event_date < TIMESTAMP '2002-01-01'""",
    ),
    "promo_eligibility": _with(
        "views past prior_order dated membership ranges",
        """SELECT *, is_classic_eligible * is_new_store_consumers_eligible * is_winback_eligible * is_member_eligible
        AS cx_eligible FROM flagged""",
        """joined AS (SELECT d.view_id, d.event_date, CAST(d.store_id AS VARCHAR) AS store_id,
            CAST(d.consumer_id AS VARCHAR) AS consumer_id, CASE WHEN m.day IS NULL THEN 0 ELSE 1 END AS cx_is_member,
            d.last_order_date, d.days_since_last_order, r.campaign_id, r.is_classic, r.is_new_store_consumers,
            r.is_member, r.is_winback, r.winback_days
            FROM dated d JOIN ranges r ON r.store_id = d.store_id AND r.starts_at <= d.event_date
                AND (r.ends_at IS NULL OR d.event_date < r.ends_at)
            LEFT JOIN membership m ON m.consumer_id = d.consumer_id AND m.day = CAST(d.event_date AS DATE)
            WHERE d.event_date >= TIMESTAMP '1995-01-01' AND d.event_date < TIMESTAMP '2002-01-01'),
        flagged AS (SELECT *, CASE WHEN is_classic = 1 THEN 1 - cx_is_member ELSE 1 END AS is_classic_eligible,
            CASE WHEN is_new_store_consumers = 1 AND last_order_date IS NOT NULL THEN 0 ELSE 1 END
                AS is_new_store_consumers_eligible,
            CASE WHEN is_winback = 0 THEN 1 WHEN last_order_date IS NULL THEN 0
                WHEN CAST(days_since_last_order AS INTEGER) >= coalesce(winback_days, 0) THEN 1 ELSE 0 END
                AS is_winback_eligible,
            CASE WHEN is_member = 1 THEN cx_is_member ELSE 1 END AS is_member_eligible FROM joined)""",
    ),
    "dedup_events": """SELECT l_orderkey || '-' || l_linenumber AS event_key, l_shipdate AS received_at, l_partkey, l_suppkey
        FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate, l_partkey, l_suppkey) = 1""",
    "version_history": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER w AS version_number,
        l_shipdate AS valid_from, lead(l_shipdate) OVER w AS valid_to, lead(l_shipdate) OVER w IS NULL AS is_current
        FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey)""",
    "order_sequence": _with("placed numbered", "SELECT * REPLACE (round(subtotal, 4) AS subtotal) FROM numbered"),
    "consumers_acquired": _with(
        "placed numbered membership",
        """SELECT campaign_id, CAST(created_at AS DATE) AS day,
        count(DISTINCT CASE WHEN store_cx_rn = 1 THEN consumer_id END) AS new_cx_acquired,
        count(DISTINCT consumer_id) - count(DISTINCT CASE WHEN store_cx_rn = 1 THEN consumer_id END) AS existing_cx_acquired,
        count(DISTINCT consumer_id) AS total_cx_acquired,
        count(DISTINCT CASE WHEN first_rn = 1 AND is_member THEN consumer_id END) AS new_member_cx_acquired,
        count(DISTINCT CASE WHEN first_rn > 1 AND is_member THEN consumer_id END) AS existing_member_cx_acquired
        FROM (SELECT *, min(store_cx_rn) OVER (PARTITION BY campaign_id, CAST(created_at AS DATE), consumer_id) AS first_rn,
            (consumer_id, CAST(created_at AS DATE)) IN (SELECT consumer_id, day FROM membership) AS is_member FROM numbered)
        GROUP BY 1, 2""",
    ),
    "reorder_retention": _with(
        "placed",
        "SELECT store_id, active_date, count(*) AS cxs, CAST(sum(n) AS BIGINT) AS deliveries, round(sum(s), 4) AS sales, "
        + ", ".join(
            f"""CAST(sum(a_{d}) AS BIGINT) AS reorder_deliv_{d}, count(*) FILTER (a_{d} > 0) AS cx_reordered_{d},
            round(sum(s_{d}), 4) AS reorder_sales_{d}, round(sum(a_{d}) / sum(n), 4) AS reorder_rate_{d},
            round(count(*) FILTER (a_{d} > 0) / count(*), 4) AS cx_reordered_{d}_rate"""
            for d in ("30", "60", "90", "since")
        )
        + " FROM spans GROUP BY 1, 2",
        """daily AS (SELECT store_id, consumer_id, CAST(created_at AS DATE) AS active_date, count(*) AS n,
            sum(subtotal) AS s FROM placed GROUP BY ALL),
        spans AS (SELECT a.store_id, a.consumer_id, a.active_date, a.n, a.s,
            coalesce(sum(b.n) FILTER (b.active_date - a.active_date <= 30), 0) AS a_30,
            coalesce(sum(b.n) FILTER (b.active_date - a.active_date <= 60), 0) AS a_60,
            coalesce(sum(b.n) FILTER (b.active_date - a.active_date <= 90), 0) AS a_90,
            coalesce(sum(b.s) FILTER (b.active_date - a.active_date <= 30), 0) AS s_30,
            coalesce(sum(b.s) FILTER (b.active_date - a.active_date <= 60), 0) AS s_60,
            coalesce(sum(b.s) FILTER (b.active_date - a.active_date <= 90), 0) AS s_90,
            coalesce(sum(b.s), 0) AS s_since, coalesce(sum(b.n), 0) AS a_since FROM daily a LEFT JOIN daily b ON a.store_id = b.store_id
            AND a.consumer_id = b.consumer_id AND b.active_date > a.active_date GROUP BY ALL)""",
    ),
    "view_to_conversion": _with(
        "actions",
        """SELECT v.event_id AS impression_event_id, v.consumer_id, v.store_id, v.ts AS impression_timestamp,
        CASE WHEN c.event_id IS NULL THEN 0 ELSE 1 END AS is_clicked, c.event_id AS click_event_id, c.ts AS click_timestamp,
        CASE WHEN s.event_id IS NULL THEN 0 ELSE 1 END AS is_added_to_cart,
        CASE WHEN o.event_id IS NULL THEN 0 ELSE 1 END AS is_converted, o.event_id AS delivery_id, o.ts AS order_timestamp
        FROM actions v LEFT JOIN actions c ON c.event_id - 1 = v.event_id AND c.event_type = 'click'
        LEFT JOIN actions s ON s.event_id - 1 = c.event_id AND s.event_type = 'signup'
        LEFT JOIN actions o ON o.event_id - 1 = c.event_id AND o.event_type = 'purchase' WHERE v.event_type = 'view'""",
    ),
    "request_funnel": _with(
        "line_ids",
        """SELECT o_orderpriority AS product_surface, count(DISTINCT o_orderkey) AS requests,
        count(DISTINCT w.line) AS auctions_won, count(DISTINCT i.line) AS impressions,
        count(DISTINCT c.line) AS clicks, count(DISTINCT d.line) AS orders FROM orders
        LEFT JOIN line_ids w ON w.l_orderkey = o_orderkey AND w.l_returnflag <> 'R'
        LEFT JOIN line_ids i ON i.line = w.line AND i.l_linestatus = 'F'
        LEFT JOIN line_ids c ON c.line = i.line AND c.l_discount >= 0.05
        LEFT JOIN line_ids d ON d.line = c.line AND d.l_tax >= 0.04 GROUP BY 1""",
    ),
    "last_click_attribution": _with(
        "actions",
        """SELECT delivery_id, consumer_id, store_id, ordered_at, CASE WHEN sec <= 604800 THEN click_id END AS click_id,
        CASE WHEN sec <= 604800 THEN CAST(sec // 60 AS BIGINT) END AS lag_minutes,
        CASE WHEN sec <= 604800 THEN CAST(sec // 3600 AS BIGINT) END AS lag_hours,
        CASE WHEN sec <= 604800 THEN 1 ELSE 0 END AS is_attributed FROM latest""",
        """latest AS (SELECT o.event_id AS delivery_id, o.consumer_id, o.store_id, o.ts AS ordered_at,
            c.event_id AS click_id, date_sub('second', c.ts, o.ts) AS sec
            FROM actions o LEFT JOIN actions c ON c.event_type = 'click' AND c.consumer_id = o.consumer_id
            AND c.store_id = o.store_id AND c.ts <= o.ts WHERE o.event_type = 'purchase'
            QUALIFY row_number() OVER (PARTITION BY o.event_id ORDER BY c.ts DESC NULLS LAST, c.event_id DESC) = 1)""",
    ),
    "campaign_performance": _with(
        "actions",
        """SELECT campaign_id, day, impressions, clicks, orders, round(sales, 8) AS sales, round(cost, 8) AS cost,
        CASE WHEN impressions = 0 THEN 0 ELSE round(clicks / impressions, 8) END AS click_through_rate,
        CASE WHEN clicks = 0 THEN 0 ELSE round(orders / clicks, 8) END AS conversion_rate,
        CASE WHEN orders = 0 THEN 0 ELSE round(sales / orders, 8) END AS aov,
        CASE WHEN orders = 0 THEN 0 ELSE round(cost / orders, 8) END AS cost_per_order,
        CASE WHEN cost = 0 THEN 0 ELSE round(sales / cost, 8) END AS roas FROM sums""",
        """sums AS (SELECT store_id AS campaign_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'view') AS impressions,
            count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS orders,
            coalesce(sum(value) FILTER (event_type = 'purchase'), 0.0) AS sales,
            coalesce(sum(value / 10) FILTER (event_type = 'click'), 0.0) AS cost FROM actions
            WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1, 2)""",
    ),
    "top_items": """SELECT store_id, string_agg(item, ',' ORDER BY n DESC, item) AS top_items FROM (
        SELECT l_suppkey AS store_id, p_name AS item, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey
        GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, p_name) <= 5) GROUP BY 1""",
    "attached_orders": """SELECT CAST(o_orderdate AS DATE) AS active_date, o_orderpriority AS cohort, count(*) AS store_orders,
        round(sum(o_totalprice), 4) AS store_sales, CAST(sum(ad) AS BIGINT) AS paid_ads_attach_store_orders,
        CAST(sum(promo) AS BIGINT) AS paid_promotion_attach_store_orders,
        CAST(sum(greatest(ad, promo)) AS BIGINT) AS paid_ads_promotion_attach_store_orders,
        CAST(sum(banner) AS BIGINT) AS paid_banner_ads_attach_store_orders FROM (SELECT *,
            CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45) THEN 1 ELSE 0 END AS banner,
            CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.08) THEN 1 ELSE 0 END AS ad,
            CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_tax >= 0.06) THEN 1 ELSE 0 END AS promo
            FROM orders) GROUP BY 1, 2""",
    "request_volume": """SELECT CAST(ts AS DATE) AS active_date, event_type AS placement, props AS feature_id,
        count(*) AS total_requests FROM events GROUP BY 1, 2, 3""",
    "zone_event_time": """SELECT event_id, ts, ts - INTERVAL 8 HOUR AS zone_ts FROM events""",
    "membership_active_range": _with(
        "ranges",
        """SELECT l_orderkey, l_linenumber, l_suppkey, campaign_id, member_start, member_end,
        greatest(member_start, starts_at) AS active_start, least(member_end, ends_at) AS active_end FROM members
        JOIN ranges USING (campaign_id)
        WHERE greatest(member_start, starts_at) < least(member_end, coalesce(ends_at, member_end))""",
        """members AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey AS campaign_id,
            least(o_orderdate, l_shipdate) AS member_start, greatest(o_orderdate, l_shipdate) AS member_end
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    ),
    "normalised_query": """SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g')) AS normalised
        FROM documents""",
    "allocate_fee": """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey AS campaign_id, l_extendedprice,
        round(p_retailprice * l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_partkey), 4) AS fee_alloc
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "apportion_fee": """WITH parts AS (
            SELECT l_partkey AS campaign_id, l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS price_cents,
                CAST(round(p_retailprice * 100) AS HUGEINT) AS fee,
                sum(CAST(round(l_extendedprice * 100) AS HUGEINT)) OVER (PARTITION BY l_partkey) AS whole
            FROM lineitem JOIN part ON l_partkey = p_partkey
        ),
        placed AS (
            SELECT *, fee * price_cents // whole AS share,
                row_number() OVER (PARTITION BY campaign_id ORDER BY fee * price_cents % whole DESC, l_orderkey, l_linenumber) AS place
            FROM parts
        )
        SELECT campaign_id, l_orderkey, l_linenumber, price_cents, CAST(share
            + CASE WHEN place <= fee - sum(share) OVER (PARTITION BY campaign_id) THEN 1 ELSE 0 END AS BIGINT) AS fee_alloc_cents
        FROM placed""",
    # Summer time of the years up to 2006: from the first Sunday of April, 10:00 UTC, to the last of October, 9:00 UTC.
    "zone_order_time": """WITH moments AS (
            SELECT o_orderkey, o_orderdate + to_hours(o_orderkey % 24) AS ordered_at,
                make_date(year(o_orderdate), 4, 1) AS april, make_date(year(o_orderdate), 10, 31) AS october
            FROM orders
        )
        SELECT o_orderkey, ordered_at, ordered_at - CASE
            WHEN ordered_at >= CAST(april + CAST((7 - dayofweek(april)) % 7 AS INTEGER) AS TIMESTAMP) + INTERVAL 10 HOUR
                AND ordered_at < CAST(october - CAST(dayofweek(october) AS INTEGER) AS TIMESTAMP) + INTERVAL 9 HOUR
            THEN INTERVAL 7 HOUR ELSE INTERVAL 8 HOUR END AS zone_ts
        FROM moments""",
}

_FEE_REPORTS = {
    "ads_fee": ("ads_fee", "Ads Fee", "ads_fee"),
    "promo_fee": ("promotion_fee", "Promo Fee", "promo_fee"),
}
for _name, (_fee, _label, _value) in _FEE_REPORTS.items():
    for _suffix, _rivals in (("", "WHERE business_id IN (1, 18)"), ("_no_rivals_named", "")):
        _rival = f"rival AS (SELECT store_id FROM stores {_rivals})"
        ORACLE_SQL[f"{_name}_share{_suffix}"] = _with(
            "stores store availability near fees",
            f"""SELECT 'Mx within Cx Radius Total {_label}' AS metric, round(sum({_fee} / 100), 4) AS total_{_value}
            FROM fees WHERE {_NEAR}
            UNION ALL SELECT 'Business Total {_label}', round(sum({_fee} / 100), 4) FROM fees WHERE {_BRAND}
            UNION ALL SELECT 'Competitor Businesses Total {_label}', round(sum({_fee} / 100), 4) FROM fees
            WHERE store_id IN (SELECT store_id FROM rival)""",
            _rival,
        )
        ORACLE_SQL[f"{_name}_per_store{_suffix}"] = _with(
            "stores store availability near fees",
            f"""SELECT 'Mx within Cx Radius {_label} per Store' AS metric,
            round(sum({_fee} / 100) / nullif(count(DISTINCT store_id), 0), 4) AS {_value}_per_store FROM fees WHERE {_NEAR}
            UNION ALL SELECT 'Business {_label} per Store',
            round(sum({_fee} / 100) / nullif((SELECT count(store_id) FROM store), 0), 4) FROM fees WHERE {_BRAND}
            UNION ALL SELECT 'Competitor Businesses {_label} per Store',
            round(sum({_fee} / 100) / nullif((SELECT count(store_id) FROM rival), 0), 4) FROM fees
            WHERE store_id IN (SELECT store_id FROM rival)""",
            _rival,
        )
