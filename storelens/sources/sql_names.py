"""Names for use in `spark.sql`: a view per role, and the functions Spark's SQL lacks."""

from __future__ import annotations

from pyspark.sql import SparkSession

from storelens.sources.roles import ROLES, SEVERAL_SOURCES

DIV0 = """
CREATE OR REPLACE TEMPORARY FUNCTION div0(part DOUBLE, whole DOUBLE) RETURNS DOUBLE
RETURN CASE WHEN part IS NOT NULL AND whole = 0 THEN 0 ELSE part / nullif(whole, 0) END
"""

HISTORY = """
CREATE OR REPLACE TEMPORARY FUNCTION query_history_by_user(
    user_name STRING, end_time_range_start TIMESTAMP, end_time_range_end TIMESTAMP)
RETURNS TABLE (user_name STRING, end_time TIMESTAMP_NTZ, query_text STRING)
RETURN SELECT log.user_name, log.end_time, log.query_text FROM query_log AS log
WHERE log.user_name = query_history_by_user.user_name AND log.end_time BETWEEN
    convert_timezone(current_timezone(), 'UTC', CAST(end_time_range_start AS TIMESTAMP_NTZ))
    AND convert_timezone(current_timezone(), 'UTC', CAST(end_time_range_end AS TIMESTAMP_NTZ))
"""


def register_views(spark: SparkSession, tables) -> list[str]:
    """A temporary view per role; the sources of a role with several are numbered from 1."""
    views = []
    for role in ROLES:
        frames = getattr(tables, role, None)
        if frames is None:
            continue
        if role in SEVERAL_SOURCES:
            named = [(f"{role}_{i}", frame) for i, frame in enumerate(frames, start=1)]
        else:
            named = [(role, frames)]
        for name, frame in named:
            frame.createOrReplaceTempView(name)
            views.append(name)
    return views


def register_functions(spark: SparkSession) -> None:
    """div0(part, whole), and query_history_by_user(...) over the view `query_log`."""
    spark.sql(DIV0)
    spark.sql(HISTORY)
