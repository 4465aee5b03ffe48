"""Lookups in a query log that already exists as a table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.sources.days import in_partitions


def _instant(moment: str | dt.datetime, kind: str) -> Column:
    """Text may carry an offset such as -0700; a log without zones is in UTC wall time."""
    instant = F.lit(moment).cast("timestamp")
    if kind == "timestamp":
        return instant
    wall = instant.cast("timestamp_ntz")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), wall).cast(kind)


def history_by_user(
    query_log: DataFrame, user_name: str, since: str | dt.datetime, until: str | dt.datetime
) -> DataFrame:
    """Log rows of one user that ended in the range, both bounds included, newest first."""
    kind = dict(query_log.dtypes)["end_time"]
    first, last = _instant(since, kind), _instant(until, kind)
    found = query_log.where((F.col("user_name") == user_name) & F.col("end_time").between(first, last))
    found = in_partitions(found, F.to_date(first), F.to_date(last))
    rest = [c for c in found.columns if c != "end_time"]
    return found.orderBy(F.desc("end_time"), *rest)
