"""Tables partitioned by day: reports read only the partitions their days can lie in.

A role table from such a table carries its partition's day as `DAY`. Filters by
days test it beside the moment and drop it, so results are the same with and
without partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.scalars import Day, date_part_between, day_window

DAY = "_day"


@dataclass(frozen=True)
class DayColumn:
    """The column a table is partitioned by: a date, or text or a number in `pattern`.

    A row may lie up to `early` days before or `late` days after the date of its
    moment, as where partitions follow the arrival or another zone's calendar.
    """

    name: str
    early: int = 0
    late: int = 0
    pattern: str | None = None


def day_of(partitions: DayColumn) -> Column:
    day = F.col(partitions.name)
    day = F.to_date(day.cast("string"), partitions.pattern) if partitions.pattern else day.cast("date")
    return day.alias(DAY, metadata={"early": partitions.early, "late": partitions.late})


def with_day(frame: DataFrame, partitions: DayColumn) -> DataFrame:
    """The frame with its partitions' day, for the filters below; the partition column itself goes."""
    return frame.select(*[c for c in frame.columns if c != partitions.name], day_of(partitions))


def in_partitions(frame: DataFrame, first: Column, last: Column) -> DataFrame:
    """Rows of the partitions that can hold moments of the dates, without `DAY`; all rows of a frame without it.

    Rows in no day's partition are kept: only their moments tell.
    """
    if DAY not in frame.columns:
        return frame
    slack, day = frame.schema[DAY].metadata, F.col(DAY)
    near = day.between(F.date_sub(first, slack.get("early", 0)), F.date_add(last, slack.get("late", 0)))
    return frame.where(near | day.isNull()).drop(DAY)


def _dates(start: Day, end: Day) -> tuple[Column, Column]:
    return F.lit(start).cast("date"), F.lit(end).cast("date")


def in_days(frame: DataFrame, moment: str, start: Day, end: Day) -> DataFrame:
    """Rows from the start day's midnight up to, not including, midnight after the end day."""
    return in_partitions(frame.where(day_window(moment, start, end)), *_dates(start, end))


def on_dates(frame: DataFrame, moment: str, start: Day, end: Day) -> DataFrame:
    """Rows whose date part lies in the closed range."""
    return in_partitions(frame.where(date_part_between(moment, start, end)), *_dates(start, end))


def write_by_day(frame: DataFrame, moment: str, path: str, name: str = "day") -> DayColumn:
    """Writes the frame partitioned by the date of its moment, a new folder, and says how to read it.

    Days are brought together before they are written, large ones in several
    files and small ones several to a task, as adaptive execution finds them.
    """
    dated = frame.withColumn(name, F.to_date(moment))
    dated.hint("rebalance", name).write.partitionBy(name).parquet(path)
    return DayColumn(name)
