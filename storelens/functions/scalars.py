"""Column expressions shared by the reports. All are built-in Spark functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

Day = str | dt.date


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def day_window(moment: Column | str, start: Day, end: Day) -> Column:
    """From the start day's midnight up to, not including, midnight after the end day."""
    first = F.lit(start).cast("timestamp_ntz")
    past = F.timestamp_add("DAY", F.lit(1), F.lit(end).cast("timestamp_ntz"))
    moment = as_column(moment)
    return (moment >= first) & (moment < past)


def date_part_between(moment: Column | str, start: Day, end: Day) -> Column:
    """Closed range on the date part; the optimizer turns it into a pushed timestamp range."""
    return F.to_date(as_column(moment)).between(
        F.lit(start).cast("date"), F.lit(end).cast("date")
    )


def safe_ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole as double; null when part is null, 0 when whole is 0.

    Used for every division whose divisor can be 0, also where a plain division
    would raise an error instead of answering.
    """
    part, whole = as_column(part).cast("double"), as_column(whole).cast("double")
    return F.when(part.isNotNull() & (whole == 0), F.lit(0.0)).otherwise(
        part / F.nullif(whole, F.lit(0.0))
    )


# The type amounts are summed in: six places after the point, below 10^12 each.
EXACT = "decimal(18,6)"


def exact_sum(amount: Column | str) -> Column:
    """The sum of amounts in decimals, so that it depends neither on their order nor on partitions.

    An amount is rounded to six places first; one of 10^12 or more and a sum of
    10^32 or more are errors under ANSI mode (Spark's default) and null without
    it. Not-a-number and infinities have no decimal and count as null.
    """
    return F.sum(as_column(amount).cast(EXACT))


def cents(amount: Column | str) -> Column:
    """An amount in cents, or an exact sum of them, as a double of whole units."""
    return as_column(amount).cast("double") / 100


def search_label(clean_term: Column | str, product_name: Column | str) -> Column:
    """The trimmed search term, or the lowered product name where there is no term."""
    return F.coalesce(F.trim(as_column(clean_term)), F.lower(as_column(product_name)))


# Names of the places an impression can come from.
CAROUSEL, SEARCH = "carousel", "search"


def product_surface(search_term: Column | str) -> Column:
    return F.when(as_column(search_term).isNull(), CAROUSEL).otherwise(SEARCH)


def empty_list(items: Column | str) -> Column:
    return F.size(as_column(items)) == 0


def in_optional_list(value: Column | str, items: Column | str) -> Column:
    """True for every value when the list is empty, else list membership."""
    return F.when(empty_list(items), F.lit(True)).otherwise(
        F.array_contains(as_column(items), as_column(value))
    )


def normalised_query(text: Column | str) -> Column:
    """Lower case, punctuation to blanks, blanks collapsed and trimmed (formula is ours).

    Combining marks belong to their letters and stay.
    """
    words = F.regexp_replace(F.lower(as_column(text)), r"[^\p{L}\p{M}\p{N}]+", " ")
    return F.trim(words)


def zone_time(utc_moment: Column | str, zone: str) -> Column:
    """A UTC wall-clock time as the wall-clock time of another zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), as_column(utc_moment))


def overlap(
    starts: list[Column | str], ends: list[Column | str]
) -> tuple[Column, Column, Column]:
    """Common part of several validity ranges: start, end, and whether it is non-empty.

    A null end is open; a null start means the range began before all others.
    """
    first = F.array_max(F.array(*[as_column(c) for c in starts]))
    last = F.array_min(F.array(*[as_column(c) for c in ends]))
    return first, last, F.coalesce(first < last, F.lit(True))
