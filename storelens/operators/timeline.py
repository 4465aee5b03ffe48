"""Ordered operations per key (last before, running number, validity range).

A window per key puts the whole key into one task. Here the timeline of a key
that is a large share of the rows is cut into slots of even size (see cuts.py),
by time and a tie, so neither many rows at one instant nor rows without a time
meet in one task. What a slot must know of the others (the last value before it,
the count so far, the first time after it) comes from per-slot aggregates of
those keys alone, as one extra row. All other keys keep one group and get no
extra row, in the same pass; without cuts the plan is the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from storelens.operators.checkpoints import checkpointed
from storelens.operators.cuts import cut_table, none_reaches, slot_counts, with_slot
from storelens.operators.joins import row_part


def _known(columns: list[str]) -> Column:
    known = F.lit(True)
    for column in columns:
        known = known & F.col(column).isNotNull()
    return known


def _missing(kind: DataType) -> Column:
    return F.lit(None).cast(kind)


def last_before(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: str,
    right_time: str,
    payload: list[str] | None = None,
    inclusive: bool = False,
    floor: int | None = None,
    heat: DataFrame | None = None,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Left rows plus `last`, a struct of the latest right row at or before them.

    `last` holds `right_time` and the payload columns, null where there is none;
    equal right times are decided by the larger payload. Strictly before unless
    `inclusive`. Both sides meet in one union, so no pairs are ever formed.
    `heat` is a frame with the left keys and times that is cheaper to look at.
    `bound` has some of the keys as its columns and about as many rows of each of
    their values as both sides together; where none of these reaches over a range,
    no key does, and neither side is looked at before the pass.
    """
    # Sort positions of left and right rows at the same time; 0 comes before both.
    left_rank, right_rank = (2, 1) if inclusive else (1, 2)
    place = ["_time", "_rank", "_tie"]
    values = F.struct(right_time, *(payload or []))
    columns = left.columns
    # Left rows at one instant are told apart by a hash, so cuts can lie between them.
    sought = left.withColumns({
        "_time": F.col(left_time).cast("timestamp_ntz"), "_rank": F.lit(left_rank), "_tie": F.xxhash64(*columns, F.spark_partition_id())
    })
    given = right.where(_known([*keys, right_time])).select(
        *keys, F.col(right_time).cast("timestamp_ntz").alias("_time"), F.lit(right_rank).alias("_rank"),
        F.lit(0).cast("long").alias("_tie"), values.alias("_last"),
    )
    cuts = None
    if bound is None or not none_reaches(bound, floor):
        looked_at = left if heat is None else heat
        seen = looked_at.select(
            *keys, F.col(left_time).cast("timestamp_ntz").alias("_time"), F.lit(left_rank).alias("_rank"),
            F.xxhash64(F.lit("tie"), F.monotonically_increasing_id()).alias("_tie"),
        ).where(_known([*keys, "_time"]))
        cuts = cut_table(seen.unionByName(given.drop("_last")), keys, place, floor)

    last_type = given.schema["_last"].dataType
    # What a row holds besides; keys and the time, where the union keeps their types, are not shuffled twice.
    kinds, other = dict(left.dtypes), dict(right.dtypes)
    told = {*(k for k in keys if kinds[k] == other[k]), *([left_time] if kinds[left_time] == "timestamp_ntz" else [])}
    row = F.struct(F.lit(True).alias("_there"), *(c for c in columns if c not in told))
    row_type = sought.select(row.alias("row")).schema["row"].dataType
    # Left rows that can have no match are spread, so that they form no large group.
    lone = 1 + row_part(columns, F.lit(1000))
    spread = F.when(_known([*keys, "_time"]), F.lit(0)).otherwise(lone).cast("long")
    left_rows = with_slot(sought, cuts, keys, place).select(
        *keys, "_slot", "_time", "_rank", spread.alias("_spread"), _missing(last_type).alias("_last"), row.alias("_row")
    )
    right_rows = with_slot(given, cuts, keys, place).drop("_tie").withColumns({"_spread": F.lit(0).cast("long"), "_row": _missing(row_type)})
    rows = left_rows.unionByName(right_rows)
    if cuts is not None:
        rows = rows.unionByName(_carried(given, cuts, keys, place).withColumns({"_spread": F.lit(0).cast("long"), "_row": _missing(row_type)}))
    group = [*keys, "_spread"]
    if cuts is None:
        rows = rows.drop("_slot")
    else:
        group.append("_slot")
    order = Window.partitionBy(*group).orderBy("_time", "_rank")
    found = rows.withColumn("last", F.max("_last").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    held = [F.col(f"_row.`{c}`") if c not in told else F.col(c) if c in keys else F.col("_time").alias(c) for c in columns]
    return found.where(F.col("_row").isNotNull()).select(*held, "last")


def _carried(given: DataFrame, cuts: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """One row per slot of a cut key, with the last value before the slot; it sorts first, having no time."""
    acts = with_slot(given, cuts, keys, place, only_cut=True).groupBy(*keys, "_slot").agg(F.max("_last").alias("_last"))
    slots = slot_counts(cuts, keys).withColumn("_last", _missing(given.schema["_last"].dataType))
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    each = acts.unionByName(slots).groupBy(*keys, "_slot").agg(F.max("_last").alias("_last"))
    carried = each.withColumn("_last", F.max("_last").over(earlier)).where(F.col("_last").isNotNull())
    return carried.withColumns({"_time": _missing(given.schema["_time"].dataType), "_rank": F.lit(0)})


# Sort positions within one group: the row that brings the count so far, the real
# rows, the row that brings the first time after the slot.
_HEAD, _ROW, _TAIL = 0, 1, 2


def running_numbers(
    rows: DataFrame,
    owner: str,
    levels: dict[str, list[str]],
    time: str,
    tie: list[str],
    next_time: str | None = None,
    floor: int | None = None,
    heat: DataFrame | None = None,
) -> DataFrame:
    """Numbers each row 1, 2, ... by time within the owner and within finer groups of it.

    `levels` maps an output column to the columns that, with the owner, form the
    group. `next_time` names a column for the time of the owner's next row. One
    shuffle by owner (and slot, for cut owners) serves all of them. `heat` is a
    frame with about as many rows that is cheaper to count.
    """
    cuts = cut_table(rows, [owner], [time, *tie], floor, heat)
    listed = with_slot(rows, cuts, [owner], [time, *tie])
    placed = listed.withColumns({"_at": F.lit(_ROW), "_level": F.lit(""), "_weight": F.lit(1).cast("long")})
    place = [owner]
    if cuts is not None:
        place.append("_slot")
        finest = list(dict.fromkeys(c for columns in levels.values() for c in columns))
        cut = with_slot(rows, cuts, [owner], [time, *tie], only_cut=True)
        # Groups of cut owners and their slots; all that follows is prefix sums over these.
        counts = checkpointed(
            cut.groupBy(owner, *finest, "_slot").agg(
                F.count(F.lit(1)).alias("_weight"), F.min(time).alias(time), F.max(F.col(time).isNull()).alias("_timeless")
            )
        )
        for name, columns in levels.items():
            group = [owner, *columns]
            before = Window.partitionBy(*group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
            heads = (
                counts.groupBy(*group, "_slot")
                .agg(F.sum("_weight").alias("_weight"))
                .withColumn("_weight", F.sum("_weight").over(before))
                .where(F.col("_weight").isNotNull())
                .withColumns({"_at": F.lit(_HEAD), "_level": F.lit(name)})
            )
            placed = placed.unionByName(heads, allowMissingColumns=True)
        if next_time:
            # Rows without a time come first, so a slot with one starts without a time.
            first = F.when(~F.max("_timeless"), F.min(time)).alias(time)
            tails = (
                counts.groupBy(owner, "_slot")
                .agg(first)
                .withColumn(time, F.lead(time).over(Window.partitionBy(owner).orderBy("_slot")))
                .where(F.col(time).isNotNull())
                .withColumns({"_at": F.lit(_TAIL), "_level": F.lit("next")})
            )
            placed = placed.unionByName(tails, allowMissingColumns=True)
    placed = placed.repartition(*place)
    for name, columns in levels.items():
        order = Window.partitionBy(*place, *columns).orderBy("_at", time, *tie)
        so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        weight = F.when(F.col("_level").isin("", name), F.col("_weight")).otherwise(0)
        placed = placed.withColumn(name, F.sum(weight).over(so_far))
    if next_time:
        placed = placed.withColumn(
            next_time, F.lead(time).over(Window.partitionBy(*place).orderBy("_at", time, *tie))
        )
    extra = [c for c in ("_at", "_level", "_weight", "_slot") if c in placed.columns]
    return placed.where(F.col("_at") == _ROW).drop(*extra)


def validity_ranges(
    versions: DataFrame, key: str, updated_at: str, tie: list[str], **cut
) -> DataFrame:
    """Adds `version_number`, `valid_from`, `valid_to` (next version's time) and `is_current`."""
    numbered = running_numbers(
        versions, key, {"version_number": []}, updated_at, tie, next_time="valid_to", **cut
    )
    return numbered.withColumns(
        {"valid_from": F.col(updated_at), "is_current": F.col("valid_to").isNull()}
    )
