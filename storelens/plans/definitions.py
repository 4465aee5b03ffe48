"""Table definitions and column catalogues: read columns out of them and report drift.

A definition is a row (table_name, ddl). All parsing is row-local: nothing is
shuffled until two sides are compared, and a definition that cannot be read
becomes a finding instead of stopping the others.

Some habits of the readers are kept on purpose: brackets inside quotes count,
columns part at a comma followed by a blank (so `NUMBER(38, 0)` is cut in two),
and a comment ends at its first closing quote.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from storelens.operators.joins import skew_join
from storelens.sources.contracts import TYPE_NAMES

# Fixed patterns. Line breaks are gone when they run, so a dot may match anything.
COMMENT_TEXT = r"(?s)COMMENT ?'.*?'"
QUOTED_TEXT = r"(?s)'.*?'"
WORD = r"[^\s\x1c-\x1f\x85\xa0\p{Z}]+"
BRACKET_OR_TEXT = r"[()]|[^()]+"

# Fixed names of findings.
NOT_A_DEFINITION = "not_a_definition"
EMPTY_COLUMN = "empty_column"
DUPLICATE_COLUMN = "duplicate_column"
MISSING_TYPE = "missing_type"
COUNT_MISMATCH = "count_mismatch"
MISSING_IN_OLD = "missing_in_old"
TYPE_MISMATCH = "type_mismatch"
POSITION_MISMATCH = "position_mismatch"
SEVERAL_DEFINITIONS = "several_definitions"
ONE_SIDED = "only_on_one_side"


def body_bounds(ddl: Column) -> Column:
    """Struct (start, end): 0-based positions of the first bracket and its partner, else -1."""
    def number(value: int) -> Column:
        return F.lit(value).cast("int")

    begin = F.struct(
        number(0).alias("at"), number(0).alias("depth"), number(-1).alias("start"), number(-1).alias("end")
    )

    def step(state: Column, piece: Column) -> Column:
        running = state["end"] < 0
        opens = running & (piece == "(")
        closes = running & (piece == ")") & (state["start"] >= 0)
        depth = state["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        return F.struct(
            (state["at"] + F.length(piece)).alias("at"),
            depth.alias("depth"),
            F.when(opens & (state["start"] < 0), state["at"]).otherwise(state["start"]).alias("start"),
            F.when(closes & (depth == 0), state["at"]).otherwise(state["end"]).alias("end"),
        )

    pieces = F.regexp_extract_all(ddl, F.lit(BRACKET_OR_TEXT), F.lit(0))
    return F.aggregate(pieces, begin, step, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def ddl_body_range(definitions: DataFrame) -> DataFrame:
    """table_name, start, end, finding: where the column list lies in each text."""
    bounds = definitions.select("table_name", body_bounds(F.col("ddl")).alias("bounds"))
    readable = F.coalesce(F.col("bounds.end") >= 0, F.lit(False))
    return bounds.select(
        "table_name",
        F.when(readable, F.col("bounds.start")).alias("start"),
        F.when(readable, F.col("bounds.end")).alias("end"),
        F.when(~readable, NOT_A_DEFINITION).alias("finding"),
    )


def _entries(definitions: DataFrame, dropped: str) -> DataFrame:
    """Adds `names` and `types` arrays, both null when the text has no column list."""
    bounded = definitions.withColumn("_bounds", body_bounds(F.col("ddl")))
    body = F.substring(
        F.col("ddl"), F.col("_bounds.start") + 2, F.col("_bounds.end") - F.col("_bounds.start") - 1
    )
    flat = F.regexp_replace(F.translate(body, "\n\t", ""), dropped, "")
    columns = F.when(F.col("_bounds.end") >= 0, F.split(flat, ", "))
    words = F.transform(columns, lambda c: F.regexp_extract_all(c, F.lit(WORD), F.lit(0)))
    return (
        bounded.withColumn("_words", words)
        .withColumn("names", F.transform("_words", lambda w: F.get(w, F.lit(0))))
        .withColumn("types", F.transform("_words", lambda w: F.get(w, F.lit(1))))
        .drop("_bounds", "_words", "ddl")
    )


def _name_finding() -> Column:
    return (
        F.when(F.col("names").isNull(), NOT_A_DEFINITION)
        .when(F.exists("names", lambda n: n.isNull()), EMPTY_COLUMN)
        .when(F.size(F.array_distinct("names")) < F.size("names"), DUPLICATE_COLUMN)
    )


def _type_finding() -> Column:
    return F.coalesce(_name_finding(), F.when(F.exists("types", lambda t: t.isNull()), MISSING_TYPE))


def _readable(entries: DataFrame, finding: Column, *arrays: str) -> DataFrame:
    """Empties the arrays of texts with a finding.

    They are then exploded as outer and the one row of an emptied array dropped:
    any filter on the arrays, also one Spark infers from a plain explode, would
    be pushed below the parsing and parse every text again.
    """
    return entries.withColumns({a: F.when(finding.isNull(), F.col(a)) for a in arrays})


def ddl_columns(definitions: DataFrame) -> DataFrame:
    """table_name, ordinal (from 0), column_name of every readable definition."""
    readable = _readable(_entries(definitions, COMMENT_TEXT), _name_finding(), "names")
    columns = readable.select("table_name", F.posexplode_outer("names").alias("ordinal", "column_name"))
    return columns.where("ordinal is not null")


def ddl_types(definitions: DataFrame) -> DataFrame:
    """table_name, column_name, data_type of every definition whose columns all have a type."""
    entries = _entries(definitions, COMMENT_TEXT)
    pairs = entries.withColumn("columns", F.arrays_zip("names", "types"))
    readable = _readable(pairs, _type_finding(), "columns")
    typed = readable.select("table_name", F.inline_outer("columns").alias("column_name", "data_type"))
    return typed.where("column_name is not null")


def ddl_findings(definitions: DataFrame) -> DataFrame:
    """table_name, finding for each definition that ddl_types leaves out."""
    entries = _entries(definitions, COMMENT_TEXT)
    found = entries.select("table_name", F.explode_outer(F.array(_type_finding())).alias("finding"))
    return found.where("finding is not null")


def _one_per_table(definitions: DataFrame) -> DataFrame:
    """What one text per table says, and whether another text says something else.

    Texts are read before they are shuffled, so comments stay behind, and copies
    collapse to one row per task.
    """
    parsed = _entries(definitions, QUOTED_TEXT).select(
        "table_name",
        F.struct(
            _type_finding().alias("finding"),
            "names",
            F.transform("types", F.upper).alias("types"),
        ).alias("said"),
    )
    return parsed.groupBy("table_name").agg(
        F.min("said").alias("said"), (F.min("said") != F.max("said")).alias("several")
    )


def ddl_compare(new: DataFrame, old: DataFrame) -> DataFrame:
    """table_name, finding, column_name: one row per difference, none for equal tables.

    Types are compared in upper case, positions and names as written, all quoted
    text is ignored. As soon as a table has a finding of its own (unreadable,
    count differs, ...) its columns are not compared.
    """
    sides = {}
    for side, frame in (("new", new), ("old", old)):
        sides[side] = _one_per_table(frame).select(
            "table_name",
            F.when(F.col("several"), SEVERAL_DEFINITIONS).otherwise(F.col("said.finding")).alias(f"{side}_finding"),
            F.size("said.names").alias(f"{side}_count"),
            F.arrays_zip("said.names", "said.types").alias(f"{side}_columns"),
            F.lit(True).alias(f"in_{side}"),
        )
    tables = sides["new"].join(sides["old"], "table_name", "full")
    finding = (
        F.when(F.col("in_new").isNull() | F.col("in_old").isNull(), ONE_SIDED)
        .when(F.coalesce("new_finding", "old_finding").isNotNull(), F.coalesce("new_finding", "old_finding"))
        .when(F.col("new_count") != F.col("old_count"), COUNT_MISMATCH)
    )
    judged = tables.withColumn("finding", finding)

    # Names are unique here, so a map finds a column's old type and position at once.
    old_columns = F.map_from_entries(
        F.transform(
            "old_columns",
            lambda c, i: F.struct(c["names"], F.struct(c["types"].alias("type"), i.alias("at"))),
        )
    )
    equal_sized = judged.where("finding is null").select(
        "table_name", "new_columns", old_columns.alias("old")
    )
    columns = equal_sized.select("table_name", "old", F.posexplode_outer("new_columns").alias("at", "c"))
    columns = columns.where("at is not null").select(
        "table_name",
        F.col("c.names").alias("column_name"),
        F.col("c.types").alias("type"),
        "at",
        F.try_element_at("old", F.col("c.names")).alias("before"),
    )
    kinds = F.array_compact(
        F.array(
            F.when(F.col("before").isNull(), MISSING_IN_OLD),
            F.when(F.col("before.type") != F.col("type"), TYPE_MISMATCH),
            F.when(F.col("before.at") != F.col("at"), POSITION_MISMATCH),
        )
    )
    differences = columns.select("table_name", F.explode_outer(kinds).alias("finding"), "column_name")
    differences = differences.where("finding is not null")
    whole = judged.where("finding is not null").select(
        "table_name", "finding", F.lit(None).cast("string").alias("column_name")
    )
    return whole.unionByName(differences)


# Words in the names of columns whose NUMBER holds money or a rate, not an id or a count.
DECIMAL_NAMES = (
    r"(?i)(^|_)(fee|fees|price|cost|sale|sales|amount|bid|budget|rate|roas|aov|cpa|subtotal|gov|discount|"
    r"revenue|profit|value|credit|score)(_|$)"
)
# Names the rule above gets wrong: averages with a fraction, and whole numbers named after money.
DECIMAL_COLUMNS = frozenset({"AVERAGE_POSITION", "AVG_POSITION", "AVERAGE_RANK"})
WHOLE_NAMES = r"(?i)_(seconds|minutes|hours|days|count|id)$"


def catalog_fields(catalog: DataFrame, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """table_name, ordinal, column_name, spark_type of every catalogue row.

    NUMBER comes without precision: names of money and rates become decimal(38,6),
    as do DECIMAL_COLUMNS; others, durations and counts of money among them, bigint. `overrides` gives the Spark type of single columns by name.
    """
    kind = F.upper("data_type")
    name = F.col("column_name")
    by_rule = name.rlike(DECIMAL_NAMES) & ~name.rlike(WHOLE_NAMES)
    fractional = F.upper("column_name").isin(*sorted(DECIMAL_COLUMNS)) | by_rule
    mapped = F.when((kind == "NUMBER") & fractional, "decimal(38,6)")
    for name, spark_type in TYPE_NAMES.items():
        mapped = mapped.when(kind == name, spark_type)
    chosen = mapped.otherwise("string")
    for column, spark_type in (overrides or {}).items():
        chosen = F.when(F.upper("column_name") == column.upper(), spark_type).otherwise(chosen)
    return catalog.select("table_name", "ordinal", "column_name", chosen.alias("spark_type"))


def catalog_schemas(catalog: DataFrame, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """table_name and the columns of every table, in ordinal order, as the text of a Spark schema.

    A group is the columns of one table.
    """
    fields = catalog_fields(catalog, overrides)
    quoted = F.concat(F.lit("`"), F.replace("column_name", F.lit("`"), F.lit("``")), F.lit("` "), "spark_type")
    column = F.struct("ordinal", "column_name", "spark_type", quoted.alias("ddl"))
    columns = fields.groupBy("table_name").agg(F.array_sort(F.collect_list(column)).alias("columns"))
    return columns.select("table_name", F.array_join("columns.ddl", ", ").alias("ddl"))


def catalog_struct(catalog: DataFrame, table: str, overrides: Mapping[str, str] | None = None) -> StructType:
    """Schema of one table, in ordinal order; an unknown table has no columns."""
    row = catalog_schemas(catalog.where(F.col("table_name") == table), overrides).first()
    return StructType.fromDDL(row["ddl"]) if row else StructType([])


def catalog_checks(catalog: DataFrame, tables: DataFrame) -> DataFrame:
    """subject, finding, detail over a whole catalogue and the list of known tables.

    empty_table: a known table without columns. ordinal_gap: the first ordinal of
    each hole. duplicate_ordinal, duplicate_column: within a table. mixed_types:
    one column name with several types, over all tables. Every group is counted,
    none is collected.
    """
    rows = catalog.select("table_name", "column_name", "ordinal", F.upper("data_type").alias("data_type"))

    per_table = rows.groupBy("table_name").agg(F.max("ordinal").alias("last"))
    empty = tables.select("table_name").distinct().join(per_table, "table_name", "left_anti")
    empty = empty.select(
        F.col("table_name").alias("subject"), F.lit("empty_table").alias("finding"), F.lit("").alias("detail")
    )

    # Each ordinal is there once and asks for 1 and for its successor; the last ordinal of
    # a table asks in vain.
    def entry(ordinal: Column, there: int) -> Column:
        return F.struct(ordinal.alias("ordinal"), F.lit(there).alias("there"))

    entries = F.array(entry(F.col("ordinal"), 1), entry(F.col("ordinal") + 1, 0), entry(F.lit(1), 0))
    times = (
        rows.select("table_name", F.inline(entries))
        .where(F.col("ordinal").isNotNull())
        .groupBy("table_name", "ordinal")
        .agg(F.sum("there").alias("times"))
    )

    odd = skew_join(times.where("times <> 1"), per_table, ["table_name"], "left")
    ordinals = odd.where((F.col("times") > 1) | (F.col("ordinal") < F.col("last"))).select(
        F.col("table_name").alias("subject"),
        F.when(F.col("times") > 1, "duplicate_ordinal").otherwise("ordinal_gap").alias("finding"),
        F.col("ordinal").cast("string").alias("detail"),
    )
    columns = rows.where(F.col("column_name").isNotNull()).groupBy("table_name", "column_name").count()
    columns = columns.where("count > 1").select(
        F.col("table_name").alias("subject"),
        F.lit("duplicate_column").alias("finding"),
        F.col("column_name").alias("detail"),
    )
    mixed = (
        rows.groupBy("column_name")
        .agg(F.countDistinct("data_type").alias("types"))
        .where("types > 1")
        .select(
            F.col("column_name").alias("subject"),
            F.lit("mixed_types").alias("finding"),
            F.col("types").cast("string").alias("detail"),
        )
    )
    return (
        empty.unionByName(ordinals).unionByName(columns).unionByName(mixed)
    )
