"""Column catalogues exported as CSV: one row per table column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Fixed header of the export.
EXPORT_COLUMNS = (
    "DBMS",
    "TABLE_CATALOG",
    "TABLE_SCHEMA",
    "TABLE_NAME",
    "COLUMN_NAME",
    "ORDINAL_POSITION",
    "DATA_TYPE",
    "CHARACTER_MAXIMUM_LENGTH",
    "CONSTRAINT_TYPE",
    "k2.table_schema",
    "k2.table_name",
    "k2.column_name",
)


def read_catalog(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Catalogue rows of all CSV files under the path; a header-only file gives none.

    Lengths are exported as decimal text and become whole numbers.
    """
    schema = StructType([StructField(name, StringType()) for name in EXPORT_COLUMNS])
    raw = spark.read.option("header", True).schema(schema).csv(path)
    return raw.select(
        F.col("TABLE_CATALOG").alias("table_catalog"),
        F.col("TABLE_SCHEMA").alias("table_schema"),
        F.col("TABLE_NAME").alias("table_name"),
        F.col("COLUMN_NAME").alias("column_name"),
        F.col("ORDINAL_POSITION").try_cast("int").alias("ordinal"),
        F.col("DATA_TYPE").alias("data_type"),
        _whole(F.col("CHARACTER_MAXIMUM_LENGTH")).alias("max_length"),
    )


def _whole(text: Column) -> Column:
    return text.try_cast("double").try_cast("bigint")


def one_row(spark: SparkSession) -> DataFrame:
    """The smallest query there is: one row, `num` = 1."""
    return spark.range(1).select(F.lit(1).alias("num"))
