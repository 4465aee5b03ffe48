"""Column contracts: fixed names, order, types and comments of a result table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

# Type names contracts and catalogues use, and the Spark types for them.
TYPE_NAMES = {
    "TEXT": "string",
    "NUMBER": "bigint",
    "BOOLEAN": "boolean",
    "TIMESTAMP_NTZ": "timestamp_ntz",
    "FLOAT": "double",
    "DATE": "date",
    "ARRAY": "array<string>",
}

SPARK_TYPES: dict[str, DataType] = {
    "string": StringType(),
    "int": IntegerType(),
    "bigint": LongType(),
    "double": DoubleType(),
    "decimal(38,6)": DecimalType(38, 6),
    "boolean": BooleanType(),
    "date": DateType(),
    "timestamp_ntz": TimestampNTZType(),
    "array<string>": ArrayType(StringType()),
}


def contract(*columns: tuple[str, str, str]) -> StructType:
    """A schema from (name, Spark type, comment) triples."""
    return StructType(
        [
            StructField(name, SPARK_TYPES[kind], True, {"comment": comment})
            for name, kind, comment in columns
        ]
    )


def contract_from_yaml(text: str) -> StructType:
    """A schema from YAML text with a `column_definitions` list of name, type, comment."""
    import yaml

    columns = yaml.safe_load(text)["column_definitions"]
    return contract(
        *[
            (c["name"].lower(), TYPE_NAMES[c["type"].upper()], c.get("comment", "").strip())
            for c in columns
        ]
    )


def conform_to(frame: DataFrame, schema: StructType) -> DataFrame:
    """The contract's columns in its order, types and comments."""
    return frame.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema]
    )


def contract_findings(found: StructType, wanted: StructType, renamed: Mapping[str, str] | None = None) -> list[str]:
    """How a schema departs from a contract; empty when it holds.

    `renamed` gives, for columns that have another name here, that name by the
    contract's; findings use the contract's names.
    """
    findings = []
    back = {here.lower(): there.lower() for there, here in (renamed or {}).items()}
    found = StructType([StructField(back.get(f.name.lower(), f.name), f.dataType) for f in found])
    positions = {f.name.lower(): (i, f) for i, f in enumerate(found)}
    names = {f.name.lower() for f in wanted}
    for i, field in enumerate(wanted):
        if field.name.lower() not in positions:
            findings.append(f"{field.name}: missing")
            continue
        at, other = positions[field.name.lower()]
        if other.dataType != field.dataType:
            findings.append(f"{field.name}: type {other.dataType.simpleString()}")
        if at != i:
            findings.append(f"{field.name}: position {at}")
    findings += [f"{f.name}: not in contract" for f in found if f.name.lower() not in names]
    return findings
