"""Small role tables for tests, from rows given by hand."""

from __future__ import annotations

from types import SimpleNamespace

from storelens.sources.roles import ROLES, SEVERAL_SOURCES


def role_tables(spark, **rows):
    """Tables with every role; a role not named is empty. Rows are dicts, missing columns null."""
    tables = {}
    for role, columns in ROLES.items():
        schema = ", ".join(f"`{name}` {kind}" for name, kind in columns.items())

        def frame(given, schema=schema, columns=columns):
            return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in given], schema)

        given = rows.get(role, [])
        if role in SEVERAL_SOURCES:
            sources = given if given else [[], []]
            tables[role] = [frame(source) for source in sources]
        else:
            tables[role] = frame(given)
    return SimpleNamespace(**tables)


def metrics(frame) -> dict:
    rows = frame.collect()
    return {row[0]: row[1] for row in rows}
