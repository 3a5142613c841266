"""Compare a query with its SQL: names, row count and values in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return "\0NULL" if value is None else str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def differences(df, con, sql) -> str | None:
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    types = {c[0]: str(c[1]) for c in cursor.description}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    for name, kind in df.dtypes:
        if SAME_TYPE.get(kind, kind) != types[name]:
            return f"type of {name}: {kind} against {types[name]}"
    wanted = _rows(names, cursor.fetchall())
    found = _rows(df.columns, df.collect())
    if len(found) != len(wanted):
        return f"{len(found)} rows against {len(wanted)}"
    for a, b in zip(found, wanted):
        if a != b:
            return f"{a} against {b}"[:600]
    return None
