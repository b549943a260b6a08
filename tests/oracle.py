"""Runs registered queries on Spark and their SQL twins on DuckDB and compares the rows."""

from __future__ import annotations

import math
import os
import tempfile

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute(f"SET temp_directory = '{tempfile.mkdtemp(prefix='run-')}'")
    con.execute("SET max_temp_directory_size = '4GB'")  # a twin that spills more is written wrongly
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(names), sorted(plain, key=repr)


_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def difference(df, con, sql: str) -> str | None:
    """What differs between a Spark frame and a SQL text; None if nothing does."""
    want_types = {row[0]: _TYPES.get(row[1], row[1]) for row in con.execute(f"DESCRIBE {sql}").fetchall()}
    if dict(df.dtypes) != want_types:
        return f"types {dict(df.dtypes)} != {want_types}"
    got_names, got = _rows(df.columns, df.collect())
    cursor = con.execute(sql)
    want_names, want = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} != {b}"
    return None
