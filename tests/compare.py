"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

KINDS = {
    "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
    "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when names, types, row count and values agree."""
    rel = con.sql(sql)
    theirs_cols = sorted(zip(rel.columns, [str(t) for t in rel.types]))
    ours_cols = sorted((c, KINDS.get(t, t)) for c, t in spark_df.dtypes)
    out = []
    if [c for c, _ in ours_cols] != [c for c, _ in theirs_cols]:
        return [f"columns {ours_cols} against {theirs_cols}"]
    out += [f"type {a} against {b}" for a, b in zip(ours_cols, theirs_cols) if a != b and "array" not in a[1]]
    names = [c for c, _ in ours_cols]
    ours = sorted(tuple(_cell(r[c]) for c in names) for r in spark_df.collect())
    order = [rel.columns.index(c) for c in names]
    theirs = sorted(tuple(_cell(r[i]) for i in order) for r in rel.fetchall())
    if len(ours) != len(theirs):
        out.append(f"rows {len(ours)} against {len(theirs)}")
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        out.append(f"{len(bad)} rows differ, first {names}: {bad[0][0]} against {bad[0][1]}")
    return out
