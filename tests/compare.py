"""Run registered queries beside their SQL and compare the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.9g}"
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        tuple(_cell(r[i]) for i in order) for r in rows)


def difference(con, spark, sf_dir, query, sql) -> str | None:
    """None if equal, otherwise a short report."""
    df = query(spark, sf_dir)
    ours = table(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    theirs = table([d[0] for d in found.description], found.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if ours[1] == theirs[1]:
        return None
    extra = [r for r in ours[1] if r not in set(theirs[1])][:3]
    missing = [r for r in theirs[1] if r not in set(ours[1])][:3]
    return f"{len(ours[1])} rows vs {len(theirs[1])}; only ours {extra}; only SQL {missing}"
