"""Exact duplicate rows without shuffling whole rows.

Rows are hashed first and only the hashes are shuffled. A hash that occurs once
proves its row unique; the few other rows are compared cell by cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsight.functions import values as V
from gridsight.session import stage


def row_hash(df: DataFrame, columns: Sequence[str]) -> Column:
    return F.xxhash64(*[V.native(df, c) for c in columns])


def repeated_hashes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(__h) of the row hashes that occur more than once, stored.

    Joins with it leave the choice to Spark: a small table is sent to all tasks, a
    large one is shuffled, where each hash stands once and AQE splits the other side.
    """
    hashes = df.select(row_hash(df, columns).alias("__h"))
    return stage(hashes.groupBy("__h").agg(F.count("*").alias("n"))
                 .where(F.col("n") > 1).select("__h"), "hashes")


def copies(df: DataFrame) -> DataFrame:
    """(.., n): one row per distinct row that may occur more than once.

    Copies collapse map-side, so a row that fills a third of the table is no hot
    key. Nulls are equal to each other.
    """
    columns = df.columns
    cells = [V.native(df, c).alias(f"c{i}") for i, c in enumerate(columns)]
    rows = df.select(*cells, row_hash(df, columns).alias("__h")).join(
        repeated_hashes(df, columns), "__h", "left_semi")
    return rows.groupBy(*[f"c{i}" for i in range(len(columns))]).agg(F.count("*").alias("n"))


def unique_rows(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """The table without exact copies; `order_by` is a row number outside the row.

    Rows with a hash of their own pass through without a shuffle. The kept copy
    has the lowest row number.
    """
    columns = [c for c in df.columns if c != order_by]
    df = df.select(*[  # NaN is a missing cell like any other
        V.present(df, c).cast(V.dtype_of(df, c)).alias(c)
        if isinstance(V.dtype_of(df, c), V.FLOATING) else V.col(c) for c in df.columns])

    def grouped(rows: DataFrame) -> DataFrame:
        if order_by is None:
            return rows.distinct()
        return rows.groupBy(*[V.col(c) for c in columns]).agg(
            F.min(V.col(order_by)).alias(order_by)).select(*[V.col(c) for c in df.columns])

    repeated = repeated_hashes(df, columns)
    hashed = df.withColumn("__h", row_hash(df, columns))
    single = hashed.join(repeated, "__h", "left_anti").drop("__h")
    several = hashed.join(repeated, "__h", "left_semi").drop("__h")
    return single.unionByName(grouped(several))
