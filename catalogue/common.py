"""Registry and shared inputs of the query catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under `name`, with the SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def day_text(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


# Orders with gaps and copies: a price is missing while an order is pending, one
# priority means "not given", low priorities carry no date, and every order without
# a date was recorded twice.
DIRTY_SQL = """
d AS (
  SELECT o_orderkey, o_custkey,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS o_totalprice,
         nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority,
         CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END AS o_orderdate
  FROM orders),
dirty_orders AS (
  SELECT * FROM d UNION ALL SELECT * FROM d WHERE o_orderdate IS NULL)
"""


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    d = orders.select(
        "o_orderkey", "o_custkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("o_totalprice"),
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("o_orderpriority"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate")).alias("o_orderdate"))
    return d.unionAll(d.where(F.col("o_orderdate").isNull()))


# Lineitem under business names.
SALES_SQL = """
sales AS (
  SELECT l_orderkey AS order_id, l_suppkey AS customer_id, l_partkey AS product_id,
         l_quantity AS quantity, l_extendedprice AS revenue,
         l_extendedprice * l_discount AS cost,
         l_returnflag AS returnflag, l_shipdate AS ship_date
  FROM lineitem)
"""


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("customer_id"),
        F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("revenue"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("cost"),
        F.col("l_returnflag").alias("returnflag"), F.col("l_shipdate").alias("ship_date"))


def union_all_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
