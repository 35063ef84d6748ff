"""Duplicates, missing cells, outliers, the cleaning pipeline."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.common import (
    DIRTY_SQL, ORACLES, day_text, dirty_orders, query, read, rounded, union_all_sql)
from gridsight.functions import values as V
from gridsight.operators import clean, profile
from gridsight.session import shared_folder
from gridsight.sources import sinks

UNIQUE_SQL = f"{DIRTY_SQL}, u AS (SELECT DISTINCT * FROM dirty_orders)"


def _dates_as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("o_orderdate", day_text("o_orderdate"))


@query("dedup", f"""
WITH {DIRTY_SQL}
SELECT DISTINCT o_orderkey, o_custkey, o_totalprice, o_orderpriority,
       strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM dirty_orders""")
def dedup(spark, sf_dir):
    return _dates_as_text(clean.drop_duplicates(dirty_orders(spark, sf_dir)))


@query("fill_unknown", f"""
WITH {DIRTY_SQL}
SELECT o_orderkey, coalesce(o_orderpriority, 'Unknown') AS o_orderpriority FROM dirty_orders""")
def fill_unknown(spark, sf_dir):
    filled = clean.fill_unknown(dirty_orders(spark, sf_dir), ["o_orderpriority"])
    return filled.select("o_orderkey", "o_orderpriority")


@query("impute_mean", f"""
WITH {DIRTY_SQL}
SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM dirty_orders)), 4)
       AS o_totalprice FROM dirty_orders""")
def impute_mean(spark, sf_dir):
    filled = clean.impute_mean(dirty_orders(spark, sf_dir), ["o_totalprice"])
    return rounded(filled.select("o_orderkey", "o_totalprice"), 4, "o_totalprice")


@query("impute_median", f"""
WITH {DIRTY_SQL}
SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT median(o_totalprice) FROM dirty_orders)), 4)
       AS o_totalprice FROM dirty_orders""")
def impute_median(spark, sf_dir):
    filled = clean.impute_median(dirty_orders(spark, sf_dir), ["o_totalprice"])
    return rounded(filled.select("o_orderkey", "o_totalprice"), 4, "o_totalprice")


MODE_SQL = """(SELECT o_orderpriority FROM {source} WHERE o_orderpriority IS NOT NULL
  GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1)"""


@query("impute_mode", f"""
WITH {DIRTY_SQL}
SELECT o_orderkey, coalesce(o_orderpriority, {MODE_SQL.format(source="dirty_orders")})
       AS o_orderpriority FROM dirty_orders""")
def impute_mode(spark, sf_dir):
    filled = clean.impute_mode(dirty_orders(spark, sf_dir), ["o_orderpriority"])
    return filled.select("o_orderkey", "o_orderpriority")


FILLED_DATE_SQL = """coalesce(
  last_value(o_orderdate IGNORE NULLS) OVER (
    ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(o_orderdate IGNORE NULLS) OVER (
    ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query("ffill_bfill", f"""
WITH {UNIQUE_SQL}
SELECT o_orderkey, strftime({FILLED_DATE_SQL}, '%Y-%m-%d') AS o_orderdate FROM u""")
def ffill_bfill(spark, sf_dir):
    unique = clean.drop_duplicates(dirty_orders(spark, sf_dir))
    filled = clean.fill_forward_backward(unique, ["o_orderdate"], "o_orderkey")
    return _dates_as_text(filled.select("o_orderkey", "o_orderdate"))


def _fences(table: str, column: str) -> str:
    return f"""(SELECT q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM (
      SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3
      FROM {table}))"""


def _outliers(table: str, column: str) -> str:
    return f"""
SELECT '{column}' AS "column", count(*) FILTER (WHERE {column} < low OR {column} > high) AS "count",
       round(count(*) FILTER (WHERE {column} < low OR {column} > high) * 100.0 / count(*), 6) AS pct,
       round(min(low), 6) AS lower_bound, round(min(high), 6) AS upper_bound,
       min({column}) AS "min", max({column}) AS "max"
FROM {table}, {_fences(table, column)}
HAVING "count" > 0"""


OUTLIER_COLUMNS = {"events": ["value"], "documents": ["n_chars"],
                   "lineitem": ["l_quantity", "l_extendedprice"], "part": ["p_retailprice"]}


@query("outlier_profile", union_all_sql([
    _outliers(t, c) for t, cs in OUTLIER_COLUMNS.items() for c in cs]))
def outlier_profile(spark, sf_dir):
    frames = [clean.outlier_profile(read(spark, sf_dir, t), cs)
              for t, cs in OUTLIER_COLUMNS.items()]
    found = reduce(DataFrame.unionByName, frames).drop("position")
    return rounded(found, 6, "pct", "lower_bound", "upper_bound")


@query("outlier_flags", f"""
SELECT event_id, value < low OR value > high AS is_outlier
FROM events, {_fences("events", "value")}""")
def outlier_flags(spark, sf_dir):
    flagged = clean.flag_outliers(read(spark, sf_dir, "events"), "value")
    return flagged.select("event_id", "is_outlier")


RARE_SQL = """rare AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'
                          THEN o_totalprice END AS pending_urgent FROM orders)"""


@query("high_null_warning", f"""
WITH {RARE_SQL}
SELECT * FROM (
  SELECT 'pending_urgent' AS "column", count(*) - count(pending_urgent) AS null_count,
         round((count(*) - count(pending_urgent)) * 100.0 / count(*), 6) AS null_pct FROM rare)
WHERE null_pct > 80""")
def high_null_warning(spark, sf_dir):
    rare = read(spark, sf_dir, "orders").select("o_orderkey", F.when(
        (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"),
        F.col("o_totalprice")).alias("pending_urgent"))
    found = clean.high_null_warnings(profile.profile_columns(rare))
    return rounded(found, 6, "null_pct")


def _cleaned(spark, sf_dir) -> clean.Cleaned:
    df = dirty_orders(spark, sf_dir)
    return clean.clean(df, profile.profile_columns(df), order_by="o_orderkey")


@query("clean_pipeline", f"""
WITH {UNIQUE_SQL}
SELECT o_orderkey, o_custkey,
       round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM u)), 4) AS o_totalprice,
       coalesce(o_orderpriority, {MODE_SQL.format(source="u")}) AS o_orderpriority,
       strftime({FILLED_DATE_SQL}, '%Y-%m-%d') AS o_orderdate
FROM u""")
def clean_pipeline(spark, sf_dir):
    return rounded(_dates_as_text(_cleaned(spark, sf_dir).data), 4, "o_totalprice")


@query("cleaning_log", f"""
WITH {UNIQUE_SQL},
filled AS (SELECT coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM u)) AS price FROM u)
SELECT * FROM (
  SELECT 'drop_duplicates' AS action, NULL AS "column",
         (SELECT count(*) FROM dirty_orders) - count(*) AS affected FROM u
  UNION ALL
  SELECT 'impute_mean', 'o_totalprice', count(*) - count(o_totalprice) FROM u
  UNION ALL
  SELECT 'impute_mode', 'o_orderpriority', count(*) - count(o_orderpriority) FROM u
  UNION ALL
  SELECT 'fill_forward', 'o_orderdate', count(*) - count(o_orderdate) FROM u
  UNION ALL
  SELECT 'flag_outliers', 'o_totalprice', count(*) FROM filled, {_fences("filled", "price")}
  WHERE price < low OR price > high)
WHERE affected > 0""")
def cleaning_log(spark, sf_dir):
    return _cleaned(spark, sf_dir).log.select("action", "column", "affected")


@query("clean_stored", ORACLES["clean_pipeline"])
def clean_stored(spark, sf_dir):
    """The cleaned table, written and read back."""
    path = f"{shared_folder(spark)}/cleaned-{uuid.uuid4().hex}"
    sinks.write_parquet(_cleaned(spark, sf_dir).data, path)
    return rounded(_dates_as_text(spark.read.parquet(path)), 4, "o_totalprice")


@query("clean_without_numbers", f"""
WITH {UNIQUE_SQL}
SELECT o_orderkey, o_custkey, coalesce(round(o_totalprice, 4), -1) AS o_totalprice,
       coalesce(o_orderpriority, {MODE_SQL.format(source="u")}) AS o_orderpriority,
       strftime({FILLED_DATE_SQL}, '%Y-%m-%d') AS o_orderdate
FROM u""")
def clean_without_numbers(spark, sf_dir):
    """Imputation disabled: missing numbers stay missing (shown as -1)."""
    df = dirty_orders(spark, sf_dir)
    found = clean.clean(df, profile.profile_columns(df), "disabled", order_by="o_orderkey").data
    shown = rounded(_dates_as_text(found), 4, "o_totalprice")
    return shown.withColumn("o_totalprice", F.coalesce("o_totalprice", F.lit(-1.0)))


@query("coerce_numbers", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN -1 ELSE o_totalprice END AS price FROM orders""")
def coerce_numbers(spark, sf_dir):
    """Text cells as numbers; what is no number becomes missing (shown as -1)."""
    texts = read(spark, sf_dir, "orders").select("o_orderkey", F.when(
        F.col("o_orderstatus") == "P", "about 12").otherwise(
        F.concat(F.lit(" "), F.col("o_totalprice").cast("string"))).alias("price"))
    return texts.select("o_orderkey", F.coalesce(V.as_number(texts, "price"), F.lit(-1.0)).alias("price"))
