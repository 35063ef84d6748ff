"""Column descriptions and relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.common import DIRTY_SQL, dirty_orders, query, read, rounded, union_all_sql
from gridsight.operators import describe

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _population_moments(c: str) -> str:
    return f"""
       round(avg((x - m) ^ 3) / sqrt(avg((x - m) ^ 2)) ^ 3, 6) AS skewness,
       round(avg((x - m) ^ 4) / avg((x - m) ^ 2) ^ 2 - 3, 6) AS kurtosis"""


def _describe_sql(table: str, c: str) -> str:
    return f"""
SELECT '{c}' AS "column", count(x) AS "count", round(avg(x), 4) AS mean, min(x) AS "min",
       max(x) AS "max", round(max(x) - min(x), 4) AS "range", round(stddev_samp(x), 4) AS std,
       round(var_samp(x), 3) AS "var", {_population_moments(c)},
       round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS median,
       round(quantile_cont(x, 0.75), 6) AS q75, min(common) AS "mode"
FROM (SELECT {c}::DOUBLE AS x, avg({c}) OVER () AS m FROM {table}),
     (SELECT {c}::DOUBLE AS common FROM {table} GROUP BY {c}
      ORDER BY count(*) DESC, {c} LIMIT 1)"""


def _rounded_describe(df: DataFrame) -> DataFrame:
    df = rounded(df, 4, "mean", "range", "std")
    df = rounded(df, 6, "skewness", "kurtosis", "q25", "median", "q75")
    return rounded(df, 3, "var").drop("position")


@query("numeric_describe", union_all_sql([_describe_sql("lineitem", c) for c in NUMBERS]))
def numeric_describe(spark, sf_dir):
    return _rounded_describe(describe.numeric_describe(read(spark, sf_dir, "lineitem"), NUMBERS))


def _moments_sql(table: str, c: str) -> str:
    return f"""
SELECT '{c}' AS "column", count(x) AS "count", {_population_moments(c)}
FROM (SELECT {c}::DOUBLE AS x, avg({c}) OVER () AS m FROM {table})"""


SKEWED = {"events": "value", "documents": "n_chars", "customer": "c_acctbal"}


@query("moments", union_all_sql([_moments_sql(t, c) for t, c in SKEWED.items()]))
def moments(spark, sf_dir):
    frames = [describe.moments(read(spark, sf_dir, t), [c]) for t, c in SKEWED.items()]
    found = reduce(DataFrame.unionByName, frames)
    return rounded(found, 6, "skewness", "kurtosis").select(
        "column", "count", "skewness", "kurtosis")


@query("quartiles", union_all_sql([
    f"SELECT '{c}' AS \"column\", round(quantile_cont({c}, 0.25), 6) AS q25, "
    f"round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q75 "
    f"FROM lineitem" for c in NUMBERS]))
def quartiles(spark, sf_dir):
    return rounded(describe.quartiles(read(spark, sf_dir, "lineitem"), NUMBERS), 6,
                   "q25", "median", "q75")


@query("numeric_mode", union_all_sql([
    f"""SELECT '{c}' AS "column", (SELECT {c} FROM lineitem GROUP BY {c}
    ORDER BY count(*) DESC, {c} LIMIT 1)::DOUBLE AS "mode" """ for c in NUMBERS]))
def numeric_mode(spark, sf_dir):
    return describe.numeric_mode(read(spark, sf_dir, "lineitem"), NUMBERS)


def _distribution_sql(table: str, c: str, top: int = 10) -> str:
    return f"""
SELECT '{c}' AS "column", rank, value, sum(n)::BIGINT AS "count",
       round(sum(n) * 100.0 / min(total), 6) AS pct
FROM (SELECT least(r, {top + 1})::INT AS rank, CASE WHEN r > {top} THEN 'Others' ELSE v END AS value,
             n, total
      FROM (SELECT coalesce(CAST({c} AS VARCHAR), 'Missing') AS v, count(*) AS n,
                   sum(count(*)) OVER () AS total,
                   row_number() OVER (ORDER BY count(*) DESC,
                                      coalesce(CAST({c} AS VARCHAR), 'Missing')) AS r
            FROM {table} GROUP BY 1))
GROUP BY rank, value"""


@query("value_distribution", union_all_sql(
    [_distribution_sql("part", c) for c in ("p_name", "p_brand", "p_type")]))
def value_distribution(spark, sf_dir):
    found = describe.value_distribution(
        read(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"])
    return rounded(found, 6, "pct")


@query("value_distribution_missing", f"WITH {DIRTY_SQL}" +
       _distribution_sql("dirty_orders", "o_orderpriority"))
def value_distribution_missing(spark, sf_dir):
    found = describe.value_distribution(dirty_orders(spark, sf_dir), ["o_orderpriority"])
    return rounded(found, 6, "pct")


LABELS = ["l_returnflag", "l_linestatus", "l_tax", "l_linenumber"]


def _extremes_sql(table: str, c: str) -> str:
    return f"""
SELECT '{c}' AS "column", count(*) AS categories, sum(n)::BIGINT AS total,
       arg_min(v, (-n, v)) AS most_common, max(n) AS most_count,
       round(max(n) * 100.0 / sum(n), 6) AS most_pct,
       arg_max(v, (-n, v)) AS least_common, min(n) AS least_count,
       round(min(n) * 100.0 / sum(n), 6) AS least_pct
FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {table} GROUP BY 1)"""


@query("category_extremes", union_all_sql([_extremes_sql("lineitem", c) for c in LABELS]))
def category_extremes(spark, sf_dir):
    found = describe.category_extremes(read(spark, sf_dir, "lineitem"), LABELS)
    return rounded(found, 6, "most_pct", "least_pct")


PRICED_SQL = """priced AS (
  SELECT l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount,
         l_extendedprice * (1 - l_discount) AS net, -l_extendedprice * l_tax AS tax,
         1.0::DOUBLE AS unit FROM lineitem)"""
PRICED = ["quantity", "price", "discount", "net", "tax", "unit"]


def _priced(spark, sf_dir) -> DataFrame:
    price = F.col("l_extendedprice")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("quantity"), price.alias("price"),
        F.col("l_discount").alias("discount"), (price * (1 - F.col("l_discount"))).alias("net"),
        (-price * F.col("l_tax")).alias("tax"), F.lit(1.0).alias("unit"))


def _r(a: str, b: str) -> str:
    return "max(0)" if "unit" in (a, b) else f"corr({a}, {b})"


@query("correlation_matrix", f"WITH {PRICED_SQL}" + union_all_sql([
    f"SELECT '{a}' AS col1, '{b}' AS col2, round(({_r(a, b)})::DOUBLE, 6) + 0.0 AS r FROM priced"
    for a in PRICED for b in PRICED]))
def correlation_matrix(spark, sf_dir):
    found = describe.correlation_matrix(_priced(spark, sf_dir), PRICED)
    return rounded(found, 6, "r").select("col1", "col2", "r")


_PAIRS = [(a, b) for i, a in enumerate(PRICED) for b in PRICED[i + 1:] if b != "unit"]


@query("strong_pairs", f"""
WITH {PRICED_SQL}, pairs AS ({union_all_sql([
    f"SELECT '{a}' AS col1, '{b}' AS col2, corr({a}, {b}) AS r FROM priced" for a, b in _PAIRS])})
SELECT col1, col2, round(r, 6) AS r, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END
       AS direction, CASE WHEN abs(r) >= 0.7 THEN 'strong' ELSE 'moderate' END AS strength
FROM pairs WHERE abs(r) >= 0.4 ORDER BY abs(r) DESC LIMIT 10""")
def strong_pairs(spark, sf_dir):
    pairs = describe.pair_correlations(_priced(spark, sf_dir), PRICED)
    return rounded(describe.strong_pairs(pairs), 6, "r")


# Gaps in one column, infinite cells in two, and a column that is constant where another is not missing.
GAPPED_SQL = """gapped AS (
  SELECT CASE WHEN l_linenumber <> 3 THEN l_quantity END AS quantity,
         CASE WHEN l_orderkey % 97 = 0 THEN 'infinity'::DOUBLE ELSE l_extendedprice END AS price,
         CASE WHEN l_orderkey % 89 = 0 THEN '-infinity'::DOUBLE
              WHEN l_linenumber <> 2 THEN l_extendedprice * (1 - l_discount) END AS net,
         CASE WHEN l_linenumber = 3 THEN l_tax ELSE 1.0 END AS flat FROM lineitem)"""
GAPPED = ["quantity", "price", "net", "flat"]


def _gapped(spark, sf_dir) -> DataFrame:
    price, line, key = F.col("l_extendedprice"), F.col("l_linenumber"), F.col("l_orderkey")
    return read(spark, sf_dir, "lineitem").select(
        F.when(line != 3, F.col("l_quantity")).alias("quantity"),
        F.when(key % 97 == 0, float("inf")).otherwise(price).alias("price"),
        F.when(key % 89 == 0, float("-inf")).when(line != 2, price * (1 - F.col("l_discount"))).alias("net"),
        F.when(line == 3, F.col("l_tax")).otherwise(1.0).alias("flat"))


def _finite_r(a: str, b: str) -> str:
    both = f"isfinite({a}) AND isfinite({b})"
    varies = " AND ".join(f"max({c}) FILTER ({both}) > min({c}) FILTER ({both})" for c in (a, b))
    return f"CASE WHEN {varies} THEN corr({a}, {b}) FILTER ({both}) ELSE 0 END"


@query("correlation_gaps", f"WITH {GAPPED_SQL}" + union_all_sql([
    f"SELECT '{a}' AS col1, '{b}' AS col2, round(({_finite_r(a, b)})::DOUBLE, 6) + 0.0 AS r FROM gapped"
    for a in GAPPED for b in GAPPED]))
def correlation_gaps(spark, sf_dir):
    found = describe.correlation_matrix(_gapped(spark, sf_dir), GAPPED)
    return rounded(found, 6, "r").select("col1", "col2", "r")


def _group_sql(table: str, cat: str, num: str) -> str:
    return f"""
SELECT '{cat}' AS cat_column, '{num}' AS num_column, rank, category, round(mean, 4) AS mean,
       round(median, 6) AS median, round(total, 2) AS "sum", n AS "count"
FROM (SELECT CAST({cat} AS VARCHAR) AS category, avg({num}) AS mean, median({num}) AS median,
             sum({num}) AS total, count({num}) AS n,
             row_number() OVER (ORDER BY avg({num}) DESC, CAST({cat} AS VARCHAR))::INT AS rank
      FROM {table} WHERE {cat} IS NOT NULL GROUP BY {cat} HAVING count({num}) > 0)
WHERE rank <= 10"""


@query("group_stats", union_all_sql([
    _group_sql("lineitem", cat, num) for cat in ("l_returnflag", "l_linestatus", "l_tax")
    for num in ("l_quantity", "l_extendedprice", "l_discount")]))
def group_stats(spark, sf_dir):
    found = describe.group_stats(
        read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_tax"],
        ["l_quantity", "l_extendedprice", "l_discount"])
    return _shown_groups(found)


def _shown_groups(df: DataFrame) -> DataFrame:
    df = rounded(rounded(rounded(df, 4, "mean"), 6, "median"), 2, "sum")
    return df.drop("cat_position", "num_position")


@query("group_stats_many", union_all_sql([
    _group_sql("part", "p_brand", "p_retailprice"), _group_sql("part", "p_name", "p_retailprice"),
    _group_sql("part", "p_brand", "p_size"), _group_sql("part", "p_name", "p_size")]))
def group_stats_many(spark, sf_dir):
    return _shown_groups(describe.group_stats(
        read(spark, sf_dir, "part"), ["p_brand", "p_name"], ["p_retailprice", "p_size"]))


@query("crosstab", """
SELECT l_returnflag AS cat1, l_linestatus AS cat2, count(*) AS "count" FROM lineitem
GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 30""")
def crosstab(spark, sf_dir):
    return describe.crosstab(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("crosstab_wide", """
SELECT p_brand AS cat1, p_type AS cat2, count(*) AS "count" FROM part
GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 30""")
def crosstab_wide(spark, sf_dir):
    return describe.crosstab(read(spark, sf_dir, "part"), "p_brand", "p_type")
