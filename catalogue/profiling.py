"""Profiles and semantic types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.common import DIRTY_SQL, dirty_orders, query, read, rounded, union_all_sql
from gridsight.operators import profile

# Tables and the SQL types of their columns.
TABLES = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int",
                 "c_acctbal": "double", "c_mktsegment": "string"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int",
                 "s_acctbal": "double"},
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string",
             "p_type": "string", "p_size": "int", "p_retailprice": "double"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
               "o_totalprice": "double", "o_orderdate": "timestamp",
               "o_orderpriority": "string"},
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint",
                 "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double",
                 "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
                 "l_linestatus": "string", "l_shipdate": "timestamp"},
    "events": {"event_id": "bigint", "ts": "timestamp", "user_id": "bigint",
               "event_type": "string", "value": "double", "props": "string"},
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string",
                  "source": "string", "n_chars": "bigint"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
    "conversations": {"conv_id": "bigint", "turn": "bigint", "role": "string",
                      "text": "string"},
    "pages": {"page_id": "bigint", "url": "string", "html": "string"},
    "benchmark": {"item_id": "bigint", "text": "string"},
    "embeddings": {"vec_id": "bigint", "embedding": "list", "label": "int"},
}

# The rules by name and type, over distinct values u, non-missing cells nn, all rows n.
# Limits of the type rules.
TYPE_RULES = """CASE
    WHEN nn = 0 THEN 'empty'
    WHEN regexp_matches(name, 'id|key|code|num|uuid|index') AND u > 1 THEN 'id'
    WHEN u = nn AND u > 5 AND dtype IN ('int', 'bigint') AND nn = n THEN 'id'
    WHEN u <= 2 AND boolean_like THEN 'boolean'
    WHEN dtype = 'timestamp' THEN 'datetime'
    WHEN dtype IN ('int', 'bigint', 'double') AND u <= 10 THEN 'categorical'
    WHEN dtype IN ('int', 'bigint', 'double') THEN 'numeric'
    WHEN u <= 25 OR u / n < 0.05 THEN 'categorical'
    ELSE 'text' END"""
# The boolean spellings.
SPELLINGS = ("'0','1','True','False','true','false','T','F','Y','N','yes','no','Yes','No'")


def _column_facts(table: str, column: str, dtype: str) -> str:
    if dtype in ("int", "bigint", "double"):
        like = f"coalesce(bool_and({column} IN (0, 1)), false)"
    elif dtype == "string":
        like = f"coalesce(bool_and({column} IN ({SPELLINGS})), false)"
    else:
        like = "false"
    return (f"SELECT '{table}' AS table_name, '{column}' AS name, '{dtype}' AS dtype, "
            f"count(*) AS n, count({column}) AS nn, count(DISTINCT {column}) AS u, "
            f"{like} AS boolean_like FROM {table}")


ALL_FACTS = union_all_sql([_column_facts(t, c, d) for t, cs in TABLES.items()
                           for c, d in cs.items()])


def _typed(spark, sf_dir) -> DataFrame:
    frames = [profile.profile_columns(read(spark, sf_dir, t)).withColumn("table_name", F.lit(t))
              for t in TABLES]
    return reduce(DataFrame.unionByName, frames)


@query("profile_table", f"""
WITH {DIRTY_SQL}
SELECT count(*) AS num_records, 5::BIGINT AS num_features,
       count(*) * 5 - count(o_orderkey) - count(o_custkey) - count(o_totalprice)
         - count(o_orderpriority) - count(o_orderdate) AS total_missing,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)) AS duplicate_count
FROM dirty_orders""")
def profile_table(spark, sf_dir):
    return profile.profile_table(dirty_orders(spark, sf_dir))


def _dirty_column(column: str, kind: str, dtype: str) -> str:
    return (f"SELECT '{column}' AS \"column\", '{dtype}' AS original_dtype, {kind} AS inferred_type,"
            f" count(*) AS row_count, count(*) - count({column}) AS null_count,"
            f" round((count(*) - count({column})) * 100.0 / count(*), 6) AS null_pct,"
            f" count(DISTINCT {column}) AS unique_count FROM dirty_orders")


@query("profile_columns", f"WITH {DIRTY_SQL}" + union_all_sql([
    _dirty_column("o_orderkey", "'id'", "bigint"),
    _dirty_column("o_custkey", "'id'", "bigint"),
    _dirty_column("o_totalprice", "CASE WHEN count(DISTINCT o_totalprice) <= 10 "
                                  "THEN 'categorical' ELSE 'numeric' END", "double"),
    _dirty_column("o_orderpriority", "'categorical'", "string"),
    _dirty_column("o_orderdate", "'datetime'", "timestamp_ntz"),
]))
def profile_columns(spark, sf_dir):
    found = profile.profile_columns(dirty_orders(spark, sf_dir))
    return rounded(found, 6, "null_pct").drop("position", "sample_values")


@query("column_stats", union_all_sql([
    f"SELECT '{c}' AS \"column\", count(*) AS row_count, count({c}) AS non_null, "
    f"count(DISTINCT {c}) AS unique_count FROM lineitem" for c in TABLES["lineitem"]]))
def column_stats(spark, sf_dir):
    return profile.column_stats(read(spark, sf_dir, "lineitem")).drop("boolean_like")


def _first_values(column: str) -> str:
    return (f"SELECT '{column}' AS \"column\", row_number() OVER (ORDER BY o_orderkey)::INT AS position, "
            f"CAST({column} AS VARCHAR) AS value FROM dirty_unique WHERE {column} IS NOT NULL")


@query("sample_values", f"""
WITH {DIRTY_SQL}, dirty_unique AS (SELECT DISTINCT * FROM dirty_orders)
SELECT * FROM ({union_all_sql([_first_values(c) for c in (
    "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate")])})
WHERE position <= 10""")
def sample_values(spark, sf_dir):
    return profile.sample_values(dirty_orders(spark, sf_dir).distinct(), ["o_orderkey"])


@query("semantic_types", f"""
SELECT table_name, name AS "column", {TYPE_RULES} AS inferred_type,
       nn AS filled, u AS unique_count
FROM ({ALL_FACTS})""")
def semantic_types(spark, sf_dir):
    return _typed(spark, sf_dir).select(
        "table_name", "column", "inferred_type",
        (F.col("row_count") - F.col("null_count")).alias("filled"), "unique_count")


LINEITEM_FACTS = union_all_sql([_column_facts("lineitem", c, d)
                                for c, d in TABLES["lineitem"].items()])


@query("type_summary", f"""
SELECT inferred_type, count(*) AS columns FROM (
  SELECT {TYPE_RULES} AS inferred_type FROM ({LINEITEM_FACTS})) GROUP BY inferred_type""")
def type_summary(spark, sf_dir):
    return profile.type_summary(profile.profile_columns(read(spark, sf_dir, "lineitem")))


@query("missing_report", f"""
WITH {DIRTY_SQL}
SELECT * FROM ({union_all_sql([
    f'SELECT {chr(39)}{c}{chr(39)} AS "column", count(*) - count({c}) AS null_count, '
    f'round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_pct FROM dirty_orders'
    for c in ("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate")])})
WHERE null_count > 0""")
def missing_report(spark, sf_dir):
    found = profile.missing_report(profile.profile_columns(dirty_orders(spark, sf_dir)))
    return rounded(found, 6, "null_pct")
