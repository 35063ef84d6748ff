"""Business figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.common import SALES_SQL, query, read, rounded, sales
from gridsight.functions.money import money
from gridsight.operators import kpi, profile


@query("kpi_match", f"""
WITH {SALES_SQL}, kinds(kind, rank, term) AS (VALUES
  ('revenue', 1, 'revenue'), ('revenue', 1, 'sales_amount'), ('revenue', 1, 'sales'),
  ('revenue', 1, 'turnover'), ('revenue', 1, 'invoice_val'),
  ('sales_qty', 2, 'quantity'), ('sales_qty', 2, 'qty'), ('sales_qty', 2, 'volume'),
  ('sales_qty', 2, 'units_sold'), ('sales_qty', 2, 'units'),
  ('profit', 3, 'profit'), ('profit', 3, 'margin'), ('profit', 3, 'net_profit'),
  ('profit', 3, 'earnings'),
  ('cost', 4, 'cost'), ('cost', 4, 'spend'), ('cost', 4, 'expense'), ('cost', 4, 'expenses'),
  ('cost', 4, 'budget'),
  ('customers', 5, 'customer_id'), ('customers', 5, 'cust_id'), ('customers', 5, 'client_id'),
  ('customers', 5, 'user_id'), ('customers', 5, 'customer'), ('customers', 5, 'user'),
  ('customers', 5, 'buyer'),
  ('products', 6, 'product_id'), ('products', 6, 'prod_id'), ('products', 6, 'item_id'),
  ('products', 6, 'product'), ('products', 6, 'item'), ('products', 6, 'sku'),
  ('orders', 7, 'order_id'), ('orders', 7, 'transaction_id'), ('orders', 7, 'trans_id'),
  ('orders', 7, 'order_no'), ('orders', 7, 'invoice_id'), ('orders', 7, 'order')),
names AS (SELECT column_name AS name, row_number() OVER () AS i
          FROM (DESCRIBE SELECT * FROM sales)),
hits AS (SELECT name, i, kind, rank FROM names JOIN kinds
         ON name = term OR starts_with(name, term || '_') OR ends_with(name, '_' || term)
         QUALIFY row_number() OVER (PARTITION BY name ORDER BY rank) = 1)
SELECT kind, arg_max(name, i) AS "column", max(cells) AS cells
FROM hits, (SELECT count(*) AS cells FROM sales) GROUP BY kind""")
def kpi_match(spark, sf_dir):
    """The recognised columns and how many cells each holds."""
    df = sales(spark, sf_dir)
    found = kpi.kpi_match(df).select("kind", "column")
    cells = df.agg(*[F.count(c).alias(c) for c in df.columns]).unpivot([], df.columns, "column", "cells")
    return found.join(cells, "column").select("kind", "column", "cells")


def _types(df: DataFrame) -> dict[str, str]:
    return profile.types_of(profile.profile_columns(df))


@query("kpi_values", f"""
WITH {SALES_SQL}
SELECT name, "column", type, round(raw_value, 2) AS raw_value FROM (
  SELECT 'Total Records' AS name, 'N/A' AS "column", 'generic' AS type,
         count(*)::DOUBLE AS raw_value FROM sales
  UNION ALL SELECT 'Total Features', 'N/A', 'generic', 8
  UNION ALL SELECT 'Total revenue', 'revenue', 'business_sum', sum(revenue) FROM sales
  UNION ALL SELECT 'Average revenue', 'revenue', 'business_avg', avg(revenue) FROM sales
  UNION ALL SELECT 'Total cost', 'cost', 'business_sum', sum(cost) FROM sales
  UNION ALL SELECT 'Average cost', 'cost', 'business_avg', avg(cost) FROM sales
  UNION ALL SELECT 'Total Quantity (quantity)', 'quantity', 'business_qty', sum(quantity) FROM sales
  UNION ALL SELECT 'Total Customers', 'customer_id', 'business_count',
                   count(DISTINCT customer_id) FROM sales
  UNION ALL SELECT 'Total Products', 'product_id', 'business_count',
                   count(DISTINCT product_id) FROM sales
  UNION ALL SELECT 'Total Transactions', 'order_id', 'business_count',
                   count(DISTINCT order_id) FROM sales)""")
def kpi_values(spark, sf_dir):
    df = sales(spark, sf_dir)
    return rounded(kpi.kpis(df, _types(df)), 2, "raw_value").select(
        "name", "column", "type", "raw_value")


@query("kpi_fallback", """
SELECT 'Total Records' AS name, count(*)::DOUBLE AS raw_value FROM customer
UNION ALL SELECT 'Average c_acctbal', round(avg(c_acctbal), 4) FROM customer
UNION ALL SELECT 'Total Features', 5""")
def kpi_fallback(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    return rounded(kpi.kpis(df, _types(df)), 4, "raw_value").select("name", "raw_value")


@query("fallback_total", """
SELECT 's_suppkey' AS "column", sum(s_suppkey)::DOUBLE AS total FROM supplier
UNION ALL SELECT 'p_partkey', sum(p_partkey)::DOUBLE FROM part""")
def fallback_total(spark, sf_dir):
    frames = [kpi.fallback_total(read(spark, sf_dir, t)) for t in ("supplier", "part")]
    return reduce(DataFrame.unionByName, frames)


# Limits and signs of money texts.
MONEY_SQL = """CASE
  WHEN abs(amount) >= 1e9 THEN sign || '₹' || printf('%.2f', abs(amount) / 1e9) || 'B'
  WHEN abs(amount) >= 1e6 THEN sign || '₹' || printf('%.2f', abs(amount) / 1e6) || 'M'
  WHEN abs(amount) >= 1e3 THEN sign || '₹' || printf('%.2f', abs(amount) / 1e3) || 'K'
  ELSE sign || '₹' || format('{:,.2f}', amount) END"""


@query("money_format", f"""
WITH amounts AS (
  SELECT 'segment ' || c_mktsegment AS label, round(sum(c_acctbal), 1) AS amount
  FROM customer GROUP BY c_mktsegment
  UNION ALL SELECT 'status ' || o_orderstatus, round(sum(o_totalprice), 1)
  FROM orders GROUP BY o_orderstatus
  UNION ALL SELECT 'loss ' || l_returnflag, round(-avg(l_quantity), 1)
  FROM lineitem GROUP BY l_returnflag)
SELECT label, {MONEY_SQL} AS text
FROM (SELECT *, CASE WHEN amount < 0 THEN '-' ELSE '' END AS sign FROM amounts)""")
def money_format(spark, sf_dir):
    def sums(table: str, key: str, label: str, amount) -> DataFrame:
        return read(spark, sf_dir, table).groupBy(
            F.concat(F.lit(label), F.col(key)).alias("label")).agg(
            F.round(amount, 1).alias("amount"))

    amounts = reduce(DataFrame.unionByName, [
        sums("customer", "c_mktsegment", "segment ", F.sum("c_acctbal")),
        sums("orders", "o_orderstatus", "status ", F.sum("o_totalprice")),
        sums("lineitem", "l_returnflag", "loss ", -F.avg("l_quantity"))])
    return amounts.select("label", money(F.col("amount")).alias("text"))
