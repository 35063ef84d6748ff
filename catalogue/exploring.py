"""Search, pages, samples, pivots, facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.common import DIRTY_SQL, day_text, dirty_orders, query, read, rounded, union_all_sql
from gridsight.operators import charts, explore, profile


@query("search_rows", """
SELECT c_custkey, c_mktsegment FROM customer
WHERE regexp_matches(c_name || chr(10) || CAST(c_custkey AS VARCHAR) || chr(10)
      || CAST(c_nationkey AS VARCHAR) || chr(10) || CAST(c_acctbal AS VARCHAR) || chr(10)
      || c_mktsegment, 'build|mach.*ry', 'i')""")
def search_rows(spark, sf_dir):
    found = explore.search_rows(read(spark, sf_dir, "customer"), "build|mach.*ry")
    return found.select("c_custkey", "c_mktsegment")


@query("search_plain", """
SELECT doc_id, lang, source FROM documents
WHERE contains(lower(text), 'the') OR contains(CAST(doc_id AS VARCHAR), 'the')
   OR contains(lower(lang), 'the') OR contains(lower(source), 'the')""")
def search_plain(spark, sf_dir):
    found = explore.search_rows(read(spark, sf_dir, "documents"), "The", regex=False)
    return found.select("doc_id", "lang", "source")


@query("page_rows", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 175""")
def page_rows(spark, sf_dir):
    found = explore.page_rows(read(spark, sf_dir, "orders"), "o_orderkey", page=7, size=25)
    return found.select("o_orderkey", "o_totalprice")


@query("page_rows_deep", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey
LIMIT 25 OFFSET (SELECT 25 * (count(*) // 50) FROM orders)""")
def page_rows_deep(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    found = explore.page_rows(orders, "o_orderkey", page=orders.count() // 50, size=25)
    return found.select("o_orderkey", "o_totalprice")


@query("page_after", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 120 ORDER BY o_orderkey LIMIT 25""")
def page_after(spark, sf_dir):
    found = explore.page_after(read(spark, sf_dir, "orders"), "o_orderkey", 120, 25)
    return found.select("o_orderkey", "o_totalprice")


@query("column_sample", """
SELECT o_orderkey AS row_key, o_totalprice AS value FROM orders
ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 2000""")
def column_sample(spark, sf_dir):
    return explore.column_sample(read(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey")


@query("sample_top_values", """
SELECT value, count(*) AS "count" FROM (
  SELECT props AS value FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 2000)
GROUP BY value ORDER BY 2 DESC, 1 LIMIT 10""")
def sample_top_values(spark, sf_dir):
    sample = explore.column_sample(read(spark, sf_dir, "events"), "props", "event_id")
    return explore.sample_top_values(sample)


def _pivot_sql(aggregate: str, digits: int = 2) -> str:
    cells = ", ".join(
        f"coalesce(round(({aggregate.format(x=x)})::DOUBLE, {digits}), 0) AS \"{s}\"" for s, x in (
            (s, f"CASE WHEN o_orderstatus = '{s}' THEN o_totalprice END") for s in "FOP"))
    return (f"SELECT o_orderpriority, {cells} FROM orders GROUP BY o_orderpriority")


def _pivot(spark, sf_dir, how: str, digits: int = 2):
    found = explore.pivot(read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus",
                          "o_totalprice", how)
    labels = found.columns[1:]
    return rounded(found.withColumns({c: F.col(c).cast("double") for c in labels}), digits,
                   *labels)


@query("pivot_sum", _pivot_sql("sum({x})"))
def pivot_sum(spark, sf_dir):
    return _pivot(spark, sf_dir, "sum")


@query("pivot_cells", """
SELECT o_orderpriority AS "row", o_orderkey AS "column", sum(o_totalprice) AS cell
FROM orders GROUP BY o_orderpriority, o_orderkey""")
def pivot_cells(spark, sf_dir):
    """One column for each order: more than a wide pivot holds."""
    return explore.pivot_cells(read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", "o_totalprice")


@query("pivot_mean", _pivot_sql("avg({x})", 4))
def pivot_mean(spark, sf_dir):
    return _pivot(spark, sf_dir, "mean", 4)


@query("pivot_median", _pivot_sql("median({x})", 6))
def pivot_median(spark, sf_dir):
    return _pivot(spark, sf_dir, "median", 6)


@query("pivot_min", _pivot_sql("min({x})"))
def pivot_min(spark, sf_dir):
    return _pivot(spark, sf_dir, "min")


@query("pivot_max", _pivot_sql("max({x})"))
def pivot_max(spark, sf_dir):
    return _pivot(spark, sf_dir, "max")


@query("pivot_count", _pivot_sql("count({x})"))
def pivot_count(spark, sf_dir):
    return _pivot(spark, sf_dir, "count")


@query("pivot_std", _pivot_sql("stddev_samp({x})", 4))
def pivot_std(spark, sf_dir):
    return _pivot(spark, sf_dir, "std", 4)


@query("pivot_var", _pivot_sql("var_samp({x})", 0))
def pivot_var(spark, sf_dir):
    return _pivot(spark, sf_dir, "var", 0)


@query("pivot_nunique", _pivot_sql("count(DISTINCT {x})"))
def pivot_nunique(spark, sf_dir):
    return _pivot(spark, sf_dir, "nunique")


@query("group_agg", f"""
WITH {DIRTY_SQL}
SELECT o_orderpriority, round(coalesce(sum(o_totalprice), 0), 2) AS o_totalprice
FROM dirty_orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""")
def group_agg(spark, sf_dir):
    found = explore.group_agg(dirty_orders(spark, sf_dir), "o_orderpriority", "o_totalprice")
    return rounded(found, 2, "o_totalprice")


@query("group_median", """
SELECT l_partkey, round(median(l_extendedprice), 6) AS l_extendedprice FROM lineitem
GROUP BY l_partkey""")
def group_median(spark, sf_dir):
    found = explore.group_agg(read(spark, sf_dir, "lineitem"), "l_partkey", "l_extendedprice",
                              "median")
    return rounded(found, 6, "l_extendedprice")


@query("facet_values", union_all_sql([
    f"""SELECT * FROM (SELECT '{c}' AS "column", {c} AS value, count(*) AS "count" FROM lineitem
    GROUP BY {c}) WHERE (SELECT count(DISTINCT {c}) FROM lineitem) BETWEEN 1 AND 15"""
    for c in ("l_returnflag", "l_linestatus")]) + """
UNION ALL SELECT * FROM (SELECT 'l_tax' AS "column", CAST(l_tax AS VARCHAR) AS value,
  count(*) AS "count" FROM lineitem GROUP BY l_tax)
WHERE (SELECT count(DISTINCT l_tax) FROM lineitem) BETWEEN 1 AND 10""")
def facet_values(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    return explore.facet_values(df, profile.profile_columns(df).collect())


FACET = {"l_returnflag": "R", "l_linestatus": "F", "l_tax": "0.02"}
FACET_SQL = "l_returnflag = 'R' AND l_linestatus = 'F' AND l_tax = 0.02"


@query("facet_filter", f"""
SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM lineitem WHERE {FACET_SQL}""")
def facet_filter(spark, sf_dir):
    rows = explore.facet_filter(read(spark, sf_dir, "lineitem"), FACET)
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")


FIGURES = [("l_extendedprice", "business_sum"), ("l_discount", "business_avg"),
           ("l_quantity", "business_qty"), ("l_partkey", "business_count")]


@query("facet_kpis", f"""
WITH f AS (SELECT * FROM lineitem WHERE {FACET_SQL})
SELECT 'N/A' AS "column", 'generic' AS type, count(*)::DOUBLE AS value FROM f
UNION ALL SELECT 'l_extendedprice', 'business_sum', round(sum(l_extendedprice), 2) FROM f
UNION ALL SELECT 'l_discount', 'business_avg', round(avg(l_discount), 2) FROM f
UNION ALL SELECT 'l_quantity', 'business_qty', sum(l_quantity) FROM f
UNION ALL SELECT 'l_partkey', 'business_count', count(DISTINCT l_partkey) FROM f""")
def facet_kpis(spark, sf_dir):
    return rounded(explore.facet_kpis(read(spark, sf_dir, "lineitem"), FACET, FIGURES), 2, "value")


@query("facet_counts", """
SELECT CAST(l_linenumber AS VARCHAR) AS value, count(*) AS "count" FROM lineitem
WHERE l_returnflag = 'R' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def facet_counts(spark, sf_dir):
    return explore.facet_counts(read(spark, sf_dir, "lineitem"), {"l_returnflag": "R"},
                                "l_linenumber")


@query("facet_daily", """
SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, round(sum(l_extendedprice), 2) AS "sum"
FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""")
def facet_daily(spark, sf_dir):
    found = explore.facet_daily(read(spark, sf_dir, "lineitem"), {"l_returnflag": "R"},
                                "l_shipdate", "l_extendedprice")
    return rounded(found.withColumn("day", day_text("day")), 2, "sum")


@query("facet_means", """
SELECT CAST(l_linenumber AS VARCHAR) AS category, round(avg(l_extendedprice), 4) AS mean
FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""")
def facet_means(spark, sf_dir):
    found = explore.facet_means(read(spark, sf_dir, "lineitem"), {"l_returnflag": "R"},
                                "l_linenumber", "l_extendedprice")
    return rounded(found, 4, "mean")


@query("facet_histogram", """
WITH f AS (SELECT value AS x FROM events WHERE event_type = 'click'),
r AS (SELECT min(x) AS lo, (max(x) - min(x)) / 20 AS w FROM f),
b AS (SELECT least(floor((x - lo) / w) + 1, 20)::INT AS bin, count(*) AS n FROM f, r GROUP BY 1)
SELECT g.bin::INT AS bin, coalesce(n, 0) AS "count"
FROM (SELECT unnest(range(1, 21)) AS bin) g LEFT JOIN b ON g.bin = b.bin""")
def facet_histogram(spark, sf_dir):
    rows = explore.facet_filter(read(spark, sf_dir, "events"), {"event_type": "click"})
    return charts.histogram(rows, ["value"]).select("bin", "count")
