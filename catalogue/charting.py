"""Data behind the charts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from catalogue.common import query, read, rounded, sales, union_all_sql
from catalogue.describing import PRICED, PRICED_SQL, _group_sql, _priced, _r
from catalogue.profiling import LINEITEM_FACTS, TABLES, TYPE_RULES, _column_facts
from catalogue.trends import DAILY_SQL, YEARLY_SQL, _daily, _yearly
from gridsight.operators import charts, describe, kpi, profile

# Names of columns not worth a chart.
HIDDEN = ("id|key|code|uuid|index|idx|serial|number|no|num|phone|mobile|zip|zipcode|postal|fax|"
          "url|link|hash|account|seq|sequence|date|time|year|month|day")
PART_FACTS = union_all_sql([_column_facts("part", c, d) for c, d in TABLES["part"].items()])


@query("meaningful_columns", f"""
SELECT name AS "column", kind AS inferred_type FROM (
  SELECT name, u, {TYPE_RULES} AS kind
  FROM ({LINEITEM_FACTS} UNION ALL {PART_FACTS}))
WHERE kind NOT IN ('id', 'text', 'empty', 'datetime') AND u > 1
  AND NOT regexp_matches(name, '^({HIDDEN})([_ ]|$)|[_ ]({HIDDEN})$')""")
def meaningful_columns(spark, sf_dir):
    frames = [charts.meaningful_columns(profile.profile_columns(read(spark, sf_dir, t))).select(
        "column", "inferred_type") for t in ("lineitem", "part")]
    return frames[0].unionByName(frames[1])


@query("business_columns", """
SELECT * FROM (VALUES ('quantity'), ('revenue'), ('cost')) t("column")
WHERE (SELECT count(DISTINCT l_quantity) FROM lineitem) > 10""")
def business_columns(spark, sf_dir):
    df = sales(spark, sf_dir)
    found = profile.profile_columns(df)
    return charts.business_columns(found, kpi.kpis(df, profile.types_of(found))).select("column")


def _bins_sql(table: str, c: str) -> str:
    return f"""
SELECT '{c}' AS "column", g.bin::INT AS bin, round(lo + w * (g.bin - 1), 6) AS low,
       round(lo + w * g.bin, 6) AS high, coalesce(n, 0) AS "count"
FROM (SELECT unnest(range(1, 21)) AS bin) g
CROSS JOIN (SELECT min({c}) AS lo, (max({c}) - min({c})) / 20 AS w FROM {table}) r
LEFT JOIN (SELECT least(floor(({c} - lo) / ((hi - lo) / 20)) + 1, 20)::INT AS bin, count(*) AS n
           FROM {table}, (SELECT min({c}) AS lo, max({c}) AS hi FROM {table}) GROUP BY 1) b
ON g.bin = b.bin"""


BINNED = {"events": "value", "lineitem": "l_extendedprice", "customer": "c_acctbal",
          "orders": "o_totalprice"}


@query("histogram", union_all_sql([_bins_sql(t, c) for t, c in BINNED.items()]))
def histogram(spark, sf_dir):
    frames = [charts.histogram(read(spark, sf_dir, t), [c]) for t, c in BINNED.items()]
    return rounded(reduce(DataFrame.unionByName, frames), 6, "low", "high")


def _box_sql(table: str, c: str) -> str:
    return f"""
SELECT '{c}' AS "column", round(min(q1), 6) AS q1, round(min(q2), 6) AS median,
       round(min(q3), 6) AS q3,
       min({c}) FILTER (WHERE {c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))::DOUBLE
         AS whisker_low,
       max({c}) FILTER (WHERE {c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))::DOUBLE
         AS whisker_high,
       count(*) FILTER (WHERE {c} NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))
         AS outliers
FROM {table}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2,
                      quantile_cont({c}, 0.75) AS q3 FROM {table})"""


BOXED = {"events": "value", "documents": "n_chars", "lineitem": "l_extendedprice"}


@query("box_summary", union_all_sql([_box_sql(t, c) for t, c in BOXED.items()]))
def box_summary(spark, sf_dir):
    frames = [charts.box_summary(read(spark, sf_dir, t), [c]) for t, c in BOXED.items()]
    return rounded(reduce(DataFrame.unionByName, frames), 6, "q1", "median", "q3")


@query("topn_counts", union_all_sql([f"""
SELECT * FROM (SELECT '{c}' AS "column", row_number() OVER (ORDER BY count(*) DESC, {c})::INT AS rank,
       {c} AS value, count(*) AS "count" FROM part GROUP BY {c}) WHERE rank <= 8"""
    for c in ("p_name", "p_brand", "p_type")]))
def topn_counts(spark, sf_dir):
    return charts.topn_counts(read(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"],
                              charts.TOP_STATIC)


SHOWN = [c for c in PRICED if c != "discount"]


@query("heatmap_long", f"WITH {PRICED_SQL}" + union_all_sql([
    f"SELECT '{a}' AS col1, '{b}' AS col2, round(({_r(a, b)})::DOUBLE, 2) + 0.0 AS r "
    f"FROM priced" for a in SHOWN for b in SHOWN]))
def heatmap_long(spark, sf_dir):
    return charts.heatmap_long(_priced(spark, sf_dir), PRICED, SHOWN)


@query("trend_points", f"""
SELECT metric, date, round(s, 2) AS "sum" FROM ({YEARLY_SQL} UNION ALL {DAILY_SQL})
WHERE metric <> 'l_quantity'""")
def trend_points(spark, sf_dir):
    periods = _yearly(spark, sf_dir).unionByName(_daily(spark, sf_dir))
    return rounded(charts.trend_points(periods, ["l_extendedprice", "value"]), 2, "sum")


@query("group_bars", union_all_sql([
    f"SELECT cat_column, num_column, rank, category, mean FROM "
    f"({_group_sql('lineitem', c, 'l_extendedprice')})" for c in ("l_returnflag", "l_tax")]))
def group_bars(spark, sf_dir):
    groups = describe.group_stats(
        read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_tax"],
        ["l_quantity", "l_extendedprice"])
    shown = ["l_returnflag", "l_tax", "l_extendedprice"]
    return rounded(charts.group_bars(groups, shown), 4, "mean")
