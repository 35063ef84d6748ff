"""Time series and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.common import day_text, query, read, rounded
from gridsight.operators import clean, describe, insights, profile, timeseries
from gridsight.plans import analyze


@query("time_grain", """
SELECT source, days, CASE WHEN days > 1095 THEN 'Yearly' WHEN days > 90 THEN 'Monthly'
       ELSE 'Daily' END AS grain
FROM (SELECT 'lineitem' AS source, datesub('day', min(l_shipdate), max(l_shipdate)) AS days
      FROM lineitem
      UNION ALL SELECT 'orders', datesub('day', min(o_orderdate), max(o_orderdate)) FROM orders
      UNION ALL SELECT 'events', datesub('day', min(ts), max(ts)) FROM events)""")
def time_grain(spark, sf_dir):
    spans = [
        timeseries.time_span(read(spark, sf_dir, t), c).select(
            F.lit(t).alias("source"), "days", "grain")
        for t, c in (("lineitem", "l_shipdate"), ("orders", "o_orderdate"), ("events", "ts"))]
    return spans[0].unionByName(spans[1]).unionByName(spans[2])


def _periods_sql(table: str, ts: str, unit: str, label: str, *metrics: str) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{m}' AS metric, date_trunc('{unit}', {ts}) AS period,
        strftime(date_trunc('{unit}', {ts}), '{label}') AS date, sum({m}) AS s, avg({m}) AS a,
        count({m}) AS n FROM {table} GROUP BY ALL HAVING count({m}) > 0""" for m in metrics)


YEARLY_SQL = _periods_sql("lineitem", "l_shipdate", "year", "%Y", "l_quantity", "l_extendedprice")
MONTHLY_SQL = _periods_sql("orders", "o_orderdate", "month", "%Y-%m", "o_totalprice")
DAILY_SQL = _periods_sql("events", "ts", "day", "%Y-%m-%d", "value")
SHOWN_SQL = """SELECT metric, date, round(s, 2) AS "sum", round(a, 4) AS mean, n AS "count" """


def _shown(periods):
    return rounded(rounded(periods, 2, "sum"), 4, "mean").select(
        "metric", "date", "sum", "mean", "count")


def _yearly(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    grain = timeseries.choose_grain(df, "l_shipdate")
    return timeseries.resample(df, "l_shipdate", ["l_quantity", "l_extendedprice"], grain)


def _monthly(spark, sf_dir):
    return timeseries.resample(read(spark, sf_dir, "orders"), "o_orderdate", ["o_totalprice"],
                               timeseries.MONTHLY)


def _daily(spark, sf_dir):
    df = read(spark, sf_dir, "events")
    return timeseries.resample(df, "ts", ["value"], timeseries.choose_grain(df, "ts"))


@query("resample_yearly", f"{SHOWN_SQL} FROM ({YEARLY_SQL})")
def resample_yearly(spark, sf_dir):
    return _shown(_yearly(spark, sf_dir))


@query("resample_monthly", f"{SHOWN_SQL} FROM ({MONTHLY_SQL})")
def resample_monthly(spark, sf_dir):
    return _shown(_monthly(spark, sf_dir))


@query("resample_daily", f"{SHOWN_SQL} FROM ({DAILY_SQL})")
def resample_daily(spark, sf_dir):
    return _shown(_daily(spark, sf_dir))


ALL_PERIODS = f"({YEARLY_SQL} UNION ALL {MONTHLY_SQL} UNION ALL {DAILY_SQL})"


def _all_periods(spark, sf_dir):
    return _yearly(spark, sf_dir).unionByName(_monthly(spark, sf_dir)).unionByName(
        _daily(spark, sf_dir))


@query("growth", f"""
SELECT metric, count(*) AS periods,
       round(CASE WHEN count(*) > 1 AND arg_min(s, period) <> 0
             THEN (arg_max(s, period) - arg_min(s, period)) / arg_min(s, period) * 100
             ELSE 0 END, 4) AS growth_pct
FROM {ALL_PERIODS} GROUP BY metric""")
def growth(spark, sf_dir):
    return rounded(timeseries.growth(_all_periods(spark, sf_dir)), 4, "growth_pct").select(
        "metric", "periods", "growth_pct")


@query("moving_average", f"""
SELECT metric, date, round(CASE WHEN count(*) OVER w >= least(3, count(*) OVER (PARTITION BY metric))
       THEN avg(s) OVER w END, 2) AS moving_average
FROM {ALL_PERIODS}
WINDOW w AS (PARTITION BY metric ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def moving_average(spark, sf_dir):
    found = timeseries.moving_average(_all_periods(spark, sf_dir))
    return rounded(found, 2, "moving_average").select("metric", "date", "moving_average")


@query("peak_low", f"""
SELECT metric, arg_min(date, (-s, period)) AS peak_date, round(max(s), 2) AS peak_value,
       arg_min(date, (s, period)) AS low_date, round(min(s), 2) AS low_value
FROM {ALL_PERIODS} GROUP BY metric""")
def peak_low(spark, sf_dir):
    found = timeseries.peak_and_low(_all_periods(spark, sf_dir))
    return rounded(found, 2, "peak_value", "low_value").drop("metric_position")


@query("parse_dates", """
SELECT o_orderkey, strftime(try_strptime(CASE WHEN o_orderstatus = 'P' THEN 'pending'
       ELSE strftime(o_orderdate, '%d/%m/%Y') END, '%d/%m/%Y'), '%Y-%m-%d') AS parsed
FROM orders""")
def parse_dates(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select("o_orderkey", F.when(
        F.col("o_orderstatus") == "P", "pending").otherwise(
        F.date_format("o_orderdate", "dd/MM/yyyy")).alias("order_day"))
    parsed = timeseries.parse_dates(df, "order_day", "parsed")
    return parsed.select("o_orderkey", day_text("parsed").alias("parsed"))


@query("parse_dates_iso", """
SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS parsed FROM lineitem""")
def parse_dates_iso(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", day_text("l_shipdate").alias("ship_day"))
    parsed = timeseries.parse_dates(df, "ship_day", "parsed")
    return parsed.select("l_orderkey", "l_linenumber", day_text("parsed").alias("parsed"))


# Findings on the events table: one number (value), two labels, daily trend.
@query("insights", f"""
WITH fences AS (
  SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25))
         AS low,
         quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25))
         AS high FROM events),
outl AS (SELECT count(*) FILTER (WHERE value < low OR value > high) AS n,
                count(*) FILTER (WHERE value < low OR value > high) * 100.0 / count(*) AS pct
         FROM events, fences),
stats AS (SELECT avg(value) AS mean, median(value) AS median,
                 avg((value - m) ^ 3) / sqrt(avg((value - m) ^ 2)) ^ 3 AS skew
          FROM (SELECT value, avg(value) OVER () AS m FROM events)),
labels_count AS (
  SELECT 0 AS p, 'event_type' AS c, event_type AS v, count(*) AS n FROM events GROUP BY event_type
  UNION ALL SELECT 1, 'props', props, count(*) FROM events GROUP BY props),
common AS (SELECT p, c, arg_min(v, (-n, v)) AS v, max(n) AS n, max(n) * 100.0 / sum(n) AS pct
           FROM labels_count GROUP BY p, c),
ranked AS (SELECT event_type AS g, avg(value) AS mean, row_number() OVER (
             ORDER BY avg(value) DESC, event_type) AS r FROM events GROUP BY event_type),
ends AS (SELECT arg_min(g, r) AS best, arg_max(g, r) AS worst, arg_min(mean, r) AS hi,
                arg_max(mean, r) AS lo FROM ranked WHERE r <= 10),
periods AS ({DAILY_SQL}),
trend AS (SELECT (arg_max(s, period) - arg_min(s, period)) / arg_min(s, period) * 100 AS g,
                 arg_min(date, (-s, period)) AS peak, max(s) AS peak_value,
                 arg_min(date, (s, period)) AS low, min(s) AS low_value FROM periods),
acts AS (SELECT CASE WHEN n > 0 THEN 1 ELSE 0 END AS n FROM outl)
SELECT category, position, rule_id, subject, round(v1, 4) AS v1, round(v2, 4) AS v2 FROM (
  SELECT 'data_quality' AS category, 0 AS position, 'no_missing' AS rule_id, NULL AS subject,
         0::DOUBLE AS v1, NULL::DOUBLE AS v2
  UNION ALL SELECT 'data_quality', 1, CASE WHEN n > 0 THEN 'outliers' ELSE 'no_outliers' END,
         CASE WHEN n > 0 THEN 'value' END, n, CASE WHEN n > 0 THEN pct END FROM outl
  UNION ALL SELECT 'data_quality', 2, 'cleaning_actions', NULL, n, NULL FROM acts WHERE n > 0
  UNION ALL SELECT 'descriptive', 0, CASE WHEN skew > 1 THEN 'average_right-skewed'
         WHEN skew < -1 THEN 'average_left-skewed' ELSE 'average_symmetric' END, 'value',
         mean, median FROM stats
  UNION ALL SELECT 'descriptive', p + 1, 'most_common', c || '=' || v, n, pct FROM common
  UNION ALL SELECT 'relationship', 0, 'no_correlation', NULL, NULL, NULL
  UNION ALL SELECT 'relationship', 1, 'group_range', best || '>' || worst, hi, lo FROM ends
  UNION ALL SELECT 'trend', 0, CASE WHEN g >= 0 THEN 'increased' ELSE 'decreased' END, 'value',
         abs(g), NULL FROM trend
  UNION ALL SELECT 'trend', 1, 'peak_low', 'value:' || peak || '/' || low, peak_value, low_value
         FROM trend
  UNION ALL SELECT 'business', 0, CASE WHEN g < 0 THEN 'investigate_decline' ELSE 'use_growth' END,
         'value', abs(g), NULL FROM trend
  UNION ALL SELECT 'business', 1, 'best_segment', best, hi, NULL FROM ends
  UNION ALL SELECT 'business', 2, 'worst_segment', worst, lo, NULL FROM ends
  UNION ALL SELECT 'business', 3, 'monitor_outliers', 'value', n, NULL FROM outl WHERE n > 0)""")
def event_insights(spark, sf_dir):
    """Types are fixed here: the distinct-value thresholds move them between scales."""
    df = read(spark, sf_dir, "events")
    found = profile.profile_columns(df)
    types = {"event_type": "categorical", "value": "numeric", "props": "categorical",
             "ts": "datetime"}
    retyped = found.withColumn("inferred_type", F.coalesce(*[
        F.when(F.col("column") == c, t) for c, t in types.items()], "inferred_type"))
    done = clean.clean(df, retyped, drop_copies=False, keep=lambda frame: frame)
    statistics = analyze.gather(
        types, retyped, done.outliers, done.log, describe.numeric_describe(df, ["value"]),
        describe.category_extremes(df, ["event_type", "props"]),
        describe.strong_pairs(describe.pair_correlations(df, ["value"])),
        describe.group_stats(df, ["event_type"], ["value"]), analyze.trend_tables(df, types))
    rows = insights.insights(spark, statistics)
    return rounded(rows, 4, "v1", "v2").drop("text")


def _skew_sql(table: str, c: str) -> str:
    return f"""
SELECT '{c}' AS "column", avg((x - m) ^ 3) / sqrt(avg((x - m) ^ 2)) ^ 3 AS skewness,
       min(x) AS "min", max(x) AS "max", stddev_samp(x) AS std
FROM (SELECT {c}::DOUBLE AS x, avg({c}) OVER () AS m FROM {table})"""


@query("skew_alert", f"""
SELECT "column", round(skewness, 6) AS skewness, "min", "max", round(std, 4) AS std
FROM ({_skew_sql("events", "value")} UNION ALL {_skew_sql("documents", "n_chars")}
      UNION ALL {_skew_sql("orders", "o_totalprice")})
WHERE abs(skewness) > 1.5""")
def skew_alert(spark, sf_dir):
    frames = [describe.moments(read(spark, sf_dir, t), [c]) for t, c in (
        ("events", "value"), ("documents", "n_chars"), ("orders", "o_totalprice"))]
    described = frames[0].unionByName(frames[1]).unionByName(frames[2])
    return rounded(rounded(insights.skew_alerts(described), 6, "skewness"), 4, "std")
