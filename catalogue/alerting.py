"""Threshold alerts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalogue.common import DIRTY_SQL, dirty_orders, query, read, rounded, union_all_sql
from catalogue.cleaning import _fences
from gridsight.operators import alerts
from gridsight.session import shared_folder


@query("alert_metrics", f"""
WITH {DIRTY_SQL}, priced AS (SELECT * FROM dirty_orders WHERE o_totalprice IS NOT NULL),
m AS (SELECT avg(o_totalprice) AS mean, sum(o_totalprice) AS s, min(o_totalprice) AS lo,
             max(o_totalprice) AS hi, count(*) - count(o_totalprice) AS gaps FROM dirty_orders)
SELECT column_name, metric, round(actual, 4) AS actual FROM (
  SELECT 'o_totalprice' AS column_name, 'mean' AS metric, mean AS actual FROM m
  UNION ALL SELECT 'o_totalprice', 'sum', round(s, 2) FROM m
  UNION ALL SELECT 'o_totalprice', 'min', lo FROM m
  UNION ALL SELECT 'o_totalprice', 'max', hi FROM m
  UNION ALL SELECT 'o_totalprice', 'null_count', gaps FROM m
  UNION ALL SELECT 'o_totalprice', 'outliers', count(*) FROM priced,
    {_fences("priced", "o_totalprice")} WHERE o_totalprice < low OR o_totalprice > high
  UNION ALL SELECT 'o_orderpriority', 'null_count', count(*) - count(o_orderpriority)
    FROM dirty_orders
  UNION ALL SELECT 'o_orderpriority', 'outliers', 0)""")
def alert_metrics(spark, sf_dir):
    found = alerts.column_metrics(dirty_orders(spark, sf_dir), ["o_totalprice", "o_orderpriority"])
    return found.withColumn("actual", F.when(
        F.col("metric") == "sum", F.round("actual", 2)).otherwise(F.round("actual", 4)))


# Thresholds are set beside the measured figures: the limit of each rule is a statistic of
# another column, so that the outcome follows the data.
RULES = [
    (1, "mean", "value", ">", 10.0, "warning"),
    (2, "sum", "value", "<", 10.0, "critical"),
    (3, "min", "value", "<", 1.0, "info"),
    (4, "max", "value", ">", 200.0, "critical"),
    (5, "null_count", "props", "=", 0.0, "info"),
    (6, "outliers", "value", ">", 5.0, "warning"),
    (7, "outliers", "event_type", "=", 0.0, "info"),
    (8, "mean", "no_such_column", ">", 0.0, "warning"),
    (9, "no_such_metric", "value", ">", 0.0, "warning"),
    (10, "max", "user_id", ">", 3.0, "warning"),
]
RULES_SQL = "(VALUES " + ", ".join(
    f"({i}::BIGINT, '{m}', '{c}', '{o}', {v}::DOUBLE, '{s}')" for i, m, c, o, v, s in RULES
) + ") r(id, metric, column_name, operator, value, severity)"


def _numeric_metrics(column: str) -> list[str]:
    return [f"SELECT '{column}' AS column_name, '{name}' AS metric, ({agg}({column}) + 0.0)::DOUBLE AS "
            f"actual FROM events" for name, agg in (
                ("mean", "avg"), ("sum", "sum"), ("min", "min"), ("max", "max"))]


METRICS_SQL = union_all_sql([
    *_numeric_metrics("value"), *_numeric_metrics("user_id"),
    *[f"SELECT '{c}', 'null_count', (count(*) - count({c}))::DOUBLE FROM events"
      for c in ("value", "user_id", "props", "event_type")],
    f"SELECT 'value', 'outliers', (count(*) FILTER (WHERE value < low OR value > high))::DOUBLE "
    f"FROM events, {_fences('events', 'value')}",
    "SELECT 'event_type', 'outliers', 0::DOUBLE", "SELECT 'props', 'outliers', 0::DOUBLE"])


@query("alerts", f"""
SELECT id, upper(severity) || ': ' || upper(substr(replace(metric, '_', ' '), 1, 1))
         || substr(replace(metric, '_', ' '), 2) || ' of ''' || column_name || ''' is '
         || CASE WHEN metric IN ('null_count', 'outliers') THEN CAST(actual::BIGINT AS VARCHAR)
            ELSE format('{{:,.2f}}', actual) END
         || ', breaching threshold of ' || operator || ' ' || format('{{:,.2f}}', value) AS message,
       severity, column_name AS "column", metric, round(actual, 4) AS actual,
       value AS "limit", operator
FROM {RULES_SQL} JOIN ({METRICS_SQL}) USING (column_name, metric)
WHERE CASE operator WHEN '<' THEN actual < value WHEN '>' THEN actual > value
      ELSE abs(actual - value) < 1e-5 END""")
def breached(spark, sf_dir):
    rules = spark.createDataFrame(
        RULES, "id bigint, metric string, column_name string, operator string, value double, "
               "severity string")
    return rounded(alerts.evaluate(read(spark, sf_dir, "events"), rules), 4, "actual")


@query("alert_rules", """
WITH c AS (SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderstatus) AS id, avg(o_totalprice) AS mean
           FROM orders GROUP BY o_orderstatus)
SELECT 'ana' AS owner, id, 'mean' AS metric, 'o_totalprice' AS column_name, '>' AS operator,
       round(mean / 2, 2) AS value, 'critical' AS severity FROM c WHERE id <> 1
UNION ALL SELECT 'ben', id, 'max', 'o_totalprice', '<', round(mean, 2), 'warning' FROM c WHERE id = 1""")
def alert_rules(spark, sf_dir):
    """Rules with limits from the data: added, replaced, one deleted, one of another owner."""
    path = f"{shared_folder(spark)}/rules-{uuid.uuid4().hex}"
    means = read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(
        F.avg("o_totalprice").alias("mean")).orderBy("o_orderstatus").collect()
    for i, r in enumerate(means, 1):
        alerts.add_rule(spark, path, "ana", i, "o_totalprice", "<", round(r["mean"], 2))
        alerts.add_rule(spark, path, "ana", i, "o_totalprice", ">", round(r["mean"] / 2, 2),
                        severity="critical")
    alerts.delete_rule(spark, path, "ana", 1)
    alerts.add_rule(spark, path, "ben", 1, "o_totalprice", "<", round(means[0]["mean"], 2), "max")
    return alerts.list_rules(spark, path)
