"""Threshold rules on column metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsight.functions import frequency
from gridsight.functions import values as V
from gridsight.operators import clean

RULE_SCHEMA = ("owner string, id bigint, metric string, column_name string, operator string, "
               "value double, severity string")
METRICS = ("mean", "sum", "min", "max", "null_count", "outliers")
OPERATORS = ("<", ">", "=")
EQUAL_WITHIN = 1e-5


# --- rules ----------------------------------------------------------------------------------
# The store is an append-only Parquet table: a deletion is one more row, so nothing is
# rewritten and a failed write leaves the old state.

_STORE_SCHEMA = f"{RULE_SCHEMA}, deleted boolean, written_at timestamp"


def _append(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, f"{RULE_SCHEMA}, deleted boolean").withColumn(
        "written_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def add_rule(spark: SparkSession, path: str, owner: str, rule_id: int, column_name: str,
             operator: str, value: float, metric: str = "mean",
             severity: str = "warning") -> None:
    """Store one rule; a reused id replaces the owner's older rule."""
    if not column_name or not operator:
        raise ValueError("a rule needs a column and a comparison")
    _append(spark, path, [(owner, int(rule_id), metric, column_name, operator, float(value),
                           severity, False)])


def delete_rule(spark: SparkSession, path: str, owner: str, rule_id: int) -> None:
    _append(spark, path, [(owner, int(rule_id), None, None, None, None, None, True)])


def list_rules(spark: SparkSession, path: str, owner: str | None = None) -> DataFrame:
    """Current rules, of one owner if given."""
    log = spark.read.schema(_STORE_SCHEMA).parquet(path)
    if owner is not None:
        log = log.where(F.col("owner") == owner)
    # Of writes in the same instant a deletion counts as the last.
    newest = Window.partitionBy("owner", "id").orderBy(
        F.col("written_at").desc(), F.col("deleted").desc())
    current = log.withColumn("n", F.row_number().over(newest)).where(
        (F.col("n") == 1) & ~F.col("deleted"))
    return current.drop("n", "deleted", "written_at")


# --- evaluation -----------------------------------------------------------------------------

def column_metrics(df: DataFrame, columns: list[str], with_outliers: bool = True) -> DataFrame:
    """(column_name, metric, actual) of the given columns; one aggregate for all.

    Truth values count as 0 and 1. Columns without numbers have `null_count` and
    `outliers` (0) only.
    """
    columns = [c for c in columns if c in df.columns]
    spark = df.sparkSession
    empty = spark.createDataFrame([], "column_name string, metric string, actual double")
    if not columns:
        return empty
    aggs, cells = [], []
    numeric = [c for c in columns if V.is_numeric(V.dtype_of(df, c))]
    truths = [c for c in columns if V.family(V.dtype_of(df, c)) == "boolean"]
    for i, c in enumerate(columns):
        x = V.as_number(df, c)
        metrics = {"null_count": F.count_if(V.present(df, c).isNull()).cast("double")}
        if c in numeric or c in truths:
            metrics |= {"mean": F.avg(x), "sum": F.coalesce(F.sum(x), F.lit(0.0)),
                        "min": F.min(x), "max": F.max(x)}
        for name, agg in metrics.items():
            aggs.append(agg.alias(f"{name}{i}"))
            cells.append(F.struct(F.lit(c).alias("column_name"), F.lit(name).alias("metric"),
                                  F.col(f"{name}{i}").alias("actual")))
    table = df.agg(*aggs).select(F.explode(F.array(*cells)).alias("m")).select("m.*")
    if not with_outliers:
        return table
    found = {s[0]: float(s[1]) for s in clean.outlier_stats(df, numeric)}
    outliers = spark.createDataFrame(
        [(c, "outliers", found.get(c, 0.0)) for c in columns],
        "column_name string, metric string, actual double")
    return frequency.union_all([table, outliers])


def evaluate(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Breached rules with the measured value and a message.

    Rules on unknown columns or metrics are skipped. Only the distinct column
    and metric names of the rules are read to decide what to measure.
    """
    wanted = rules.where(F.col("column_name").isin(df.columns)).select(
        "column_name", "metric").distinct().collect()
    columns = sorted({r["column_name"] for r in wanted}, key=df.columns.index)
    metrics = column_metrics(df, columns, any(r["metric"] == "outliers" for r in wanted))
    # At most six rows per column of the table.
    joined = rules.join(F.broadcast(metrics), ["column_name", "metric"])
    actual, limit = F.col("actual"), F.col("value")
    breached = (
        F.when(F.col("operator") == "<", actual < limit)
        .when(F.col("operator") == ">", actual > limit)
        .when(F.col("operator") == "=", F.abs(actual - limit) < EQUAL_WITHIN)
        .otherwise(F.lit(False))
    )
    words = F.regexp_replace("metric", "_", " ")
    label = F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substring(words, 2, 1000)))
    whole = F.col("metric").isin("null_count", "outliers")
    shown = F.when(whole, actual.cast("bigint").cast("string")).otherwise(
        F.format_string("%,.2f", actual))
    message = F.concat(
        F.upper("severity"), F.lit(": "), label, F.lit(" of '"), F.col("column_name"),
        F.lit("' is "), shown, F.lit(", breaching threshold of "), F.col("operator"), F.lit(" "),
        F.format_string("%,.2f", limit))
    return joined.where(F.coalesce(breached, F.lit(False))).select(
        "id", message.alias("message"), "severity", F.col("column_name").alias("column"),
        "metric", "actual", limit.alias("limit"), "operator")
