"""Trends over the first date column: grain, period sums, growth, peaks."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsight.functions import dates
from gridsight.functions import values as V

# Spans in whole days above which a coarser grain is used.
YEARLY_OVER_DAYS = 3 * 365
MONTHLY_OVER_DAYS = 90
MOVING_WINDOW = 3
TREND_COLUMNS = 2


class Grain(NamedTuple):
    name: str
    unit: str
    label: str


YEARLY = Grain("Yearly", "year", "yyyy")
MONTHLY = Grain("Monthly", "month", "yyyy-MM")
DAILY = Grain("Daily", "day", "yyyy-MM-dd")
GRAINS = (YEARLY, MONTHLY, DAILY)


def parse_dates(df: DataFrame, column: str, output: str, fmt: str | None = None) -> DataFrame:
    """Add the date column as a timestamp; cells outside the column's layout are null."""
    return df.withColumn(output, dates.as_timestamp(df, column, fmt))


def time_span(df: DataFrame, column: str, fmt: str | None = None) -> DataFrame:
    """(first, last, days, grain) of a date column; days are whole 24-hour days."""
    ts = dates.as_timestamp(df, column, fmt)
    span = df.agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    days = F.extract(F.lit("DAY"), F.col("last") - F.col("first")).cast("bigint")
    return span.withColumn("days", days).withColumn(
        "grain", F.when(F.col("days") > YEARLY_OVER_DAYS, YEARLY.name)
        .when(F.col("days") > MONTHLY_OVER_DAYS, MONTHLY.name)
        .when(F.col("days").isNotNull(), DAILY.name))


def choose_grain(df: DataFrame, column: str, fmt: str | None = None) -> Grain | None:
    """The grain for a column's span; None without any date."""
    name = time_span(df, column, fmt).first()["grain"]
    return next((g for g in GRAINS if g.name == name), None)


def resample(df: DataFrame, date_column: str, metrics: Sequence[str], grain: Grain,
             fmt: str | None = None) -> DataFrame:
    """(metric_position, metric, period, date, sum, mean, count) per period with values.

    One grouping for all metrics; the result has one row per metric and period.
    """
    ts = dates.as_timestamp(df, date_column, fmt)
    period = F.date_trunc(grain.unit, ts).cast("timestamp_ntz").alias("period")
    cells = {m: V.as_number(df, m) for m in metrics}
    by_period = df.where(ts.isNotNull()).groupBy(period).agg(*[
        F.struct(F.lit(i).alias("metric_position"), F.lit(m).alias("metric"),
                 F.sum(x).alias("sum"), F.avg(x).alias("mean"), F.count(x).alias("count"))
        .alias(f"m{i}")
        for i, (m, x) in enumerate(cells.items())])
    flat = by_period.select("period", F.explode(F.array(
        *[F.col(f"m{i}") for i in range(len(cells))])).alias("m"))
    return flat.where(F.col("m.count") > 0).select(
        "m.metric_position", "m.metric", "period",
        F.date_format("period", grain.label).alias("date"), "m.sum", "m.mean", "m.count")


def growth(periods: DataFrame) -> DataFrame:
    """(metric, periods, growth_pct) from the first to the last period sum."""
    ends = periods.groupBy("metric_position", "metric").agg(
        F.count("*").alias("periods"),
        F.min_by("sum", "period").alias("first_sum"), F.max_by("sum", "period").alias("last_sum"))
    change = (F.col("last_sum") - F.col("first_sum")) / F.nullif(F.col("first_sum"), F.lit(0.0))
    return ends.withColumn("growth_pct", F.when(
        (F.col("periods") > 1) & (F.col("first_sum") != 0), change * 100).otherwise(0.0))


def moving_average(periods: DataFrame, width: int = MOVING_WINDOW) -> DataFrame:
    """Mean of the last `width` period sums; null until the window is full.

    Runs on the period table, which has at most one row per year, month or day
    of a span under 91 days.
    """
    by_metric = Window.partitionBy("metric")
    size = F.least(F.lit(width), F.count("*").over(by_metric))
    number = F.row_number().over(by_metric.orderBy("period"))
    recent = by_metric.orderBy("period").rowsBetween(1 - width, 0)
    return periods.withColumn("moving_average", F.when(
        number >= size, F.avg("sum").over(recent)))


def peak_and_low(periods: DataFrame) -> DataFrame:
    """(metric, peak_date, peak_value, low_date, low_value); the earliest period on ties."""
    high = F.min(F.struct((-F.col("sum")).alias("v"), "period", "date"))
    low = F.min(F.struct(F.col("sum").alias("v"), "period", "date"))
    ends = periods.groupBy("metric_position", "metric").agg(high.alias("hi"), low.alias("lo"))
    return ends.select(
        "metric_position", "metric", F.col("hi.date").alias("peak_date"),
        (-F.col("hi.v")).alias("peak_value"), F.col("lo.date").alias("low_date"),
        F.col("lo.v").alias("low_value"))
