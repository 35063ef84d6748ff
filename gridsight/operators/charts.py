"""Data behind the charts: which columns, bins, boxes, bars."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsight.functions import quantiles
from gridsight.functions import values as V
from gridsight.operators import describe

# Names that mark keys, sequences and other columns not worth a chart.
HIDDEN_TERMS = (
    "id", "key", "code", "uuid", "index", "idx", "serial", "number", "no", "num",
    "phone", "mobile", "zip", "zipcode", "postal", "fax", "url", "link", "hash",
    "account", "seq", "sequence", "date", "time", "year", "month", "day",
)
HIDDEN_TYPES = ("id", "text", "empty", "datetime")
BINS = 20
TOP_INTERACTIVE = 10
TOP_STATIC = 8
CHART_COLUMNS = 3


def meaningful_columns(profile: DataFrame) -> DataFrame:
    """Profile rows of the columns worth a chart, by name, type and variety."""
    terms = "|".join(HIDDEN_TERMS)
    name = F.lower("column")
    hidden = name.rlike(rf"^({terms})([_ ]|$)") | name.rlike(rf"[_ ]({terms})$")
    return profile.where(
        ~F.col("inferred_type").isin(*HIDDEN_TYPES) & (F.col("unique_count") > 1) & ~hidden)


def business_columns(profile: DataFrame, kpis: DataFrame) -> DataFrame:
    """Profile rows of numeric columns that carry a business figure."""
    figures = kpis.where(F.col("type").startswith("business_")).select("column").distinct()
    return profile.where(F.col("inferred_type") == "numeric").join(
        F.broadcast(figures), "column", "left_semi")  # a few rows per table


def chart_columns(profile: DataFrame, kpis: DataFrame | None = None) -> dict[str, list[str]]:
    """{"numeric": [...], "categorical": [...]} in table order."""
    shown = meaningful_columns(profile)
    numeric = shown if kpis is None else business_columns(shown, kpis)

    def names(rows: DataFrame, kind: str) -> list[str]:
        found = rows.where(F.col("inferred_type") == kind).select("position", "column").collect()
        return [r["column"] for r in sorted(found, key=lambda r: r["position"])]

    return {"numeric": names(numeric, "numeric"), "categorical": names(shown, "categorical")}


def _bin_edges(low: float, high: float, bins: int) -> list[float]:
    """The bins' ends, the nearest doubles of those between the two numbers as written."""
    if not (math.isfinite(low) and math.isfinite(high)):
        return [low + (high - low) * b / bins for b in range(bins + 1)]
    first, last = Fraction(repr(low)), Fraction(repr(high))
    return [float(first + (last - first) * b / bins) for b in range(bins + 1)]


def _bin_of(x: Column, edges: Sequence[float]) -> Column:
    """The bin whose ends hold the value: by comparison, as a quotient may round across an end."""
    if not all(map(math.isfinite, edges)):
        return F.lit(None).cast("int")  # an infinite range has no equal widths
    return F.when(x.isNotNull(), reduce(
        lambda n, edge: n + (x >= F.lit(edge)).cast("int"), edges[1:-1], F.lit(1)))


def histogram(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> DataFrame:
    """(column, bin, low, high, count): equal-width bins, the last one closed, empty ones too.

    A constant column gets a unit-wide range around its value.
    """
    names = list(columns)
    spark = df.sparkSession
    schema = "column string, bin int, low double, high double"
    if not names:
        return spark.createDataFrame([], f"{schema}, count bigint")
    numbers = {c: V.as_number(df, c) for c in names}
    ends = df.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(numbers.values())
                    for n, f in (("lo", F.min), ("hi", F.max))]).first()
    ranges = {}
    for i, c in enumerate(names):
        low, high = ends[f"lo{i}"], ends[f"hi{i}"]
        if low is not None:
            ranges[c] = (low - 0.5, high + 0.5) if low == high else (low, high)
    edges = {c: _bin_edges(float(lo), float(hi), bins) for c, (lo, hi) in ranges.items()}
    grid = [(c, b + 1, ends[b], ends[b + 1]) for c, ends in edges.items() for b in range(bins)]
    if not ranges:
        return spark.createDataFrame([], f"{schema}, count bigint")
    slots = V.long_form(df, {c: _bin_of(numbers[c], ends) for c, ends in edges.items()})
    counts = V.with_names(slots.where(F.col("value").isNotNull()).groupBy(
        "pos", F.col("value").cast("int").alias("bin")).agg(F.count("*").alias("n")), ranges)
    table = spark.createDataFrame(grid, schema)  # bins x columns rows
    return table.join(counts, ["column", "bin"], "left").select(
        "column", "bin", "low", "high", F.coalesce("n", F.lit(0)).alias("count"))


def box_summary(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the last values inside the fences, outlier count."""
    cut = quantiles.column_quantiles(df, columns, describe.QUARTILES)
    spark = df.sparkSession
    schema = ("column string, q1 double, median double, q3 double, whisker_low double, "
              "whisker_high double, outliers bigint")
    if not cut:
        return spark.createDataFrame([], schema)
    aggs = []
    for i, (c, (q1, _, q3)) in enumerate(cut.items()):
        low, high = q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1)
        x = V.as_number(df, c)
        inside = (x >= low) & (x <= high)
        aggs += [F.min(F.when(inside, x)).alias(f"lo{i}"), F.max(F.when(inside, x)).alias(f"hi{i}"),
                 F.count_if((x < low) | (x > high)).alias(f"n{i}")]
    r = df.agg(*aggs).first()
    return spark.createDataFrame(
        [(c, q1, q2, q3, r[f"lo{i}"], r[f"hi{i}"], r[f"n{i}"])
         for i, (c, (q1, q2, q3)) in enumerate(cut.items())], schema)


def topn_counts(df: DataFrame, columns: Sequence[str], top: int = TOP_INTERACTIVE) -> DataFrame:
    """(column, rank, value, count) of the most frequent values."""
    head = describe.top_values(describe.labelled_counts(df, columns), top)
    return head.select("column", "rank", "value", F.col("n").alias("count"))


def heatmap_long(df: DataFrame, numeric: Sequence[str], shown: Sequence[str]) -> DataFrame:
    """(col1, col2, r) of the shown numeric columns, two decimals; empty below two columns."""
    columns = [c for c in numeric if c in set(shown)]
    matrix = describe.correlation_matrix(df, columns) if len(columns) >= 2 else None
    if matrix is None:
        return df.sparkSession.createDataFrame([], "col1 string, col2 string, r double")
    return matrix.select("col1", "col2", F.round("r", 2).alias("r"))


def trend_points(periods: DataFrame, shown: Sequence[str]) -> DataFrame:
    """(metric, date, sum) of the shown metrics."""
    return periods.where(F.col("metric").isin(list(shown))).select("metric", "date", "sum")


def group_bars(groups: DataFrame, shown: Sequence[str]) -> DataFrame:
    """(cat_column, num_column, rank, category, mean) of shown column pairs."""
    names = list(shown)
    return groups.where(F.col("cat_column").isin(names) & F.col("num_column").isin(names)).select(
        "cat_column", "num_column", "rank", "category", "mean")

