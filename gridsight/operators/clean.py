"""Cleaning: duplicates, missing cells, outlier profile, action log."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsight.functions import duplicates, frequency, quantiles
from gridsight.functions import values as V
from gridsight.operators import profile as P
from gridsight.session import stage

FILL_TEXT = "Unknown"
IMPUTATIONS = ("auto", "mean", "median", "disabled")
HIGH_NULL_PCT = 80

# Rows per range that one fill-forward task sorts, and the most ranges; beyond them ranges grow.
ROWS_PER_RANGE = 1_000_000
MOST_RANGES = 4096

LOG_SCHEMA = T.StructType([
    T.StructField("position", T.IntegerType()),
    T.StructField("action", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("affected", T.LongType()),
    T.StructField("fill_value", T.StringType()),
    T.StructField("text", T.StringType()),
])
OUTLIER_SCHEMA = T.StructType([
    T.StructField("position", T.IntegerType()),
    T.StructField("column", T.StringType()),
    T.StructField("count", T.LongType()),
    T.StructField("pct", T.DoubleType()),
    T.StructField("lower_bound", T.DoubleType()),
    T.StructField("upper_bound", T.DoubleType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
])


class Cleaned(NamedTuple):
    """The cleaned table, what was done, and its outlier profile."""

    data: DataFrame
    log: DataFrame
    outliers: DataFrame


# --- duplicates -----------------------------------------------------------------------------

def drop_duplicates(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """Exact duplicate rows reduced to one; nulls are equal.

    `order_by` names a row-number column that is not part of the row itself;
    the first copy's number is kept.
    """
    return duplicates.unique_rows(df, order_by)


# --- missing cells --------------------------------------------------------------------------

def _replace(df: DataFrame, changed: dict) -> DataFrame:
    """One projection that swaps the given columns."""
    return df.select(*[
        (changed[c] if c in changed else V.col(c)).alias(c) for c in df.columns])


def fill_unknown(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing ids and texts become a fixed word; the column becomes text."""
    return _replace(df, {
        c: F.coalesce(V.as_text(df, c), F.lit(FILL_TEXT)) for c in columns})


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _fill_numbers(df, _means(df, columns))


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _fill_numbers(df, _medians(df, columns))


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _fill_modes(df, columns, frequency.modes(df, columns))


def _means(df, columns):
    if not columns:
        return {}
    row = df.agg(*[F.avg(V.present(df, c).cast("double")).alias(f"m{i}")
                   for i, c in enumerate(columns)]).first()
    return {c: row[i] for i, c in enumerate(columns)}


def _medians(df, columns):
    return {c: q[0] for c, q in quantiles.column_quantiles(df, columns, [0.5]).items()}


def _fill_numbers(df, fills):
    return _replace(df, {
        c: F.coalesce(V.present(df, c).cast("double"), F.lit(v).cast("double"))
        for c, v in fills.items()})


def _fill_modes(df, columns, modes):
    changed = {}
    for c in columns:
        if modes.get(c) is None:
            changed[c] = F.coalesce(V.as_text(df, c), F.lit(FILL_TEXT))
        else:
            dtype = V.dtype_of(df, c)
            changed[c] = F.coalesce(V.present(df, c), F.lit(modes[c]).cast(dtype))
    return _replace(df, changed)


def fill_forward_backward(df: DataFrame, columns: Sequence[str], order_by: str,
                          ranges: int | None = None) -> DataFrame:
    """Missing cells take the last earlier value by `order_by`, leading ones the first later.

    The key and the columns to fill, nothing else, are sorted into even ranges of the
    (unique) order key, compared in its own type, and written, so that ranges cannot
    change later. A window runs inside each range only; what enters a range from earlier
    ones comes from a table with one row per range, of at most MOST_RANGES rows. The
    filled cells of rows with gaps are then looked up by key: few of them are broadcast
    by Spark, so that other columns stay where they are.
    """
    columns = list(columns)
    if not columns:
        return df
    key = V.col(order_by)
    if ranges is None:
        ranges = _ranges(df.count())
    places = range(len(columns))
    present = {c: V.present(df, c) for c in columns}
    narrow = df.select(key.alias("__key"), *[present[c].alias(f"__v{i}") for i, c in enumerate(columns)])
    rows = stage(narrow.repartitionByRange(ranges, "__key").withColumn(
        "__range", F.spark_partition_id()), "ranges")

    where = [F.when(F.col(f"__v{i}").isNotNull(), F.col("__key")) for i in places]
    ends = rows.groupBy("__range").agg(
        *[F.max_by(f"__v{i}", where[i]).alias(f"__l{i}") for i in places],
        *[F.min_by(f"__v{i}", where[i]).alias(f"__f{i}") for i in places],
    )
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("__range").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    # Cells before the first value of the table take that value.
    carried = ends.select(
        "__range",
        *[F.coalesce(F.last(f"__l{i}", ignorenulls=True).over(earlier),
                     F.first(f"__f{i}", ignorenulls=True).over(whole)).alias(f"__c{i}")
          for i in places],
    )
    inside = Window.partitionBy("__range").orderBy("__key").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    gap = frequency.any_of([F.col(f"__v{i}").isNull() for i in places])
    filled = rows.select("*", *[
        F.last(f"__v{i}", ignorenulls=True).over(inside).alias(f"__w{i}") for i in places])
    fills = stage(
        filled.where(gap).join(carried, "__range")
        .select("__key", *[F.coalesce(f"__w{i}", f"__c{i}").alias(f"__w{i}") for i in places])
        .dropDuplicates(["__key"]), "fills")
    return df.join(fills, key.eqNullSafe(F.col("__key")), "left").select(*[
        F.coalesce(present[c], F.col(f"__w{columns.index(c)}")).alias(c) if c in present else V.col(c)
        for c in df.columns])


def _ranges(rows: int) -> int:
    return min(MOST_RANGES, max(1, -(-rows // ROWS_PER_RANGE)))


# --- outliers -------------------------------------------------------------------------------

def outlier_bounds(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5,
                   counts: dict[str, int] | None = None) -> dict[str, tuple[float, float]]:
    """{column: (lower, upper)} from exact quartiles; columns without numbers are left out."""
    bounds = {}
    for c, (q1, q3) in quantiles.column_quantiles(df, columns, [0.25, 0.75], counts).items():
        spread = multiplier * (q3 - q1)
        bounds[c] = (q1 - spread, q3 + spread)
    return bounds


def outlier_stats(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5,
                  counts: dict[str, int] | None = None) -> list[tuple]:
    """(column, count, rows, lower, upper, min, max) per numeric column, in one aggregate."""
    bounds = outlier_bounds(df, columns, multiplier, counts)
    if not bounds:
        return []
    aggs = [F.count("*").alias("rows")]
    for i, (c, (low, high)) in enumerate(bounds.items()):
        x = V.as_number(df, c)
        aggs += [F.count_if((x < low) | (x > high)).alias(f"n{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    found = {c: (c, row[f"n{i}"], row["rows"], low, high, row[f"lo{i}"], row[f"hi{i}"])
             for i, (c, (low, high)) in enumerate(bounds.items())}
    return [found[c] for c in columns if c in found]


def outlier_profile(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5,
                    counts: dict[str, int] | None = None) -> DataFrame:
    """Columns with values strictly outside the quartile fences."""
    stats = outlier_stats(df, columns, multiplier, counts)
    return _outlier_table(df.sparkSession, stats)


def _outlier_table(spark: SparkSession, stats: list[tuple]) -> DataFrame:
    rows = [(i, c, n, n / total * 100, low, high, lo, hi)
            for i, (c, n, total, low, high, lo, hi) in enumerate(s for s in stats if s[1] > 0)]
    return spark.createDataFrame(rows, OUTLIER_SCHEMA)


def flag_outliers(df: DataFrame, column: str, multiplier: float = 1.5,
                  output: str = "is_outlier") -> DataFrame:
    """Mark rows whose value lies outside the fences; missing values are not outliers."""
    low, high = outlier_bounds(df, [column], multiplier).get(column, (None, None))
    if low is None:
        return df.withColumn(output, F.lit(False))
    x = V.as_number(df, column)
    return df.withColumn(output, F.coalesce((x < low) | (x > high), F.lit(False)))


def high_null_warnings(profile: DataFrame, limit: float = HIGH_NULL_PCT) -> DataFrame:
    """Columns that are mostly empty."""
    return profile.where(F.col("null_pct") > limit).select("column", "null_count", "null_pct")


# --- the whole pipeline ---------------------------------------------------------------------

def clean(df: DataFrame, profile: DataFrame, imputation: str = "auto",
          drop_copies: bool = True, outlier_multiplier: float = 1.5,
          order_by: str | None = None, row_number: str | None = None,
          keep=stage) -> Cleaned:
    """Duplicates, then missing cells by semantic type, then outlier flags.

    `profile` is that of the raw table. `order_by` gives the row order for date
    columns (default: `row_number`, a row-number column outside the data).
    `keep` stores a table that several passes read; by default it is written to
    the shared folder, so the duplicate shuffle runs once.
    """
    if imputation not in IMPUTATIONS:
        raise ValueError(f"unknown imputation {imputation!r}; choose from {IMPUTATIONS}")
    spark = df.sparkSession
    order_by = order_by or row_number
    types = P.types_of(profile)
    log: list[tuple] = []

    data = keep(drop_duplicates(df, row_number)) if drop_copies else df
    columns = [c for c in data.columns if c != row_number]
    numeric = [c for c in columns if types.get(c) == "numeric"]
    facts = data.agg(
        F.count("*").alias("rows"),
        *[F.count(V.present(data, c)).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.avg(V.as_number(data, c)).alias(f"m{i}") for i, c in enumerate(numeric)],
    ).first()
    kept = facts["rows"]
    before = profile.agg(F.max("row_count")).first()[0] or 0
    if drop_copies and before > kept:
        log.append(("drop_duplicates", None, before - kept, None,
                    f"{before - kept} exact duplicate rows were removed."))
    nulls = {c: kept - facts[f"n{i}"] for i, c in enumerate(columns)}
    gaps = {c: n for c, n in nulls.items() if n > 0}

    texts = [c for c in gaps if types.get(c) in ("id", "text", "empty")]
    labels = [c for c in gaps if types.get(c) in ("categorical", "boolean")]
    moments = [c for c in gaps if types.get(c) == "datetime"]
    numbers = [c for c in gaps if c in numeric and imputation != "disabled"]
    if imputation == "median":
        fills = _medians(data, numbers)
    else:
        fills = {c: facts[f"m{numeric.index(c)}"] for c in numbers}
    modes = frequency.modes(data, labels) if labels else {}

    filled = fill_unknown(data, texts)
    filled = _fill_numbers(filled, fills)
    filled = _fill_modes(filled, labels, modes)
    if moments:
        if order_by is None:
            raise ValueError(f"date columns {moments} need order_by to be filled")
        ranges = _ranges(kept)
        filled = fill_forward_backward(filled, moments, order_by, ranges)

    for c, n in gaps.items():
        share = n / before * 100 if before else 0.0
        if share > HIGH_NULL_PCT:
            log.append(("warn_empty", c, n, None, f"'{c}' is {share:.1f}% empty."))
        if c in texts or (c in labels and modes.get(c) is None):
            log.append(("fill_unknown", c, n, FILL_TEXT,
                        f"{n} missing cells of '{c}' were set to '{FILL_TEXT}'."))
        elif c in fills:
            how = "median" if imputation == "median" else "mean"
            log.append((f"impute_{how}", c, n, f"{fills[c]:.2f}",
                        f"{n} missing numbers of '{c}' took the {how} {fills[c]:.2f}."))
        elif c in labels:
            log.append(("impute_mode", c, n, str(modes[c]),
                        f"{n} missing values of '{c}' took the mode '{modes[c]}'."))
        elif c in moments:
            log.append(("fill_forward", c, n, None,
                        f"{n} missing dates of '{c}' were filled from their neighbours."))

    filled = keep(filled) if gaps or not drop_copies else filled
    sizes = {c: kept - (gaps.get(c, 0) if c not in fills else 0) for c in numeric}
    known = {c: sizes[c] for c in numeric if sizes[c] > 0 and V.is_numeric(V.dtype_of(filled, c))}
    stats = outlier_stats(filled, list(known), outlier_multiplier, known)
    for c, n, total, low, high, _, _ in stats:
        if n > 0:
            log.append(("flag_outliers", c, n, None,
                        f"{n} values of '{c}' ({n / total * 100:.1f}%) lie outside "
                        f"[{low:.2f}, {high:.2f}] at {outlier_multiplier} times the spread."))
    log_table = spark.createDataFrame([(i, *entry) for i, entry in enumerate(log)], LOG_SCHEMA)
    return Cleaned(filled, log_table, _outlier_table(spark, stats))
