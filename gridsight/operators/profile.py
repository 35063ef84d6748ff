"""Column and table profiles, semantic types, missing-cell report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsight.functions import dates, duplicates, frequency
from gridsight.functions import values as V

# Name parts that mark ids and dates, and the boolean spellings.
ID_NAME_PARTS = ("id", "key", "code", "num", "uuid", "index")
DATE_NAME_PARTS = ("date", "time", "year", "month", "day")
BOOLEAN_SPELLINGS = ("0", "1", "True", "False", "true", "false", "T", "F", "Y", "N",
                     "yes", "no", "Yes", "No")

# Longer texts are counted by digest, so that long texts are not shuffled.
LONGEST_COUNTED_TEXT = 64
SAMPLE_SIZE = 10
HEAD_ROWS = 50

PROFILE_SCHEMA = T.StructType([
    T.StructField("position", T.IntegerType()),
    T.StructField("column", T.StringType()),
    T.StructField("original_dtype", T.StringType()),
    T.StructField("inferred_type", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("null_count", T.LongType()),
    T.StructField("null_pct", T.DoubleType()),
    T.StructField("unique_count", T.LongType()),
    T.StructField("sample_values", T.ArrayType(T.StringType())),
])


def has_part(name: str, parts: Sequence[str]) -> bool:
    return any(part in name.lower() for part in parts)


def column_stats(df: DataFrame, columns: Sequence[str] | None = None,
                 approx: bool = False) -> DataFrame:
    """(column, row_count, non_null, unique_count, boolean_like), one row per column.

    Exact by default, from the value-frequency tables. `approx=True` swaps the
    shuffle of distinct values for a sketch in a single wide aggregate.
    """
    if approx:
        return _approx_stats(df, columns)

    def boolean_like(kind: str):
        if kind in ("bigint", "double"):
            return F.col("value").isin(0, 1)
        if kind == "boolean":
            return F.lit(True)
        if kind == "string":
            return F.col("value").isin(*BOOLEAN_SPELLINGS)
        return F.lit(False)

    return frequency.union_all([
        counts.groupBy("column").agg(
            F.sum("n").alias("row_count"),
            F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0))
            .alias("non_null"),
            F.count("value").alias("unique_count"),
            F.coalesce(F.bool_and(boolean_like(kind)), F.lit(False)).alias("boolean_like"),
        )
        for kind, counts in frequency.family_counts(
            df, columns, longest=LONGEST_COUNTED_TEXT).items()
    ])


def _approx_stats(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    names = list(columns or df.columns)
    tokens = F.array(*[F.lit(t) for t in BOOLEAN_SPELLINGS])
    wide = df.agg(F.struct(F.count("*").alias("rows"), *[
        F.struct(
            F.lit(c).alias("column"),
            F.count(V.native(df, c)).alias("non_null"),
            F.approx_count_distinct(V.native(df, c), 0.01).alias("unique_count"),
            F.coalesce(F.bool_and(F.array_contains(tokens, V.native(df, c).cast("string"))
                                  | V.as_number(df, c).isin(0, 1)), F.lit(False))
            .alias("boolean_like"),
        ).alias(f"s{i}") for i, c in enumerate(names)
    ]).alias("s"))
    per_column = F.array(*[F.col(f"s.s{i}") for i in range(len(names))])
    return wide.select(F.col("s.rows").alias("row_count"), F.explode(per_column).alias("c")).select(
        "c.column", "row_count", "c.non_null", "c.unique_count", "c.boolean_like")


def first_values(df: DataFrame, columns: Sequence[str], order_by: Sequence[str] | None = None,
                 rows: int = HEAD_ROWS) -> dict[str, list[str]]:
    """{column: non-missing text cells of the first rows}.

    With `order_by` the first rows by that key, kept in bounded per-task heaps;
    without it the first rows in scan order. Those few rows are fetched, as a
    fetch stops after the first splits while a limit inside a plan visits all.
    """
    names = list(columns)
    first = df.orderBy(*[V.col(k) for k in order_by]) if order_by else df
    found = first.select(*[V.as_text(df, c).alias(f"v{j}") for j, c in enumerate(names)]
                         ).limit(rows).collect()
    return {c: [r[j] for r in found if r[j] is not None] for j, c in enumerate(names)}


def first_filled(df: DataFrame, columns: Sequence[str], order_by: Sequence[str] | None = None,
                 size: int = SAMPLE_SIZE) -> DataFrame:
    """(column, position, value): the first non-missing cells of each column, in one pass.

    Without `order_by` in scan order. Ranks are limited in every task before the shuffle, so
    at most `size` cells of a column and task are moved, whatever the number of columns.
    """
    names = list(columns)
    keys = [V.col(k) for k in order_by] if order_by else [F.monotonically_increasing_id()]
    ranked = [f"__k{i}" for i in range(len(keys))]
    cells = F.array(*[F.struct(F.lit(i).alias("pos"), V.as_text(df, c).alias("value"))
                      for i, c in enumerate(names)])
    rows = df.select(*[k.alias(n) for k, n in zip(keys, ranked)], F.inline(F.filter(
        cells, lambda x: x["value"].isNotNull())))
    place = F.row_number().over(Window.partitionBy("pos").orderBy(*ranked))
    top = rows.withColumn("position", place).where(F.col("position") <= size)
    return V.with_names(top.select("pos", "position", "value"), names)


def date_layouts(df: DataFrame, samples: dict[str, list[str]]) -> dict[str, str]:
    """{column: layout} of the text columns whose every cell follows one date layout.

    `samples` holds some cells of each column. A layout that one of them breaks is out
    without a job; the others are held against all cells, so the answer does not depend
    on the order of the rows.
    """
    spark = df.sparkSession
    # A date has a digit, so most text columns are settled here.
    cells = [(c, v) for c, values in samples.items()
             if values and all(any(x.isdigit() for x in v) for v in values) for v in values]
    if not cells:
        return {}
    table = spark.createDataFrame(cells, "column string, value string")
    fits = table.groupBy("column").agg(*[
        F.bool_and(dates.parse(F.col("value"), f).isNotNull()).alias(f"f{i}")
        for i, f in enumerate(dates.FORMAT_NAMES)])
    open_ = [(r["column"], f) for r in fits.collect()
             for i, f in enumerate(dates.FORMAT_NAMES) if r[f"f{i}"]]
    if not open_:
        return {}
    every = df.agg(*[
        F.coalesce(F.bool_and(F.when(V.present(df, c).isNotNull(), dates.parse(
            V.as_text(df, c), f).isNotNull())), F.lit(False)).alias(f"k{i}")
        for i, (c, f) in enumerate(open_)]).first()
    found: dict[str, str] = {}
    for i, (c, f) in enumerate(open_):
        if every[f"k{i}"]:
            found.setdefault(c, f)
    return found


def sample_values(df: DataFrame, order_by: Sequence[str], columns: Sequence[str] | None = None,
                  size: int = SAMPLE_SIZE) -> DataFrame:
    """(column, position, value): the first non-missing values of every column."""
    return first_filled(df, columns or df.columns, order_by, size)


def infer_type(name: str, dtype: T.DataType, stats: Row, dated_text: bool,
               string_unique_is_id: bool = False, numeric_dates: bool = False) -> str:
    """Semantic type of one column from its statistics; the first rule that fits wins.

    `dated_text` says that all texts follow one date layout.
    """
    rows, filled, distinct = stats["row_count"], stats["non_null"], stats["unique_count"]
    numeric = V.is_numeric(dtype)
    if filled == 0:
        return "empty"
    # An integer column with gaps is a float column to the rules.
    whole = isinstance(dtype, V.INTEGRAL) and filled == rows
    unique_kind = whole or (string_unique_is_id and isinstance(dtype, T.StringType))
    if has_part(name, ID_NAME_PARTS) and distinct > 1:
        return "id"
    if distinct == filled and distinct > 5 and unique_kind:
        return "id"
    if isinstance(dtype, T.BooleanType) or (distinct <= 2 and stats["boolean_like"]):
        return "boolean"
    if numeric and numeric_dates and has_part(name, DATE_NAME_PARTS):
        return "datetime"
    if numeric:
        return "categorical" if distinct <= 10 else "numeric"
    if dated_text or isinstance(dtype, V.TEMPORAL):
        return "datetime"
    return "categorical" if distinct <= 25 or distinct / rows < 0.05 else "text"


def profile_columns(df: DataFrame, order_by: Sequence[str] | None = None, approx: bool = False,
                    columns: Sequence[str] | None = None, string_unique_is_id: bool = False,
                    numeric_dates: bool = False) -> DataFrame:
    """One row per column: type, missing cells, distinct values, sample.

    The table is scanned once per type family, each scan reading its own
    columns; only rows describing columns reach the driver. `order_by` decides
    which values come first; `columns` leaves others (a row number) out.
    """
    names = list(columns or df.columns)
    stats = {r["column"]: r for r in column_stats(df, names, approx).collect()}
    head = first_values(df, names, order_by)
    sparse = [c for c in names
              if c in stats and len(head[c]) < min(SAMPLE_SIZE, stats[c]["non_null"])]
    if sparse:  # too few values in the first rows: one pass over all these columns
        head |= {c: [] for c in sparse}
        for r in first_filled(df, sparse, order_by).orderBy("position").collect():
            head[r["column"]].append(r["value"])
    sample = {c: head[c][:SAMPLE_SIZE] for c in names}
    texts = {c: v for c, v in sample.items() if isinstance(V.dtype_of(df, c), T.StringType)}
    dated = date_layouts(df, texts)

    rows = []
    for i, field in enumerate(df.schema[c] for c in names):
        s = stats.get(field.name) or Row(row_count=0, non_null=0, unique_count=0,
                                         boolean_like=False)
        kind = infer_type(field.name, field.dataType, s, field.name in dated,
                          string_unique_is_id, numeric_dates)
        nulls = s["row_count"] - s["non_null"]
        pct = nulls / s["row_count"] * 100 if s["row_count"] else 0.0
        rows.append((i, field.name, field.dataType.simpleString(), kind, s["row_count"], nulls,
                     pct, s["unique_count"], sample[field.name]))
    return df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)


def profile_table(df: DataFrame) -> DataFrame:
    """One row: records, features, missing cells, exact duplicate rows."""
    missing = sum((F.when(V.present(df, c).isNull(), 1).otherwise(0) for c in df.columns),
                  F.lit(0))
    totals = df.select(missing.alias("m")).agg(
        F.count("*").alias("num_records"), F.sum("m").alias("total_missing"))
    copies = duplicates.copies(df).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_count"))
    return totals.select(
        "num_records", F.lit(len(df.columns)).cast("bigint").alias("num_features"),
        F.coalesce("total_missing", F.lit(0)).cast("bigint").alias("total_missing"),
        copies.scalar().alias("duplicate_count"))


def type_summary(profile: DataFrame) -> DataFrame:
    """Number of columns of each semantic type."""
    return profile.groupBy("inferred_type").agg(F.count("*").alias("columns"))


def missing_report(profile: DataFrame) -> DataFrame:
    """Columns with missing cells."""
    return profile.where(F.col("null_count") > 0).select(
        "column", "null_count", "null_pct").orderBy("column")


def types_of(profile: DataFrame) -> dict[str, str]:
    """{column: semantic type} in table order; one row per column is read."""
    rows = profile.select("position", "column", "inferred_type").collect()
    return {r["column"]: r["inferred_type"] for r in sorted(rows, key=lambda r: r["position"])}


def of_type(types: dict[str, str], *kinds: str) -> list[str]:
    return [c for c, kind in types.items() if kind in kinds]

