"""Look at rows and slices: search, pages, samples, pivots, facets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from gridsight.functions import dates, frequency, quantiles
from gridsight.functions import values as V

SAMPLE_ROWS = 2000
SAMPLE_SEED = 42
FACET_LIMIT = 15
HIDDEN_FACET = "Unknown"
TOP_COUNTS = 10
# Up to this many keys are skipped in a bounded heap; deeper pages start at a found key.
SHALLOW_OFFSET = 1000
# Ranges that keys are counted in at once, and the sampled keys for each.
KEY_RANGES = 64
EDGE_SAMPLE = 32
MAX_ZEROS = 8


# --- rows -----------------------------------------------------------------------------------

def search_rows(df: DataFrame, query: str, regex: bool = True) -> DataFrame:
    """Rows where any column contains `query`, ignoring case."""
    query = query.strip() if regex else query
    if not query:
        return df
    cells = [V.as_text(df, c) for c in df.columns]
    if regex:
        hit = [cell.rlike(f"(?i){query}") for cell in cells]
    else:
        hit = [F.lower(cell).contains(query.lower()) for cell in cells]
    return df.where(F.coalesce(frequency.any_of([F.coalesce(h, F.lit(False)) for h in hit]),
                               F.lit(False)))


def page_rows(df: DataFrame, key: str, page: int, size: int = 10) -> DataFrame:
    """Page `page` (from 0) in the order of a unique key, of any sortable type.

    The keys of the page are found first, on the key column alone; whole rows
    are then read for that key range only.
    """
    keys = df.select(V.col(key).alias("k")).where("k is not null")
    start, offset = first_key_near(keys, page * size)
    if offset is None:
        return df.limit(0)
    rows = keys if start is None else keys.where(F.col("k") >= start)
    wanted = rows.orderBy("k").offset(offset).limit(size)
    ends = wanted.agg(F.min("k").alias("low"), F.max("k").alias("high")).first()
    if ends["low"] is None:
        return df.limit(0)
    k = V.col(key)
    return df.where((k >= ends["low"]) & (k <= ends["high"])).orderBy(k)


def _range_of(key: Column, edges: list) -> Column:
    """How many of the sorted `edges` are at or below the key, by bisection."""
    def part(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < F.lit(edges[middle]), part(low, middle)).otherwise(
            part(middle + 1, high))
    return part(0, len(edges))


def first_key_near(keys: DataFrame, rank: int, ranges: int = KEY_RANGES,
                   near: int = SHALLOW_OFFSET) -> tuple:
    """(start key, offset behind it) of the key at `rank`; (None, None) past the end.

    A bounded sample of the keys, the first ones in hash order, cuts them into ranges,
    which are counted where the rows lie: one row per range and task is shuffled, no key.
    The range that holds the rank is cut again until the offset in it is small.
    """
    k = F.col("k")
    start, inside = None, keys
    while rank > near:
        sample = [r["k"] for r in inside.orderBy(F.xxhash64(k), k).limit(
            ranges * EDGE_SAMPLE).orderBy(k).collect()]
        step = max(1, len(sample) // ranges)
        edges = sample[step::step]
        counts = inside.groupBy(_range_of(k, edges).alias("part")).agg(
            F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high")).collect()
        size = sum(r["n"] for r in counts)
        for r in sorted(counts, key=lambda r: r["part"]):
            if rank < r["n"]:
                break
            rank -= r["n"]
        else:
            return None, None
        start = r["low"]
        if r["low"] == r["high"] or r["n"] == size:
            break
        inside = keys.where((k >= r["low"]) & (k <= r["high"]))
    return start, rank


def page_after(df: DataFrame, key: str, after, size: int = 10) -> DataFrame:
    """The next page behind a known key: any key type, any depth, one bounded heap."""
    rows = df if after is None else df.where(V.col(key) > F.lit(after))
    return rows.orderBy(V.col(key)).limit(size)


def sample_order(key: Column, seed: int = SAMPLE_SEED) -> Column:
    """A hash order that depends on the row key only, not on partitions."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def hash_sample(rows: DataFrame, key: str, size: int, seed: int = SAMPLE_SEED) -> DataFrame:
    """The `size` rows that come first in hash order of a unique key.

    One counting pass finds the longest run of leading zeros that still has
    enough rows; only those few rows are sorted, however many there are in all.
    """
    digest = sample_order(V.col(key), seed)
    zeros = rows.agg(*[
        F.count_if(digest.startswith("0" * k)).alias(f"z{k}") for k in range(1, MAX_ZEROS + 1)
    ]).first()
    longest = max([k for k in range(1, MAX_ZEROS + 1) if zeros[f"z{k}"] >= size], default=0)
    near = rows.where(digest.startswith("0" * longest)) if longest else rows
    return near.orderBy(digest, V.col(key)).limit(size)


def column_sample(df: DataFrame, column: str, key: str, size: int = SAMPLE_ROWS,
                  seed: int = SAMPLE_SEED) -> DataFrame:
    """At most `size` non-missing values of a column, the same ones on every run."""
    value = V.present(df, column)
    rows = df.where(value.isNotNull()).select(V.col(key).alias("row_key"), value.alias("value"))
    return hash_sample(rows, "row_key", size, seed)


def sample_top_values(sample: DataFrame, top: int = TOP_COUNTS) -> DataFrame:
    """Most frequent values of a column sample."""
    counts = sample.groupBy(V.as_text(sample, "value").alias("value")).agg(
        F.count("*").alias("count"))
    return counts.orderBy(F.col("count").desc(), "value").limit(top)


def preview(df: DataFrame, key: str, page: int = 0, size: int = 10,
            query: str = "") -> tuple[int, DataFrame]:
    """(number of matching rows, one page of them)."""
    found = search_rows(df, query)
    return found.count(), page_rows(found, key, page, size)


# --- group and pivot ------------------------------------------------------------------------

PIVOT_FUNCTIONS = ("sum", "mean", "median", "min", "max", "count", "std", "var", "nunique")


def _simple(how: str, x: Column) -> Column:
    return {
        "sum": F.coalesce(F.sum(x), F.lit(0.0)), "mean": F.avg(x), "min": F.min(x),
        "max": F.max(x), "count": F.count(x), "std": F.stddev_samp(x), "var": F.var_samp(x),
        "nunique": F.count_distinct(x),
    }[how]


def _grouped(df: DataFrame, keys: Sequence[str], value: str, how: str) -> DataFrame:
    """(k0, k1, .., cell) for groups without missing keys."""
    if how not in PIVOT_FUNCTIONS:
        raise ValueError(f"unknown aggregate {how!r}; choose from {PIVOT_FUNCTIONS}")
    plain = how in ("min", "max", "count", "nunique")
    x = V.present(df, value) if plain else V.as_number(df, value)
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[V.col(k).alias(n) for n, k in zip(names, keys)], x.alias("x")).where(
        frequency.all_of([F.col(n).isNotNull() for n in names]))
    if how == "median":
        groups = rows.select(*names).distinct()
        medians = quantiles.grouped_median(rows, names, "x", "cell")
        return groups.join(medians, names, "left")
    return rows.groupBy(*names).agg(_simple(how, F.col("x")).alias("cell"))


def group_agg(df: DataFrame, row: str, value: str, how: str = "sum") -> DataFrame:
    """(row, value) aggregate per group, sorted by group; groups without values stay."""
    return _grouped(df, [row], value, how).select(
        F.col("k0").alias(row), F.col("cell").alias(value)).orderBy(V.col(row))


def _axis(df, row, column, value, how, cells) -> DataFrame:
    """Distinct pivot columns, from the input columns where that is enough."""
    if how in ("std", "var"):  # these need two values in one cell
        return cells.select("k1").distinct()
    filled = [V.col(row).isNotNull(), V.col(column).isNotNull()]
    if how not in ("sum", "count", "nunique"):  # an empty group has no cell
        filled.append(V.present(df, value).isNotNull())
    return df.where(frequency.all_of(filled)).select(V.col(column).alias("k1")).distinct()


def pivot_cells(df: DataFrame, row: str, column: str, value: str, how: str = "sum") -> DataFrame:
    """(row, column, cell): the filled cells of a pivot as a long table, of any width."""
    return _grouped(df, [row, column], value, how).where(F.col("cell").isNotNull()).select(
        F.col("k0").alias("row"), F.col("k1").alias("column"), "cell")


def pivot(df: DataFrame, row: str, column: str, value: str, how: str = "sum") -> DataFrame:
    """Row by column matrix of an aggregate; missing cells are 0, both axes sorted.

    Cells are aggregated first, so the pivot itself sees one row per cell. Rows
    and columns without any cell are dropped. Wider ones than Spark's limit of pivot
    columns are to be had as `pivot_cells`.
    """
    cells = pivot_cells(df, row, column, value, how).select(
        F.col("row").alias("k0"), F.col("column").alias("k1"), "cell")
    kind = V.family(V.dtype_of(df, column))
    label = V.text_of(F.col("k1").cast(kind), kind)
    limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    axis = (_axis(df, row, column, value, how, cells)
            .select("k1", label.alias("label")).orderBy("k1").limit(limit + 1).collect())
    if len(axis) > limit:
        raise ValueError(f"'{column}' has more than {limit} values (spark.sql.pivotMaxValues); "
                         "pivot_cells has no limit")
    labels = [r["label"] for r in axis]
    wide = cells.select("k0", label.alias("label"), "cell").groupBy("k0").pivot(
        "label", labels).agg(F.first("cell")) if labels else cells.select("k0").distinct()
    return wide.select(F.col("k0").alias(row), *[
        F.coalesce(V.col(x), F.lit(0)).alias(x) for x in labels]).orderBy(V.col(row))


# --- facets ---------------------------------------------------------------------------------

def facet_values(df: DataFrame, profile_rows: Sequence[Row] | Mapping[str, int],
                 limit: int = FACET_LIMIT) -> DataFrame:
    """(column, value, count) of the columns offered as filters.

    `profile_rows` maps candidate columns to their distinct counts; those that
    cannot qualify are not counted again.
    """
    distinct = dict(profile_rows) if isinstance(profile_rows, Mapping) else {
        r["column"]: r["unique_count"] for r in profile_rows
        if r["inferred_type"] in ("categorical", "boolean")}
    columns = [c for c, n in distinct.items() if n <= limit + 1]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, count bigint")
    counts = frequency.text_counts(df, columns).where(
        F.col("value").isNotNull() & (F.col("value") != HIDDEN_FACET))
    sizes = counts.groupBy("column").agg(F.count("*").alias("values")).where(
        F.col("values") <= limit)
    return counts.join(F.broadcast(sizes), "column").select(  # one row per column
        "column", "value", F.col("n").alias("count"))


def facet_filter(df: DataFrame, chosen: Mapping[str, object]) -> DataFrame:
    """Rows that equal every chosen value; compared in the column's own type, so it is
    pushed down to the scan."""
    conditions = []
    for c, value in chosen.items():
        kind = V.family(V.dtype_of(df, c))
        if value is None:
            conditions.append(V.col(c).isNull())
        elif kind == "string":
            conditions.append(V.col(c) == F.lit(str(value)))
        else:
            conditions.append(V.col(c) == F.lit(value).try_cast(V.dtype_of(df, c)))
    return df.where(frequency.all_of(conditions))


def _shown_number(df: DataFrame, column: str) -> Column:
    """A number as a filtered view counts it: a missing cell is 0, other text is left out."""
    return F.when(V.present(df, column).isNull(), 0.0).otherwise(V.as_number(df, column))


def facet_kpis(df: DataFrame, chosen: Mapping[str, object],
               figures: Sequence[tuple[str, str]]) -> DataFrame:
    """(column, type, value) of KPI figures under a filter, in one aggregate.

    `figures` are (column, KPI type) pairs.
    """
    rows = facet_filter(df, chosen)
    aggs, cells = [F.count("*").cast("double").alias("rows")], []
    cells.append(F.struct(F.lit("N/A").alias("column"), F.lit("generic").alias("type"),
                          F.col("rows").alias("value")))
    for i, (c, kind) in enumerate(figures):
        x = _shown_number(rows, c)
        if kind in ("business_sum", "business_qty"):
            aggs.append(F.coalesce(F.sum(x), F.lit(0.0)).alias(f"f{i}"))
        elif kind in ("business_avg", "generic_avg"):
            aggs.append(F.coalesce(F.avg(x), F.lit(0.0)).alias(f"f{i}"))
        else:
            # A missing cell counts as one more distinct value.
            gap = F.coalesce(F.max(V.present(rows, c).isNull().cast("int")), F.lit(0))
            aggs.append((F.count_distinct(V.present(rows, c)) + gap).cast("double")
                        .alias(f"f{i}"))
        cells.append(F.struct(F.lit(c).alias("column"), F.lit(kind).alias("type"),
                              F.col(f"f{i}").alias("value")))
    return rows.agg(*aggs).select(F.explode(F.array(*cells)).alias("k")).select("k.*")


def facet_counts(df: DataFrame, chosen: Mapping[str, object], column: str,
                 top: int = TOP_COUNTS) -> DataFrame:
    """Most frequent values of a column under a filter."""
    rows = facet_filter(df, chosen)
    label = F.coalesce(V.as_text(rows, column), F.lit("null"))
    return rows.groupBy(label.alias("value")).agg(F.count("*").alias("count")).orderBy(
        F.col("count").desc(), "value").limit(top)


def facet_daily(df: DataFrame, chosen: Mapping[str, object], date_column: str,
                value: str, fmt: str | None = None) -> DataFrame:
    """(day, sum) under a filter."""
    rows = facet_filter(df, chosen)
    day = F.to_date(dates.as_timestamp(rows, date_column, fmt)).alias("day")
    amount = F.coalesce(V.as_number(rows, value), F.lit(0.0))
    return rows.groupBy(day).agg(F.sum(amount).alias("sum")).orderBy("day")


def facet_means(df: DataFrame, chosen: Mapping[str, object], category: str,
                value: str) -> DataFrame:
    """(category, mean) of all groups under a filter, best first."""
    rows = facet_filter(df, chosen)
    label = F.coalesce(V.as_text(rows, category), F.lit("null")).alias("category")
    x = _shown_number(rows, value)
    return rows.where(x.isNotNull()).groupBy(label).agg(F.avg(x).alias("mean")).orderBy(
        F.col("mean").desc(), "category")
