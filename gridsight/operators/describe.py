"""Describe single columns and their relations."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement, permutations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsight.functions import frequency, quantiles
from gridsight.functions import values as V

QUARTILES = [0.25, 0.5, 0.75]
MISSING_LABEL = "Missing"
OTHERS_LABEL = "Others"
TOP_VALUES = 10
TOP_GROUPS = 10
TOP_PAIRS = 10
#: Pairs of columns that one aggregate of plain sums, and one of own means, holds.
DIRECT_PAIRS = 40
FEW_PAIRS = 6
#: Category columns of one scan; a grouping set has a bit for each.
MAX_GROUPINGS = 60
CROSSTAB_ROWS = 30
COMPARED_COLUMNS = 3
# Least |r| of a reported pair, and of a strong one.
MODERATE_R = 0.4
STRONG_R = 0.7

MOMENT_FIELDS = ("mean", "min", "max", "range", "std", "var", "skewness", "kurtosis")
DESCRIBE_SCHEMA = T.StructType(
    [T.StructField("position", T.IntegerType()), T.StructField("column", T.StringType()),
     T.StructField("count", T.LongType())]
    + [T.StructField(f, T.DoubleType())
       for f in (*MOMENT_FIELDS, "q25", "median", "q75", "mode")])


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, extremes, spread, skewness, excess kurtosis; one pass, no shuffle of rows.

    Spread is the sample form and 0 for one value; skewness and kurtosis are the
    population forms, 0 up to two values and null for a constant column.
    """
    aggs = []
    for i, c in enumerate(columns):
        x = V.as_number(df, c)
        few = F.count(x) <= 2
        aggs.append(F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column"),
            F.count(x).alias("count"), F.avg(x).alias("mean"),
            F.min(x).alias("min"), F.max(x).alias("max"),
            (F.max(x) - F.min(x)).alias("range"),
            F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"),
            F.coalesce(F.var_samp(x), F.lit(0.0)).alias("var"),
            F.when(few, 0.0).otherwise(F.skewness(x)).alias("skewness"),
            F.when(few, 0.0).otherwise(F.kurtosis(x)).alias("kurtosis"),
        ).alias(f"d{i}"))
    wide = df.agg(*aggs)
    rows = wide.select(F.explode(F.array(*[F.col(f"d{i}") for i in range(len(columns))]))
                       .alias("d"))
    return rows.select("d.*").where(F.col("count") > 0)


def quartiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, q25, median, q75), exact and interpolated."""
    found = quantiles.column_quantiles(df, columns, QUARTILES)
    return df.sparkSession.createDataFrame(
        [(c, *found[c]) for c in columns if c in found],
        "column string, q25 double, median double, q75 double")


def numeric_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mode): most frequent number, the smallest on ties."""
    numbers = V.numbers_long(df, columns).groupBy("pos", "value").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("rank"), "value"))
    return V.with_names(
        numbers.groupBy("pos").agg(best.getField("value").alias("mode")), columns)


def numeric_describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Moments, quartiles and mode of numeric columns, one row per column."""
    columns = list(columns)
    if not columns:
        return df.sparkSession.createDataFrame([], DESCRIBE_SCHEMA)
    basic = {r["column"]: r for r in moments(df, columns).collect()}
    known = {c: basic[c]["count"] for c in columns if c in basic}
    cut = quantiles.column_quantiles(df, list(known), QUARTILES, known)
    modes = {r["column"]: r["mode"] for r in numeric_mode(df, columns).collect()}
    rows = [
        (i, c, basic[c]["count"], *[basic[c][f] for f in MOMENT_FIELDS], *cut[c], modes[c])
        for i, c in enumerate(columns) if c in basic
    ]
    return df.sparkSession.createDataFrame(rows, DESCRIBE_SCHEMA)


# --- categories -----------------------------------------------------------------------------

def labelled_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n): text value counts with missing cells as their own label."""
    counts = frequency.text_counts(df, list(columns))
    return counts.select(
        "column", F.coalesce("value", F.lit(MISSING_LABEL)).alias("value"), "n")


def _totals(counts: DataFrame) -> DataFrame:
    """One row per column: total, number of values, most and least common value."""
    most = F.min(F.struct((-F.col("n")).alias("rank"), "value"))
    least = F.max(F.struct((-F.col("n")).alias("rank"), "value"))
    return counts.groupBy("column").agg(
        F.sum("n").alias("total"), F.count("*").alias("categories"),
        most.alias("most"), least.alias("least"))


def top_values(counts: DataFrame, size: int) -> DataFrame:
    """The most frequent values of each column; ties by value.

    The rank limit runs before the shuffle, so no task holds a whole column.
    """
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def value_distribution(df: DataFrame, columns: Sequence[str],
                       top: int = TOP_VALUES) -> DataFrame:
    """(column, rank, value, count, pct): the top values, the rest as one row."""
    counts = labelled_counts(df, columns)
    # At most `top` values are listed per column, and one row of totals.
    head = top_values(counts, top).groupBy("column").agg(
        F.collect_list(F.struct("rank", "value", "n")).alias("rows"), F.sum("n").alias("shown"))
    totals = _totals(counts).select("column", "total", "categories")
    rest = F.array(F.struct(F.lit(top + 1).alias("rank"), F.lit(OTHERS_LABEL).alias("value"),
                            (F.col("total") - F.col("shown")).alias("n")))
    rows = F.when(F.col("categories") > top, F.concat("rows", rest)).otherwise(F.col("rows"))
    return head.join(F.broadcast(totals), "column").select(
        "column", "total", F.explode(rows).alias("r")).select(
        "column", "r.rank", "r.value", F.col("r.n").alias("count"),
        (F.col("r.n") / F.col("total") * 100).alias("pct"))


def category_extremes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: number of categories, most and least common with share."""
    totals = _totals(labelled_counts(df, columns))

    def share(name: str):
        return -F.col(f"{name}.rank") / F.col("total") * 100

    return totals.select(
        "column", "categories", "total",
        F.col("most.value").alias("most_common"),
        (-F.col("most.rank")).alias("most_count"), share("most").alias("most_pct"),
        F.col("least.value").alias("least_common"),
        (-F.col("least.rank")).alias("least_count"), share("least").alias("least_pct"))


# --- relations ------------------------------------------------------------------------------

def _finite(df: DataFrame, name: str) -> Column:
    """The number in a cell; infinities count as missing, as they have no deviation."""
    number = V.as_number(df, name)
    return F.when(F.abs(number) < float("inf"), number)


def _direct(df: DataFrame, pairs: Sequence[tuple]) -> DataFrame:
    """(p1, p2, col1, col2, r) of the pairs ((i, a), (j, b)), each an aggregate of its own."""
    cells = []
    for (i, a), (j, b) in pairs:
        x, y = _finite(df, a), _finite(df, b)
        # corr itself fails where a spread is 0.
        spread = F.sqrt(F.var_pop(F.when(y.isNotNull(), x)) * F.var_pop(F.when(x.isNotNull(), y)))
        r = F.try_divide(F.covar_pop(x, y), spread)
        r = F.when((spread > 0) & ~F.isnan(r), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
        cells.append(F.struct(F.lit(i).alias("p1"), F.lit(j).alias("p2"), F.lit(a).alias("col1"),
                              F.lit(b).alias("col2"), r.alias("r")))
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def _pair_sums(df: DataFrame, means: dict[str, float]) -> np.ndarray:
    """n, sums of x, x squared and x * y over the rows where both columns have a number, as
    four matrices [x, y]. Values are taken from their means, so that squares keep their digits.

    One scan in the JVM: plain sums for few pairs; for more, each row is one vector of values,
    squares and presences, and tasks add up its outer products.
    """
    k = len(means)
    values = df.select(*[(_finite(df, c) - F.lit(m)).alias(f"x{i}") for i, (c, m) in enumerate(means.items())])
    x = [F.col(f"x{i}") for i in range(k)]
    if k * (k - 1) // 2 > DIRECT_PAIRS:
        known = [F.coalesce(v, F.lit(0.0)) for v in x]
        parts = [*known, *[v * v for v in known], *[v.isNotNull().cast("double") for v in x]]
        vectors = values.select(array_to_vector(F.array(*parts)).alias("v"))
        rows = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v"), numCols=len(parts))
        sums = rows.computeGramianMatrix().toArray()
        return np.array([sums[2 * k:, 2 * k:], sums[:k, 2 * k:], sums[k:2 * k, 2 * k:], sums[:k, :k]])
    out, cells, places = np.zeros((4, k, k)), [], []
    for i, j in permutations(range(k), 2):
        mine = F.when(x[j].isNotNull(), x[i])
        cells += [F.sum(mine), F.sum(mine * mine)]
        places += [(1, i, j), (2, i, j)]
        if i < j:
            cells += [F.count(x[i] + x[j]).cast("double"), F.sum(x[i] * x[j])]
            places += [(0, i, j), (3, i, j)]
    for place, value in zip(places, values.agg(*[c.alias(f"s{n}") for n, c in enumerate(cells)]).first()):
        out[place] = value or 0.0
    for both in (0, 3):
        out[both] += out[both].T
    return out


def _coefficients(n: np.ndarray, first: np.ndarray, square: np.ndarray,
                  product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """r of all pairs of columns, and the pairs in which a spread may be rounding only."""
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = square - first * first / n
        r = (product - first * first.T / n) / np.sqrt(spread * spread.T)
    flat = spread <= 1e-7 * square
    return r, flat | flat.T


def pair_correlations(df: DataFrame, columns: Sequence[str], diagonal: bool = False) -> DataFrame:
    """(p1, p2, col1, col2, r) for every pair of columns, pairwise complete.

    A cell counts where both columns hold a finite number. r is null where it is not defined:
    beside a constant column, or where the rows of a pair do not vary. Pairs whose spread cannot
    be told from rounding are computed once more, each from its own means.
    """
    spark = df.sparkSession
    schema = "p1 int, p2 int, col1 string, col2 string, r double"
    numbered = list(enumerate(columns))
    pairs = list(combinations_with_replacement(numbered, 2) if diagonal else combinations(numbered, 2))
    if not pairs:
        return spark.createDataFrame([], schema)
    facts = df.agg(*[F.struct(F.avg(_finite(df, c)), F.coalesce(
        F.max(_finite(df, c)) > F.min(_finite(df, c)), F.lit(False))) for c in columns]).first()
    means = {c: facts[i][0] for i, c in numbered if facts[i][1]}
    at = {c: i for i, c in enumerate(means)}
    r, unsure = _coefficients(*_pair_sums(df, means)) if len(means) > 1 else (None, None)
    found, direct = [], []
    for (i, a), (j, b) in pairs:
        if a not in at or b not in at:
            found.append((i, j, a, b, None))
        elif i == j:
            found.append((i, j, a, b, 1.0))
        elif unsure[at[a], at[b]]:
            direct.append(((i, a), (j, b)))
        else:
            value = float(r[at[a], at[b]])
            found.append((i, j, a, b, max(-1.0, min(1.0, value)) if math.isfinite(value) else None))
    return frequency.union_all([spark.createDataFrame(found, schema), *[
        _direct(df, direct[k:k + FEW_PAIRS]) for k in range(0, len(direct), FEW_PAIRS)]])


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(p1, p2, col1, col2, r) for all ordered pairs; undefined values are 0."""
    both = F.when(F.col("p1") == F.col("p2"), F.array(F.struct("p1", "p2", "col1", "col2", "r"))).otherwise(
        F.array(F.struct("p1", "p2", "col1", "col2", "r"),
                F.struct(F.col("p2").alias("p1"), F.col("p1").alias("p2"), F.col("col2").alias("col1"),
                         F.col("col1").alias("col2"), "r")))
    return pair_correlations(df, columns, diagonal=True).select(F.inline(both)).withColumn(
        "r", F.coalesce("r", F.lit(0.0)))


def strong_pairs(pairs: DataFrame, top: int = TOP_PAIRS) -> DataFrame:
    """Pairs with |r| of at least 0.4, strongest first."""
    size = F.abs("r")
    return (
        pairs.where(size >= MODERATE_R).orderBy(size.desc(), "p1", "p2")
        .select("col1", "col2", "r",
                F.when(F.col("r") > 0, "positive").otherwise("negative").alias("direction"),
                F.when(size >= STRONG_R, "strong").otherwise("moderate").alias("strength"))
        .limit(top)
    )


GROUP_SCHEMA = T.StructType([
    T.StructField("cat_position", T.IntegerType()), T.StructField("num_position", T.IntegerType()),
    T.StructField("cat_column", T.StringType()), T.StructField("num_column", T.StringType()),
    T.StructField("rank", T.IntegerType()), T.StructField("category", T.StringType()),
    T.StructField("mean", T.DoubleType()), T.StructField("median", T.DoubleType()),
    T.StructField("sum", T.DoubleType()), T.StructField("count", T.LongType()),
])


def group_stats(df: DataFrame, categories: Sequence[str], numbers: Sequence[str],
                top: int = TOP_GROUPS) -> DataFrame:
    """Mean, median, sum, count of each number per category value; the best means per pair.

    Means decide which groups are shown, and they combine map-side; all category columns
    share one scan, as grouping sets. Exact
    medians are then taken for the shown groups alone, so their number stays
    small however many categories there are.
    """
    spark = df.sparkSession
    shown: list[tuple] = []
    if not numbers:
        return spark.createDataFrame([], GROUP_SCHEMA)
    for at in range(0, len(categories), MAX_GROUPINGS):
        shown += _best_groups(df, categories[at:at + MAX_GROUPINGS], at, numbers, top)

    medians = _shown_medians(df, categories, numbers, shown)
    rows = [
        (ci, r["num"], categories[ci], numbers[r["num"]], r["rank"], r["category"], r["mean"],
         medians[(ci, r["num"], r["category"])], r["sum"], r["count"])
        for ci, r in shown
    ]
    return spark.createDataFrame(rows, GROUP_SCHEMA)


def _best_groups(df, categories, first, numbers, top) -> list[tuple]:
    """(place of the category column, row) of the groups with the best means, of all columns."""
    k = len(categories)
    label = [F.col(f"l{i}") for i in range(k)]
    narrow = df.select(
        *[V.native(df, c).alias(f"l{i}") for i, c in enumerate(categories)],
        *[V.as_number(df, n).alias(f"x{i}") for i, n in enumerate(numbers)])
    grouped = narrow.groupingSets([[c] for c in label], *label).agg(
        F.grouping_id().alias("set"), *[
            F.struct(F.lit(i).alias("num"), F.avg(f"x{i}").alias("mean"), F.sum(f"x{i}").alias("sum"),
                     F.count(f"x{i}").alias("count")).alias(f"g{i}") for i in range(len(numbers))])
    # A set's number has a bit for every column it leaves out, the first column's highest.
    mine = [F.col("set") == F.lit((1 << k) - 1 - (1 << (k - 1 - i))) for i in range(k)]
    place = F.coalesce(*[F.when(mine[i] & label[i].isNotNull(), F.lit(i)) for i in range(k)])
    text = F.coalesce(*[F.when(mine[i], V.text_of(label[i], V.family(V.dtype_of(df, c))))
                        for i, c in enumerate(categories)])
    flat = (
        grouped.select(place.alias("cat"), text.alias("category"), *label, F.explode(F.array(
            *[F.col(f"g{i}") for i in range(len(numbers))])).alias("g"))
        .select("cat", "category", *label, "g.*").where(F.col("cat").isNotNull() & (F.col("count") > 0)))
    best = Window.partitionBy("cat", "num").orderBy(F.col("mean").desc(), "category")
    ranked = flat.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return [(first + r["cat"], r.asDict() | {"label": r[f"l{r['cat']}"]}) for r in ranked.collect()]


def _shown_medians(df, categories, numbers, shown):
    """Exact medians of at most `top` groups for each pair of columns."""
    frames, counts, names = [], {}, {}
    for ci, cat in enumerate(categories):
        mine = [r for c, r in shown if c == ci]
        if not mine:
            continue
        label = V.native(df, cat)
        labels = {r["label"]: r["category"] for r in mine}  # at most `top` per number
        place = F.array_position(F.array(*[F.lit(x) for x in labels]), label).cast("int")
        number = {r: i + 1 for i, r in enumerate(labels.values())}
        for category, i in number.items():
            names[(ci, i)] = category
        picked = df.where(label.isin(list(labels))).select(
            place.alias("place"),
            *[V.as_number(df, n).alias(f"x{ni}") for ni, n in enumerate(numbers)])
        cells = []
        for ni in range(len(numbers)):
            wanted = [number[r["category"]] for r in mine if r["num"] == ni]
            cells += [F.lit(ni), F.when(F.col("place").isin(wanted), F.col(f"x{ni}"))]
        frames.append(picked.select(
            F.lit(ci).alias("cat"), "place",
            F.stack(F.lit(len(numbers)), *cells).alias("num", "value")).where(
            F.col("value").isNotNull()))
        counts.update({(ci, r["num"], number[r["category"]]): r["count"] for r in mine})
    if not frames:
        return {}
    found = quantiles.exact_quantiles(
        frequency.union_all(frames), ["cat", "num", "place"], [0.5], counts)
    return {(c, n, names[(c, place)]): q[0] for (c, n, place), q in found.items()}


def crosstab(df: DataFrame, first: str, second: str, rows: int = CROSSTAB_ROWS) -> DataFrame:
    """(cat1, cat2, count) of the value pairs that occur, by value, first rows."""
    a, b = V.native(df, first).alias("a"), V.native(df, second).alias("b")
    pairs = df.select(a, b).where("a is not null and b is not null").groupBy("a", "b").agg(
        F.count("*").alias("count")).orderBy("a", "b").limit(rows)
    return pairs.select(
        V.text_of(F.col("a"), V.family(V.dtype_of(df, first))).alias("cat1"),
        V.text_of(F.col("b"), V.family(V.dtype_of(df, second))).alias("cat2"), "count")
