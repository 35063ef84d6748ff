"""Exact, linearly interpolated quantiles without a single-task value buffer.

Built-in `percentile` keeps every distinct value of a group in one task. Here a
mergeable sketch first brackets the wanted ranks, then only the values inside
the brackets are shuffled. Everything outside a bracket collapses map-side into
one counted marker row, so ranks stay exact and a bracket that missed its rank
is noticed and widened.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsight.functions import values as V
from gridsight.session import stage

# Largest number of bracketed values that one window partition sorts.
BRACKET_LIMIT = 5_000_000
# Sketch size, and the rank margin left around a wanted rank: more than twice the
# sketch's expected rank error of 0.13 %.
SKETCH_SIZE = 4096
MARGIN = 0.003
REFINE_STEPS = 256
EDGE_SKETCH_SIZE = 32_768
# Ranges that one group's middle is cut into at once.
PIECE_STEPS = 64


def _ranks(n: int, probs: Sequence[float]) -> list[tuple[int, int, float]]:
    """(lower rank, upper rank, weight of the upper) per probability, 0-based."""
    out = []
    for p in probs:
        position = p * (n - 1)
        low = math.floor(position)
        out.append((low, min(low + 1, n - 1), position - low))
    return out


def exact_quantiles(
    long: DataFrame,
    groups: Sequence[str],
    probs: Sequence[float],
    counts: dict[tuple, int] | None = None,
    bracket_limit: int = BRACKET_LIMIT,
) -> dict[tuple, list[float]]:
    """Quantiles of `value` for a small, known set of groups.

    `long` holds the group columns and a non-null double `value`; there must be
    one group per analysed column or a few per column, as the answer is
    returned to the caller as {group: [quantiles]}. `counts` gives the group
    sizes when the caller already knows them. A bracket that misses its ranks is
    drawn wider, step by step, and narrowed again while it holds too much.
    """
    groups = list(groups)
    margin = MARGIN
    brackets, seen = _sketch_brackets(long, groups, probs, margin)
    counts = {g: n for g, n in (counts or seen).items() if n > 0}
    if any(seen.get(g) != n for g, n in counts.items()):
        raise ValueError("the given group sizes are not those of the rows")
    answer: dict[tuple, list[float]] = {}
    pending = counts
    while pending:
        brackets = {g: brackets[g] for g in pending}
        expected = max(math.ceil(n * min(1.0, 2 * margin * len(probs))) for n in pending.values())
        while expected > bracket_limit:
            brackets, size = _refine(long, groups, pending, probs, brackets)
            if size >= expected:
                break  # ties only: the values in the bracket collapse to few rows
            expected = size
        answer |= _select(long, groups, pending, probs, brackets)
        pending = {g: n for g, n in pending.items() if g not in answer}
        if pending:
            if margin >= 1:
                raise RuntimeError("the rows changed while their quantiles were sought")
            margin = min(1.0, max(margin * 8, 0.01))
            brackets, _ = _sketch_brackets(long, groups, probs, margin)
    return answer


def _between(low: float, high: float, weight: float) -> float:
    """Linear interpolation that infinities on both sides leave alone."""
    if low == high or weight == 0:
        return low
    if math.isfinite(low):
        return low + (high - low) * weight
    return low if math.isfinite(high) else math.nan


def _sketch_brackets(long, groups, probs, margin):
    """{group: [(low, high) per probability]} and {group: size}, from one sketch per group."""
    points = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-margin, margin)})
    sketches = long.groupBy(*groups).agg(
        F.kll_sketch_agg_double("value", SKETCH_SIZE).alias("s"), F.count("*").alias("n"))
    rows = sketches.select(*groups, "n", F.kll_sketch_get_quantile_double(
        "s", F.array(*[F.lit(p) for p in points])).alias("q")).collect()
    brackets, sizes = {}, {}
    for r in rows:
        at = dict(zip(points, r["q"]))
        g = tuple(r[c] for c in groups)
        brackets[g] = [(at[max(p - margin, 0.0)], at[min(p + margin, 1.0)]) for p in probs]
        sizes[g] = r["n"]
    return brackets, sizes


def _with_brackets(long, groups, brackets):
    """Join lo0, hi0, lo1, .. to the rows: one row per group, so the broadcast is small."""
    width = max(len(bs) for bs in brackets.values())
    schema = T.StructType([long.schema[g] for g in groups] + [
        T.StructField(f"{end}{i}", T.DoubleType()) for i in range(width) for end in ("lo", "hi")])
    rows = [(*g, *[float(x) for b in bs for x in b], *[None] * (2 * (width - len(bs))))
            for g, bs in brackets.items()]
    return long.join(F.broadcast(long.sparkSession.createDataFrame(rows, schema)), groups), width


def _refine(long, groups, counts, probs, brackets):
    """Narrow every bracket to about 1/REFINE_STEPS of its values."""
    steps = F.array(*[F.lit(i / REFINE_STEPS) for i in range(REFINE_STEPS + 1)])
    joined, _ = _with_brackets(long, groups, brackets)
    aggs, grids = [], []
    for i in range(len(probs)):
        inside = (F.col("value") >= F.col(f"lo{i}")) & (F.col("value") <= F.col(f"hi{i}"))
        aggs += [
            F.count_if(F.col("value") < F.col(f"lo{i}")).alias(f"below{i}"),
            F.count_if(inside).alias(f"inside{i}"),
            F.kll_sketch_agg_double(F.when(inside, F.col("value")), SKETCH_SIZE).alias(f"s{i}"),
        ]
        grids += [f"below{i}", f"inside{i}", F.when(
            F.col(f"inside{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", steps))
            .alias(f"q{i}")]
    refined, size = {}, 0
    for r in joined.groupBy(*groups).agg(*aggs).select(*groups, *grids).collect():
        g = tuple(r[c] for c in groups)
        refined[g], here = [], 0
        for i, (low_rank, high_rank, _) in enumerate(_ranks(counts[g], probs)):
            old_low, old_high = brackets[g][i]
            inside, grid = r[f"inside{i}"], r[f"q{i}"]
            if not inside:
                refined[g].append((old_low, old_high))
                continue
            first = math.floor((low_rank - r[f"below{i}"]) / inside * REFINE_STEPS) - 1
            last = math.ceil((high_rank + 1 - r[f"below{i}"]) / inside * REFINE_STEPS) + 1
            refined[g].append((
                old_low if first < 0 else grid[min(first, REFINE_STEPS)],
                old_high if last > REFINE_STEPS else grid[max(last, 0)]))
            here += math.ceil(inside * 4 / REFINE_STEPS)
        size = max(size, here)
    return refined, size


def _merged(intervals):
    """Sorted, non-overlapping intervals."""
    out: list[list[float]] = []
    for low, high in sorted(intervals):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def _select(long, groups, counts, probs, brackets):
    """Exact order statistics inside the brackets, of the groups whose brackets hold them."""
    joined, width = _with_brackets(long, groups, {g: _merged(bs) for g, bs in brackets.items()})
    x = F.col("value")
    # `slot` counts the brackets that start at or below the value; a value in none
    # of them lies in the gap behind the last one that started.
    slot = sum((F.when(x >= F.col(f"lo{i}"), 1).otherwise(0) for i in range(width)), F.lit(0))
    inside = F.lit(False)
    for i in range(width):
        inside = inside | F.coalesce(
            (x >= F.col(f"lo{i}")) & (x <= F.col(f"hi{i}")), F.lit(False))
    located = joined.select(*groups, slot.alias("slot"), inside.alias("inside"),
                            F.when(inside, x).alias("value"))
    wanted = {g: sorted({r for low, high, _ in _ranks(counts[g], probs) for r in (low, high)})
              for g in brackets}
    schema = T.StructType([long.schema[g] for g in groups]
                          + [T.StructField("wanted", T.ArrayType(T.LongType()))])
    table = long.sparkSession.createDataFrame([(*g, w) for g, w in wanted.items()], schema)
    order = [F.col("slot"), F.col("inside").desc(), F.col("value")]
    cumulative = Window.partitionBy(*groups).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = (
        located.groupBy(*groups, "slot", "inside", "value").agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(cumulative))
        .join(F.broadcast(table), groups)
        .withColumn("hits", F.filter("wanted", lambda r: (
            r < F.col("upto")) & (r >= F.col("upto") - F.col("n"))))
        .where(F.size("hits") > 0)
        .select(*groups, "inside", "value", "hits")
    )
    at: dict[tuple, dict[int, float]] = {g: {} for g in brackets}
    for r in placed.collect():
        if r["inside"]:
            at[tuple(r[c] for c in groups)].update({rank: r["value"] for rank in r["hits"]})
    return {
        g: [_between(at[g][low], at[g][high], weight)
            for low, high, weight in _ranks(counts[g], probs)]
        for g in brackets if len(at[g]) == len(wanted[g])}


def column_quantiles(df: DataFrame, names: Sequence[str], probs: Sequence[float],
                     counts: dict[str, int] | None = None, **limits) -> dict[str, list[float]]:
    """Exact quantiles of several numeric columns: {column: [quantiles]}."""
    names = list(names)
    if not names:
        return {}
    keyed = None if counts is None else {(i,): counts[c] for i, c in enumerate(names)}
    found = exact_quantiles(V.numbers_long(df, names), ["pos"], probs, keyed, **limits)
    return {names[g[0]]: q for g, q in sorted(found.items())}


def _edges(df: DataFrame, key: str, buckets: int) -> tuple[list[float], int | None]:
    """(edges of even ranges of a numeric key, number of keys if they were counted)."""
    if buckets < 2:
        return [], None
    steps = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    sketch = df.where(F.col(key).isNotNull()).agg(
        F.kll_sketch_agg_double(key, EDGE_SKETCH_SIZE).alias("s"), F.count(key).alias("n"))
    found = sketch.select("n", F.when(
        F.col("n") > 0, F.kll_sketch_get_quantile_double("s", steps)).alias("q")).first()
    return sorted({e for e in found["q"] or [] if math.isfinite(e)}), found["n"]


def _cut(df: DataFrame, key: str, edges: list[float], output: str) -> DataFrame:
    splits = [-math.inf, *edges, math.inf]
    if len(splits) < 3:  # nothing to cut
        return df.withColumn(output, F.lit(0))
    placed = Bucketizer(splits=splits, inputCol=key, outputCol=output,
                        handleInvalid="keep").transform(df)
    return placed.withColumn(output, F.coalesce(F.col(output).cast("int"), F.lit(-1)))


def bucketed(df: DataFrame, key: str, buckets: int, output: str = "bucket") -> DataFrame:
    """Assign every row to one of at most `buckets` even ranges of a numeric key.

    The edges come from a mergeable sketch and are literals afterwards, so a
    recomputed partition puts its rows into the same buckets. Rows without a
    key form bucket -1.
    """
    return _cut(df, key, _edges(df, key, buckets)[0], output)


def grouped_median(df: DataFrame, keys: Sequence[str], value: str, output: str,
                   buckets: int = 1024, limit: int = BRACKET_LIMIT) -> DataFrame:
    """Exact median of `value` for any number of groups, hot groups included.

    Values are counted per (group, value), counts are added up per value range,
    and only the ranges holding a middle rank are sorted. A range of more than
    `limit` values is cut by its own quantiles first, again and again, so no
    window partition grows with the group.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("__v"))
    edges, size = _edges(rows, "__v", buckets)
    counted = (
        _cut(rows, "__v", edges, "__b")
        .groupBy(*keys, F.lit(0).alias("__p"), "__b", "__v").agg(F.count("*").alias("__n")))
    open_ended = size is None or size > limit
    if open_ended:
        counted = stage(counted, "median-counts")
    total = F.sum("__in").over(Window.partitionBy(*keys))
    middle = _middle_ranges(counted, keys, F.floor((total - 1) / 2), F.ceil((total - 1) / 2))
    found = []
    while open_ended:
        middle = stage(middle, "median-ranges")
        wide = F.col("__values") > limit
        if middle.where(wide).isEmpty():
            break
        found.append(_middle_values(counted, middle.where(~wide), keys))
        counted = stage(_cut_again(_inside(counted, middle.where(wide), keys), keys),
                        "median-counts")
        middle = _middle_ranges(counted, keys, F.col("__piece_low"), F.col("__piece_high"))
    found.append(_middle_values(counted, middle, keys))
    return reduce(DataFrame.unionByName, found).groupBy(*keys).agg(
        ((F.max("__low_v") + F.max("__high_v")) / 2).alias(output))


def _middle_ranges(counted, keys, low, high):
    """The ranges that hold a middle rank, with the ranks counted from their own start.

    A group has one piece, or two: 0 with the lower middle rank, 1 with the upper one only.
    """
    by_range = Window.partitionBy(*keys, "__p").orderBy("__b").rowsBetween(
        Window.unboundedPreceding, -1)
    carried = [F.max(c).alias(c) for c in ("__piece_low", "__piece_high") if c in counted.columns]
    ranges = (
        counted.groupBy(*keys, "__p", "__b")
        .agg(F.sum("__n").alias("__in"), F.count("*").alias("__values"), *carried)
        .withColumn("__before", F.coalesce(F.sum("__in").over(by_range), F.lit(0)))
        .withColumn("__low", low - F.col("__before")).withColumn("__high", high - F.col("__before")))

    def here(rank: str):
        return F.when((F.col(rank) >= 0) & (F.col(rank) < F.col("__in")), F.col(rank))

    return ranges.withColumn("__low", here("__low")).withColumn("__high", here("__high")).where(
        F.coalesce("__low", "__high").isNotNull()).select(
        *keys, "__p", "__b", "__values", "__low", "__high")


def _inside(counted, middle, keys):
    """The counted values of the given ranges, with the ranks wanted of them."""
    at = [*keys, "__p", "__b"]
    renamed = middle.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(at)],
                            "__low", "__high")
    match = F.lit(True)
    for i, k in enumerate(at):
        match = match & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return counted.select(*at, "__v", "__n").join(renamed, match).select(
        *at, "__v", "__n", "__low", "__high")


def _middle_values(counted, middle, keys):
    """(keys, lower middle value, upper middle value) of the given ranges."""
    upto = F.sum("__n").over(Window.partitionBy(*keys, "__p", "__b").orderBy("__v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    placed = _inside(counted, middle, keys).withColumn("__upto", upto)

    def at(rank: str):
        return F.max(F.when((F.col(rank) >= F.col("__upto") - F.col("__n"))
                            & (F.col(rank) < F.col("__upto")), F.col("__v")))

    return placed.groupBy(*keys).agg(at("__low").alias("__low_v"), at("__high").alias("__high_v"))


def _cut_again(cells, keys):
    """Every wide range as a piece of its own, cut into PIECE_STEPS ranges by its quantiles."""
    pieces = cells.withColumn("__p", F.when(F.col("__low").isNotNull(), 0).otherwise(1)).drop("__b")
    at = [*keys, "__p"]
    steps = F.array(*[F.lit(i / PIECE_STEPS) for i in range(1, PIECE_STEPS)])
    edges = pieces.groupBy(*at).agg(F.kll_sketch_agg_double("__v", SKETCH_SIZE).alias("s")).select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(at)],
        F.kll_sketch_get_quantile_double("s", steps).alias("__edges"))
    match = F.lit(True)
    for i, k in enumerate(at):
        match = match & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return pieces.join(edges, match).select(
        *at, F.size(F.filter("__edges", lambda e: e <= F.col("__v"))).alias("__b"), "__v", "__n",
        F.col("__low").alias("__piece_low"), F.col("__high").alias("__piece_high"))
