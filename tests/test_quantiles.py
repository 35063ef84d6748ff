"""Exact quantiles on every path, with ties, hot groups and missed brackets."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsight.functions import quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(7)
    hot = [42.0] * 4000
    values = hot + list(np.round(rng.lognormal(3, 2, 8000), 3))
    return spark.createDataFrame([(float(v), "a" if i % 3 else "b") for i, v in enumerate(values)],
                                 "x double, g string").repartition(7), values


@pytest.mark.parametrize("limits", [
    {}, {"bracket_limit": 1}, {"bracket_limit": 100}])
def test_column_quantiles(numbers, limits):
    df, values = numbers
    found = quantiles.column_quantiles(df, ["x"], PROBS, **limits)["x"]
    assert found == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-12)


@pytest.mark.parametrize("limits", [{}, {"bracket_limit": 500}])
def test_missed_brackets_are_widened(numbers, monkeypatch, limits):
    df, values = numbers
    monkeypatch.setattr(quantiles, "MARGIN", 0.0)  # brackets of one value each
    sizes = []
    select = quantiles._select
    monkeypatch.setattr(quantiles, "_select", lambda *a: sizes.append(a[2]) or select(*a))
    found = quantiles.column_quantiles(df, ["x"], [0.1, 0.25, 0.5, 0.9], **limits)["x"]
    assert found == pytest.approx(list(np.quantile(values, [0.1, 0.25, 0.5, 0.9])))
    assert 1 < len(sizes) < 5


def test_given_sizes_must_be_right(numbers):
    df, values = numbers
    with pytest.raises(ValueError):
        quantiles.column_quantiles(df, ["x"], [0.5], {"x": len(values) + 1})


@pytest.mark.parametrize("n", [30, 300_000])
def test_infinities(spark, n):
    """One path for every size: a third of the values is infinite."""
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, float("inf")).otherwise(
        F.col("id").cast("double")).alias("x"))
    found = quantiles.column_quantiles(df, ["x"], [0.25, 0.75, 0.9])["x"]
    assert math.isfinite(found[0]) and found[1:] == [math.inf, math.inf]
    low = df.select((-F.col("x")).alias("x"))
    assert quantiles.column_quantiles(low, ["x"], [0.1])["x"] == [-math.inf]


def test_several_columns_and_empty(spark):
    df = spark.createDataFrame([(1.0, None, 5), (2.0, None, 6), (4.0, None, 7)],
                               "a double, b double, c int")
    found = quantiles.column_quantiles(df, ["a", "b", "c"], [0.5])
    assert found == {"a": [2.0], "c": [6.0]}


@pytest.mark.parametrize("buckets", [1, 4, 1024])
def test_grouped_median(numbers, buckets):
    df, _ = numbers
    want = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.median("x").alias("m")).collect()}
    got = {r["g"]: r["m"] for r in
           quantiles.grouped_median(df, ["g"], "x", "m", buckets).collect()}
    assert got == pytest.approx(want)


def test_grouped_median_many_groups(spark):
    df = spark.range(5000).select((F.col("id") % 701).alias("k"), (F.col("id") * 7 % 997)
                                  .cast("double").alias("x"))
    want = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.median("x").alias("m")).collect()}
    got = {r["k"]: r["m"] for r in quantiles.grouped_median(df, ["k"], "x", "m", 64).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("buckets,limit", [(1, 70), (2, 100), (16, 64)])
def test_grouped_median_cuts_wide_ranges_again(spark, buckets, limit):
    """Groups of every parity, in narrow ranges of their own, with a hot and a null group."""
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "hot")
        .otherwise(F.concat(F.lit("g"), (F.col("id") % 5).cast("string"))).alias("k"),
        (F.col("id") % 2).alias("h"),
        (F.xxhash64("id") % 5000 / 7 + (F.col("id") % 5) * 1e6).alias("x"))
    df = df.unionByName(df.orderBy("x").limit(1))
    want = {(r["k"], r["h"]): r["m"] for r in df.groupBy("k", "h").agg(
        F.median("x").alias("m")).collect()}
    got = {(r["k"], r["h"]): r["m"] for r in quantiles.grouped_median(
        df, ["k", "h"], "x", "m", buckets, limit).collect()}
    assert got == pytest.approx(want)


def test_buckets_are_even_and_stable(spark):
    df = spark.range(10_000).withColumn("k", F.col("id").cast("double"))
    sizes = [r["count"] for r in quantiles.bucketed(df, "k", 10).groupBy("bucket").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 1500
    assert math.isclose(sum(sizes), 10_000)
