"""Edge cases and properties of single operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridsight.functions import dates, money
from gridsight.functions import values as V
from gridsight.operators import (
    alerts, charts, clean, describe, explore, insights, kpi, profile, timeseries)

STAMP = dt.datetime(2020, 1, 1)


def cells(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- profile --------------------------------------------------------------------------------

def types(df, **options):
    return profile.types_of(profile.profile_columns(df, **options))


def test_types(spark):
    df = spark.createDataFrame(
        [(i, None, i % 2, "yes" if i % 2 else "no", f"2020-01-{i % 28 + 1:02d}", float(i) / 7,
          f"word {i}", "x" if i % 3 else "y", i if i else None, bool(i % 2), 2000 + i)
         for i in range(40)],
        "row_no long, nothing string, flag int, answer string, start string, amount double, "
        "note string, kind string, gap long, truth boolean, birth_year long")
    found = types(df)
    assert found == {
        "row_no": "id", "nothing": "empty", "flag": "boolean", "answer": "boolean",
        "start": "datetime", "amount": "numeric", "note": "text", "kind": "categorical",
        "gap": "numeric", "truth": "boolean", "birth_year": "id"}
    assert types(df, string_unique_is_id=True)["note"] == "id"
    assert types(df, approx=True) == found


def test_numeric_dates_option(spark):
    df = spark.createDataFrame([(2000 + i % 12,) for i in range(40)], "sales_year long")
    assert types(df) == {"sales_year": "numeric"}
    assert types(df, numeric_dates=True) == {"sales_year": "datetime"}


def test_sparse_column_sample(spark):
    df = spark.range(2000).select(
        "id", F.when(F.col("id") >= 1990, F.concat(F.lit("2020-01-"), F.lpad(
            (F.col("id") - 1980).cast("string"), 2, "0"))).alias("start")).coalesce(1)
    row = profile.profile_columns(df).where("column = 'start'").first()
    assert row["inferred_type"] == "datetime" and row["sample_values"][0] == "2020-01-10"


def test_profile_nan_and_empty_table(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")
    row = profile.profile_columns(df).first()
    assert (row["null_count"], row["unique_count"]) == (2, 1)
    empty = df.limit(0)
    assert profile.profile_columns(empty).first()["inferred_type"] == "empty"
    assert tuple(profile.profile_table(empty).first()) == (0, 1, 0, 0)


def test_long_texts_count_exactly(spark):
    long = "a" * 100
    df = spark.createDataFrame([(long + "1",), (long + "2",), (long + "1",), ("b",)], "t string")
    assert profile.column_stats(df).first()["unique_count"] == 3


# --- clean ----------------------------------------------------------------------------------

@pytest.mark.parametrize("partitions", [1, 7, 50])
def test_fill_forward_any_partitioning(spark, partitions):
    base = spark.range(500).select(
        F.col("id").alias("k"),
        F.when((F.col("id") > 20) & (F.col("id") % 7 == 0), F.col("id")).alias("v"))
    want = [max(21, k - k % 7) for k in range(500)]
    for ranges in (1, 9):
        df = base.repartition(partitions)
        filled = clean.fill_forward_backward(df, ["v"], "k", ranges)
        assert [r["v"] for r in filled.orderBy("k").collect()] == want
        again = clean.fill_forward_backward(filled, ["v"], "k", ranges)
        assert cells(again) == cells(filled)


def test_fill_forward_empty_ranges_and_all_null(spark):
    df = spark.range(100).select(
        F.col("id").alias("k"), F.when(F.col("id") == 50, F.lit("x")).alias("a"),
        F.lit(None).cast("string").alias("b"))
    filled = clean.fill_forward_backward(df, ["a", "b"], "k", 10).collect()
    assert {r["a"] for r in filled} == {"x"} and {r["b"] for r in filled} == {None}


def test_drop_duplicates(spark, monkeypatch):
    rows = [(1, "a", None), (1, "a", None), (2, None, 1.0), (2, None, 1.0), (3, "c", 2.0)]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    once = clean.drop_duplicates(df)
    assert once.count() == 3 and cells(clean.drop_duplicates(once)) == cells(once)
    numbered = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)],
                                     "a int, b string, c double, n long")
    kept = clean.drop_duplicates(numbered, "n")
    assert sorted(r["n"] for r in kept.collect()) == [0, 2, 4]
    # The same rows where Spark has to shuffle both sides.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert cells(clean.drop_duplicates(df)) == cells(once)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert profile.profile_table(df).first()["duplicate_count"] == 2


@pytest.mark.parametrize("how,fill", [("mean", 4.0), ("median", 2.5), ("disabled", None)])
def test_clean_strategies(spark, how, fill):
    df = spark.createDataFrame(
        [(i, v, w, d) for i, (v, w, d) in enumerate(
            [(1.0, "p", "2020-01-01"), (2.0, "q", None), (3.0, None, "2020-01-03"),
             (10.0, "q", "2020-01-04"), (None, "p", "2020-01-05")])],
        "order_id int, amount double, kind string, day string")
    found = profile.profile_columns(df).withColumn("inferred_type", F.when(
        F.col("column") == "amount", "numeric").otherwise(F.col("inferred_type")))
    done = clean.clean(df, found, how, order_by="order_id")
    rows = {r["order_id"]: r for r in done.data.collect()}
    assert rows[4]["amount"] == fill
    assert rows[2]["kind"] == "p"  # tie goes to the smaller value
    assert rows[1]["day"] == "2020-01-01"


def test_clean_unknown_and_empty_column(spark):
    df = spark.createDataFrame([(1, None, None), (2, "n1", None), (None, "n2", None)],
                               "item_id int, note_id string, nothing string")
    done = clean.clean(df, profile.profile_columns(df))
    assert cells(done.data) == [("1", "Unknown", "Unknown"), ("2", "n1", "Unknown"),
                                ("Unknown", "n2", "Unknown")]
    assert {r["action"] for r in done.log.collect()} == {"fill_unknown", "warn_empty"}
    with pytest.raises(ValueError):
        clean.clean(df, profile.profile_columns(df), "guess")


def test_outliers_need_strict_excess(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "x double")
    row = clean.outlier_profile(df, ["x"]).first()
    assert (row["count"], row["upper_bound"], row["pct"]) == (1, 7.0, 20.0)
    assert clean.outlier_profile(df, ["x"], 1000.0).count() == 0
    assert clean.flag_outliers(df.limit(0), "x").count() == 0


# --- describe -------------------------------------------------------------------------------

def test_describe_edges(spark):
    one = spark.createDataFrame([(5.0, None)], "a double, b double")
    row = describe.numeric_describe(one, ["a", "b"]).collect()
    assert len(row) == 1
    assert (row[0]["std"], row[0]["skewness"], row[0]["mode"], row[0]["q25"]) == (0, 0, 5, 5)
    same = spark.createDataFrame([(5.0,)] * 4, "a double")
    assert describe.numeric_describe(same, ["a"]).first()["skewness"] is None
    assert describe.numeric_describe(same, []).count() == 0


def test_distribution_adds_up(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") % 10 != 3, F.col("id") % 37).alias("v"), (F.col("id") % 2 == 0)
        .alias("t"))
    rows = describe.value_distribution(df, ["v", "t"]).collect()
    by = {c: [r for r in rows if r["column"] == c] for c in ("v", "t")}
    assert len(by["v"]) == 11 and {r["value"] for r in by["t"]} == {"True", "False"}
    assert by["v"][0]["value"] == "Missing" or "Missing" in {r["value"] for r in by["v"]}
    for c in by:
        assert sum(r["count"] for r in by[c]) == 1000
        assert sum(r["pct"] for r in by[c]) == pytest.approx(100)


def test_correlation_matrix(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0, None), (2.0, 4.0, 7.0, 1.0), (3.0, 6.5, 7.0, 0.0)],
                               "a double, b double, c double, d double")
    rows = describe.correlation_matrix(df, ["a", "b", "c", "d"]).collect()
    r = {(x["col1"], x["col2"]): x["r"] for x in rows}
    assert len(r) == 16 and all(r[a, b] == r[b, a] for a, b in r)
    assert r["a", "a"] == 1 and r["c", "c"] == 0 and r["a", "c"] == 0
    assert r["a", "d"] == pytest.approx(-1)


def test_many_pairs_are_split(spark):
    names = [f"c{i}" for i in range(13)]
    df = spark.range(50).select(*[(F.rand(i) + F.col("id") * i).alias(n)
                                  for i, n in enumerate(names)])
    assert describe.pair_correlations(df, names).count() == 78


def test_group_stats_drop_empty_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 9.0), ("c", 2.0)],
                               "k string, x double")
    rows = describe.group_stats(df, ["k"], ["x"]).collect()
    assert [(r["category"], r["mean"], r["median"], r["count"]) for r in rows] == [
        ("a", 2.0, 2.0, 2), ("c", 2.0, 2.0, 1)]
    assert describe.group_stats(df, [], ["x"]).count() == 0


# --- time -----------------------------------------------------------------------------------

def test_grain_counts_whole_days(spark):
    def grain(days, hours=0):
        df = spark.createDataFrame([(STAMP,), (STAMP + dt.timedelta(days=days, hours=hours),)],
                                   "t timestamp_ntz")
        return timeseries.choose_grain(df, "t").name

    assert [grain(90), grain(90, 23), grain(91), grain(1095), grain(1096)] == [
        "Daily", "Daily", "Monthly", "Monthly", "Yearly"]
    assert timeseries.choose_grain(
        spark.createDataFrame([(None,)], "t timestamp_ntz"), "t") is None


def test_resample_drops_empty_periods(spark):
    df = spark.createDataFrame(
        [("2020-01-05", 2.0), ("2020-01-07", 3.0), ("2020-03-01", None), ("2020-04-01", 0.0),
         ("bad", 100.0)], "day string, x double")
    periods = timeseries.resample(df, "day", ["x"], timeseries.MONTHLY)
    assert cells(periods.select("date", "sum", "count")) == [
        ("2020-01", 5.0, 2), ("2020-04", 0.0, 1)]
    assert timeseries.growth(periods).first()["growth_pct"] == -100
    zero = periods.withColumn("sum", F.lit(0.0))
    assert timeseries.growth(zero).first()["growth_pct"] == 0
    assert timeseries.peak_and_low(zero).first()["low_date"] == "2020-01"
    averages = [r["moving_average"] for r in
                timeseries.moving_average(periods).orderBy("period").collect()]
    assert averages == [None, 2.5]


@pytest.mark.parametrize("ranges", [1, 7, 200])
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_fill_forward_in_any_zone(spark, ranges, zone):
    """Keys around a skipped hour keep their order, whatever the number of ranges."""
    rows = [(dt.datetime(2021, 3, 14, 1, 0) + dt.timedelta(minutes=5 * i), i if i % 9 == 4 else None)
            for i in range(60)]
    want, last = [], 4
    for _, v in rows:
        last = v if v is not None else last
        want.append(last)
    df = spark.createDataFrame(rows, "t timestamp_ntz, v int").repartition(5)
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        filled = clean.fill_forward_backward(df, ["v"], "t", ranges).orderBy("t")
        assert [r["v"] for r in filled.collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_one_bad_cell_settles_the_type(spark):
    """All cells decide on dates, in any row order."""
    good = [(i, f"2020-01-{1 + i % 28:02d}") for i in range(200)]
    for rows in (good[:-1] + [(199, "no date")], [(0, "no date")] + good[1:]):
        df = spark.createDataFrame(rows, "id int, t string").coalesce(1)
        kinds = {r["column"]: r["inferred_type"] for r in profile.profile_columns(df).collect()}
        assert kinds["t"] != "datetime"
    kinds = {r["column"]: r["inferred_type"] for r in
             profile.profile_columns(spark.createDataFrame(good, "id int, t string")).collect()}
    assert kinds["t"] == "datetime"


def test_date_layouts(spark):
    df = spark.createDataFrame(
        [("01-02-2010", "3 Mar 2020", "20200131"), ("13-02-2010", "x", "20201301")],
        "a string, b string, c string")
    assert dates.choose_format(df, "a") == "day-month-year"
    first = df.limit(1)
    assert dates.choose_format(first, "a") == "month-day-year"
    got = df.select(dates.as_timestamp(df, "a").alias("a"), dates.as_timestamp(df, "b").alias("b"),
                    dates.as_timestamp(df, "c").alias("c")).collect()
    assert got[0]["a"] == dt.datetime(2010, 2, 1) and got[1]["a"] == dt.datetime(2010, 2, 13)
    assert got[0]["b"] == dt.datetime(2020, 3, 3) and got[1]["b"] is None
    assert got[0]["c"] == dt.datetime(2020, 1, 31) and got[1]["c"] is None


# --- figures --------------------------------------------------------------------------------

def test_kpi_terms():
    assert kpi.match_columns(["Order_Date", "Total_Sales", "sales", "my_user", "unitsold"]) == {
        "orders": "Order_Date", "revenue": "sales", "customers": "my_user"}


def test_kpi_only_numeric_sums(spark):
    df = spark.createDataFrame([("x", 1.0)], "revenue string, other double")
    names = [r["name"] for r in kpi.kpis(df, {"revenue": "text", "other": "numeric"}).collect()]
    assert names == ["Total Records", "Average other", "Total Features"]


def test_money(spark):
    amounts = [0.0, -5.0, 999.994, 1000.0, -2_500_000.0, 3.2e9]
    want = ["₹0.00", "-₹-5.00", "₹999.99", "₹1.00K", "-₹2.50M", "₹3.20B"]
    df = spark.createDataFrame([(a,) for a in amounts], "a double")
    assert [r[0] for r in df.select(money.money(F.col("a"))).collect()] == want
    assert [money.money_text(a) for a in amounts] == want


def test_default_insights(spark):
    rows = insights.insights(spark, insights.Statistics()).collect()
    assert [(r["category"], r["rule_id"]) for r in rows] == [
        ("data_quality", "no_missing"), ("data_quality", "no_outliers"), ("trend", "no_trend"),
        ("relationship", "no_correlation"), ("business", "default_strategy")]


# --- explore --------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def keyed(spark):
    return spark.range(6000).select(
        (F.col("id") * 3).alias("k"), F.format_string("name %05d", F.col("id")).alias("name"),
        (F.col("id") % 4).alias("g")).repartition(9)


@pytest.mark.parametrize("key", ["k", "name"])
def test_pages_any_depth(keyed, key):
    for page in (0, 3, 150, 400, 599):
        rows = explore.page_rows(keyed, key, page, 10).collect()
        assert [r["k"] for r in rows] == [3 * i for i in range(page * 10, page * 10 + 10)]
    assert explore.page_rows(keyed, key, 600, 10).count() == 0
    assert explore.page_rows(keyed, key, 100_000, 10).count() == 0
    after = explore.page_after(keyed, key, explore.page_rows(keyed, key, 0, 10).collect()[-1][key])
    assert [r["k"] for r in after.collect()] == [3 * i for i in range(10, 20)]


def test_page_search_narrows(keyed):
    keys = keyed.select(F.col("k"))
    start, offset = explore.first_key_near(keys, 5432, ranges=4, near=10)
    assert offset <= 10 and start + 3 * offset == 3 * 5432


@pytest.mark.parametrize("key", [
    "CAST(k AS DECIMAL(20, 3))", "timestamp_seconds(k * 86400)",
    "CAST(timestamp_seconds(k * 86400) AS TIMESTAMP_NTZ)",
    "date_add(DATE'1999-12-31', CAST(k AS INT))", "CAST(name AS BINARY)",
    "CASE WHEN k = 17997 THEN CAST('nan' AS DOUBLE) WHEN k = 0 THEN CAST('-inf' AS DOUBLE) ELSE k / 7 END"])
def test_pages_of_any_key_type(keyed, key):
    rows = keyed.select(F.expr(key).alias("key"), "k")
    for page in (0, 250, 599):
        found = explore.page_rows(rows, "key", page, 10).collect()
        assert [r["k"] for r in found] == [3 * i for i in range(page * 10, page * 10 + 10)]


def test_pages_of_repeated_keys_end(spark):
    rows = spark.range(5000).select(F.lit(7).alias("k"))
    assert explore.first_key_near(rows, 4000, near=10) == (7, 4000)
    assert explore.first_key_near(rows, 5000, near=10) == (None, None)


def test_sample_is_stable(keyed):
    one = explore.column_sample(keyed, "name", "k", 100)
    two = explore.column_sample(keyed.repartition(3), "name", "k", 100)
    assert [tuple(r) for r in one.collect()] == [tuple(r) for r in two.collect()]
    assert explore.column_sample(keyed, "name", "k", 100_000).count() == 6000
    whole = keyed.orderBy(explore.sample_order(F.col("k"))).limit(100)
    assert {r["k"] for r in whole.collect()} == {r["row_key"] for r in one.collect()}


def test_search(keyed):
    assert explore.search_rows(keyed, "NAME 0000[12]").count() == 2
    assert explore.search_rows(keyed, "0000[12]", regex=False).count() == 0
    assert explore.search_rows(keyed, " ").count() == 6000
    total, page = explore.preview(keyed, "k", 2, 10, "name 00[0-4]")
    assert total == 500 and [r["k"] for r in page.collect()] == [3 * i for i in range(20, 30)]


def test_pivot_axes(spark):
    df = spark.createDataFrame(
        [("a", "x", 1.0), ("a", "y", None), ("b", "x", 3.0), (None, "x", 9.0), ("c", "z", None),
         ("b", None, 5.0)], "r string, c string, v double")
    assert explore.pivot(df, "r", "c", "v", "mean").collect() == [("a", 1.0), ("b", 3.0)]
    summed = explore.pivot(df, "r", "c", "v")
    assert summed.columns == ["r", "x", "y", "z"]
    assert [tuple(r) for r in summed.collect()] == [
        ("a", 1.0, 0.0, 0.0), ("b", 3.0, 0.0, 0.0), ("c", 0.0, 0.0, 0.0)]
    assert explore.pivot(df, "r", "c", "v", "std").collect() == []
    with pytest.raises(ValueError):
        explore.pivot(df, "r", "c", "v", "product")


def test_facets(spark):
    df = spark.createDataFrame(
        [("a", 1, 2.0), ("Unknown", 2, None), ("b", 1, 4.0), (None, 1, 6.0)],
        "k string, g int, x double")
    values = explore.facet_values(df, {"k": 4, "g": 2})
    assert cells(values.select("column", "value")) == [("g", "1"), ("g", "2"), ("k", "a"), ("k", "b")]
    kpis = explore.facet_kpis(df, {}, [("x", "business_avg"), ("k", "business_count")])
    assert {r["column"]: r["value"] for r in kpis.collect()} == {"N/A": 4.0, "x": 3.0, "k": 4.0}
    assert explore.facet_filter(df, {"g": "1", "k": "b"}).count() == 1
    assert explore.facet_filter(df, {"g": "one"}).count() == 0


def test_facet_filter_is_pushed_down(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = explore.facet_filter(df, {"l_linenumber": "3"}).select("l_orderkey")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_linenumber,3)" in plan


# --- charts ---------------------------------------------------------------------------------

def test_histogram(spark):
    df = spark.createDataFrame([(0.0, 5.0), (0.5, 5.0), (10.0, 5.0), (None, 5.0)], "a double, b double")
    rows = charts.histogram(df, ["a", "b"]).collect()
    a = {r["bin"]: r["count"] for r in rows if r["column"] == "a"}
    b = {r["bin"]: r["count"] for r in rows if r["column"] == "b"}
    assert len(a) == 20 and a[1] == 1 and a[2] == 1 and a[20] == 1 and sum(a.values()) == 3
    assert b[11] == 4 and sum(b.values()) == 4


def test_meaningful_names(spark):
    rows = [(i, c, "numeric", 20) for i, c in enumerate(
        ["amount", "zip code", "phone_home", "paid", "no", "total no", "notes", "day_of"])]
    found = spark.createDataFrame(
        rows, "position int, column string, inferred_type string, unique_count int")
    assert [r["column"] for r in charts.meaningful_columns(found).collect()] == [
        "amount", "paid", "notes"]


# --- alerts ---------------------------------------------------------------------------------

def test_alert_store_and_messages(spark, tmp_path):
    path = str(tmp_path / "rules")
    alerts.add_rule(spark, path, "ana", 1, "x", ">", 2.0)
    alerts.add_rule(spark, path, "ana", 2, "x", "=", 1.0, "null_count", "critical")
    alerts.add_rule(spark, path, "ben", 1, "x", "<", 0.0)
    alerts.add_rule(spark, path, "ana", 3, "gone", "<", 0.0)
    alerts.delete_rule(spark, path, "ben", 1)
    rules = alerts.list_rules(spark, path, "ana")
    assert rules.count() == 3 and alerts.list_rules(spark, path, "ben").count() == 0
    df = spark.createDataFrame([(1234.5,), (2000.0,), (None,)], "x double")
    messages = {r["id"]: r["message"] for r in alerts.evaluate(df, rules).collect()}
    assert messages == {
        1: "WARNING: Mean of 'x' is 1,617.25, breaching threshold of > 2.00",
        2: "CRITICAL: Null count of 'x' is 1, breaching threshold of = 1.00"}
    with pytest.raises(ValueError):
        alerts.add_rule(spark, path, "ana", 4, "", "<", 1.0)


def test_text_of_numbers(spark):
    values = [1e7, 1234567.5, 123456789.25, 0.00012, -0.0, 1e20, 2.0, 1e-5]
    df = spark.createDataFrame([(v,) for v in values], "a double")
    assert [r[0] for r in df.select(V.as_text(df, "a").alias("t")).collect()] == [
        "10000000.0", "1234567.5", "123456789.25", "0.00012", "0.0", "1.0E20", "2.0", "1.0E-5"]


def test_wide_correlations_take_one_scan(spark):
    """63 columns with gaps and a large offset, against pandas."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 63)) + rng.normal(size=(500, 1)) + 1e6
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 62] = 5.0
    table = pd.DataFrame(x, columns=[f"c{i}" for i in range(63)])
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x],
                               ", ".join(f"c{i} double" for i in range(63))).repartition(5)
    pairs = describe.pair_correlations(df, df.columns)
    want = table.corr().to_numpy()
    rows = pairs.collect()
    assert len(rows) == 63 * 62 // 2
    for r in rows:
        assert r["r"] is None if 62 in (r["p1"], r["p2"]) else abs(r["r"] - want[r["p1"], r["p2"]]) < 1e-9
    described = describe.correlation_matrix(df, df.columns)
    assert "Arrow" not in described._jdf.queryExecution().optimizedPlan().toString()


def test_infinite_cells_have_no_correlation(spark):
    """They are left out like missing ones, pair by pair; what is undefined is 0 and not strong."""
    import numpy as np
    import pandas as pd

    inf, nan = float("inf"), float("nan")
    rows = [(1.0, 2.0, inf, 3.0, nan), (2.0, 4.0, -inf, 3.0, 1.0), (inf, 7.0, 1.0, 3.0, 2.0),
            (3.0, None, 2.0, -inf, 5.0), (5.0, 2.0, 4.0, 3.0, inf), (-inf, inf, 9.0, 3.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    want = pd.DataFrame(rows, columns=df.columns).astype(float).corr().fillna(0.0)
    got = {(r["col1"], r["col2"]): r["r"] for r in describe.correlation_matrix(df, df.columns).collect()}
    for (a, b), r in got.items():
        assert r == pytest.approx(want.loc[a, b], abs=1e-12), (a, b)
    strong = describe.strong_pairs(describe.pair_correlations(df, df.columns)).collect()
    assert {(r["col1"], r["col2"]) for r in strong} == {
        (a, b) for a in want for b in want if a < b and abs(want.loc[a, b]) >= 0.4}
    assert all(np.isfinite(r["r"]) for r in strong)


def test_fill_forward_moves_only_what_it_fills(spark):
    """Other columns are read once; the fills are looked up by a broadcast of the gap rows."""
    df = spark.range(300).select(
        F.col("id").alias("k"), F.when(F.col("id") % 50 != 3, F.col("id")).alias("v"),
        F.repeat(F.lit("x"), 50).alias("wide"))
    filled = clean.fill_forward_backward(df, ["v"], "k", 4)
    assert filled.columns == df.columns and filled.count() == 300
    assert {r["k"]: r["v"] for r in filled.where(F.col("k") % 50 == 3).collect()} == {
        k: k - 1 for k in range(3, 300, 50)}
    plan = filled._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    # The same rows where Spark has to shuffle both sides, and with most cells missing.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sparse = df.withColumn("v", F.when(F.col("k") % 100 == 10, F.col("k")))
        got = clean.fill_forward_backward(sparse, ["v"], "k", 4).orderBy("k").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [r["v"] for r in got] == [max(10, (k - 10) // 100 * 100 + 10) for k in range(300)]


def test_fill_ranges_are_bounded():
    assert [clean._ranges(n) for n in (0, 1, 1_000_001, 10 ** 12)] == [1, 1, 2, clean.MOST_RANGES]


def test_sparse_columns_share_one_pass(spark):
    """The jobs of a profile do not depend on the number of sparse columns."""
    def sparse(columns):
        return spark.range(0, 2000, numPartitions=3).select("id", *[
            F.when(F.col("id") >= 1000 + 100 * i, F.col("id")).alias(f"c{i}") for i in range(columns)])

    def jobs(df, group):
        spark.sparkContext.setJobGroup(group, group)
        rows = {r["column"]: r["sample_values"]
                for r in profile.profile_columns(df, ["id"], columns=df.columns[1:]).collect()}
        return rows, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few, one = jobs(sparse(1), "sparse-1")
    many, eight = jobs(sparse(8), "sparse-8")
    spark.sparkContext.setJobGroup("", "")
    assert many == {f"c{i}": [str(1000 + 100 * i + j) for j in range(10)] for i in range(8)}
    assert few["c0"] == many["c0"] and one == eight


def test_pivot_wider_than_sparks_limit(spark):
    spark.conf.set("spark.sql.pivotMaxValues", "10")
    try:
        df = spark.range(60).select((F.col("id") % 2).alias("r"), (F.col("id") % 30).alias("c"),
                                    F.when(F.col("id") % 30 != 7, F.col("id")).alias("x"))
        with pytest.raises(ValueError, match="pivot_cells"):
            explore.pivot(df, "r", "c", "x")
        got = {(r["row"], r["column"]): r["cell"]
               for r in explore.pivot_cells(df, "r", "c", "x", "max").collect()}
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")
    assert got == {(c % 2, c): c + 30 for c in range(30) if c != 7}


def test_histogram_counts_a_value_on_an_edge_in_the_bin_that_it_opens(spark):
    # 525.16 is the low end of bin 4: by division it would be in bin 3.
    df = spark.createDataFrame([(492.13,), (525.16,), (712.33,)], "x double")
    rows = charts.histogram(df, ["x"]).orderBy("bin").collect()
    assert [r["bin"] for r in rows if r["count"]] == [1, 4, 20]
    assert rows[3]["low"] == 525.16 and rows[2]["high"] == 525.16
    wide = spark.createDataFrame([(-999.85 + i / 100,) for i in range(4001)], "x double")
    for r in charts.histogram(wide, ["x"]).collect():
        inside = (F.col("x") >= r["low"]) & (F.col("x") <= r["high"] if r["bin"] == 20 else F.col("x") < r["high"])
        assert wide.where(inside).count() == r["count"]
    gaps = spark.createDataFrame([(float("inf"),), (1.0,)], "x double")
    assert charts.histogram(gaps, ["x"]).agg(F.sum("count")).first()[0] == 0
