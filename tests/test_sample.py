"""The whole analysis on the sales sample, against hand-checked values."""

import pytest
from sample import CSV

from gridsight.operators import profile
from gridsight.plans import analyze
from gridsight.sources import catalog, text


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sample") / "sales.csv"
    path.write_text(CSV)
    return text.read_csv(spark, str(path), row_number=True)


@pytest.fixture(scope="module")
def run(table):
    return analyze.analyze(table, row_number=text.ROW_NUMBER)


def rows_of(df, key):
    return {r[key]: r for r in df.collect()}


def test_read_types(table):
    assert dict(table.dtypes) == {
        "Date": "string", "Region": "string", "Product": "string", "Revenue": "double",
        "Quantity": "bigint", "Profit": "double", "Customer_ID": "string", "_row": "bigint"}


def test_profile(table, run):
    assert profile.types_of(run.raw_profile) == {
        "Date": "datetime", "Region": "categorical", "Product": "categorical",
        "Revenue": "numeric", "Quantity": "categorical", "Profit": "numeric",
        "Customer_ID": "id"}
    found = rows_of(run.raw_profile, "column")
    assert [found[c]["null_count"] for c in ("Region", "Revenue", "Profit")] == [5, 5, 0]
    assert found["Date"]["sample_values"][:2] == ["2026-01-01", "2026-01-02"]
    whole = profile.profile_table(table.drop("_row")).first()
    assert tuple(whole) == (103, 7, 10, 3)


def test_clean(run):
    assert run.data.count() == 100
    log = {(r["action"], r["column"]): r for r in run.log.collect()}
    assert log[("drop_duplicates", None)]["affected"] == 3
    assert log[("impute_mode", "Region")]["fill_value"] == "South"
    assert log[("impute_mean", "Revenue")]["fill_value"] == "16535.71"
    outliers = rows_of(run.outliers, "column")
    assert {c: o["count"] for c, o in outliers.items()} == {"Revenue": 3, "Profit": 2}
    assert outliers["Revenue"]["lower_bound"] == pytest.approx(7396.686485)
    assert outliers["Profit"]["upper_bound"] == pytest.approx(3420.567824)


def test_describe(run):
    found = rows_of(run.describe, "column")
    revenue, profit = found["Revenue"], found["Profit"]
    for field, value in {"mean": 16535.708170, "median": 15287.118212, "min": 9037.293256,
                         "max": 95000, "std": 10918.574633, "skewness": 6.244917,
                         "kurtosis": 40.002284}.items():
        assert revenue[field] == pytest.approx(value, rel=1e-6)
    assert profit["kurtosis"] == pytest.approx(40.177117, rel=1e-6)
    assert run.pairs.first()["r"] == pytest.approx(0.997606, abs=1e-6)
    assert run.strong.first()["strength"] == "strong"


def test_groups_and_crosstab(run):
    means = [(r["category"], round(r["mean"], 3), r["count"]) for r in run.groups.collect()
             if r["cat_column"] == "Region" and r["num_column"] == "Revenue"]
    assert means == [("East", 18202.756, 24), ("South", 17252.771, 33),
                     ("North", 16216.359, 19), ("West", 14135.517, 24)]
    cells = {(r["cat1"], r["cat2"]): r["count"] for r in run.crosstab.collect()}
    assert len(cells) == 16
    assert cells[("South", "Tablet")] == 15 and cells[("North", "Laptop")] == 3


def test_trend(run):
    assert run.trends.grain.name == "Monthly"
    sums = {r["date"]: r["sum"] for r in run.trends.periods.collect() if r["metric"] == "Revenue"}
    assert sums == pytest.approx({"2026-01": 608583.130587, "2026-02": 418336.284239,
                                  "2026-03": 472504.416827, "2026-04": 154146.985384})
    assert rows_of(run.trends.growth, "metric")["Revenue"]["growth_pct"] == pytest.approx(
        -74.671170, abs=1e-5)
    peak = rows_of(run.trends.peaks, "metric")["Revenue"]
    assert (peak["peak_date"], peak["low_date"]) == ("2026-01", "2026-04")


def test_kpis(run):
    shown = [(r["name"], r["value"]) for r in run.kpis.orderBy("position").collect()]
    assert shown == [
        ("Total Records", "100"), ("Total Products", "4"), ("Total Revenue", "₹1.65M"),
        ("Average Revenue", "₹16.54K"), ("Total Profit", "₹247.89K"),
        ("Average Profit", "₹2.48K"), ("Total Customers", "100"), ("Total Features", "7")]


def test_insights(run):
    rules = [(r["category"], r["rule_id"]) for r in run.insights.collect()]
    assert ("relationship", "correlation_positive") in rules
    assert rules.count(("business", "investigate_decline")) == 2
    assert ("data_quality", "no_missing") in rules


def test_charts(run):
    data = analyze.chart_data(run)
    bins = [r["count"] for r in data.histograms.collect() if r["column"] == "Revenue"]
    assert len(bins) == 20 and sum(bins) == 100
    assert {r["outliers"] for r in data.boxes.collect()} == {2, 3}
    assert {r["column"] for r in data.bars.collect()} == {"Region", "Product", "Quantity"}


def test_catalog(spark, run, tmp_path):
    path = str(tmp_path / "runs")
    first = analyze.save_run(run, path, "sales.csv", owner="ana")
    analyze.save_run(run, path, "again.csv", owner="ben")
    assert catalog.recent_runs(spark, path).count() == 2
    mine = catalog.recent_runs(spark, path, "ana").collect()
    assert [(r["run_id"], r["record_count"]) for r in mine] == [(first, 100)]
    assert "Total Revenue" in catalog.load_run(spark, path, first).first()["content"]
