"""Awkward column names and partitionings go through the whole analysis."""

import pytest
from pyspark.sql import functions as F

from gridsight.operators import explore, ml
from gridsight.plans import analyze
from gridsight.sources import text

LINES = ["unit.price,unit.price,order date,a`b,group.name"] + [
    f"{i * 3 % 41 + 0.5},{i % 17 if i % 5 else ''},2020-{i % 12 + 1:02d}-{i % 28 + 1:02d},"
    f"{i % 3},g{i % 4 if i % 7 else ''}" for i in range(300)]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("names") / "t.csv"
    path.write_text("\n".join(LINES) + "\n")
    return text.read_csv(spark, str(path), row_number=True)


def test_dotted_names(table):
    run = analyze.analyze(table, row_number="_row")
    assert [r["column"] for r in run.describe.collect()] == ["unit.price", "unit.price.1"]
    assert run.data.where("`unit.price.1` is null").count() == 0
    assert {r["cat_column"] for r in run.groups.collect()} == {"a`b", "group.name"}
    assert run.trends.date_column == "order date"
    charts = analyze.chart_data(run)
    assert charts.histograms.count() == 0  # no business figure among the numbers
    assert explore.pivot(run.data, "group.name", "a`b", "unit.price").columns == [
        "group.name", "0", "1", "2"]
    trained, _ = ml.train(run.data, "unit.price", ["a`b", "group.name", "order date"], trees=3,
                          depth=4)
    assert ml.score(trained, run.data).count() == run.data.count()


@pytest.mark.parametrize("rows,schema", [
    ([("a", "u"), ("b", "u"), ("a", None)], "kind string, other string"),
    ([(float(i),) for i in range(30)], "amount double"),
    ([(1,), (1,)], "flag int"),
    ([(None,), (None,)], "nothing string"),
    ([(f"2020-01-{i + 1:02d}",) for i in range(20)], "day string"),
])
def test_narrow_tables(spark, rows, schema):
    run = analyze.analyze(spark.createDataFrame(rows, schema), drop_copies=False)
    assert run.data.count() == len(rows)
    assert run.insights.count() >= 4
    for part in analyze.chart_data(run):
        assert part is None or part.count() >= 0


@pytest.mark.parametrize("partitions", [1, 7, 60])
def test_same_answer_for_any_partitioning(table, partitions):
    run = analyze.analyze(table.repartition(partitions), row_number="_row")
    seen = (
        sorted(map(tuple, run.data.select(*[F.col(f"`{c}`") if "`" not in c else F.col("`a``b`")
                                            for c in run.data.columns]).collect()), key=str),
        [(r["action"], r["column"], r["affected"]) for r in run.log.collect()],
        [r["sample_values"] for r in run.profile.collect()],
        [(r["column"], r["median"], r["mode"]) for r in run.describe.collect()])
    first = test_same_answer_for_any_partitioning.__dict__.setdefault("seen", seen)
    assert seen == first
