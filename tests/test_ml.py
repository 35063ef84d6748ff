"""Models, features and metrics."""

import pytest
from pyspark.sql import functions as F

from gridsight.operators import ml


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(400).select(
        F.col("id"), (F.col("id") % 7).cast("double").alias("a"),
        F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (F.col("id") % 3 + 1)
                     .cast("int")).alias("kind"),
        F.date_add(F.to_date(F.lit("2020-01-01")), F.col("id").cast("int")).cast("timestamp_ntz")
        .alias("sold_date"),
        (F.col("id") % 7 * 10 + F.col("id") % 3).cast("double").alias("price"))


@pytest.fixture(scope="module")
def priced(table):
    return ml.train(table, "price", ["a", "kind", "sold_date"], trees=8, key="id")


def test_regression(spark, table, priced):
    trained, scored = priced
    assert trained.mode == "regression"
    assert trained.features == ["a", "kind", "sold_date_year", "sold_date_month",
                                "sold_date_day", "sold_date_dayofweek"]
    assert ml.regression_metrics(scored).first()["r2"] > 0.95
    weights = [r["importance"] for r in ml.importances(trained, spark).collect()]
    assert sum(weights) == pytest.approx(1) and weights == sorted(weights, reverse=True)
    assert ml.top_drivers(ml.importances(trained, spark)).count() == 3
    share = scored.count() / 400
    assert 0.1 < share < 0.3


def test_scoring_and_storage(spark, table, priced, tmp_path):
    trained, _ = priced
    again = ml.load(spark, _saved(trained, tmp_path))
    new = table.limit(3).withColumn("kind", F.lit("unseen"))
    zero = table.limit(3).withColumn("kind", F.lit("x"))
    a, b, c = (sorted(tuple(r) for r in ml.score(m, t).select("id", "prediction").collect())
               for m, t in ((trained, new), (trained, zero), (again, new)))
    assert a == b == c  # an unseen label takes code 0, that of "x"
    gap = table.limit(2).withColumn("a", F.lit(None).cast("double"))
    assert [r["prediction"] for r in ml.score(trained, gap).collect()] == [None, None]


def _saved(trained, tmp_path):
    path = str(tmp_path / "model")
    ml.save(trained, path)
    return path


def test_classification(table):
    trained, scored = ml.train(table, "kind", ["price"], trees=5, key="id")
    assert trained.mode == "classification"
    found = ml.classification_metrics(scored).first()
    assert found["accuracy"] > 0.9
    matrix = ml.confusion(scored)
    assert sum(sum(r[1:]) for r in matrix.collect()) == scored.count()
    out = ml.score(trained, table)
    assert {r["predicted"] for r in out.select("predicted").distinct().collect()} <= {"x", "y", "z"}
    assert out.agg(F.min("confidence"), F.max("confidence")).first()[1] <= 1


def test_few_numbers_are_classes(table):
    assert ml.is_classification(table.withColumn("t", F.col("id") % 4), "t")
    assert not ml.is_classification(table, "a")


def test_clusters(table):
    trained, placed = ml.train_clusters(table, ["a", "price", "kind"], k=3, key="id")
    assert placed.count() == 400 and trained.params["inertia"] > 0
    means = placed.agg(F.avg("x"), F.avg("y")).first()
    assert means[0] == pytest.approx(0, abs=1e-6) and means[1] == pytest.approx(0, abs=1e-6)
    assert ml.plot_sample(placed, "id").count() == 150
    assert ml.score(trained, table).first()["prediction"].startswith("Cluster ")


def test_refusals(table):
    with pytest.raises(ValueError):
        ml.train(table, "sold_date", ["a"])
    with pytest.raises(ValueError):
        ml.train(table.limit(9), "price", ["a"])


def test_tuning(table):
    trained, _ = ml.train(table, "price", ["a", "kind"], tune=True, tree_grid=(2, 4),
                          depth_grid=(2, None), key="id")
    assert trained.params["depth"] == ml.DEEPEST and len(trained.params["scores"]) == 4


@pytest.mark.parametrize("parts", [1, 7, 200])
def test_label_codes(spark, parts):
    df = spark.range(900).select(F.format_string("w%04d", F.col("id") * 7 % 300).alias("w"))
    codes = {r["label"]: r["code"] for r in ml.label_codes(df.repartition(parts), "w").collect()}
    assert codes == {f"w{i:04d}": float(i) for i in range(300)}
    assert ml.label_encode(df, "w").where("w_code is null").count() == 0


def test_many_classes(spark):
    """More classes than the learner guesses from unnamed labels."""
    df = spark.range(3000).select("id", F.format_string("c%03d", F.col("id") % 150).alias("y"),
                                  (F.col("id") % 150).alias("x"))
    trained, scored = ml.train(df, "y", ["x"], trees=3, depth=12, key="id")
    assert trained.model.numClasses == 150 and scored.count() > 400
    cells = ml.confusion_cells(ml.score(trained, df), "y", "predicted")
    assert cells.agg(F.sum("n")).first()[0] == 3000
    listed = ml.predictor_categories(df, ["x", "y"]).collect()
    assert len(listed) == 150 and {r["feature"] for r in listed} == {"y"}


def test_dates_that_do_not_parse(spark):
    """They take the commonest date; missing cells stay without an answer."""
    df = spark.createDataFrame(
        [(i, "n/k" if i == 7 else f"2020-0{1 + i % 3 // 2}-01", float(i % 3)) for i in range(60)],
        "id int, due_date string, y double")
    plan = ml.plan_predictors(df, ["due_date"])
    assert plan[0].kind == "date" and plan[0].fill.startswith("2020-01-01")
    trained, scored = ml.train(df, "y", ["due_date"], trees=2, key="id")
    assert scored.count() > 0
    _, placed = ml.train_clusters(df, ["due_date", "y"], k=2, key="id")
    assert placed.count() == 60
    answers = ml.score(trained, df.withColumn("due_date", F.when(F.col("id") != 3, F.col("due_date"))))
    assert [r["id"] for r in answers.where("predicted IS NULL").collect()] == [3]


def test_depth_is_refused_beyond_the_learner(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).cast("double").alias("y"),
                                 (F.col("id") % 5).alias("x"))
    with pytest.raises(ValueError):
        ml.train(df, "y", ["x"], trees=2, depth=31, key="id")


def test_metric_edges(spark):
    same = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "label double, prediction double")
    assert ml.regression_metrics(same).first()["r2"] == 1.0
    never = spark.createDataFrame([("a", "b"), ("c", "c")], "label string, prediction string")
    found = ml.classification_metrics(never).first()
    assert (found["accuracy"], found["precision"]) == (0.5, 0.5)
    assert ml.confusion(never).columns == ["label", "a", "b", "c"]


def test_split_ignores_partitions(table):
    def marks(df):
        return sorted(df.select("id", ml.split_mark(df).alias("t")).collect())

    assert marks(table) == marks(table.repartition(5))


WALK = """
WITH RECURSIVE walked AS (
  SELECT row_key, tree, 0 AS node FROM cells GROUP BY row_key, tree
  UNION ALL
  SELECT a.row_key, a.tree, CASE WHEN c.value <= n.threshold THEN n."left" ELSE n."right" END
  FROM walked a JOIN nodes n ON n.tree = a.tree AND n.node = a.node
  JOIN cells c ON c.row_key = a.row_key AND c.tree = a.tree AND c.feature = n.feature),
leaves AS (
  SELECT a.row_key, a.tree, n.prediction, n.votes
  FROM walked a JOIN nodes n ON n.tree = a.tree AND n.node = a.node WHERE n.feature IS NULL)
"""


def _walk(forest, rows, features, select):
    """A query over the leaf of every row in every tree, by DuckDB on the table of nodes."""
    import duckdb
    import pandas as pd

    nodes = forest.toPandas()
    table = rows.toPandas()
    cells = pd.concat([pd.DataFrame({"row_key": table["id"], "feature": f, "value": table[f]}) for f in features])
    con = duckdb.connect()
    con.register("nodes", nodes)
    con.register("plain", cells)
    con.execute("CREATE TABLE cells AS SELECT * FROM plain, (SELECT DISTINCT tree FROM nodes)")
    return {r[0]: r[1:] for r in con.execute(WALK + select).fetchall()}


@pytest.fixture(scope="module")
def noisy(spark):
    return spark.range(600).select(
        "id", (F.rand(1) * 10).alias("a"), (F.rand(2) * 10).alias("b"), F.rand(3).alias("c")).withColumn(
        "price", F.col("a") * 3 + F.col("b") + F.col("c")).withColumn(
        "band", F.when(F.col("price") > 25, "high").when(F.col("price") > 15, "middle").otherwise("low")).cache()


def test_answers_and_confidence_are_those_of_the_nodes(spark, noisy):
    trained, _ = ml.train(noisy, "band", ["a", "b", "c"], key="id", depth=5)
    forest = ml.forest_nodes(trained, spark)
    assert forest.select("tree").distinct().count() == 50
    votes = _walk(forest, noisy, ["a", "b", "c"], """
      SELECT row_key, list(list_transform(votes, lambda v: v / list_sum(votes))) FROM leaves GROUP BY row_key""")
    names = {r["code"]: r["label"] for r in trained.codes["band"].collect()}
    scored = ml.score(trained, noisy).collect()
    assert len(scored) == 600 and len({r["confidence"] for r in scored}) > 50
    for r in scored:
        shares = [sum(tree) / 50 for tree in zip(*votes[r["id"]][0])]
        assert r["confidence"] == pytest.approx(max(shares), abs=1e-9)
        (code,) = [int(c) for c, name in names.items() if name == r["predicted"]]
        assert shares[code] == pytest.approx(max(shares), abs=1e-9)


def test_values_are_those_of_the_nodes(spark, noisy):
    trained, _ = ml.train(noisy, "price", ["a", "b", "c"], key="id")
    means = _walk(ml.forest_nodes(trained, spark), noisy, ["a", "b", "c"],
                  "SELECT row_key, avg(prediction) FROM leaves GROUP BY row_key")
    for r in ml.score(trained, noisy).collect():
        assert r["prediction"] == pytest.approx(means[r["id"]][0], abs=1e-9)
    weights = ml.importances(trained, spark).collect()
    assert [r["feature"] for r in weights] == ["a", "b", "c"]
    assert sum(r["importance"] for r in weights) == pytest.approx(1)
    points = ml.plot_sample(ml.score(trained, noisy), "id").collect()
    assert len(points) == 150 and all(r["prediction"] == pytest.approx(means[r["id"]][0]) for r in points)


def test_grid_scores_do_not_depend_on_partitions(spark, table):
    def scores(df):
        trained, _ = ml.train(df, "price", ["a", "kind"], tune=True, key="id", tree_grid=(3, 5),
                              depth_grid=(2, 5), parallelism=2)
        return trained.params["scores"]

    assert scores(table.repartition(1)) == pytest.approx(scores(table.repartition(40)), abs=1e-12)


def test_grid_with_too_few_keys_for_all_folds(spark, table):
    trained, _ = ml.train(table.withColumn("id", F.col("id") % 2), "price", ["a"], tune=True, key="id",
                          tree_grid=(2,), depth_grid=(2,))
    assert len(trained.params["scores"]) == 1


def test_learners_see_equal_rows_as_few_weighted_ones(spark):
    df = spark.range(100_000).select("id", (F.col("id") % 7).cast("double").alias("a"),
                                     (F.col("id") % 7 * 10.0).alias("y"))
    plan = ml.plan_predictors(df, ["a"])
    cells = ml._counted(ml.build_features(df.withColumns({"label": F.col("y"), "__fold": F.lit(0)}), plan, {}), plan)
    laid = ml._laid_out(cells, plan, ml.PIECES).toPandas()
    assert len(laid) == 7 * ml.PIECES and laid["weight"].sum() == 100_000
    assert laid["weight"].max() - laid["weight"].min() <= 1  # 14,285 or 14,286 rows in 128 pieces
    few = ml._laid_out(cells.withColumn("__n", F.lit(5).cast("long")), plan, ml.PIECES)
    assert few.count() == 35 and few.where("weight <> 1").isEmpty()
    trained, scored = ml.train(df, "y", ["a"], trees=3, key="id")
    assert scored.count() == pytest.approx(20_000, rel=0.05)
    assert scored.where(F.abs(F.col("label") - F.col("prediction")) > 1e-9).isEmpty()


def test_clusters_see_equal_rows_as_one_with_a_weight(spark, monkeypatch):
    df = spark.range(9_000).select("id", F.when(F.col("id") < 6_000, 1.0).otherwise(5.0).alias("a"),
                                   (F.col("id") % 3).cast("double").alias("b"))
    seen = []
    laid_out = ml._laid_out
    monkeypatch.setattr(ml, "_laid_out", lambda *args: seen.append(laid_out(*args)) or seen[-1])
    trained, placed = ml.train_clusters(df, ["a", "b"], k=2, key="id")
    assert seen[0].count() == 6 and seen[0].agg(F.sum("weight")).first()[0] == 9_000
    assert trained.params["inertia"] == pytest.approx(6_000)  # b is 0, 1, 2: 2/3 a row
    assert sorted(r["count"] for r in placed.groupBy("cluster").count().collect()) == [3_000, 6_000]
