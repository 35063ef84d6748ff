"""Features, splits, metrics, and fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.common import query, read, rounded
from gridsight.operators import ml

ORDER_PREDICTORS = ["o_orderdate", "o_orderpriority", "o_orderstatus", "o_custkey"]


@query("ml_features", """
SELECT o_orderkey, year(o_orderdate)::DOUBLE AS o_orderdate_year,
       month(o_orderdate)::DOUBLE AS o_orderdate_month, day(o_orderdate)::DOUBLE AS o_orderdate_day,
       (isodow(o_orderdate) - 1)::DOUBLE AS o_orderdate_dayofweek,
       (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::DOUBLE AS o_orderpriority,
       (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::DOUBLE AS o_orderstatus,
       o_custkey::DOUBLE AS o_custkey
FROM orders""")
def ml_features(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    plan = ml.plan_predictors(orders, ORDER_PREDICTORS)
    codes = {p.column: ml.label_codes(orders, p.column) for p in plan if p.kind == "label"}
    names = [f for p in plan for f in p.features]
    return ml.build_features(orders, plan, codes).select(
        "o_orderkey", *[F.col(f"__f{i}").alias(n) for i, n in enumerate(names)])


@query("label_encode", """
SELECT p_partkey, (dense_rank() OVER (ORDER BY p_name) - 1)::DOUBLE AS p_name_code FROM part""")
def label_encode(spark, sf_dir):
    return ml.label_encode(read(spark, sf_dir, "part"), "p_name").select("p_partkey", "p_name_code")


@query("predictor_meta", """
SELECT 'o_orderdate_year' AS feature, 'numeric' AS type, min(year(o_orderdate))::DOUBLE AS "min",
       max(year(o_orderdate))::DOUBLE AS "max", CAST(median(year(o_orderdate))::DOUBLE AS VARCHAR)
       AS "default", 0::BIGINT AS categories FROM orders
UNION ALL SELECT 'o_orderdate_month', 'numeric', 1, 12,
       CAST(median(month(o_orderdate))::DOUBLE AS VARCHAR), 0 FROM orders
UNION ALL SELECT 'o_orderdate_day', 'numeric', 1, 31,
       CAST(median(day(o_orderdate))::DOUBLE AS VARCHAR), 0 FROM orders
UNION ALL SELECT 'o_orderdate_dayofweek', 'numeric', 0, 6,
       CAST(median(isodow(o_orderdate) - 1)::DOUBLE AS VARCHAR), 0 FROM orders
UNION ALL SELECT 'o_orderpriority', 'categorical', NULL, NULL,
       (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
       count(DISTINCT o_orderpriority) FROM orders
UNION ALL SELECT 'o_orderstatus', 'categorical', NULL, NULL,
       (SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
       count(DISTINCT o_orderstatus) FROM orders
UNION ALL SELECT 'o_custkey', 'numeric', min(o_custkey)::DOUBLE, max(o_custkey)::DOUBLE,
       CAST(median(o_custkey)::DOUBLE AS VARCHAR), 0 FROM orders""")
def predictor_meta(spark, sf_dir):
    found = ml.predictor_meta(read(spark, sf_dir, "orders"), ORDER_PREDICTORS)
    return found.drop("position").withColumn("categories", F.coalesce("categories", F.lit(0)))


SPLIT_SQL = "substr(md5('42:' || o_orderkey), 1, 4) < '3333'"


@query("split", f"SELECT o_orderkey, {SPLIT_SQL} AS is_test FROM orders")
def split(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return orders.select("o_orderkey", ml.split_mark(orders, "o_orderkey").alias("is_test"))


# A rule of thumb in the place of a model: the price tells the status.
GUESSED_SQL = """guessed AS (
  SELECT o_orderstatus AS label, CASE WHEN o_totalprice < 150000 THEN 'F'
         WHEN o_totalprice < 300000 THEN 'O' ELSE 'N' END AS prediction FROM orders)"""


def _guessed(spark, sf_dir):
    price = F.col("o_totalprice")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("label"),
        F.when(price < 150000, "F").when(price < 300000, "O").otherwise("N").alias("prediction"))


@query("classification_metrics", f"""
WITH {GUESSED_SQL},
per_class AS (
  SELECT label, count(*) AS support, count(*) FILTER (WHERE label = prediction) AS hit,
         (SELECT count(*) FROM guessed g WHERE g.prediction = o.label) AS guesses
  FROM guessed o GROUP BY label)
SELECT round(sum(hit) / sum(support), 6) AS accuracy,
       round(sum(2.0 * hit / (support + guesses) * support) / sum(support), 6) AS f1_score,
       round(sum(CASE WHEN guesses > 0 THEN hit * 1.0 / guesses ELSE 0 END * support)
             / sum(support), 6) AS "precision"
FROM per_class""")
def classification_metrics(spark, sf_dir):
    found = ml.classification_metrics(_guessed(spark, sf_dir))
    return rounded(found, 6, "accuracy", "f1_score", "precision")


@query("confusion", f"""
WITH {GUESSED_SQL}, classes AS (
  SELECT label FROM guessed UNION SELECT prediction FROM guessed)
SELECT c.label, count(*) FILTER (WHERE prediction = 'F') AS "F",
       count(*) FILTER (WHERE prediction = 'N') AS "N",
       count(*) FILTER (WHERE prediction = 'O') AS "O",
       count(*) FILTER (WHERE prediction = 'P') AS "P"
FROM classes c LEFT JOIN guessed g ON c.label = g.label GROUP BY c.label""")
def confusion(spark, sf_dir):
    return ml.confusion(_guessed(spark, sf_dir))


@query("regression_metrics", """
WITH g AS (SELECT l_extendedprice AS y, l_quantity * 2100 AS p FROM lineitem)
SELECT round(1 - avg((y - p) ^ 2) / var_pop(y), 6) AS r2, round(avg(abs(y - p)), 3) AS mae,
       round(avg((y - p) ^ 2), 0) AS mse FROM g""")
def regression_metrics(spark, sf_dir):
    scored = read(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 2100).alias("prediction"))
    found = ml.regression_metrics(scored)
    return rounded(rounded(rounded(found, 6, "r2"), 3, "mae"), 0, "mse")


# Targets that one column decides exactly, so that SQL knows the answers of a forest with
# default settings on the rows held out.
RULE_SQL = f"""ruled AS (
  SELECT l_quantity, l_linenumber, l_quantity * 100 + 5 AS worth,
         CASE WHEN l_quantity > 25 THEN 'bulk' ELSE 'single' END AS size,
         substr(md5('42:' || l_orderkey || '-' || l_linenumber), 1, 4) < '3333' AS is_test,
         l_orderkey || '-' || l_linenumber AS row_key
  FROM lineitem)"""
RULE_PREDICTORS = ["l_quantity", "l_linenumber"]


def _ruled(spark, sf_dir):
    quantity = F.col("l_quantity")
    return read(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_linenumber", (quantity * 100 + 5).alias("worth"),
        F.when(quantity > 25, "bulk").otherwise("single").alias("size"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_key"))


@query("rf_classify", f"""
WITH {RULE_SQL}
SELECT '0.0' AS label, '0.0' AS guess, count(*) AS n FROM ruled WHERE is_test AND size = 'bulk'
UNION ALL
SELECT '1.0', '1.0', count(*) FROM ruled WHERE is_test AND size = 'single'""")
def rf_classify(spark, sf_dir):
    """The confusion of a forest on the rows held out."""
    _, scored = ml.train(_ruled(spark, sf_dir), "size", RULE_PREDICTORS, key="row_key")
    return ml.confusion_cells(scored)


@query("rf_regress", f"""
WITH {RULE_SQL}
SELECT 1.0 AS r2, 0.0 AS mae, 0.0 AS mse, count(*) AS rows FROM ruled WHERE is_test""")
def rf_regress(spark, sf_dir):
    _, scored = ml.train(_ruled(spark, sf_dir), "worth", RULE_PREDICTORS, key="row_key")
    found = ml.regression_metrics(scored).withColumn("rows", F.lit(scored.count()))
    return found.select(*[(F.round(c, 6) + 0.0).alias(c) for c in ("r2", "mae", "mse")], "rows")


@query("rf_grid", """
WITH parts AS (
  SELECT p_size, substr(md5('42:' || p_partkey), 1, 4) < '3333' AS is_test FROM part)
SELECT 9 AS candidates, true AS deep, 1.0 AS r2, count(*) AS rows FROM parts WHERE is_test""")
def rf_grid(spark, sf_dir):
    """The whole grid; a depth of 5 has too few leaves for the sizes, so a deeper one wins."""
    parts = read(spark, sf_dir, "part").select(
        "p_partkey", "p_size", (F.col("p_size") * 10.0).alias("worth"))
    trained, scored = ml.train(parts, "worth", ["p_size"], tune=True, key="p_partkey", parallelism=4)
    best = trained.params
    return ml.regression_metrics(scored).select(
        F.lit(len(best["scores"])).alias("candidates"), F.lit(best["depth"] > 5).alias("deep"),
        F.round("r2", 2).alias("r2"), F.lit(scored.count()).alias("rows"))


@query("importances", """
SELECT 1 AS rank, 'l_quantity' AS feature, true AS leads, count(*) AS rows FROM lineitem""")
def importances(spark, sf_dir):
    """The column that decides the target is the top driver."""
    ruled = _ruled(spark, sf_dir)
    trained, _ = ml.train(ruled, "worth", RULE_PREDICTORS, key="row_key")
    return ml.top_drivers(ml.importances(trained, spark), 1).select(
        "rank", "feature", (F.col("importance") > 0.9).alias("leads"), F.lit(ruled.count()).alias("rows"))


# Three groups of lines, far apart.
PARTED_SQL = """parted AS (
  SELECT l_returnflag, l_quantity + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 10000 ELSE 30000 END
         AS place, l_linenumber FROM lineitem)"""


def _parted(spark, sf_dir):
    flag = F.col("l_returnflag")
    shift = F.when(flag == "A", 0).when(flag == "N", 10_000).otherwise(30_000)
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_quantity") + shift).alias("place"), "l_linenumber",
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_key"))


@query("kmeans", f"""
WITH {PARTED_SQL}, each AS (
  SELECT count(*) AS rows, count(*) * (var_pop(place) + var_pop(l_linenumber)) AS inner_spread
  FROM parted GROUP BY l_returnflag)
SELECT row_number() OVER (ORDER BY rows) AS nth, rows,
       round((SELECT sum(inner_spread) FROM each) / (SELECT sum(rows) FROM each), 4) AS inertia_per_row
FROM each""")
def kmeans(spark, sf_dir):
    from pyspark.sql import Window

    trained, placed = ml.train_clusters(_parted(spark, sf_dir), ["place", "l_linenumber"], key="row_key")
    total = placed.count()
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("rows"))
    return sizes.select(F.row_number().over(Window.orderBy("rows")).alias("nth"), "rows", F.round(
        F.lit(trained.params["inertia"] / total), 4).alias("inertia_per_row"))


@query("pca_2d", """
WITH m AS (
  SELECT var_samp(l_quantity) AS a, var_samp(l_linenumber) AS b,
         covar_samp(l_quantity, l_linenumber) AS c, count(*) AS rows FROM lineitem)
SELECT round((a + b) / 2 + sqrt((a - b) ^ 2 / 4 + c * c), 4) AS spread_x,
       round((a + b) / 2 - sqrt((a - b) ^ 2 / 4 + c * c), 4) AS spread_y, 0.0 AS together, rows FROM m""")
def pca_2d(spark, sf_dir):
    """Spread along the two components, by the closed form for two columns."""
    _, placed = ml.train_clusters(read(spark, sf_dir, "lineitem").select("l_quantity", "l_linenumber"),
                                  ["l_quantity", "l_linenumber"])
    return placed.agg(F.var_samp("x").alias("x"), F.var_samp("y").alias("y"),
                      F.covar_samp("x", "y").alias("xy"), F.count("*").alias("rows")).select(
        F.round("x", 4).alias("spread_x"), F.round("y", 4).alias("spread_y"),
        F.abs(F.round("xy", 4)).alias("together"), "rows")


@query("actual_vs_predicted", """
SELECT least(150, (SELECT count(*) FROM lineitem)) AS points, true AS on_the_line""")
def actual_vs_predicted(spark, sf_dir):
    """The plot's points lie on the diagonal."""
    ruled = _ruled(spark, sf_dir)
    trained, _ = ml.train(ruled, "worth", RULE_PREDICTORS, key="row_key")
    return ml.plot_sample(ml.score(trained, ruled), "row_key").agg(
        F.count("*").alias("points"),
        F.bool_and(F.abs(F.col("worth") - F.col("prediction")) < 1e-6).alias("on_the_line"))


@query("score_batch", f"""
WITH {RULE_SQL}
SELECT CASE WHEN l_linenumber = 4 THEN NULL ELSE size END AS predicted, count(*) AS n
FROM ruled GROUP BY ALL""")
def score_batch(spark, sf_dir):
    """Rows with a missing number stay without an answer."""
    ruled = _ruled(spark, sf_dir)
    trained, _ = ml.train(ruled, "size", RULE_PREDICTORS, key="row_key")
    gaps = ruled.withColumn("l_quantity", F.when(F.col("l_linenumber") != 4, F.col("l_quantity")))
    return ml.score(trained, gaps).groupBy("predicted").agg(F.count("*").alias("n"))


@query("importances_all", """
SELECT 1 AS rank, 'l_quantity' AS feature, 1.0 AS importance
UNION ALL SELECT 2, 'l_linenumber', 0.0""")
def importances_all(spark, sf_dir):
    """Every importance: one column decides the target, the other says nothing about it."""
    trained, _ = ml.train(_ruled(spark, sf_dir), "worth", RULE_PREDICTORS, key="row_key")
    return rounded(ml.importances(trained, spark), 3, "importance")


@query("score_rows", f"""
WITH {RULE_SQL}
SELECT row_key, CASE WHEN l_linenumber = 4 THEN NULL ELSE size END AS predicted,
       CASE WHEN l_linenumber = 4 THEN NULL ELSE true END AS sure FROM ruled""")
def score_rows(spark, sf_dir):
    """Each row's answer, and whether more than half of the trees' votes stand behind it."""
    ruled = _ruled(spark, sf_dir)
    trained, _ = ml.train(ruled, "size", RULE_PREDICTORS, key="row_key")
    gaps = ruled.withColumn("l_quantity", F.when(F.col("l_linenumber") != 4, F.col("l_quantity")))
    return ml.score(trained, gaps).select("row_key", "predicted", (F.col("confidence") > 0.5).alias("sure"))


# Two columns that hold the answer together, so trees differ and votes are split.
MIXED_PREDICTORS = ["l_quantity", "l_discount", "l_tax"]


def _mixed(spark, sf_dir):
    score = F.col("l_quantity") / 50 + F.col("l_discount") * 10 + F.col("l_tax") * 5
    return read(spark, sf_dir, "lineitem").select(
        *MIXED_PREDICTORS, F.when(score > 1.2, "high").when(score > 0.7, "middle").otherwise("low").alias("band"),
        (score * 100).alias("worth"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_key"))


@query("score_confidence")
def score_confidence(spark, sf_dir):
    """Each row's class and its confidence, by 50 trees (a test walks the same trees by SQL)."""
    mixed = _mixed(spark, sf_dir)
    trained, _ = ml.train(mixed, "band", MIXED_PREDICTORS, key="row_key")
    return ml.score(trained, mixed).select("row_key", "predicted", "confidence")


@query("plot_points")
def plot_points(spark, sf_dir):
    """The points of the plot of actual and predicted values."""
    mixed = _mixed(spark, sf_dir)
    trained, _ = ml.train(mixed, "worth", MIXED_PREDICTORS, key="row_key")
    return ml.plot_sample(ml.score(trained, mixed), "row_key").select(
        "row_key", F.col("worth").alias("actual"), F.col("prediction").alias("predicted"))


@query("complete_rows", """
SELECT count(*) AS rows, sum(o_orderkey)::BIGINT AS keys FROM (
  SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price,
         nullif(o_orderpriority, '1-URGENT') AS priority FROM orders)
WHERE price IS NOT NULL AND priority IS NOT NULL""")
def complete_rows(spark, sf_dir):
    gaps = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"),
        F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("priority"))
    return ml.complete_rows(gaps, ["price", "priority", "o_orderkey"]).agg(
        F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"))


TASK_COLUMNS = ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate")


@query("task_choice", """
SELECT 'o_orderkey' AS target, CASE WHEN count(DISTINCT o_orderkey) < 5 THEN 'classification'
       ELSE 'regression' END AS task FROM orders
UNION ALL SELECT 'o_orderstatus', 'classification'
UNION ALL SELECT 'o_totalprice', CASE WHEN count(DISTINCT o_totalprice) < 5 THEN 'classification'
       ELSE 'regression' END FROM orders
UNION ALL SELECT 'o_orderpriority', 'classification' UNION ALL SELECT 'o_orderdate', 'refused'""")
def task_choice(spark, sf_dir):
    """What each column of orders would be as a target."""
    orders = read(spark, sf_dir, "orders")

    def task(column: str) -> str:
        try:
            ml.refuse_date_target(orders, column)
        except ValueError:
            return "refused"
        return "classification" if ml.is_classification(orders, column) else "regression"

    return spark.createDataFrame([(c, task(c)) for c in TASK_COLUMNS], "target string, task string")


@query("predictor_categories", """
SELECT 'o_orderpriority' AS feature, o_orderpriority AS category,
       (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::DOUBLE AS code
FROM (SELECT DISTINCT o_orderpriority FROM orders)
UNION ALL SELECT 'o_orderstatus', o_orderstatus, (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::DOUBLE
FROM (SELECT DISTINCT o_orderstatus FROM orders)""")
def predictor_categories(spark, sf_dir):
    return ml.predictor_categories(read(spark, sf_dir, "orders"), ORDER_PREDICTORS)
