"""Train and score models on table columns: clusters, classes, numbers."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsight.functions import dates, frequency, quantiles
from gridsight.functions import values as V
from gridsight.operators import explore
from gridsight.operators import profile as P
from gridsight.session import shared_folder, stage

# Name parts of date predictors and targets, and the tuning grid.
DATE_PREDICTOR_PARTS = ("date", "time", "year")
DATE_TARGET_PARTS = ("date", "time")
TREE_GRID = (10, 50, 100)
DEPTH_GRID = (5, 10, None)
FOLDS = 3
# Tasks that the learner sees: they must not depend on how the input was cut.
ROWS_PER_TASK = 100_000
LEAST_TASKS = 8
# Most rows, each with a weight, that stand for equal rows of a forest's training table.
PIECES = 128
SEED = 42
MIN_ROWS = 10
FEWEST_VALUES = 5
PLOT_POINTS = 150
TOP_DRIVERS = 3
# "No limit" for the tree learner.
DEEPEST = 30
TEST_SHARE = 0.2
# A date-named text column is a date if more than this share of its cells parse.
DATE_SHARE = 0.5

META_SCHEMA = ("position int, feature string, type string, min double, max double, "
               "default string, categories bigint")


class Predictor(NamedTuple):
    """How one input column becomes features."""

    column: str
    kind: str  # date, label or number
    fmt: str | None = None
    fill: str | None = None  # what a date text that does not parse becomes

    @property
    def features(self) -> list[str]:
        if self.kind == "date":
            return [f"{self.column}_{part}" for part in ("year", "month", "day", "dayofweek")]
        return [self.column]


class Trained(NamedTuple):
    """A fitted model with all that scoring needs."""

    mode: str
    model: Model
    predictors: list[Predictor]
    codes: dict[str, DataFrame]
    target: str | None = None
    params: dict | None = None

    @property
    def features(self) -> list[str]:
        return [f for p in self.predictors for f in p.features]


# --- features -------------------------------------------------------------------------------

def _is_date(df: DataFrame, column: str, parts: Sequence[str]) -> tuple[bool, str | None]:
    if not P.has_part(column, parts):
        return False, None
    kind = V.family(V.dtype_of(df, column))
    if kind == "timestamp_ntz":
        return True, None
    if kind != "string":
        return False, None
    # The layout most cells follow; some cells may not parse.
    fmt = dates.choose_format(df, column)
    parsed = df.agg(F.count(dates.parse(V.col(column), fmt)).alias("dates"),
                    F.count(V.present(df, column)).alias("cells")).first()
    return parsed["dates"] > DATE_SHARE * parsed["cells"], fmt


def _commonest_date(df: DataFrame, column: str, fmt: str | None) -> str | None:
    """The date that most cells hold, the earliest of equals, as text."""
    if fmt is None:
        return None
    counts = df.groupBy(dates.as_timestamp(df, column, fmt).alias("v")).agg(
        F.count("*").alias("n")).where(F.col("v").isNotNull())
    best = counts.agg(F.min(F.struct((-F.col("n")).alias("down"), "v")).alias("b")).select(
        F.col("b.v").cast("string").alias("v")).first()
    return best["v"]


def plan_predictors(df: DataFrame, columns: Sequence[str]) -> list[Predictor]:
    """Decide per column: date parts, label code or plain number."""
    out = []
    for c in columns:
        is_date, fmt = _is_date(df, c, DATE_PREDICTOR_PARTS)
        if is_date:
            out.append(Predictor(c, "date", fmt, _commonest_date(df, c, fmt)))
        else:
            out.append(Predictor(c, "number" if V.is_numeric(V.dtype_of(df, c)) else "label"))
    return out


def date_parts(ts: Column, column: str) -> list[Column]:
    """Year, month, day, day of week (Monday 0) as numbers."""
    return [f(ts).cast("double").alias(f"{column}_{name}") for name, f in (
        ("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("dayofweek", F.weekday))]


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(label, code): alphabetical numbers from 0 of a column's text values."""
    labels = df.select(V.as_text(df, column).alias("label")).where(
        F.col("label").isNotNull()).distinct()
    # Numbered by sorted range and place in the range. The sorted table is written
    # first, so ranges and places cannot change later.
    placed = stage(labels.orderBy("label").select(
        "label", F.spark_partition_id().alias("part"),
        (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("place")), "labels")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))  # one row per task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(starts, "part").select(
        "label", (F.col("start") + F.col("place")).cast("double").alias("code"))


def _stored_codes(df: DataFrame, plan: Sequence[Predictor],
                  more: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Written code tables, so scoring does not read the training table again."""
    columns = [p.column for p in plan if p.kind == "label"] + list(more)
    return {c: stage(label_codes(df, c), "codes") for c in columns}


def label_encode(df: DataFrame, column: str, codes: DataFrame | None = None,
                 output: str | None = None) -> DataFrame:
    """Add the code of a column's text; labels not in `codes` get 0."""
    codes = label_codes(df, column) if codes is None else codes
    known = codes.select(F.col("label").alias("__label"), F.col("code").alias("__code"))
    # Spark sends the codes to all tasks if they are small; otherwise the join splits hot labels.
    text = df.withColumn("__text", V.as_text(df, column))
    return text.join(known, F.col("__text") == F.col("__label"), "left").withColumn(
        output or f"{column}_code", F.coalesce("__code", F.lit(0.0))).drop(
        "__text", "__label", "__code")


def build_features(df: DataFrame, predictors: Sequence[Predictor],
                   codes: Mapping[str, DataFrame]) -> DataFrame:
    """Replace the predictors by their feature columns, named `__f0`, `__f1`, ..

    Other columns stay. Features are plain numbers, so trees split label codes
    by order.
    """
    out, i = df, 0
    for p in predictors:
        if p.kind == "date":
            ts = dates.as_timestamp(df, p.column, p.fmt)
            if p.fill is not None:  # a cell that does not parse; missing cells stay missing
                ts = F.coalesce(ts, F.when(V.present(df, p.column).isNotNull(),
                                           F.lit(p.fill).cast("timestamp_ntz")))
            for part in date_parts(ts, p.column):
                out = out.withColumn(f"__f{i}", part)
                i += 1
        elif p.kind == "label":
            out = label_encode(out, p.column, codes[p.column], f"__f{i}")
            i += 1
        else:
            out = out.withColumn(f"__f{i}", V.as_number(df, p.column))
            i += 1
    return out


def _assembled(df: DataFrame, predictors, codes, invalid: str = "error") -> DataFrame:
    """Rows with their feature vector; only scoring may meet rows with gaps ("keep")."""
    width = sum(len(p.features) for p in predictors)
    return VectorAssembler(inputCols=[f"__f{i}" for i in range(width)], outputCol="features",
                           handleInvalid=invalid).transform(build_features(df, predictors, codes))


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without missing cells in the used columns; refuses fewer than ten."""
    used = df.select(*[V.col(c) for c in dict.fromkeys(columns)])
    rows = used.where(frequency.all_of([V.present(used, c).isNotNull() for c in used.columns]))
    if len(rows.take(MIN_ROWS)) < MIN_ROWS:
        raise ValueError(f"at least {MIN_ROWS} complete rows are needed")
    return rows


def predictor_meta(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Range, default and number of categories of every feature."""
    predictors = plan_predictors(df, columns)
    # Ranges of the date parts.
    part_range = {"month": (1.0, 12.0), "day": (1.0, 31.0), "dayofweek": (0.0, 6.0)}
    numbers: dict[str, Column] = {}
    for p in predictors:
        if p.kind == "date":
            ts = dates.as_timestamp(df, p.column, p.fmt)
            numbers.update(zip(p.features, date_parts(ts, p.column)))
        elif p.kind == "number":
            numbers[p.column] = V.as_number(df, p.column)
    names = list(numbers)
    wide = df.select(*[numbers[c].alias(f"f{i}") for i, c in enumerate(names)])
    medians = quantiles.column_quantiles(wide, wide.columns, [0.5])
    ends = wide.agg(*[a for i in range(len(names)) for a in (
        F.min(f"f{i}").alias(f"lo{i}"), F.max(f"f{i}").alias(f"hi{i}"))]).first() if names else {}
    labels = [p.column for p in predictors if p.kind == "label"]
    modes, sizes = {}, {}
    if labels:
        counts = frequency.text_counts(df, labels).where(F.col("value").isNotNull())
        best = F.min(F.struct((-F.col("n")).alias("rank"), "value"))
        for r in counts.groupBy("column").agg(best.alias("b"), F.count("*").alias("k")).collect():
            modes[r["column"]], sizes[r["column"]] = r["b"]["value"], r["k"]
    rows = []
    for p in predictors:
        for feature in p.features:
            if p.kind == "label":
                rows.append((len(rows), feature, "categorical", None, None, modes.get(feature),
                             sizes.get(feature, 0)))
                continue
            i = names.index(feature)
            low, high = ends[f"lo{i}"], ends[f"hi{i}"]
            if p.kind == "date":
                low, high = part_range.get(feature.rsplit("_", 1)[1], (low, high))
            rows.append((len(rows), feature, "numeric", low, high,
                         str(medians.get(f"f{i}", [0.0])[0]), None))
    return df.sparkSession.createDataFrame(rows, META_SCHEMA)


def predictor_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, category, code): the values that each label predictor can take."""
    none = df.sparkSession.createDataFrame([], "feature string, category string, code double")
    out = none
    for p in plan_predictors(df, columns):
        if p.kind == "label":
            out = out.unionAll(label_codes(df, p.column).select(
                F.lit(p.column).alias("feature"), F.col("label").alias("category"), "code"))
    return out


# --- split ----------------------------------------------------------------------------------

def split_mark(df: DataFrame, key: str | None = None, seed: int = SEED,
               share: float = TEST_SHARE) -> Column:
    """True for test rows: a hash of the row key, the same in every run and partitioning."""
    text = V.col(key).cast("string") if key else F.concat_ws(
        "\x1f", *[F.coalesce(V.as_text(df, c), F.lit("")) for c in df.columns])
    digest = F.md5(F.concat(F.lit(f"{seed}:"), text).cast("binary"))
    return F.substring(digest, 1, 4) < F.lit(f"{int(share * 0x10000):04x}")


# --- metrics --------------------------------------------------------------------------------

def classification_metrics(scored: DataFrame, label: str = "label",
                           prediction: str = "prediction") -> DataFrame:
    """accuracy, weighted f1 and precision; classes never predicted have precision 0."""
    cells = scored.groupBy(V.col(label).alias("label"), V.col(prediction).alias("guess")).agg(
        F.count("*").alias("n"))
    actual = cells.groupBy("label").agg(
        F.sum("n").alias("support"),
        F.coalesce(F.sum(F.when(F.col("label") == F.col("guess"), F.col("n"))), F.lit(0))
        .alias("right"))
    guessed = cells.groupBy(F.col("guess").alias("label")).agg(F.sum("n").alias("guessed"))
    per_class = actual.join(guessed, "label", "left").withColumn(
        "precision", F.coalesce(F.col("right") / F.col("guessed"), F.lit(0.0))).withColumn(
        "f1", F.coalesce(2 * F.col("right") / (F.col("support") + F.col("guessed")), F.lit(0.0)))
    total = F.sum("support")
    return per_class.agg(
        (F.sum("right") / total).alias("accuracy"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("f1_score"),
        (F.sum(F.col("precision") * F.col("support")) / total).alias("precision"))


def confusion_cells(scored: DataFrame, label: str = "label",
                    prediction: str = "prediction") -> DataFrame:
    """(label, guess, n): the cells of the confusion matrix, for any number of classes."""
    return scored.groupBy(
        V.col(label).cast("string").alias("label"),
        V.col(prediction).cast("string").alias("guess")).agg(F.count("*").alias("n"))


def confusion(scored: DataFrame, label: str = "label",
              prediction: str = "prediction") -> DataFrame:
    """Square matrix over every class seen: one row per label, one column per guess.

    For more classes than a table can have columns, take `confusion_cells`.
    """
    cells = confusion_cells(scored, label, prediction)
    both = cells.select(F.explode(F.array("label", "guess")).alias("c")).where(
        F.col("c").isNotNull()).distinct().orderBy("c")
    limit = int(scored.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    classes = [r["c"] for r in both.limit(limit + 1).collect()]
    if len(classes) > limit:
        raise ValueError(f"more than {limit} classes (spark.sql.pivotMaxValues)")
    rows = scored.sparkSession.createDataFrame([(c,) for c in classes], "label string")
    wide = cells.groupBy("label").pivot("guess", classes).agg(F.sum("n"))
    return rows.join(wide, "label", "left").select("label", *[
        F.coalesce(V.col(c), F.lit(0)).alias(c) for c in classes]).orderBy("label")


def regression_metrics(scored: DataFrame, label: str = "label",
                       prediction: str = "prediction") -> DataFrame:
    """r2, mean absolute error, mean squared error, in one aggregate."""
    y, guess = V.col(label).cast("double"), V.col(prediction).cast("double")
    error = y - guess
    sums = scored.agg(F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"),
                      F.var_pop(y).alias("spread"))
    r2 = F.when(F.col("spread") > 0, 1 - F.try_divide("mse", "spread")).otherwise(
        F.when(F.col("mse") == 0, 1.0).otherwise(0.0))
    return sums.select(r2.alias("r2"), "mae", "mse")


# --- models ---------------------------------------------------------------------------------

def is_classification(df: DataFrame, target: str) -> bool:
    """A target that is no number, or has fewer than five values, names classes."""
    if not V.is_numeric(V.dtype_of(df, target)):
        return True
    values = df.select(V.present(df, target).alias("v")).where("v is not null")
    if len({r["v"] for r in values.take(P.HEAD_ROWS)}) >= FEWEST_VALUES:
        return False  # the first rows settle it
    return len(values.distinct().take(FEWEST_VALUES)) < FEWEST_VALUES


def refuse_date_target(df: DataFrame, target: str) -> None:
    if _is_date(df, target, DATE_TARGET_PARTS)[0]:
        raise ValueError(f"'{target}' holds dates; choose a number or a label as the target")


def _depth(depth: int | str | None) -> int:
    """The learner's depth; "none" is the deepest it allows, and more is refused."""
    if depth in (None, "None"):
        return DEEPEST
    if not 0 < int(depth) <= DEEPEST:
        raise ValueError(f"depth must lie between 1 and {DEEPEST}, or be none")
    return int(depth)


def _forest(classify: bool, trees: int, depth: int | None, min_split: int):
    common = dict(
        featuresCol="features", labelCol="label", weightCol="weight", numTrees=int(trees),
        maxDepth=_depth(depth),
        minInstancesPerNode=max(1, int(min_split) // 2), seed=SEED, maxBins=64,
        maxMemoryInMB=512)
    if classify:
        return RandomForestClassifier(featureSubsetStrategy="sqrt", **common)
    return RandomForestRegressor(featureSubsetStrategy="all", **common)


def train(df: DataFrame, target: str, predictors: Sequence[str], trees: int = 50,
          depth: int | None = None, min_split: int = 2, tune: bool = False,
          key: str | None = None, tree_grid: Sequence[int] = TREE_GRID,
          depth_grid: Sequence[int | None] = DEPTH_GRID,
          parallelism: int = 2) -> tuple[Trained, DataFrame]:
    """Fit a forest on 80 % of the complete rows.

    Returns the model and the test rows with `label` and `prediction`. Rows with the same
    features and label reach the learner as at most PIECES rows with weights, so its work grows
    with the different rows; bags draw these pieces. Up to PIECES equal rows are pieces of one.
    """
    refuse_date_target(df, target)
    used = [target, *predictors] + ([key] if key else [])
    rows = complete_rows(df, used)
    classify = is_classification(rows, target)
    plan = plan_predictors(rows, predictors)
    codes = _stored_codes(rows, plan, [target] if classify else [])
    if classify:
        labelled = label_encode(rows, target, codes[target], "label")
    else:
        labelled = rows.withColumn("label", V.as_number(rows, target))
    place = F.xxhash64(*[V.as_text(rows, c) for c in ([key] if key else used)])
    marked = labelled.withColumns({
        "is_test": split_mark(rows, key),
        "__fold": F.pmod(F.xxhash64(F.lit(SEED), place), F.lit(FOLDS)).cast("int") if tune else F.lit(0)})
    test = _assembled(marked.where("is_test"), plan, codes)
    training = _laid_out(stage(_counted(build_features(marked.where(~F.col("is_test")), plan, codes), plan),
                               "cells"), plan, max(PIECES, 2 * min_split))
    if classify:  # the learner takes the number of classes from here
        classes = codes[target].count()
        training = training.withColumn("label", F.col("label").alias("label", metadata={
            "ml_attr": {"type": "nominal", "num_vals": classes, "name": "label"}}))
    params = {"trees": trees, "depth": depth, "min_split": min_split}
    if tune:
        learner = _forest(classify, trees, depth, 2)
        grid = (ParamGridBuilder()
                .addGrid(learner.numTrees, list(tree_grid))
                .addGrid(learner.maxDepth, [_depth(d) for d in depth_grid])
                .build())
        judge = (MulticlassClassificationEvaluator(metricName="accuracy", weightCol="weight") if classify
                 else RegressionEvaluator(metricName="r2", weightCol="weight"))
        search = CrossValidator(estimator=learner, estimatorParamMaps=grid, evaluator=judge,
                                numFolds=FOLDS, parallelism=parallelism, seed=SEED)
        if training.select("__fold").distinct().count() == FOLDS:  # else too few keys to go round
            search.setFoldCol("__fold")
        fitted = search.fit(training)
        model = fitted.bestModel
        params |= {"trees": model.getNumTrees, "depth": model.getOrDefault("maxDepth"),
                   "scores": list(fitted.avgMetrics)}
    else:
        model = _forest(classify, trees, depth, min_split).fit(training)
    trained = Trained("classification" if classify else "regression", model, plan, codes,
                      target, params)
    return trained, model.transform(test).select("label", "prediction")


def _names(predictors: Sequence[Predictor]) -> list[str]:
    return [f"__f{i}" for i in range(sum(len(p.features) for p in predictors))]


def _counted(data: DataFrame, predictors: Sequence[Predictor],
             kept: Sequence[str] = ("label", "__fold")) -> DataFrame:
    """Equal rows as one, with their number `__n`."""
    return data.groupBy(*_names(predictors), *kept).agg(F.count(F.lit(1)).alias("__n"))


def _laid_out(cells: DataFrame, predictors: Sequence[Predictor], pieces: int,
              kept: Sequence[str] = ("label", "__fold")) -> DataFrame:
    """The counted rows as at most `pieces` rows of nearly equal `weight` each, in the same tasks
    and order however the input was cut: the learner draws its bags by task and place. The
    number of tasks follows the number of rows."""
    names = _names(predictors)
    parts = F.least("__n", F.lit(pieces).cast("long"))
    size = cells.agg(F.sum(parts).alias("n")).first()["n"] or 0
    cut = cells.withColumn("__piece", F.explode(F.sequence(F.lit(1).cast("long"), parts)))
    # Where n is no multiple of the pieces, the first ones take one row more.
    weight = F.floor((F.col("__n") - F.col("__piece")) / parts) + 1
    rows = cut.select(*names, *kept, weight.cast("double").alias("weight"),
                      F.xxhash64(*names, *kept, "__piece").alias("__place"))
    laid = rows.repartition(max(LEAST_TASKS, -(-size // ROWS_PER_TASK)), "__place").sortWithinPartitions(
        "__place", *kept, *names)
    return VectorAssembler(inputCols=names, outputCol="features").transform(laid).select(
        "features", *kept, "weight")


def forest_nodes(trained: Trained, spark: SparkSession) -> DataFrame:
    """The forest as a table that any SQL engine can walk, one row for each node.

    (tree, node, feature, threshold, left, right, prediction, votes): a row whose `feature` is
    at most `threshold` goes to node `left`, others to `right`; leaves have no feature. Node 0
    is a tree's root. The answer is the mean of `prediction` over the trees' leaves, or the
    class with the most `votes`, each leaf's divided by their sum; its share is the confidence.
    """
    path = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
    trained.model.write().save(path)
    node = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    names = F.array(*[F.lit(name) for name in trained.features])
    inner = F.col("leftChild") >= 0
    return node.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"),
        F.when(inner, names[F.col("split.featureIndex")]).alias("feature"),
        F.when(inner, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
        F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"),
        "prediction", F.col("impurityStats").alias("votes"))


def importances(trained: Trained, spark: SparkSession) -> DataFrame:
    """(rank, feature, importance), most important first."""
    weights = zip(trained.features, trained.model.featureImportances.toArray())
    ordered = sorted(weights, key=lambda w: (-w[1], w[0]))
    return spark.createDataFrame(
        [(i + 1, name, float(w)) for i, (name, w) in enumerate(ordered)],
        "rank int, feature string, importance double")


def top_drivers(weights: DataFrame, top: int = TOP_DRIVERS) -> DataFrame:
    """The most important features."""
    return weights.where(F.col("rank") <= top)


def train_clusters(df: DataFrame, predictors: Sequence[str], k: int = 3,
                   key: str | None = None) -> tuple[Trained, DataFrame]:
    """K-means on the features and their first two principal components.

    Returns the model and all complete rows with `cluster`, `x`, `y` (and the key). K-means,
    which keeps its rows in memory, sees equal rows as one with a weight, in tasks of at most
    ROWS_PER_TASK or so; the components come from one pass over all rows.
    """
    rows = complete_rows(df, [*predictors, *([key] if key else [])])
    plan = plan_predictors(rows, predictors)
    codes = _stored_codes(rows, plan)
    kept = [V.col(key)] if key else []
    names = _names(plan)
    data = stage(build_features(rows, plan, codes).select(*kept, *names), "features")
    cells = _laid_out(stage(_counted(data, plan, ()), "cells"), plan, 1, ())
    clusters = KMeans(k=k, seed=SEED, featuresCol="features", predictionCol="cluster",
                      weightCol="weight").fit(cells)
    inertia = clusters.summary.trainingCost
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(data)
    stages: list[Model] = [clusters]
    if len(names) >= 2:
        centred = StandardScaler(withMean=True, withStd=False, inputCol="features",
                                 outputCol="centred").fit(vectors)
        plane = PCA(k=2, inputCol="centred", outputCol="plane").fit(centred.transform(vectors))
        stages += [centred, plane]
    model = PipelineModel(stages)
    trained = Trained("clustering", model, plan, codes, None, {"k": k, "inertia": inertia})
    placed = model.transform(vectors)
    plane = vector_to_array("plane") if len(names) >= 2 else F.array(F.col("__f0"), F.lit(0.0))
    return trained, placed.select(*kept, "cluster", plane[0].alias("x"), plane[1].alias("y"))


def plot_sample(rows: DataFrame, key: str, size: int = PLOT_POINTS) -> DataFrame:
    """At most 150 rows for plotting, the same ones on every run."""
    return explore.hash_sample(rows, key, size)


def score(trained: Trained, df: DataFrame) -> DataFrame:
    """Add the model's answer to every row of any table with the predictors.

    Classes come with their probability. Labels unseen in training get code 0;
    rows with a missing number or date keep a null answer.
    """
    data = _assembled(df, trained.predictors, trained.codes, "keep")
    usable = frequency.all_of([F.col(f"__f{i}").isNotNull() for i in range(len(trained.features))])
    inputs = [V.col(c) for c in df.columns]
    out = trained.model.transform(data)
    if trained.mode == "clustering":
        name = F.concat(F.lit("Cluster "), F.col("cluster").cast("string"))
        return out.select(*inputs, F.when(usable, name).alias("prediction"))
    if trained.mode == "regression":
        return out.select(*inputs, F.when(usable, F.col("prediction")).alias("prediction"))
    names = trained.codes[trained.target].select(
        F.col("label").alias("__class"), F.col("code").alias("__code"))
    best = F.array_max(vector_to_array("probability"))
    # The learner itself keeps one tree statistic per class, so classes are few.
    return out.join(F.broadcast(names), F.col("prediction") == F.col("__code"), "left").select(
        *inputs, F.when(usable, F.col("__class")).alias("predicted"),
        F.when(usable, best).alias("confidence"))


# --- storage --------------------------------------------------------------------------------

def save(trained: Trained, path: str) -> None:
    """Model, label codes and plan under one folder."""
    spark = SparkSession.getActiveSession()
    model = trained.model
    whole = model if isinstance(model, PipelineModel) else PipelineModel(stages=[model])
    whole.write().save(f"{path}/model")
    for i, codes in enumerate(trained.codes.values()):
        codes.write.parquet(f"{path}/codes{i}")
    plan = {"mode": trained.mode, "predictors": [list(p) for p in trained.predictors],
            "codes": list(trained.codes), "target": trained.target, "params": trained.params}
    spark.createDataFrame([(json.dumps(plan),)], "value string").coalesce(1).write.text(
        f"{path}/plan")


def load(spark: SparkSession, path: str) -> Trained:
    plan = json.loads(spark.read.text(f"{path}/plan").first()["value"])
    whole = PipelineModel.load(f"{path}/model")
    model = whole if plan["mode"] == "clustering" else whole.stages[0]
    codes = {name: spark.read.parquet(f"{path}/codes{i}") for i, name in enumerate(plan["codes"])}
    return Trained(plan["mode"], model, [Predictor(*p) for p in plan["predictors"]], codes,
                   plan["target"], plan["params"])
