"""Exact centroid clustering with a filter on PCA-rotated coordinates.

All vectors are whole numbers. Their second moments over all rows give the principal axes,
and every vector is stored once with its LEADING first rotated coordinates and the norm of the
remaining ones. In each round a task rotates the centroids likewise: the squared distance of
the leading coordinates plus the squared difference of the residual norms is a lower bound of
the squared distance. The centroid with the least bound is measured in integers first; a
centroid whose bound, less the rounding it may carry, exceeds that distance is out, and the
survivors are measured in integers too. So the axes steer speed only and every answer is exact.

A round sums the vectors of each cluster task by task; only these sums (one row for a cluster
and component) are shuffled, and the driver sees the centroids alone.

Defined results: components become floor(256 * x), values beyond a 64-bit integer the nearest
one; vectors with another number of components, or with a null or non-finite one, take no part;
repeated rows each count; a null id takes part, but starts a centroid only after all others;
rows that share an id start by their components; with fewer vectors than centroids each starts
one; distances and inertias beyond a 64-bit integer are null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsight.llm.registry import query, read
from gridsight.session import stage

CENTROIDS = 40
ROUNDS = 5
COMPONENTS = 64
LEADING = 16
#: Largest magnitude whose squared distances fit 64-bit integers, for up to 256 components.
NARROW = 2 ** 26
#: Survivors measured at once.
CHUNK = 1 << 16
LONG_MAX = 2 ** 63 - 1


def squared(points: np.ndarray, others: np.ndarray, narrow: bool) -> np.ndarray:
    """Exact squared distances of rows, as Python integers where 64 bits do not do."""
    d = points - others if narrow else points.astype(object) - others.astype(object)
    return (d * d).sum(axis=1)


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Axes:
    """Principal axes around a mean."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray, leading: int):
        self.mean, self.axes, self.leading = mean, axes, leading

    def rotated(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates, and the norm of the others."""
        turned = (points.astype(np.float64) - self.mean) @ self.axes
        rest = turned[:, self.leading:]
        return turned[:, :self.leading], np.sqrt((rest * rest).sum(axis=1))


def nearest(points: np.ndarray, lead: np.ndarray, residual: np.ndarray, centroids: np.ndarray,
            axes: Axes) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of every point, ties to the smaller number, and how many
    distances were measured."""
    c_lead, c_residual = axes.rotated(centroids)
    c_norm = (c_lead * c_lead).sum(axis=1)
    norm = (lead * lead).sum(axis=1)
    bound = norm[:, None] - 2 * (lead @ c_lead.T) + c_norm + (residual[:, None] - c_residual) ** 2
    # Rounding is relative to the norms, not to the distance.
    bound -= 1e-9 * ((norm + residual * residual)[:, None] + c_norm + c_residual * c_residual + 1)
    largest = max(np.abs(x).max(initial=0) for x in (points.astype(np.float64), centroids.astype(np.float64)))
    narrow = bool(largest <= NARROW)
    cluster = np.argmin(bound, axis=1)
    best = squared(points, centroids[cluster], narrow)
    far = best.astype(np.float64) * (1 + 1e-9) + 1
    alive = bound <= far[:, None]
    alive[np.arange(len(points)), cluster] = False
    row, number = np.nonzero(alive)
    measured = len(points) + len(row)
    for at in range(0, len(row), CHUNK):
        r, c = row[at:at + CHUNK], number[at:at + CHUNK]
        d = squared(points[r], centroids[c], narrow)
        # Of several survivors of a point, the nearest with the smallest number comes first.
        order = np.lexsort((c, d, r)) if narrow else np.array(
            sorted(range(len(r)), key=lambda i: (r[i], d[i], c[i])), np.int64)
        r, c, d = r[order], c[order], d[order]
        first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        r, c, d = r[first], c[first], d[first]
        better = (d < best[r]) | ((d == best[r]) & (c < cluster[r]))
        better = better.astype(bool)
        best[r[better]], cluster[r[better]] = d[better], c[better]
    return cluster, best, measured


def _moments(points: DataFrame, width: int) -> Axes:
    """Principal axes of all rows: sums and products are added up task by task."""
    schema = T.StructType([T.StructField("_sums", T.ArrayType(T.DoubleType(), False))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + width + width * width)
        for batch in batches:
            x = _rows(batch.column(0), width).astype(np.float64)
            total += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
        if total[0]:
            yield pa.RecordBatch.from_arrays(
                [pa.array([total], pa.list_(pa.float64()))], ["_sums"])

    sums = (points.select("_vec").mapInArrow(add, schema)
            .select(F.posexplode("_sums").alias("at", "value"))
            .groupBy("at").agg(F.sum("value").alias("value")))
    total = np.zeros(1 + width + width * width)
    for row in sums.toLocalIterator():
        total[row["at"]] = row["value"]
    n, mean = total[0], total[1:1 + width] / total[0]
    spread = total[1 + width:].reshape(width, width) / n - np.outer(mean, mean)
    _, axes = np.linalg.eigh((spread + spread.T) / 2)
    return Axes(mean, axes[:, ::-1], min(LEADING, width))


def _rotated(points: DataFrame, axes: Axes, width: int) -> DataFrame:
    """Add the leading coordinates and the residual norm."""
    schema = T.StructType([
        *points.schema.fields, T.StructField("_lead", T.ArrayType(T.DoubleType(), False)),
        T.StructField("_residual", T.DoubleType())])

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lead, residual = axes.rotated(_rows(batch.column(1), width))
                offsets = pa.array(np.arange(len(lead) + 1) * lead.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(lead.ravel())),
                     pa.array(residual)], schema.names)

    return points.mapInArrow(turn, schema)


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray, axes: Axes) -> tuple:
    """(vectors, cluster, squared distance) of a batch (vec, lead, residual)."""
    points = _rows(batch.column(0), centroids.shape[1])
    lead = _rows(batch.column(1), axes.leading)
    cluster, best, _ = nearest(points, lead, batch.column(2).to_numpy(), centroids, axes)
    return points, cluster, best


def _sums(points: DataFrame, centroids: np.ndarray, axes: Axes) -> DataFrame:
    """(cluster, at, total): at 0 the size of every cluster, then the sums of its components."""
    schema = T.StructType([
        T.StructField("_cluster", T.IntegerType()),
        T.StructField("_totals", T.ArrayType(T.StringType(), False))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, cluster, _ = _assigned(batch, centroids, axes)
            narrow = np.abs(x.astype(np.float64)).max() <= NARROW
            order = np.argsort(cluster, kind="stable")
            ends = np.flatnonzero(np.append(True, np.diff(cluster[order]) != 0))
            grouped = np.add.reduceat(x[order] if narrow else x[order].astype(object), ends, axis=0)
            sizes = np.diff(np.append(ends, len(order)))
            for c, size, total in zip(cluster[order][ends].tolist(), sizes.tolist(), grouped):
                # Python integers: sums of a task have no bound.
                row = np.array([size, *total.tolist()], object)
                totals[c] = totals[c] + row if c in totals else row
        if totals:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(totals), pa.int32()),
                 pa.array([[str(v) for v in row] for row in totals.values()], pa.list_(pa.string()))],
                ["_cluster", "_totals"])

    return (points.select("_vec", "_lead", "_residual").mapInArrow(add, schema)
            .select("_cluster", F.posexplode("_totals").alias("_at", "_total"))
            .groupBy("_cluster", "_at").agg(F.sum(F.col("_total").cast("decimal(38,0)")).alias("_total")))


def _distances(points: DataFrame, centroids: np.ndarray, axes: Axes, id_col: str) -> DataFrame:
    schema = T.StructType([
        T.StructField(id_col, points.schema["_id"].dataType), T.StructField("cluster", T.IntegerType()),
        T.StructField("distance", T.LongType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, cluster, best = _assigned(batch.select([1, 2, 3]), centroids, axes)
                distance = [d if d <= LONG_MAX else None for d in best.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())],
                    schema.names)

    return points.select("_id", "_vec", "_lead", "_residual").mapInArrow(assign, schema)


def _inertia(rows: DataFrame, *keys: str) -> DataFrame:
    """Distances summed by `keys`; null where one is unknown or the sum is beyond a long."""
    total = F.sum(F.col("distance").cast("decimal(20,0)"))
    known = (F.count("distance") == F.count(F.lit(1))) & (total <= F.lit(str(LONG_MAX)).cast("decimal(38,0)"))
    return rows.groupBy(*keys).agg(F.when(known, total).cast("long").alias("_inertia"))


def cluster_vectors(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS,
                    components: int = COMPONENTS, id_col: str = "vec_id",
                    vec_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    spark = vectors.sparkSession
    whole = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * 256).cast("long"))
    kept = F.col(vec_col).isNotNull() & (F.size(vec_col) == components) & F.forall(
        F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
        & (F.abs(x.cast("double")) < float("inf")))
    points = stage(vectors.where(kept).select(F.col(id_col).alias("_id"), whole.alias("_vec")), "vectors")
    order = F.sha2(F.concat(F.lit("2:"), F.col("_id").cast("string")), 256)
    first = points.orderBy(order.asc_nulls_last(), "_vec").limit(k).collect()
    if not first:
        types = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long",
                 "centroid_sha256": "string"}
        return points.select(F.col("_id").alias(id_col), *[
            F.lit(None).cast(t).alias(name) for name, t in types.items()])
    centroids = np.array([row["_vec"] for row in first], np.int64)
    axes = _moments(points, components)
    turned = stage(_rotated(points, axes, components), "rotated")
    for _ in range(rounds):
        sums: dict[int, dict[int, int]] = {}
        for row in _sums(turned, centroids, axes).collect():  # k x (components + 1) rows
            sums.setdefault(row["_cluster"], {})[row["_at"]] = int(row["_total"])
        centroids = centroids.copy()
        for c, total in sums.items():
            centroids[c] = [total[at + 1] // total[0] for at in range(components)]
    found = stage(_distances(turned, centroids, axes, id_col), "clusters")
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    by_cluster = _inertia(found, "cluster").select(
        F.col("cluster").alias("_of"), F.col("_inertia").alias("cluster_inertia"))
    inertia = _inertia(found).first()["_inertia"]
    digests = spark.createDataFrame(list(enumerate(names)), "_number int, centroid_sha256 string")
    facts = (
        by_cluster.withColumn("inertia", F.lit(inertia).cast("long"))
        .join(F.broadcast(digests), F.col("_of") == F.col("_number")).drop("_number"))
    # One row for each of at most k clusters.
    return found.join(F.broadcast(facts), F.col("cluster") == F.col("_of")).drop("_of")


def _oracle() -> str:
    steps = [
        """vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
starts AS (SELECT v, sha256('2:' || vec_id) AS h FROM vectors ORDER BY h, v LIMIT 40),
centroids0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM starts)"""]
    for n in range(ROUNDS + 1):
        steps.append(f"""assigned{n} AS MATERIALIZED (
  SELECT r, vec_id, a.v, arg_min(c, d * 64 + c) AS c, min(d) AS d FROM (
    SELECT r, vec_id, x.v, c, list_sum(list_transform(list_zip(x.v, y.v),
      lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
    FROM (SELECT row_number() OVER () AS r, * FROM vectors) x, centroids{n} y) a
  GROUP BY r, vec_id, a.v)""")
        if n < ROUNDS:
            steps.append(f"""sums{n} AS (
  SELECT c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM assigned{n}, range(1, 65) t(i) GROUP BY c, i),
centroids{n + 1} AS MATERIALIZED (
  SELECT c, coalesce(new, v) AS v FROM centroids{n} LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS new FROM sums{n} GROUP BY c) USING (c))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
  sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(k.v, ',')) AS centroid_sha256
FROM assigned{ROUNDS} JOIN centroids{ROUNDS} k USING (c)
"""


@query("op12_centroid_clusters", _oracle())
def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty clusters of the embeddings after five rounds."""
    return cluster_vectors(read(spark, sf_dir, "embeddings"))
