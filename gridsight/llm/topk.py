"""Exact top-k search by inner product with cover trees over queries and data.

Equal vectors are one point with its few smallest ids, so copies cost nothing. Points are
put in cells around pivots and cells are cut into blocks; each block is one row that holds
its points and their cover tree: a node covers its points within a radius of its centre,
its children halve that radius, and the first child keeps the centre. Query points get
blocks and trees of the same kind.

Two trees are walked together. For a pair of nodes no inner product can exceed
c.c' + |c| r' + |c'| r + r r'; a pair whose bound is under the worst k-th score of the query
node's points is dropped with everything below it. What remains at the leaves is multiplied
out. Every query block first meets a block of its own cell, and the k-th scores found
there prune its walks through all other blocks; the best of all walks are merged. Each walk
is one row with two blocks, so memory is bounded by the block size and any walk can be
repeated elsewhere.

Defined results: vectors that are null or hold a null or non-finite component, and rows
without an id, take no part; repeated rows count once; shorter vectors count as padded with
zeros; ties go to the smaller id; with fewer candidates than k all are returned; an empty
table gives no rows. Where products may leave the whole numbers of a double (2**53), points
whose rounded score could be among the best are scored once more in whole numbers, and scores
travel as decimals; one that does not fit a long is returned as null, at its right rank.
Components beyond 2**60 after scaling count as 2**60.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsight.llm.registry import query, read
from gridsight.session import stage

TOP = 5
#: Points of a block, on the data and on the query side.
BLOCK = 4096
QUERY_BLOCK = 1024
#: Pivots, a bounded sample of the points; they steer speed only.
MAX_PIVOTS = 512
LEAF = 32
#: Points multiplied out at once for a query leaf: few at first, for a k-th score to prune by.
FIRST_BATCH = 128
BATCH = 4096
#: Relative rounding error allowed for in sums of products of doubles.
SLACK = 1e-11
#: Largest component after scaling, so that sums of products fit a decimal of 38 digits.
LARGEST = 2 ** 60

NODE = np.dtype([("centre", "<i4"), ("radius", "<f8"), ("child", "<i4"), ("child_end", "<i4"),
                 ("point", "<i4"), ("point_end", "<i4")])


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, nodes): `points[order]` puts the points of every node next to each other;
    nodes hold rows of that order and ranges of their children. Node 0 is the root."""
    n = len(points)

    def distances(rows: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((points[rows] - points[centre]) ** 2).sum(axis=1))

    order = np.empty(n, np.int64)
    every = np.arange(n)
    root = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))
    reach = distances(every, root)
    found = [[root, float(reach.max()), 0, 0, 0, n]]
    todo = [(0, every)]
    while todo:
        node, rows = todo.pop()
        centre, radius, _, _, lo, hi = found[node]
        if len(rows) <= LEAF or radius == 0:
            order[lo:hi] = rows
            continue
        found[node][2] = len(found)
        rest, at = rows, lo
        while len(rest):
            d = distances(rest, centre)
            near = d <= radius / 2
            inside = rest[near]
            todo.append((len(found), inside))
            found.append([centre, float(d[near].max()), 0, 0, at, at + len(inside)])
            at += len(inside)
            rest, d = rest[~near], d[~near]
            if len(rest):
                centre = int(rest[np.argmax(d)])
        found[node][3] = len(found)
    nodes = np.array([tuple(x) for x in found], NODE)
    place = np.empty(n, np.int64)
    place[order] = every
    nodes["centre"] = place[nodes["centre"]]
    return order, nodes


class Tree:
    """A block's points in tree order, its nodes, and the first id of each point."""

    def __init__(self, points: np.ndarray, nodes: np.ndarray, ids: np.ndarray):
        self.whole, self.nodes, self.ids = points, nodes, ids
        self.points = points.astype(np.float64)
        self.lengths = np.sqrt((self.points ** 2).sum(axis=1))
        self.centres = self.points[nodes["centre"]]
        self.norms = self.lengths[nodes["centre"]]
        self.radii = nodes["radius"] * (1 + 1e-9) + SLACK * self.lengths.max(initial=0)


class Best:
    """The k best (score, id, point) of every query point so far; whole numbers if `wide`."""

    def __init__(self, n: int, k: int, floor: np.ndarray, wide: bool = False):
        self.k, self.floor, self.wide = k, floor, wide  # floor: a k-th score known from elsewhere
        self.scores = np.full((n, k), -np.inf, object if wide else np.float64)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.points = np.full((n, k), -1)

    def worst(self, lo: int, hi: int) -> np.ndarray:
        return np.maximum(self.scores[lo:hi, -1].astype(np.float64), self.floor[lo:hi])

    def meet(self, queries: Tree, lo: int, hi: int, data: Tree, rows: np.ndarray) -> None:
        """Offer the points `rows` of `data` to the query points lo to hi."""
        scores = queries.points[lo:hi] @ data.points[rows].T
        if not self.wide:
            self.offer(lo, scores, data.ids[rows], rows)
            return
        doubt = SLACK * queries.lengths[lo:hi, None] * data.lengths[rows]
        worst = self.worst(lo, hi)
        for i in range(hi - lo):
            low, high = scores[i] - doubt[i], scores[i] + doubt[i]
            least = np.partition(low, -self.k)[-self.k] if len(rows) > self.k else -np.inf
            near = rows[high >= max(worst[i] - SLACK * abs(worst[i]), least)]
            exact = data.whole[near].astype(object) @ queries.whole[lo + i].astype(object)
            self._keep(lo + i, exact, data.ids[near], near)

    def offer(self, lo: int, scores: np.ndarray, ids: np.ndarray, points: np.ndarray) -> None:
        worst = self.worst(lo, lo + len(scores))
        for i in np.flatnonzero((scores >= worst[:, None]).any(axis=1)).tolist():
            row = scores[i]
            least = worst[i]
            if len(row) > 8 * self.k:
                least = max(least, np.partition(row, -self.k)[-self.k])
            new = np.flatnonzero(row >= least)
            self._keep(lo + i, row[new], ids[new], points[new])

    def _keep(self, at: int, scores: np.ndarray, ids: np.ndarray, points: np.ndarray) -> None:
        s = np.concatenate([self.scores[at], scores])
        j = np.concatenate([self.ids[at], ids])
        p = np.concatenate([self.points[at], points])
        if self.wide:
            top = sorted(range(len(s)), key=lambda x: (-s[x], j[x]))[:self.k]
        else:
            top = np.lexsort((j, -s))[:self.k]
        self.scores[at], self.ids[at], self.points[at] = s[top], j[top], p[top]


def walk(queries: Tree, data: Tree, best: Best) -> None:
    """Improve `best` of all query points by all data points."""
    q_nodes, d_nodes = queries.nodes, data.nodes
    todo = [(0, np.array([0]))]
    while todo:
        q, pairs = todo.pop()
        lo, hi = int(q_nodes["point"][q]), int(q_nodes["point_end"][q])
        bound = (data.centres[pairs] @ queries.centres[q] + queries.norms[q] * data.radii[pairs]
                 + queries.radii[q] * (data.norms[pairs] + data.radii[pairs]))
        # Against rounding, of the bound and of large scores; scores are whole numbers.
        bound += 1e-9 * np.abs(bound) + 0.5 + SLACK * data.norms[pairs] * queries.norms[q]
        keep = bound >= best.worst(lo, hi).min()
        pairs, bound = pairs[keep], bound[keep]
        if not len(pairs):
            continue
        inner = d_nodes["child_end"][pairs] > 0
        below = [np.arange(a, b) for a, b in zip(
            d_nodes["child"][pairs[inner]].tolist(), d_nodes["child_end"][pairs[inner]].tolist())]
        if q_nodes["child_end"][q]:
            deeper = np.concatenate([*below, pairs[~inner]])
            todo.extend((c, deeper) for c in range(q_nodes["child"][q], q_nodes["child_end"][q]))
            continue
        leaves, bound = pairs[~inner], bound[~inner]
        if len(below):
            todo.append((q, np.concatenate(below)))
        first = np.argsort(-bound, kind="stable")
        leaves, bound = leaves[first], bound[first]
        sizes = np.cumsum(d_nodes["point_end"][leaves] - d_nodes["point"][leaves])
        at, batch = 0, FIRST_BATCH
        while at < len(leaves):
            if bound[at] < best.worst(lo, hi).min():  # the highest bound left
                break
            done = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, done + batch)))
            part = leaves[at:to]
            rows = np.concatenate([np.arange(a, b) for a, b in zip(
                d_nodes["point"][part].tolist(), d_nodes["point_end"][part].tolist())])
            best.meet(queries, lo, hi, data, rows)
            at, batch = to, min(BATCH, 4 * batch)


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component, within -LARGEST and LARGEST."""
    edge = float(LARGEST)
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-edge), F.least(
        F.lit(edge), x.cast("double") * factor))))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                                         & (F.abs(x.cast("double")) < float("inf")))


def _celled(points: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """Add `_cell`, the nearest pivot, and pad the vectors to `width`."""
    schema = T.StructType([
        *points.schema.fields, T.StructField("_cell", T.IntegerType())])
    half = (pivots * pivots).sum(axis=1) / 2

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = batch.schema.get_field_index("_vec")
                rows = _matrix(batch.column(at), width)
                cell = np.argmax(rows.astype(np.float64) @ pivots.T - half, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell, pa.int32())], schema.names)

    return points.mapInArrow(near, schema)


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow list column, padded with zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(vectors.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _bytes(wide: bool) -> str:
    """The type of stored components."""
    return "<i8" if wide else "<i4"


def _blocks(points: DataFrame, size: int, width: int, wide: bool, label: str) -> DataFrame:
    """One row per block: (cell, part, vectors, ids, first ids, nodes), in tree order.

    Cells are cut by hash into parts of about `size` points, so no group grows with the data.
    """
    counts = points.groupBy(F.col("_cell").alias("_of")).agg(
        F.ceil(F.count(F.lit(1)) / size).alias("_parts"))
    parted = (
        points.join(counts, F.col("_cell") == F.col("_of"))
        .withColumn("_part", F.pmod(F.xxhash64("_vec"), F.col("_parts")))
        .select("_cell", "_part", "_vec", "_ids"))
    schema = T.StructType([
        T.StructField("_cell", T.IntegerType()), T.StructField("_part", T.LongType()),
        T.StructField("_points", T.BinaryType()),
        T.StructField("_vecs", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("_ids", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("_nodes", T.BinaryType())])

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        vectors = table["_vec"].chunk(0)
        points = _matrix(vectors, width)
        order, nodes = cover_tree(points.astype(np.float64))
        take = pa.array(order)
        return pa.table({
            "_cell": table["_cell"].slice(0, 1), "_part": table["_part"].slice(0, 1),
            "_points": pa.array([points[order].astype(_bytes(wide)).tobytes()], pa.binary()),
            "_vecs": pa.array([vectors.take(take).to_pylist()], pa.list_(pa.list_(pa.int64()))),
            "_ids": pa.array([table["_ids"].chunk(0).take(take).to_pylist()],
                             pa.list_(pa.list_(pa.int64()))),
            "_nodes": pa.array([nodes.tobytes()], pa.binary())})

    return stage(parted.groupBy("_cell", "_part").applyInArrow(build, schema), label)


def _walked(pairs: DataFrame, k: int, width: int, wide: bool) -> DataFrame:
    """Walk every row's two blocks: (vec, score, ids) of the best points, and per query
    point at most k of them. `_floors` holds a known k-th score for each query point."""
    schema = T.StructType([
        T.StructField("_q_cell", T.IntegerType()), T.StructField("_q_part", T.LongType()),
        T.StructField("_at", T.IntegerType()),
        T.StructField("_score", T.DecimalType(38, 0) if wide else T.LongType()),
        T.StructField("_ids", T.ArrayType(T.LongType()))])

    stored = np.dtype(_bytes(wide))

    def tree(points: bytes, nodes: bytes, ids: list[list[int]]) -> Tree:
        return Tree(np.frombuffer(points, stored).reshape(-1, width), np.frombuffer(nodes, NODE),
                    np.array([x[0] for x in ids], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {f: batch.column(f)[row].as_py() for f in batch.schema.names}
                # Query points need no ids in a walk.
                n = len(r["_q_points"]) // (stored.itemsize * width)
                queries = tree(r["_q_points"], r["_q_nodes"], [[0]] * n)
                data = tree(r["_points"], r["_nodes"], r["_ids"])
                floor = np.array(r["_floors"] or [], np.float64)
                best = Best(n, k, floor if len(floor) else np.full(n, -np.inf), wide)
                walk(queries, data, best)
                at, rank = np.nonzero(best.points >= 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["_q_cell"]] * len(at), pa.int32()),
                     pa.array([r["_q_part"]] * len(at), pa.int64()), pa.array(at, pa.int32()),
                     pa.array([Decimal(s) for s in best.scores[at, rank].tolist()], pa.decimal128(38, 0))
                     if wide else pa.array(best.scores[at, rank].astype(np.int64), pa.int64()),
                     pa.array([r["_ids"][p] for p in best.points[at, rank].tolist()],
                              pa.list_(pa.int64()))], [f.name for f in schema])

    return pairs.mapInArrow(run, schema)


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows by (score, smaller id) of each key."""
    order = Window.partitionBy(*keys).orderBy(F.col("_score").desc(), "_id")
    return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP, id_col: str = "vec_id",
          vec_col: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows other than itself with the highest inner
    product of scaled vectors, for every row that `is_query` picks."""
    deep = k + 1  # the query itself may be among them
    rows = stage(
        vectors.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("_id"), scaled(F.col(vec_col)).alias("_vec"),
                F.coalesce(is_query, F.lit(False)).alias("_asks")), "vectors")
    size = rows.agg(
        F.max(F.size("_vec")).alias("width"), F.count(F.lit(1)).alias("n"),
        F.max(F.array_max(F.transform("_vec", F.abs))).alias("most")).first()
    result = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()),
                           T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
    if not size["n"]:
        return rows.sparkSession.createDataFrame([], result)
    width = max(1, size["width"])
    wide = width * (size["most"] or 0) ** 2 >= 2 ** 53

    # One point for equal vectors, with their smallest ids; the limit runs before the shuffle.
    same = Window.partitionBy("_vec").orderBy("_id")
    points = (
        rows.select("_vec", "_id").distinct().withColumn("_nth", F.row_number().over(same))
        .where(F.col("_nth") <= deep).groupBy("_vec").agg(F.sort_array(F.collect_list("_id")).alias("_ids")))
    points = stage(points, "points")
    wanted = min(MAX_PIVOTS, max(1, points.count() // block))
    chosen = points.orderBy(F.xxhash64("_vec"), "_vec").limit(wanted).select("_vec").collect()
    pivots = np.zeros((len(chosen), width))
    for pivot, row in zip(pivots, chosen):
        pivot[:len(row["_vec"])] = row["_vec"]

    data = _blocks(_celled(points, pivots, width), block, width, wide, "data-blocks")
    asking = rows.where("_asks").select("_vec").distinct().withColumn("_ids", F.array(F.lit(0).cast("long")))
    asked = _blocks(_celled(asking, pivots, width), query_block, width, wide, "query-blocks")
    q_side = asked.select(
        F.col("_cell").alias("_q_cell"), F.col("_part").alias("_q_part"),
        F.col("_points").alias("_q_points"), F.col("_nodes").alias("_q_nodes"))
    d_side = data.select("_cell", "_part", "_points", "_nodes", "_ids")

    home = (
        q_side.join(d_side.where(F.col("_part") == 0), F.col("_q_cell") == F.col("_cell"))
        .withColumn("_floors", F.lit(None).cast("array<double>")))
    key = ["_q_cell", "_q_part", "_at"]
    found = stage(_walked(home, deep, width, wide), "home")
    kth = (
        _first(found.withColumn("_id", F.explode("_ids")), key, deep)
        .where(F.col("_rank") == deep).select(*key, F.col("_score").alias("_kth")))
    # The k-th scores of a query block in the order of its points, which it bounds.
    floors = (
        asked.select(F.col("_cell").alias("_q_cell"), F.col("_part").alias("_q_part"),
                     F.explode(F.sequence(F.lit(0), F.size("_vecs") - 1)).alias("_at"))
        .join(kth, key, "left").groupBy("_q_cell", "_q_part")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.coalesce(
            F.col("_kth").cast("double"), F.lit(float("-inf"))).alias("s")))), lambda x: x["s"])
            .alias("_floors")))
    # Every query block meets every other data block, cell by cell; cells are bounded.
    pairs = (
        floors.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(len(chosen) - 1))))
        .join(d_side, "_cell").where((F.col("_cell") != F.col("_q_cell")) | (F.col("_part") != 0))
        .join(q_side, ["_q_cell", "_q_part"])
        .repartition("_q_cell", "_q_part", "_cell", "_part"))
    walked = found.union(_walked(pairs, deep, width, wide))

    best = _first(walked.withColumn("_id", F.explode("_ids")), key, deep)
    of_point = best.groupBy(*key).agg(F.collect_list(F.struct("_score", "_id")).alias("_best"))
    vec_of = asked.select(F.col("_cell").alias("_q_cell"), F.col("_part").alias("_q_part"),
                          F.posexplode("_vecs").alias("_at", "_vec"))
    answers = vec_of.join(of_point, key).select("_vec", "_best")
    own = (
        rows.where("_asks").select("_id", "_vec").distinct().join(answers, "_vec")
        .select(F.col("_id").alias("query_id"), F.filter(
            F.array_sort(F.transform("_best", lambda b: F.struct(
                (-b["_score"]).alias("down"), b["_id"].alias("id")))),
            lambda b: b["id"] != F.col("_id")).alias("_top")))
    return own.select("query_id", F.posexplode(F.slice("_top", 1, k)).alias("rank", "_hit")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("_hit")["id"].alias("vec_id"),
        (-F.col("_hit")["down"]).try_cast("long").alias("score"))


ORACLE = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op4_top_k", ORACLE)
def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of every fiftieth vector."""
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
