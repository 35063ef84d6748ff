"""Ranked lexical search by dense blocked matrix products.

Every item asks with its distinct terms. A document meets an item with the sum, over the
item's terms, of the term's weight times the term's impact in the document; both are whole
numbers that depend on counts over all documents. One pass over the texts keeps, for every
document, the terms that some item asks for and how often it has them. Then items and
documents are cut into tiles: an item tile has a compact vocabulary of its own, of which some
columns at a time are laid out as a dense matrix (items x columns of weights), the same
columns of a document tile as another one (columns x documents of impacts), and a float64
product gives their partial scores. Columns are taken only as long as their weights times the
largest impact stay below 2**53, so partial sums are exact in any order of addition; they are
added up as 64-bit integers.

A tile keeps, for each item, all documents whose score reaches the k-th best known so far and
then the first k in the order (score, smaller id), so ties never depend on tiles. Scores
of a share of the documents give each item a floor that the other tiles have to reach;
the best of all tiles are merged in two steps, so an item's rows do not meet in one task first.

Items are searched in rounds whose terms fit into ROUND_TERMS; more items mean more rounds,
and a round's terms, weights and items are the only data sent to all tasks.

Defined results: terms are maximal runs of ASCII letters and digits and of all characters
beyond ASCII, A-Z lower-cased; null and empty texts have none. Each row of the documents is a
document of its own, and a null id comes after all others of the same score. Rows of one item
id are one item with the terms of all their texts; a null item id is an item too. An item without
terms, or whose terms no document holds, gives no rows; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsight.llm.registry import query, read
from gridsight.session import stage

TOP = 50
#: Terms of all items of a round, each item's counted.
ROUND_TERMS = 1 << 18
ITEM_TILE = 256
DOC_TILE = 1024
COLUMNS = 2048
#: The largest impact that any term frequency reaches, and the largest exact sum.
MAX_IMPACT = 10 ** 6
EXACT = 2 ** 53
#: One document in so many is searched first, for a floor of every item.
FLOOR_SHARE = 64
LAST_ID = np.iinfo(np.int64).max

#: ASCII letters in lower case, digits and bytes beyond ASCII stay; all else parts terms.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order, with repeats."""
    return text.translate(_TERM_BYTES).split()


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term): the distinct terms of every item."""
    low = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    term = F.regexp_extract_all(low, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1))
    return items.select(F.col(id_col).cast("long").alias("_item"), F.explode(term).alias("_term")).distinct()


def _counted(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, tf): all terms counted, and those of the vocabulary by number."""
    schema = T.StructType([
        T.StructField("_id", T.LongType()), T.StructField("_n", T.LongType()),
        T.StructField("_terms", T.ArrayType(T.IntegerType(), False)),
        T.StructField("_tf", T.ArrayType(T.LongType(), False))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sizes, terms, tf = [], [0], [], []
            for text in batch.column(1).cast(pa.binary()):
                words = terms_of(text.as_py() or b"")
                found = Counter(map(vocabulary.get, words))
                found.pop(None, None)
                n.append(len(words))
                terms.extend(found.keys()), tf.extend(found.values())
                sizes.append(len(terms))
            offsets = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))],
                [f.name for f in schema])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(count, schema)


class ItemTile:
    """Up to ITEM_TILE items with their compact vocabulary, cut into exact column slices."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray):
        self.n = len(items)
        self.vocabulary = np.unique(np.concatenate(items)) if items else np.empty(0, np.int64)
        at = np.repeat(np.arange(self.n), [len(x) for x in items])
        column = np.searchsorted(self.vocabulary, np.concatenate(items))
        cost = weights[self.vocabulary]
        self.slices, lo = [], 0
        while lo < len(cost):
            upto = np.cumsum(cost[lo:lo + COLUMNS]) * MAX_IMPACT
            hi = lo + max(1, int(np.searchsorted(upto, EXACT)))
            dense = np.zeros((self.n, hi - lo))
            mine = (column >= lo) & (column < hi)
            dense[at[mine], column[mine] - lo] = cost[column[mine]]
            self.slices.append((lo, hi, dense))
            lo = hi

    def scores(self, n_docs: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """(items x documents) scores of a document tile given as (document, term, impact)."""
        column = np.searchsorted(self.vocabulary, term)
        held = np.flatnonzero(column < len(self.vocabulary))
        held = held[self.vocabulary[column[held]] == term[held]]
        order = held[np.argsort(column[held], kind="stable")]
        column, doc, impact = column[order], doc[order], impact[order]
        total = np.zeros((self.n, n_docs), np.int64)
        for lo, hi, dense in self.slices:
            part = slice(*np.searchsorted(column, [lo, hi]))
            block = np.zeros((hi - lo, n_docs))
            block[column[part] - lo, doc[part]] = impact[part]
            total += (dense @ block).astype(np.int64)
        return total


class TileTop:
    """The k best (score, smaller id) documents of every item of a tile so far."""

    def __init__(self, k: int, floors: np.ndarray):
        n = len(floors)
        self.k, self.floors = k, np.maximum(floors, 1)
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * n

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for i in np.flatnonzero((scores >= self.floors[:, None]).any(axis=1)).tolist():
            # Every document that ties with the floor is a candidate.
            new = np.flatnonzero(scores[i] >= self.floors[i])
            s = np.concatenate([self.best[i][0], scores[i][new]])
            d = np.concatenate([self.best[i][1], ids[new]])
            first = np.lexsort((d, -s))[:self.k]
            self.best[i] = s[first], d[first]
            if len(first) == self.k:
                self.floors[i] = max(self.floors[i], s[first[-1]])


def impacts(n: list[int], sizes: np.ndarray, tf: np.ndarray, docs: int, length: int) -> np.ndarray:
    """The impact of every listed term frequency in its document of n terms."""
    m = np.array([50 + (50 * x * docs) // length if length else 50 for x in n], np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, sizes))


def _searched(counted: DataFrame, items: list[list[int]], weights: np.ndarray, floors: np.ndarray,
              docs: int, length: int, k: int) -> DataFrame:
    """(item number, score, id): at most k rows for each item from every task."""
    schema = T.StructType([T.StructField("_at", T.IntegerType()), T.StructField("_score", T.LongType()),
                           T.StructField("_id", T.LongType())])
    asked = [np.array(x, np.int64) for x in items]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = range(0, len(asked), ITEM_TILE)
        tiles = [ItemTile(asked[at:at + ITEM_TILE], weights) for at in starts]
        tops = [TileTop(k, floors[at:at + ITEM_TILE].copy()) for at in starts]
        for batch in batches:
            for at in range(0, batch.num_rows, DOC_TILE):
                part = batch.slice(at, DOC_TILE)
                listed = part.column(2)
                sizes = pc.list_value_length(listed).to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(part.num_rows), sizes)
                impact = impacts(part.column(1).to_pylist(), sizes, part.column(3).flatten().to_numpy(),
                                 docs, length)
                term = listed.flatten().to_numpy().astype(np.int64)
                ids = pc.fill_null(part.column(0), LAST_ID).to_numpy()
                for tile, top in zip(tiles, tops):
                    top.offer(tile.scores(part.num_rows, doc, term, impact), ids)
        for start, top in zip(starts, tops):
            for i, (s, d) in enumerate(top.best):
                if len(s):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([start + i] * len(s), pa.int32()), pa.array(s), pa.array(d)],
                        [f.name for f in schema])

    return counted.select("_id", "_n", "_terms", "_tf").mapInArrow(search, schema)


def _first(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item number, by way of the k best of each of 64 parts."""
    order = [F.col("_score").desc(), F.col("_id")]
    parts = Window.partitionBy("_at", F.pmod(F.xxhash64("_id"), F.lit(64))).orderBy(*order)
    few = rows.withColumn("_nth", F.row_number().over(parts)).where(F.col("_nth") <= k).drop("_nth")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("_at").orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def ranked_search(items: DataFrame, docs: DataFrame, k: int = TOP, item_id: str = "item_id",
                  item_text: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    spark = docs.sparkSession
    result = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("rank", T.IntegerType()),
                           T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    asked = stage(item_terms(items, item_id, item_text), "item-terms")
    rounds = math.ceil(asked.count() / ROUND_TERMS)
    found, stats = [], None
    for turn in range(rounds):
        mine = asked.where(F.pmod(F.xxhash64("_item"), F.lit(rounds)) == turn)
        by_item: dict[int | None, list[int]] = {}
        vocabulary: dict[bytes, int] = {}
        for row in mine.toLocalIterator():
            number = vocabulary.setdefault(row["_term"].encode(), len(vocabulary))
            by_item.setdefault(row["_item"], []).append(number)
        if not by_item:
            continue
        counted = stage(_counted(docs, id_col, text_col, vocabulary), "counted")
        if stats is None:
            stats = counted.where(F.col("_n") > 0).agg(
                F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("_n"), F.lit(0)).alias("length")).first()
        df = np.zeros(len(vocabulary), np.int64)
        for row in counted.select(F.explode("_terms").alias("t")).groupBy("t").count().toLocalIterator():
            df[row["t"]] = row["count"]
        weights = np.array([math.floor(1000 * math.log((2 * stats["docs"] + 2) / (2 * x + 1)))
                            for x in df.tolist()], np.int64)
        listed = list(by_item.values())
        names = spark.createDataFrame(
            [(n, name) for n, name in enumerate(by_item)], "_at int, item_id long")
        search = (listed, weights)
        some = counted.where(F.pmod(F.xxhash64("_id", "_n"), F.lit(FLOOR_SHARE)) == 0)
        floors = np.zeros(len(listed), np.int64)
        early = _first(_searched(some, *search, floors, stats["docs"], stats["length"], k), k)
        for row in early.where(F.col("rank") == k).toLocalIterator():
            floors[row["_at"]] = row["_score"]
        best = _first(_searched(counted, *search, floors, stats["docs"], stats["length"], k), k)
        found.append(best.join(F.broadcast(names), "_at").select(
            "item_id", "rank",
            F.when(F.col("_id") != int(LAST_ID), F.col("_id")).alias("doc_id"), F.col("_score").alias("score")))
    if not found:
        return spark.createDataFrame([], result)
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


ORACLE = r"""
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM sizes),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM dfs, totals),
item_terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length))))::BIGINT AS score
  FROM item_terms JOIN weights USING (term) JOIN tfs USING (term) JOIN sizes USING (doc_id), totals
  GROUP BY item_id, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


@query("op11_ranked_search", ORACLE)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents of every benchmark item."""
    return ranked_search(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"))
