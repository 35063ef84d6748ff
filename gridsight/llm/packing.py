"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents become ids with an end mark, and longer ones are cut into full pieces after a
first, shorter one. The plan of a packing depends on piece lengths alone, so it is made from
the number of pieces of each length (one row per length up to the capacity, whatever the
corpus holds):

* of pieces above a third of the capacity at most two share a sequence; they are matched
  greedily, the longest with the longest partner that fits;
* smaller pieces, longest first, go to the tightest gap that holds them, and into new
  sequences only when there is none.

A plan is a short list of sequence patterns with the number of times each is used. Pieces of
one length are interchangeable: they are numbered over the whole table by counts per
(length, hash bucket) and a numbering inside such a bucket, and a piece's number tells its
pattern, its sequence and its place. The number of buckets follows the largest length, so
no length lands in one task.

Defined results: a null or empty text is its end mark alone; repeated rows are packed one by
one (rows with one id share a bucket); an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsight.llm import tokens
from gridsight.llm.registry import query, read
from gridsight.session import stage

CAPACITY = 1024
END_ID = 2
#: Pieces numbered in one window, apart from rows with one id.
GROUP_ROWS = 2_000
#: Texts tokenized at once, of an Arrow batch.
TEXTS = 200


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID,
           tokenizer: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32): the cut documents, ids hashed as uint32."""
    path = tokenizer or default_tokenizer()
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                texts = pc.fill_null(part.column(1), "").to_pylist()
                rows, piece, start, length, crc = [], [], [], [], []
                for row, ids in enumerate(encoder.encode(texts)):
                    data = np.concatenate([ids, end]).astype("<u4")
                    head = (len(data) - 1) % capacity + 1
                    edges = [0, *range(head, len(data) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        rows.append(row), piece.append(k), start.append(a), length.append(b - a)
                        crc.append(zlib.crc32(data[a:b].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(crc, pa.int64())],
                    [id_col, "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(cut, schema)


Pattern = tuple[tuple[int, int], ...]  # (length, pieces of it), in the order of the sequence


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used, for `counts` pieces of each length."""
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"no place for a piece of {length} in {capacity}")
        left[length] = n
    gaps: list[list[list]] = [[] for _ in range(capacity + 1)]  # by gap: [pattern, uses]

    def put(pattern: Pattern, uses: int) -> None:
        gaps[capacity - sum(s * k for s, k in pattern)].append([pattern, uses])

    third = capacity // 3
    for a in range(capacity, third, -1):
        while left[a]:
            b = min(a, capacity - a)
            while b > third and not left[b]:
                b -= 1
            if b <= third or (a == b and left[a] < 2):
                if a == b and b > third:  # the last of its length: a shorter partner
                    b -= 1
                    while b > third and not left[b]:
                        b -= 1
                if b <= third:
                    put(((a, 1),), left[a])
                    left[a] = 0
                    continue
            n = left[a] // 2 if a == b else min(left[a], left[b])
            put(((a, 2),) if a == b else ((a, 1), (b, 1)), n)
            left[a] -= n
            left[b] -= n
    for s in range(third, 0, -1):
        n, gap = left[s], s
        while n:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            if gap > capacity:
                each = capacity // s
                if n >= each:
                    put(((s, each),), n // each)
                if n % each:
                    put(((s, n % each),), 1)
                break
            group = gaps[gap][-1]
            each = min(gap // s, n)
            uses = min(group[1], n // each)
            group[1] -= uses
            if not group[1]:
                gaps[gap].pop()
            gaps[gap - each * s].append([group[0] + ((s, each),), uses])
            n -= each * uses
            gap = s
    return [(pattern, uses) for same in gaps for pattern, uses in same]


def slots(spark: SparkSession, patterns: list[tuple[Pattern, int]]) -> DataFrame:
    """One row per (pattern, length): which numbers of that length go to which sequences."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, uses in patterns:
        offset = 0
        for length, each in pattern:
            first = taken.get(length, 0)
            taken[length] = first + each * uses
            rows.append((length, first, taken[length], sequence, each, offset))
            offset += length * each
        sequence += uses
    schema = ("_length long, _from long, _to long, _sequence long, _each long, _offset long")
    return spark.createDataFrame(rows, schema)


def pack(cut: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY,
         group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add `sequence_id` and `offset` to a stored table of pieces (read twice)."""
    spark = cut.sparkSession
    # At most one row for each length.
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    most = max(counts.values(), default=0)
    buckets = max(1, -(-most // group_rows))
    bucketed = cut.withColumn("_bucket", F.pmod(F.xxhash64(id_col, "piece"), F.lit(buckets)))
    earlier = (Window.partitionBy("_b_length").orderBy("_b_bucket")
               .rowsBetween(Window.unboundedPreceding, -1))
    before = (
        bucketed.groupBy(F.col("length").alias("_b_length"), F.col("_bucket").alias("_b_bucket"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"))
    inside = Window.partitionBy("length", "_bucket").orderBy(F.col(id_col), "piece", "start")
    numbered = (
        bucketed.withColumn("_place", F.row_number().over(inside) - 1)
        .join(before, (F.col("length") == F.col("_b_length")) & (F.col("_bucket") == F.col("_b_bucket")))
        .withColumn("_number", F.col("_before") + F.col("_place")))
    # A row per pattern and length; both are bounded by the capacity, not by the corpus.
    placed = numbered.join(
        F.broadcast(slots(spark, plan(counts, capacity))),
        (F.col("length") == F.col("_length")) & (F.col("_number") >= F.col("_from"))
        & (F.col("_number") < F.col("_to")))
    nth = F.col("_number") - F.col("_from")
    return placed.select(
        *cut.columns, (F.col("_sequence") + F.floor(nth / F.col("_each"))).alias("sequence_id"),
        (F.col("_offset") + nth % F.col("_each") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """Tokenize, cut and pack; pieces are stored once, without texts and ids."""
    return pack(stage(pieces(docs, **options), "pieces"))


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    return pack_documents(read(spark, sf_dir, "documents"))
