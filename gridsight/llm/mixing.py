"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source size.
Documents stand in order of (size, digest of the id), so a systematic sample takes its
share of every size and the words taken stay close to the target. The rank of a document
gives the prefix sum of expected copies; with one random offset per source, a document
is emitted once for each whole number that its step crosses.

Ranks do not need a source in one place: rows are counted per (source, size, digest
prefix); these counts are added up over the sizes of a source first and over the prefixes
of one size second, and rows are numbered inside such a group only. The prefix grows with
the largest (source, size) group, so a hot source is split at any size. What one task adds
up is one row for each size of a source, or for each prefix of a size; targets take one
row for each source.

Defined results: a null text has size 0; a null source is a source of its own, last in
order; a source of size 0 has target 0 and emits nothing; an empty table gives no rows;
repeated rows are separate documents. Rows with one id and one size cannot be told apart,
so they share a group, and only the number of copies among them is fixed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsight.llm.registry import query, read, word_count
from gridsight.session import stage

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
#: Rows numbered in one task's window, apart from rows with one id.
GROUP_ROWS = 2_000
#: Hex digits of the prefix that rows are counted by, and the most there can be. Only a
#: size with more than 16^PREFIX_DIGITS groups is counted again, by more digits.
PREFIX_DIGITS = 4
MAX_DIGITS = 10


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS,
            max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Add `_target` to (_source, _size): the words to take from each source.

    Sources by code point, nulls last, take `weights` in turn and share the total size by
    them. No target exceeds max_repeat sizes: sources are put in order of the level at
    which they are full, and the excess of the full ones raises the level of the rest.
    """
    in_order = Window.orderBy(F.col("_source").asc_nulls_last())
    turn = F.array(*[F.lit(w) for w in weights])
    full = (
        sources.withColumn("_turn", F.row_number().over(in_order))
        .withColumn("_weight", F.get(turn, (F.col("_turn") - 1) % len(weights)))
        .withColumn("_cap", max_repeat * F.col("_size"))
        .withColumn("_full_at", F.col("_cap").cast("double") / F.col("_weight")))
    before = Window.orderBy("_full_at", "_turn").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (
        (F.sum("_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .cast("double")
        / (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0)))
    )
    shared = full.withColumn("_level", level)
    open_level = F.min(F.when(F.col("_level") <= F.col("_full_at"), F.struct("_full_at", "_level")))
    return (
        shared.withColumn("_open", open_level.over(everything)["_level"])
        .withColumn("_target", F.least(
            F.col("_cap").cast("double"),
            F.coalesce(F.col("_open"), F.lit(float("inf"))) * F.col("_weight")))
        .select("_source", "_size", "_target"))


def offset(source: Column, seed: int) -> Column:
    """The random start of a source, in [0, 1)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\0"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))


def mix(docs: DataFrame, size: str, id_col: str = "doc_id", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = 42,
        group_rows: int = GROUP_ROWS) -> DataFrame:
    """(row, source_size, target, copies): every row of `docs` as a struct, with the number of
    its copies, 0 to max_repeat. `size` names a non-null long column."""
    keyed = docs.select(
        F.struct(*docs.columns).alias("row"), F.col(id_col).alias("_id"),
        F.col(source_col).alias("_of"), F.col(size).alias("_words"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("_digest"))

    def counted(digits: int) -> DataFrame:
        return stage(
            keyed.groupBy(F.col("_of").alias("_source"), F.col("_words").alias("_each"),
                          F.substring("_digest", 1, digits).alias("_prefix"))
            .agg(F.count(F.lit(1)).alias("_rows")), "mix-groups")

    groups = counted(PREFIX_DIGITS)
    sizes = groups.groupBy("_source", "_each").agg(F.sum("_rows").alias("_rows"))
    rows = sizes.agg(F.max("_rows")).first()[0] or 0
    digits = min(MAX_DIGITS, max(0, math.ceil(math.log(max(1, rows / group_rows), 16))))
    if digits > PREFIX_DIGITS:
        groups = counted(digits)

    by_source = sizes.groupBy("_source").agg(
        F.sum(F.col("_rows") * F.col("_each")).alias("_size"))
    plan = targets(by_source, weights, max_repeat).select(
        F.col("_source").alias("_plan_source"), F.col("_size").alias("_source_size"), "_target",
        F.when(F.col("_size") > 0, F.col("_target") / F.col("_size")).otherwise(0.0).alias("_rate"),
        offset(F.col("_source"), seed).alias("_start"))

    def earlier(window) -> Column:
        before = window.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_rows").over(before), F.lit(0))

    smaller = (
        sizes.withColumn("_smaller", earlier(Window.partitionBy("_source").orderBy("_each")))
        .join(plan, F.col("_source").eqNullSafe(F.col("_plan_source")))
        .select(F.col("_source").alias("_size_source"), F.col("_each").alias("_size_each"),
                "_smaller", "_source_size", "_target", "_rate", "_start"))
    steps = (
        groups.groupBy("_source", "_each", F.substring("_prefix", 1, digits).alias("_prefix"))
        .agg(F.sum("_rows").alias("_rows"))
        .withColumn("_lower", earlier(Window.partitionBy("_source", "_each").orderBy("_prefix")))
        .join(smaller, F.col("_source").eqNullSafe(F.col("_size_source"))
              & (F.col("_each") == F.col("_size_each")))
        .withColumn("_before", F.col("_smaller") + F.col("_lower")))

    inside = (
        Window.partitionBy("_of", "_words", "_prefix").orderBy("_digest", "_id"))
    numbered = (
        keyed.withColumn("_prefix", F.substring("_digest", 1, digits))
        .withColumn("_place", F.row_number().over(inside)))
    mine = steps.select(
        F.col("_source").alias("_g_source"), F.col("_each").alias("_g_each"),
        F.col("_prefix").alias("_g_prefix"), "_before", "_source_size", "_target", "_rate", "_start")
    rank = F.col("_before") + F.col("_place")
    crossed = (F.floor(rank * F.col("_rate") + F.col("_start"))
               - F.floor((rank - 1) * F.col("_rate") + F.col("_start")))
    return (
        numbered.join(mine, F.col("_of").eqNullSafe(F.col("_g_source"))
                      & (F.col("_words") == F.col("_g_each"))
                      & (F.col("_prefix") == F.col("_g_prefix")))
        .select("row", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
                F.least(crossed, F.lit(max_repeat)).cast("int").alias("copies")))


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
full_at AS (
  SELECT *, ((turn - 1) % 3) + 1 AS weight, 3 * source_size AS cap,
         (3 * source_size)::DOUBLE / (((turn - 1) % 3) + 1) AS full_at
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS turn FROM by_source)),
levels AS (
  SELECT *,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0))::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
  FROM full_at
  WINDOW w AS (ORDER BY full_at, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
plan AS (
  SELECT source, source_size,
    least(cap::DOUBLE, coalesce(
      (SELECT arg_min(level, full_at) FROM levels WHERE level <= full_at), 'inf'::DOUBLE)
      * weight) AS target,
    ('0x' || substr(md5('42:' || coalesce(source, chr(0))), 1, 8))::BIGINT::DOUBLE
      / 4294967296.0 AS start
  FROM levels),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, md5(doc_id::VARCHAR), doc_id) AS k
  FROM sized),
rated AS (
  SELECT r.*, p.source_size, p.target, p.start,
    CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0 END AS rate
  FROM ranked r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  size * least(3, (floor(k * rate + start) - floor((k - 1) * rate + start)))::BIGINT AS taken
FROM rated
"""


@query("op10_mix_sources", ORACLE)
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from every document when sources are mixed 1 : 2 : 3, repeating."""
    sized = stage(
        read(spark, sf_dir, "documents")
        .select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    return mix(sized, "size").select(
        "row.doc_id", "row.size", "source_size", "target",
        (F.col("row.size") * F.col("copies")).alias("taken"))
