"""Value-frequency tables: the shared base of distinct counts, modes, facets.

Cells are unpivoted to narrow (position, value) rows, one frame per type family,
and counted with a map-side partial aggregate. A repeated value collapses before
the shuffle and a high-cardinality column spreads by value, so no single column
or value can load one task.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsight.functions import values as V


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def family_counts(df: DataFrame, names: Iterable[str] | None = None,
                  longest: int | None = None) -> dict[str, DataFrame]:
    """Per type family: (column, value, n) with `value` in the native type.

    Missing cells form one row with a null value. Where only the number of
    values matters, texts over `longest` characters stand as SHA-256 digests.
    """
    def cell(name: str) -> Column:
        value = V.native(df, name)
        if longest is None or V.family(V.dtype_of(df, name)) != "string":
            return value
        # The mark makes a digest longer than any text that is kept as it is.
        digest = F.concat(F.lit("sha256:"), F.sha2(value, 256))
        return F.when(F.length(value) > longest, digest).otherwise(value)

    return {
        kind: V.with_names(
            V.long_form(df, {c: cell(c) for c in cols})
            .groupBy("pos", "value").agg(F.count("*").alias("n")), cols)
        for kind, cols in V.with_families(df, names).items()
    }


def text_counts(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """(column, value string, n) over all families; missing cells keep a null value."""
    return union_all([
        counts.select("column", V.text_of(F.col("value"), kind).alias("value"), "n")
        for kind, counts in family_counts(df, names).items()
    ])


def modes(df: DataFrame, names: Iterable[str]) -> dict[str, object]:
    """Most frequent non-missing value per column; the smallest wins a tie.

    Returns one Python value per column; columns without values are left out.
    """
    found: dict[str, object] = {}
    for counts in family_counts(df, list(names)).values():
        best = (
            counts.where(F.col("value").isNotNull())
            .groupBy("column")
            .agg(F.min(F.struct((-F.col("n")).alias("rank"), "value")).alias("best"))
        )
        found.update({row["column"]: row["best"]["value"] for row in best.collect()})
    return found


def distinct_counts(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """(column, unique_count) of non-missing values, exact."""
    return union_all([
        counts.groupBy("column").agg(F.count("value").alias("unique_count"))
        for counts in family_counts(df, list(names)).values()
    ])


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
