"""Registered queries of the corpus operators, and their SQL counterparts."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows with texts that a worker answers at once.
BATCH_ROWS = 500


ROOT = os.path.realpath(os.path.join(os.path.dirname(__file__), "..", ".."))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, unless they find it as the driver does: by
    PYTHONPATH or in the working folder."""
    context = spark.sparkContext
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if ROOT in map(os.path.realpath, filter(None, places)) or context.applicationId in _shipped:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="gridsight-"), "gridsight")
    context.addPyFile(shutil.make_archive(target, "zip", ROOT, "gridsight"))
    _shipped.add(context.applicationId)


def shipped(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """fn(spark, ...) with the package on all workers."""

    @functools.wraps(fn)
    def call(spark: SparkSession, *args, **options) -> DataFrame:
        ship(spark)
        return fn(spark, *args, **options)

    return call


def query(name: str, sql: str | None = None):
    """Register a query under `name`, with the SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        QUERIES[name] = shipped(fn)
        if sql is not None:
            ORACLES[name] = sql
        return QUERIES[name]

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], name: str) -> str:
    """`name`, with underscores in front until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_texts(docs: DataFrame, keep: Sequence[str], text_col: str, name: str) -> tuple[DataFrame, int]:
    """The columns `keep` and the texts, and the place of the texts: as `name` behind the others,
    unless they are kept anyway, so that no text is sent to Python twice."""
    if text_col in keep:
        return docs.select(*keep), list(keep).index(text_col)
    return docs.select(*keep, F.col(text_col).alias(fresh(list(keep), name))), len(keep)


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of `batches`, at most `rows` at once: what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with `value` computed once however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
