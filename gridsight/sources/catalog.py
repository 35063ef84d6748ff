"""The record of past runs: append, list the recent ones, load one."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECENT_RUNS = 10
RUN_SCHEMA = ("owner string, filename string, timestamp string, record_count bigint, "
              "content string, run_id string")


def run_record(filename: str, record_count: int, content: Mapping | None = None,
               owner: str | None = None, run_id: str | None = None,
               timestamp: str | None = None) -> tuple:
    """One row for `append_runs`; `content` holds the result tables of the run."""
    return (owner, filename,
            timestamp or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M"),
            int(record_count), json.dumps(content or {}, default=str),
            run_id or uuid.uuid4().hex[:8])


def append_runs(runs: DataFrame, path: str) -> None:
    """Append run rows; one folder per run, so loading one reads nothing else."""
    runs.write.mode("append").partitionBy("run_id").parquet(path)


def append_run(spark: SparkSession, path: str, record: tuple) -> None:
    append_runs(spark.createDataFrame([record], RUN_SCHEMA).coalesce(1), path)


def _runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(path)


def recent_runs(spark: SparkSession, path: str, owner: str | None = None,
                limit: int = RECENT_RUNS) -> DataFrame:
    """An owner's runs, newest first; without owner the newest ten of all."""
    runs = _runs(spark, path).select("run_id", "filename", "timestamp", "record_count", "owner")
    newest = [F.col("timestamp").desc(), F.col("run_id")]
    if owner is not None:
        return runs.where(F.col("owner") == owner).drop("owner").orderBy(*newest)
    return runs.drop("owner").orderBy(*newest).limit(limit)


def load_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return _runs(spark, path).where(F.col("run_id") == run_id)
