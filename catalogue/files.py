"""Text and JSON files, type inference, leftovers, the run catalog."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.common import DIRTY_SQL, dirty_orders, query, read, union_all_sql
from gridsight.operators import profile
from gridsight.plans import analyze
from gridsight.session import shared_folder
from gridsight.sources import catalog, sinks, text


def _new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


# Orders as a file would hold them: all text, an empty column, two blank headers.
def _as_text(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_orderstatus") == "F", "True").when(
            F.col("o_orderstatus") == "O", "False").alias("is_final"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_custkey").cast("string"))
        .alias("o_custkey"),
        F.lit(None).cast("string").alias("empty"),
        F.lit("x").alias("Unnamed: 7"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderkey").cast("string"))
        .alias("Unnamed: 8"),
        F.col("o_orderpriority").alias("Unnamed: 9"))


def _cells_sql(name: str, cells: str, dtype: str) -> str:
    return f"SELECT '{name}' AS \"column\", {cells} AS cells, '{dtype}' AS inferred_dtype FROM orders"


@query("infer_schema", union_all_sql([
    _cells_sql("o_orderkey", "count(TRY_CAST(CAST(o_orderkey AS VARCHAR) AS BIGINT))", "bigint"),
    _cells_sql("o_totalprice", "count(TRY_CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE))", "double"),
    _cells_sql("o_orderdate", "count(o_orderdate)", "string"),
    _cells_sql("o_orderstatus", "count(*) FILTER (WHERE o_orderstatus <> 'P')", "string"),
    _cells_sql("is_final", "count(*) FILTER (WHERE o_orderstatus <> 'P')", "boolean"),
    _cells_sql("o_custkey", "count(*) FILTER (WHERE o_orderpriority <> '1-URGENT')", "bigint"),
    _cells_sql("empty", "count(NULL)", "string"),
    _cells_sql("Unnamed: 7", "count(*)", "string"),
    _cells_sql("Unnamed: 8", "count(*) FILTER (WHERE o_orderpriority = '5-LOW')", "bigint"),
    _cells_sql("Unnamed: 9", "count(o_orderpriority)", "string")]))
def infer_schema(spark, sf_dir):
    return text.infer_types(_as_text(spark, sf_dir)).drop("position")


ORDERS_TEXT_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
       nullif(o_orderstatus, 'P') AS o_orderstatus,
       CASE o_orderstatus WHEN 'F' THEN 'True' WHEN 'O' THEN 'False' END AS is_final,
       CASE WHEN o_orderpriority <> '1-URGENT' THEN CAST(o_custkey AS VARCHAR) END AS o_custkey,
       o_orderpriority AS "Unnamed: 9" FROM orders"""


@query("drop_empty_columns", ORDERS_TEXT_SQL)
def drop_empty_columns(spark, sf_dir):
    return text.drop_unwanted(_as_text(spark, sf_dir).drop("o_totalprice"))


@query("drop_unnamed", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority AS "Unnamed: 9" FROM orders""")
def drop_unnamed(spark, sf_dir):
    """One blank header holds one value, one is mostly empty, one stays."""
    return text.drop_unwanted(_as_text(spark, sf_dir).select(
        "o_orderkey", *[F.col(f"`Unnamed: {i}`") for i in (7, 8, 9)]))


def _typed_sql(extra: str) -> str:
    return f"""
SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
       nullif(o_orderstatus, 'P') AS o_orderstatus,
       CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS is_final,
       CASE WHEN o_orderpriority <> '1-URGENT' THEN o_custkey ELSE -1 END AS o_custkey,
       o_orderpriority AS "{extra}" FROM orders"""


def _shown(df: DataFrame) -> DataFrame:
    """Gaps in the whole-number column as -1, so that it stays one in every client."""
    return df.withColumn("o_custkey", F.coalesce("o_custkey", F.lit(-1)))


@query("csv_scan", _typed_sql("Unnamed: 9"))
def csv_scan(spark, sf_dir):
    path = _new_path(spark, "orders-csv")
    sinks.write_csv(_as_text(spark, sf_dir), path)
    return _shown(text.read_csv(spark, path))


@query("csv_scan_semicolon", _typed_sql("Unnamed: 9"))
def csv_scan_semicolon(spark, sf_dir):
    path = _new_path(spark, "orders-semicolon")
    _as_text(spark, sf_dir).write.csv(path, sep=";", header=True)
    return _shown(text.read_csv(spark, path))


@query("tsv_scan", _typed_sql("Unnamed: 9"))
def tsv_scan(spark, sf_dir):
    path = _new_path(spark, "orders-tsv")
    _as_text(spark, sf_dir).write.csv(path, sep="\t", header=True)
    return _shown(text.read_tsv(spark, path))


@query("csv_row_number", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders""")
def csv_row_number(spark, sf_dir):
    """File order survives the read: rank of the row number equals the written place."""
    from pyspark.sql import Window

    path = _new_path(spark, "orders-ordered")
    ordered = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy("o_orderkey")
    sinks.write_csv(ordered, path)
    rows = text.read_csv(spark, path, row_number=True)
    ranges = rows.withColumn("part", F.floor(F.col(text.ROW_NUMBER) / (1 << 33)))
    sizes = ranges.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy(text.ROW_NUMBER)
    return ranges.join(F.broadcast(starts), "part").select(
        "o_orderkey", (F.col("start") + F.row_number().over(inside) - 1).alias("place"))


@query("json_scan", """
SELECT event_id, user_id, event_type, value FROM events""")
def json_scan(spark, sf_dir):
    path = _new_path(spark, "events-json")
    events = read(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", F.lit(None).cast("string").alias("note"))
    sinks.write_json(events, path)
    return text.read_json(spark, path)


RUN_TABLES = ("customer", "events", "lineitem", "orders", "part", "supplier")


def _runs(spark, sf_dir) -> DataFrame:
    """One run record per table, holding its profile figures."""
    frames = None
    for i, t in enumerate(RUN_TABLES):
        figures = profile.profile_table(read(spark, sf_dir, t))
        run = figures.select(
            F.lit("ana" if i % 2 else "ben").alias("owner"),
            F.lit(f"{t}.parquet").alias("filename"),
            F.lit(f"2026-01-{i + 1:02d} 10:00").alias("timestamp"),
            F.col("num_records").alias("record_count"),
            F.to_json(F.struct("num_records", "num_features", "total_missing",
                               "duplicate_count")).alias("content"),
            F.lit(f"run{i}").alias("run_id"))
        frames = run if frames is None else frames.unionByName(run)
    return frames


RUNS_SQL = "(" + union_all_sql([
    f"SELECT 'run{i}' AS run_id, '{t}.parquet' AS filename, '2026-01-{i + 1:02d} 10:00' AS "
    f"timestamp, count(*) AS record_count, '{'ana' if i % 2 else 'ben'}' AS owner FROM {t}"
    for i, t in enumerate(RUN_TABLES)]) + ")"


@query("run_catalog", f"""
SELECT run_id, filename, timestamp, record_count FROM {RUNS_SQL} WHERE owner = 'ana'""")
def run_catalog(spark, sf_dir):
    path = _new_path(spark, "runs")
    catalog.append_runs(_runs(spark, sf_dir), path)
    return catalog.recent_runs(spark, path, "ana")


@query("run_catalog_all", f"""
SELECT run_id, filename, timestamp, record_count FROM {RUNS_SQL} ORDER BY timestamp DESC LIMIT 10""")
def run_catalog_all(spark, sf_dir):
    """Without an owner: the ten newest runs of all."""
    path = _new_path(spark, "runs")
    catalog.append_runs(_runs(spark, sf_dir), path)
    return catalog.recent_runs(spark, path)


@query("saved_run", f"""
WITH {DIRTY_SQL}, u AS (SELECT DISTINCT * FROM dirty_orders)
SELECT 'profile' AS saved, 5 AS rows, (SELECT count(*) FROM u) AS records
UNION ALL SELECT 'raw copies', (SELECT count(*) FROM dirty_orders) - (SELECT count(*) FROM u),
       (SELECT count(*) FROM u)
UNION ALL SELECT 'describe', 1, (SELECT count(*) FROM u)
UNION ALL SELECT 'crosstab', 0, (SELECT count(*) FROM u)""")
def saved_run(spark, sf_dir):
    """A whole run on a table with gaps and copies, saved and loaded again."""
    path = _new_path(spark, "runs")
    df = dirty_orders(spark, sf_dir)
    run = analyze.analyze(df, order_by="o_orderkey")
    run_id = analyze.save_run(run, path, "orders.parquet", owner="ana")
    record = catalog.load_run(spark, path, run_id).first()
    content = json.loads(record["content"])
    removed = next(r["affected"] for r in content["cleaning_log"] if r["action"] == "drop_duplicates")
    return spark.createDataFrame(
        [(t, len(content.get(t, [])), record["record_count"]) for t in ("profile", "describe", "crosstab")]
        + [("raw copies", removed, record["record_count"])], "saved string, rows int, records long")


@query("run_load", """
SELECT 'run2' AS run_id, 'lineitem.parquet' AS filename,
       '{"num_records":' || count(*) || ',"num_features":11,"total_missing":0,"duplicate_count":'
       || (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem))) || '}' AS content
FROM lineitem""")
def run_load(spark, sf_dir):
    path = _new_path(spark, "runs")
    catalog.append_runs(_runs(spark, sf_dir), path)
    return catalog.load_run(spark, path, "run2").select("run_id", "filename", "content")


DOCUMENTS_SQL = "SELECT doc_id, text, lang, source, n_chars FROM documents"


@query("csv_documents", DOCUMENTS_SQL)
def csv_documents(spark, sf_dir):
    """Whole texts, line breaks and quotes included, written and read back."""
    path = _new_path(spark, "documents-csv")
    sinks.write_csv(read(spark, sf_dir, "documents"), path)
    return text.read_csv(spark, path)


@query("csv_fallback_encoding", DOCUMENTS_SQL)
def csv_fallback_encoding(spark, sf_dir):
    """A file in the fallback encoding."""
    path = _new_path(spark, "documents-latin1")
    read(spark, sf_dir, "documents").write.csv(
        path, header=True, escape='"', encoding=text.FALLBACK_ENCODING,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return text.read_csv(spark, path)


@query("csv_headers", """
SELECT 'key' AS "column", count(n_nationkey) AS cells FROM nation
UNION ALL SELECT 'Name', count(n_name) FROM nation
UNION ALL SELECT 'name.1', count(n_name) FROM nation
UNION ALL SELECT 'Unnamed: 3', count(n_regionkey) FROM nation""")
def csv_headers(spark, sf_dir):
    """A repeated and a blank header."""
    path = _new_path(spark, "nation-headers")
    nation = read(spark, sf_dir, "nation")
    lines = nation.select(F.concat_ws(",", "n_nationkey", "n_name", "n_name", "n_regionkey").alias("value"))
    spark.createDataFrame([("key,Name,name,",)], "value string").unionAll(lines).coalesce(1).write.text(path)
    cells = text.read_cells(spark, path)
    return cells.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in cells.columns]).unpivot(
        [], [f"`{c}`" for c in cells.columns], "column", "cells")


@query("csv_refusal", """
SELECT count(*) AS records, 'The dataset contains no records.' AS reason FROM orders WHERE o_totalprice < 0""")
def csv_refusal(spark, sf_dir):
    """A file with a header and no record is refused."""
    path = _new_path(spark, "orders-none")
    none = read(spark, sf_dir, "orders").where("o_totalprice < 0")
    sinks.write_csv(none.coalesce(1), path)
    try:
        reason, records = "", text.read_csv(spark, path).count()
    except text.EmptyDataset as refusal:
        reason, records = str(refusal), none.count()
    return spark.createDataFrame([(records, reason)], "records long, reason string")
