"""Awkward tables for the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEY = "b" * 40
LONG = " ".join(f"w{i % 9973} and" for i in range(60_000)) + f' token="{KEY}"'
#: doc_id, text, lang, source, n_chars and columns whose names operators use themselves.
ROWS = [
    (1, "The cat sat on the mat and looked at the moon for a while.", "en", "a", 58),
    (2, "The cat sat on the mat and looked at the moon for a while.", "en", "a", 58),
    (2, "The cat sat on the mat and looked at the moon for a while.", "en", "a", 58),
    (3, "", "en", "b", 0),
    (4, None, None, None, None),
    (5, "   \n\t ", "de", "b", 6),
    (6, LONG, "en", "a", len(LONG)),
    (7, "one", "fr", None, 3),
    (8, "One\x0btwo", "fr", "c", 7),
    (9, "one two", "fr", "c", 7),
    (None, "no id here but a few words, and password: hunter2hunter2", None, "c", None),
    (10, "naïve 中文 text 🙂 api_key = 'abcdefgh.12345678' end " + KEY, "xx", "d", 9),
]
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, spans string, "
          "score int, size string, row int, _text int, _gone long, _id int, _spans int")


def rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3, 4, 5, 6) for r in ROWS], SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def plain(spark: SparkSession, found: list[tuple]) -> DataFrame:
    return spark.createDataFrame(found, "doc_id long, text string")


def folder(spark: SparkSession, path: str, none: bool = False) -> str:
    """A folder of tables with the awkward rows, or with none at all."""
    docs = empty(spark) if none else rows(spark)
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [] if none else [(1, 1, 0, "z"), (2, 1, 0, "z"), (3, 0, 1, None), (6, None, 0, None),
                              (7, 0, 0, "z"), (7, 1, 0, "z"), (None, 1, 1, "z"), (99, 1, 0, "z")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, score string") \
        .write.parquet(f"{path}/labels.parquet")
    pages = [] if none else [
        (1, "u", "<html><body><nav>Menu</nav><article><h1>T</h1><p>Body &amp; more</p></article></body>", 1),
        (1, "u", "<html><body><nav>Menu</nav><article><h1>T</h1><p>Body &amp; more</p></article></body>", 1),
        (2, None, None, 1), (None, "u", "", 1), (3, "u", "<<p <b>x</p></div></div><article", 1),
        (4, "u", "<article>" + "<p>long text here</p>" * 20_000, 1)]
    spark.createDataFrame(pages, "page_id long, url string, html string, text int") \
        .write.parquet(f"{path}/pages.parquet")
    items = [] if none else [
        (1, "the cat", 1), (1, "the cat", 1), (2, None, 1), (None, "Words 中文", None), (3, "", 1), (4, "w5 and", 2)]
    spark.createDataFrame(items, "item_id long, text string, rank int") \
        .write.parquet(f"{path}/benchmark.parquet")
    nan, inf = float("nan"), float("inf")
    vectors = [] if none else [
        (0, [1.0, 0.5], 1), (50, [0.5, 0.25], 1), (50, [0.5, 0.25], 1), (1, [1.0, 0.5], None),
        (2, None, 1), (3, [1.0, None], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [], 1),
        (7, [0.25], 1), (None, [1.0, 1.0], 1), (100, [0.0, 0.0], 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, rank int") \
        .write.parquet(f"{path}/embeddings.parquet")
    return path
