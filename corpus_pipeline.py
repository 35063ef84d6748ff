"""The corpus pipeline: a raw documents table becomes packed training sequences.

Each stage calls one operator of gridsight.llm and works on all that its predecessor kept;
its result is written as Parquet and read again. All stages but the last return the columns
of documents: documents of poor quality go, one of each group of near-duplicates stays,
secrets are cut out of texts, and documents are repeated or left out as the mix asks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsight.llm import mixing, near_dup, packing, quality_model, secret_scan
from gridsight.llm.registry import shipped, word_count
from gridsight.session import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


@shipped
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_model.accepted(docs.select(*COLUMNS), labels)


@shipped
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles."""
    return near_dup.one_of_each(docs.select(*COLUMNS))


@shipped
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by the kind of secret."""
    clean = secret_scan.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(
        F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


@shipped
def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks, from no time to three times."""
    sized = docs.select(*COLUMNS, word_count(F.col("text")).alias("words"))
    return (
        mixing.mix(sized, "words").where(F.col("copies") > 0)
        .select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(*[f"row.{c}" for c in COLUMNS]))


@shipped
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training sequences."""
    return packing.pack_documents(docs.select(*COLUMNS))


STAGES = [
    ("quality_classifier", quality_classifier), ("near_dedup", near_dedup),
    ("secret_scans", secret_scans), ("mixed_sources", mixed_sources),
    ("best_fit_packing", best_fit_packing)]

#: The stages run a trained model, hash sketches and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
