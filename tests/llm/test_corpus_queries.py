"""Registered corpus queries: beside their SQL, on awkward rows and on empty tables."""

import compare
import corpus_cases
import pytest

import corpus_pipeline
from gridsight.llm import ORACLES, QUERIES

ALL = {**QUERIES, "pipeline": corpus_pipeline.run}


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf_dir):
    assert compare.difference(compare.connect(sf_dir), spark, sf_dir, QUERIES[name], ORACLES[name]) is None


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    return corpus_cases.folder(spark, str(tmp_path_factory.mktemp("awkward")))


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return corpus_cases.folder(spark, str(tmp_path_factory.mktemp("nothing")), none=True)


EACH = {1: 12, 2: 12, 5: 12, 6: 12, 7: 12, 8: 12, 9: 6, 10: 12, 13: 12}


@pytest.mark.parametrize("name", sorted(ALL))
def test_awkward_rows(name, spark, awkward):
    rows = ALL[name](spark, awkward).collect()
    if name != "pipeline" and int(name[2:].split("_")[0]) in EACH:
        assert len(rows) == EACH[int(name[2:].split("_")[0])]


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_tables(name, spark, nothing):
    assert ALL[name](spark, nothing).collect() == []


def test_awkward_vectors(spark, awkward):
    rows = [tuple(r) for r in QUERIES["op4_top_k"](spark, awkward).orderBy("query_id", "rank").collect()]
    # 0 and 1 are equal; 50 stands twice and counts once; 7 is padded with a zero, 6 with two.
    assert rows == [
        (0, 1, 1, 81920), (0, 2, 50, 40960), (0, 3, 7, 16384), (0, 4, 6, 0), (0, 5, 100, 0),
        (50, 1, 0, 40960), (50, 2, 1, 40960), (50, 3, 7, 8192), (50, 4, 6, 0), (50, 5, 100, 0),
        (100, 1, 0, 0), (100, 2, 1, 0), (100, 3, 6, 0), (100, 4, 7, 0), (100, 5, 50, 0)]


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    counts = [docs.count()]
    for label, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, sf_dir).cache()
        counts.append(docs.count())
        if label != "best_fit_packing":
            assert docs.columns == names
            assert dict(docs.dtypes)["n_chars"] == "bigint"
    assert counts[0] > counts[1] > counts[2] == counts[3] and counts[4] > 0 and counts[5] >= counts[4]
    lengths = docs.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in lengths) <= 1024
