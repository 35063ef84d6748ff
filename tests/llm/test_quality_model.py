import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from gridsight.llm import quality_model as qm
import corpus_cases


def test_indicators_match_brute_force():
    texts = ["", "ab", "abc", "abcabc", "the the the the the the the the the the", "é中🙂 x", "a b " * 9000]

    def brute(text):
        data = text.encode()
        grams = {((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2654435761 % 2 ** 32) >> 15
                 for i in range(len(data) - 2)}
        words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        again = [w in words[max(0, i - 8):i] for i, w in enumerate(words)]
        runs = {qm.BUCKETS + int("".join(str(int(x)) for x in again[i:i + 8]), 2)
                for i in range(len(words) - 7)}
        return sorted(grams | runs)

    assert [x.tolist() for x in qm.indicators([t.encode() for t in texts])] == [brute(t) for t in texts]


def test_descent_reaches_the_optimum():
    """No feasible step of a single dual variable gains anything."""
    pick = np.random.default_rng(2)
    rows = [np.sort(pick.choice(40, 8, replace=False)) for _ in range(120)]
    values = [pick.normal(size=8) for _ in rows]
    sign = np.where([v.sum() + pick.normal() > 0 for v in values], 1.0, -1.0)
    cost = np.full(len(rows), 0.7)
    weights, bias = qm.descend(rows, values, sign, 40, cost, epochs=400)

    def loss(w, b):
        margins = np.array([w[r] @ v + b for r, v in zip(rows, values)])
        return (w @ w + b * b) / 2 + (cost * np.maximum(0, 1 - sign * margins)).sum()

    best = loss(weights, bias)
    for _ in range(200):
        assert loss(weights + pick.normal(size=40) * 0.01, bias + pick.normal() * 0.01) >= best - 1e-3


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = qm.op2_quality_model(spark, folder).join(
        spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_held_out_labels_are_not_seen(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(
        qm.fold(F.col("doc_id")) == qm.HELD_OUT, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = qm.train(docs, labels), qm.train(docs, flipped)
    assert (a.weights == b.weights).all() and (a.slope, a.shift) == (b.slope, b.shift)


def test_sample_is_bounded(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows, good = qm.sample(docs, labels, "quality", 300, "doc_id", "text")
    assert 220 < len(rows) < 380 and len(good) == len(rows)


def test_repeated_ids_count_once(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    first = docs.join(labels, "doc_id").where(qm.fold(F.col("doc_id")) != qm.HELD_OUT).select(docs["*"]).limit(1)
    copies = first.crossJoin(spark.range(300)).withColumn(
        "text", F.concat(F.lit("copy "), F.col("id").cast("string"))).drop("id")
    rows, good = qm.sample(docs, labels, "quality", 10 ** 6, "doc_id", "text")
    more, again = qm.sample(docs.unionByName(copies), labels, "quality", 10 ** 6, "doc_id", "text")
    assert len(more) == len(rows) and (again == good).all()
    assert sum(a.tolist() != b.tolist() for a, b in zip(rows, more)) <= 1


def test_without_two_classes(spark):
    docs = corpus_cases.rows(spark)
    for labels, score in (([], 0.5), ([(1, 1)], 1.0), ([(1, 0)], 0.0)):
        table = spark.createDataFrame(labels, "doc_id long, quality int")
        model = qm.train(docs, table)
        assert {round(r.score, 6) for r in qm.score(docs, model).collect()} == {score}
    assert qm.accepted(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).columns == docs.columns


def test_kept_texts_go_to_python_once(spark, monkeypatch):
    from gridsight.llm import secret_scan
    from gridsight.llm.registry import with_texts

    docs = corpus_cases.rows(spark)
    sent = []
    for module in (qm, secret_scan):
        monkeypatch.setattr(module, "with_texts", lambda *args: sent.append(with_texts(*args)) or sent[-1])
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert qm.accepted(docs, labels).count() == 12 and secret_scan.redact(docs).count() == 12
    assert [(s.columns, place) for s, place in sent] == [(docs.columns, docs.columns.index("text"))] * 2
    plain, place = with_texts(docs, ("doc_id",), "text", "_judged")
    assert plain.columns == ["doc_id", "_judged"] and place == 1


def test_answers_do_not_depend_on_slices(spark, monkeypatch):
    import pyarrow as pa

    from gridsight.llm.registry import slices

    batch = pa.RecordBatch.from_pydict({"x": list(range(1201))})
    assert [b.num_rows for b in slices([batch, batch.slice(0, 0)])] == [500, 500, 201]
    texts = [(i, None if i % 7 == 0 else f"word{i} é " * (i % 5) + "ab" * (i % 3)) for i in range(1201)]
    docs = corpus_cases.plain(spark, texts).coalesce(1)
    model = qm.fit([np.array([i % 5, 9]) for i in range(50)], np.arange(50) % 3 == 0)
    scores = {r.doc_id: r.score for r in qm.score(docs, model).collect()}
    assert scores == {i: model.score(qm.indicators([(t or "").encode()])[0]) for i, t in texts}
