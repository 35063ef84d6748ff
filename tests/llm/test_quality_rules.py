import re

import corpus_cases
import pytest
from pyspark.sql import functions as F

from gridsight.llm import quality_rules as qr


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    repeat = {j for places in windows.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(repeat) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat), failed)


def test_base_matches_brute_force(spark, sf_dir, tmp_path):
    lines = "a b c d e f g h i j k l m n o p\n"
    texts = [lines * 3, lines + lines.strip(), "x " * 300, "x " * 8, "x " * 9, "é中🙂 #" * 30,
             "one\n\n one\none\n \t\none ", "a\x0bb\x1cc d e", None, "", " \n", corpus_cases.LONG,
             " ".join(f"w{i}" for i in range(500)) + " " + " ".join(f"w{i}" for i in range(100, 300)),
             " ".join("w" if i % 9 else str(i) for i in range(400))]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    path = str(tmp_path / "docs")
    corpus_cases.plain(spark, list(enumerate(texts))).write.parquet(f"{path}/documents.parquet")
    for r in qr.op8_quality_rules(spark, path).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                r.base_failed) == brute(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_one_projection(spark, sf_dir):
    df = qr.op8_quality_rules(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Pandas|Join", plan)


@pytest.mark.parametrize("text,rule", [
    ("word " * 3, "too_few_words"), ("| x |" * 30, "symbols"), ("12 34 56 7 " * 10, "letters"),
    ("WHAT A LOUD THING THIS IS AND IT IS MEANT TO BE HEARD BY ALL OF US WHO ARE NEAR", "capitals"),
    ("supercalifragilistic " * 25, "word_length"), ("same line here\n" * 20, "repeated_lines")])
def test_rules_catch(spark, text, rule):
    (r,) = qr.measures(corpus_cases.plain(spark, [(1, text)])).select(qr.failures().alias("f")).collect()
    assert rule in r.f


def test_clean_documents_stay(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    by = {(r.quality, r.kept): r["n"] for r in qr.op8_quality_rules(spark, folder).join(labels, "doc_id")
          .groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert by.get((1, False), 0) <= 0.03 * by[(1, True)]
    assert by.get((0, False), 0) >= 0.6 * (by.get((0, False), 0) + by.get((0, True), 0))
