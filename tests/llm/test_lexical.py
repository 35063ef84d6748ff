import math
import random
import re
from collections import Counter

import corpus_cases
import numpy as np

from gridsight.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(low)


def brute(items, docs, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in counts)
    length = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for doc_id, c in counts:
            n = sum(c.values())
            m = 50 + (50 * n * n_docs) // length if length else 50
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def tables(spark, items, docs):
    return (spark.createDataFrame(items, "item_id long, text string").repartition(3),
            spark.createDataFrame([(d, t, "x", 1) for d, t in docs],
                                  "doc_id long, text string, _id string, rank int").repartition(7))


def case():
    pick = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["É", "naïve", "中文", "X1"]
    docs = [(i, " ".join(pick.choices(words, k=pick.choice([1, 3, 9, 80])))) for i in range(400)]
    # A third of the rows are copies, so many scores tie.
    docs += [(1000 + i, "w1 w2, w3. W1") for i in range(200)]
    docs += [(None, "w1 w2"), (None, "w1 w2"), (5000, None), (5001, ""), (5002, "..."), (3, "w1"),
             (6000, "w5 " * 30_000)]
    items = [(i, " ".join(pick.choices(words, k=5))) for i in range(30)]
    items += [(30, None), (31, ""), (32, "nowhere at-all"), (33, "w1"), (33, "W2 w2"), (None, "w3 w4"),
              (34, " ".join(words)), (34, " ".join(words))]
    return items, docs


def test_matches_brute_force(spark):
    items, docs = case()
    got = lexical.ranked_search(*tables(spark, items, docs), k=7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(items, docs, 7)


def test_rounds_and_tiles_change_nothing(spark, monkeypatch):
    items, docs = case()
    monkeypatch.setattr(lexical, "ROUND_TERMS", 40)
    monkeypatch.setattr(lexical, "ITEM_TILE", 4)
    monkeypatch.setattr(lexical, "DOC_TILE", 16)
    monkeypatch.setattr(lexical, "FLOOR_SHARE", 2)
    got = lexical.ranked_search(*tables(spark, items, docs), k=7)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(items, docs, 7)


def test_awkward_documents(spark):
    docs = corpus_cases.rows(spark)
    items = spark.createDataFrame([(1, "the CAT and 中文"), (2, "w5")], "item_id long, text string")
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = lexical.ranked_search(items, docs)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(
        [(1, "the CAT and 中文"), (2, "w5")], pairs, 50)
    assert lexical.ranked_search(items, corpus_cases.empty(spark)).collect() == []
    assert lexical.ranked_search(items.limit(0), docs).collect() == []


def test_terms():
    text = "Don't STOP_now: É中a1 \x00\x7fz\tİ"
    assert [t.decode() for t in lexical.terms_of(text.encode())] == terms(text)


def test_partial_sums_stay_exact(monkeypatch):
    """Columns are cut before a sum may leave the whole numbers of a float64."""
    pick = np.random.default_rng(0)
    weights = pick.integers(2 ** 30, 2 ** 31, 300)
    items = [np.arange(300), np.arange(0, 300, 7)]
    tile = lexical.ItemTile(items, weights)
    assert len(tile.slices) > 40
    for lo, hi, dense in tile.slices:
        assert dense.sum(axis=1).max() * lexical.MAX_IMPACT < lexical.EXACT
    doc, term = np.divmod(np.arange(3 * 300), 300)
    impact = pick.integers(lexical.MAX_IMPACT - 9, lexical.MAX_IMPACT, 900)
    want = [[sum(int(weights[t]) * int(impact[300 * d + t]) for t in x) for d in range(3)] for x in items]
    assert tile.scores(3, doc, term, impact).tolist() == want


def test_ties_do_not_depend_on_tiles():
    top = lexical.TileTop(3, np.zeros(1, np.int64))
    for ids in ([9, 4], [8, 1], [7, 2]):
        top.offer(np.full((1, 2), 5), np.array(ids))
    assert top.best[0][1].tolist() == [1, 2, 4]
