import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsight.llm import topk


def brute(rows, every, k):
    points = sorted({(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v in rows})
    out = []
    for i in sorted({i for i, _ in points if i % every == 0}):
        q = dict(points)[i]
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in points if j != i)
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("kind", ["spread", "clusters", "copies"])
def test_matches_brute_force(spark, kind):
    pick = random.Random(3)
    if kind == "spread":
        rows = [(i, [pick.gauss(0, 1) for _ in range(8)]) for i in range(500)]
    elif kind == "clusters":
        centres = [[pick.gauss(0, 3) for _ in range(8)] for _ in range(6)]
        rows = [(i, [c + pick.gauss(0, 0.05) for c in pick.choice(centres)]) for i in range(500)]
    else:  # a third of all rows are one vector, and many scores tie
        rows = [(i, [1.0, 0.5] if i % 3 else [float(pick.randint(-1, 1)), 0.5]) for i in range(300)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, block=60, query_block=9).orderBy("query_id", "rank")
    assert [tuple(r) for r in got.collect()] == brute(rows, 10, 5)


@pytest.mark.parametrize("size", [1e7, 1e12])
def test_large_components_are_exact(spark, size):
    pick = random.Random(11)
    rows = [(i, [float(pick.choice([0.5, 1.0, size, -size, size + pick.randint(0, 3)])) for _ in range(3)])
            for i in range(200)]
    rows += [(200, [1.0, 0.0, 0.0]), (201, [size, 0.0, 0.0]), (202, [2.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, block=40, query_block=9).orderBy("query_id", "rank")
    fits = [(q, n, j, s if -2 ** 63 <= s < 2 ** 63 else None) for q, n, j, s in brute(rows, 10, 5)]
    assert [tuple(r) for r in got.collect()] == fits


def test_a_large_component_wins(spark):
    rows = [(0, [1.0]), (1, [1e7]), (2, [2.0]), (3, [0.5]), (4, [1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [
        (4, None), (1, 655360000000), (2, 131072), (3, 32768)]


def test_trees_cover_their_points():
    points = np.random.default_rng(5).integers(-100, 100, (700, 4)).astype(float)
    order, nodes = topk.cover_tree(points)
    assert sorted(order.tolist()) == list(range(700))
    placed = points[order]
    for n in nodes:
        mine = placed[n["point"]:n["point_end"]]
        far = np.sqrt(((mine - placed[n["centre"]]) ** 2).sum(axis=1)).max()
        assert far <= n["radius"] + 1e-9
        if n["child_end"]:
            kids = nodes[n["child"]:n["child_end"]]
            assert kids[0]["centre"] == n["centre"]
            assert (kids["radius"] <= n["radius"] / 2 + 1e-9).all()
            assert kids["point"][0] == n["point"] and kids["point_end"][-1] == n["point_end"]


def test_walks_prune():
    """Far clusters are not multiplied out."""
    pick = np.random.default_rng(1)
    centres = np.eye(8) * 1000
    data = np.concatenate([c + pick.integers(-3, 4, (400, 8)) for c in centres])
    queries = centres[:1] + pick.integers(-3, 4, (20, 8))

    def tree(points):
        order, nodes = topk.cover_tree(points)
        return topk.Tree(points[order], nodes, order)

    seen = []

    class Counting(topk.Best):
        def offer(self, lo, scores, ids, points):
            seen.append(scores.size)
            super().offer(lo, scores, ids, points)

    q, d = tree(queries), tree(data)
    best = Counting(20, 5, np.full(20, -np.inf))
    topk.walk(q, d, best)
    exact = np.sort(q.points @ d.points.T, axis=1)[:, ::-1][:, :5]
    assert (best.scores == exact).all()
    assert sum(seen) < 0.5 * 20 * len(data)
