import hashlib
import math
import random

import numpy as np
import pytest

from gridsight.llm import centroids as c

LIMIT = 2 ** 63


def brute(rows, k, rounds, size):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [min(max(math.floor(256 * x), -LIMIT), LIMIT - 1) for x in v]))
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in start[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, w)), n) for n, w in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centres)):
            mine = [v for (_, v), (_, m) in zip(kept, found) if m == n]
            if mine:
                centres[n] = [sum(x) // len(mine) for x in zip(*mine)]
    found = assign()
    per = {}
    for d, n in found:
        per[n] = per.get(n, 0) + d
    total = sum(per.values())
    # Spark's nulls: a distance, and any sum that holds it or grows beyond a long.
    fits = lambda x: x if x < LIMIT else None
    return sorted(((i, n, fits(d), fits(per[n]), fits(total),
                    hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest())
                   for (i, _), (d, n) in zip(kept, found)), key=str)


def frame(spark, rows, element="double"):
    return spark.createDataFrame([(i, v, "x", 3) for i, v in rows],
                                 f"vec_id long, embedding array<{element}>, cluster string, _vec int").repartition(5)


def got(df, **options):
    return sorted([tuple(r) for r in c.cluster_vectors(df, **options).collect()], key=str)


def spread(n, size, pick):
    return [(i, [pick.gauss(0, 1) for _ in range(size)]) for i in range(n)]


def test_matches_brute_force(spark):
    pick = random.Random(6)
    rows = spread(300, 64, pick)
    rows += [(1000 + i, rows[5][1]) for i in range(150)]  # a third are one vector
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1])]
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 63 + [None]),
             (2004, [nan] * 64), (2005, [1.0] * 63 + [-inf]), (2006, [1.0] * 65)]
    assert got(frame(spark, rows)) == brute(rows, 40, 5, 64)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(12)] + [(99, [0.5, 0.0])]
    assert got(frame(spark, rows), k=6, components=2) == brute(rows, 6, 5, 2)


@pytest.mark.parametrize("scale", [1e6, 1e7, 1e12, 1e16, 1e30])
def test_large_components(spark, scale):
    pick = random.Random(1)
    rows = [(i, [pick.choice([1, -1, 0.5]) * scale + pick.random(), pick.random() * scale]) for i in range(60)]
    assert got(frame(spark, rows), k=5, components=2) == brute(rows, 5, 5, 2)


def test_fewer_vectors_than_centroids(spark):
    rows = [(3, [0.1, 0.2]), (4, [0.1, 0.2]), (5, [-0.001, 7.0])]
    assert got(frame(spark, rows, "float"), components=2) == brute(
        [(i, [float(np.float32(x)) for x in v]) for i, v in rows], 40, 5, 2)


def test_empty_table(spark):
    out = c.cluster_vectors(frame(spark, [(1, None)]))
    assert out.collect() == [] and out.columns == [
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_filter_prunes():
    """Of clustered vectors, most distances are never measured, and all answers are exact."""
    pick = np.random.default_rng(2)
    centres = pick.integers(-200, 200, (40, 64))
    points = np.repeat(centres, 50, axis=0) + pick.integers(-9, 10, (2000, 64))
    spread = np.cov(points.T.astype(float))
    axes = c.Axes(points.mean(axis=0), np.linalg.eigh(spread)[1][:, ::-1], 16)
    cluster, best, measured = c.nearest(points, *axes.rotated(points), centres, axes)
    exact = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (cluster == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert measured < 0.1 * exact.size
