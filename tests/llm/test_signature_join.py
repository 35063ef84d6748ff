import random

import corpus_cases
import numpy as np
import pytest
from test_near_dup import brute, edited

from gridsight.llm import signature_join as sj
from gridsight.llm.near_dup import _mix


def join(spark, docs, words, percent):
    got = sj.jaccard_components(corpus_cases.plain(spark, docs), words, percent)
    return sorted([tuple(r) for r in got.collect()], key=str)


@pytest.mark.parametrize("words,percent", [(4, 85), (2, 70), (3, 100)])
def test_matches_brute_force(spark, words, percent, monkeypatch):
    monkeypatch.setattr(sj, "BLOCK", 16)  # groups of several blocks
    pick = random.Random(9)
    rows = []
    for group in range(12):
        base = [f"g{group}w{i}" for i in range(pick.choice([6, 20, 60, 200, 800]))]
        for _ in range(pick.choice([2, 10, 60])):
            rows.append(edited(base, pick, pick.choice([0, 1, 2, len(base) // 40, len(base) // 25])))
    chain = [f"c{i}" for i in range(300)]
    for _ in range(40):
        chain = edited(chain, pick, 3)
        rows.append(chain)
    # A passage that many unlike texts share.
    passage = [f"p{i}" for i in range(70)]
    rows += [passage + [f"own{i}n{k}" for k in range(90)] for i in range(60)]
    rows += [["a"], ["A"], ["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d"], [], []]
    pick.shuffle(rows)
    docs = [(i, " ".join(w)) for i, w in enumerate(rows)]
    docs += [(i, t) for i, t, *_ in corpus_cases.ROWS if i not in range(len(rows)) or i is None]
    docs += [(None, docs[0][1]), (None, docs[5][1]), (docs[3][0], docs[3][1]), (docs[3][0], docs[9][1])]
    want = [r[:3] for r in brute(docs, words, percent)]
    assert join(spark, docs, words, percent) == sorted(want, key=str)


def random_set(pick, n):
    return np.unique(_mix(pick.integers(0, 2 ** 62, n).astype(np.uint64)))


@pytest.mark.parametrize("percent", [50, 70, 85, 95])
def test_linked_sets_share_a_key(percent):
    pick = np.random.default_rng(percent)
    for n in [*range(1, 40), 55, 80, 130, 400, 1500] * 6:
        a = random_set(pick, n)
        # As unlike as the threshold allows: some dropped, some put in their place, some added.
        gone = pick.integers(0, n + 1)
        b = np.union1d(pick.permutation(a)[gone:], random_set(pick, pick.integers(0, n + 1)))
        while len(a) + len(b) and 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)):
            extra, missing = np.setdiff1d(b, a), np.setdiff1d(a, b)
            if len(extra) and (pick.random() < 0.5 or not len(missing)):
                b = np.setdiff1d(b, extra[:1])
            else:
                b = np.union1d(b, missing[:1])
        if len(a) != len(b) or (a != b).any():
            assert len(np.intersect1d(sj.keys(a, percent), sj.keys(b, percent)))


def test_intervals():
    for percent in (50, 85, 99):
        for size in range(1, 3000):
            at = sj.interval(size, percent)
            assert (sj.interval_end(at - 1, percent) if at else 0) < size <= sj.interval_end(at, percent)
            assert sj.interval(100 * size // percent, percent) <= at + 1


@pytest.mark.parametrize("bits", [64, 1024, 1 << 16])
def test_traversal_loses_no_link_and_prunes(bits, monkeypatch):
    monkeypatch.setattr(sj, "MAX_BITS", bits)
    pick = np.random.default_rng(3)
    sets = []
    for _ in range(30):
        base = random_set(pick, int(pick.integers(20, 120)))
        for _ in range(6):
            keep = pick.random(len(base)) > pick.choice([0, 0.05, 0.3])
            sets.append(np.union1d(base[keep], random_set(pick, 3)).view(np.int64))
    numbers, used = sj.bit_numbers(sets)
    assert used == min(bits, 1024)
    tree = sj.SignatureTree(sets, numbers, used, np.arange(len(sets)))
    x, y, most = sj.candidates(tree, tree, 85)
    found = set(zip(x.tolist(), y.tolist()))
    linked = 0
    for i, a in enumerate(tree.sets):
        for j in range(i + 1, len(tree.sets)):
            both = len(np.intersect1d(a, tree.sets[j]))
            if 100 * both >= 85 * len(np.union1d(a, tree.sets[j])):
                linked += 1
                assert (i, j) in found
    if bits > 64:
        assert linked <= len(found)
        assert len(found) < 0.1 * len(sets) ** 2 / 2 and linked


def test_forest_joins_what_links_join():
    pick = np.random.default_rng(5)
    base = random_set(pick, 200)
    sets = [np.setdiff1d(base, base[k:k + 4]).view(np.int64) for k in range(0, 200, 4)]
    found = sj.links(sets[:30], sets[30:], np.arange(50), 85)
    assert len(found) == 49 and all(a < 30 <= b for a, b in found)
    assert len(sj.links(sets, None, np.arange(50), 85)) == 49
    assert sj.links(sets, None, np.zeros(50, int), 85) == []
