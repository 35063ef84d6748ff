import itertools
import random
import re

import corpus_cases
import numpy as np
import pytest

from gridsight.llm import near_dup as nd


def shingles(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(zip(*(words[i:] for i in range(n)))) if len(words) >= n else frozenset([tuple(words)])


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    leader = list(range(len(rows)))

    def top(x):
        while leader[x] != x:
            x = leader[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            leader[top(j)] = top(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        component = least.get(top(i)) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return sorted(out, key=str)


def edited(words, pick, times):
    words = list(words)
    for _ in range(times):
        words[pick.randrange(len(words))] = f"edit{pick.randrange(10 ** 6)}"
    return words


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_matches_brute_force(spark, words, percent, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 16)  # buckets of several blocks
    pick = random.Random(8)
    rows = []
    # Chains and stars of near copies around the threshold, copies, and short texts.
    for group in range(12):
        base = [f"g{group}w{i}" for i in range(pick.choice([6, 20, 60, 200, 800]))]
        for _ in range(pick.choice([2, 10, 60])):
            rows.append(edited(base, pick, pick.choice([0, 1, 2, len(base) // 40, len(base) // 25])))
    chain = [f"c{i}" for i in range(300)]
    for _ in range(40):
        chain = edited(chain, pick, 3)
        rows.append(chain)
    rows += [["a"], ["A"], ["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d"], [], []]
    pick.shuffle(rows)
    docs = [(i, " ".join(w)) for i, w in enumerate(rows)]
    docs += [(i, t) for i, t, *_ in corpus_cases.ROWS if i not in range(len(rows)) or i is None]
    docs += [(None, docs[0][1]), (docs[3][0], docs[3][1])]
    got = nd.near_duplicates(corpus_cases.plain(spark, docs), words, percent).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(docs, words, percent)


def test_words_split_at_ascii_space_only():
    (one, two, three) = nd.shingle_sets([t.encode() for t in ("a\u00a0b c", "A\x0bB\x1c C d", "a b c")], 3)
    assert len(one) == 1 and len(two) == 2 and len(three) == 1 and one[0] != three[0]
    hashes, sizes = nd.word_hashes([b"", b"x Y", b" \t\n", b"y"])
    assert sizes.tolist() == [0, 2, 0, 1] and hashes[1] == hashes[2]


def test_estimate_is_close():
    pick = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.85):
        errors = []
        for _ in range(60):
            pool = nd._mix(pick.integers(0, 2 ** 63, 3000, dtype=np.int64).view(np.uint64))
            both = int(2000 * share)
            a = np.sort(pool[:1000 + both // 2])
            b = np.sort(pool[1000 - both // 2:2000])
            exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            ra, rb = nd.registers(a), nd.registers(b)
            errors.append(((ra == rb) & (ra != nd.EMPTY)).mean() - exact)
        assert abs(np.mean(errors)) < 0.015


def test_band_size_follows_the_threshold():
    for percent in (50, 80, 85, 95):
        rows = nd.band_rows(percent)
        assert (1 - (percent / 100) ** rows) ** (nd.REGISTERS // rows) < nd.MISS


def test_one_of_each(spark):
    docs = corpus_cases.rows(spark)
    kept = nd.one_of_each(docs, 3, 85)
    assert kept.columns == docs.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted(
        [1, 3, 4, 5, 6, 7, 8, None, 10], key=str)  # 8 and 9 have the same words


def test_one_of_each_tells_rows_apart_by_id_and_text(spark):
    x, y, z = (" ".join(f"{name}{i}" for i in range(40)) for name in "xyz")
    rows = [(1, x), (2, x), (2, y), *[(None, z)] * 5, (7, z + " more"), (None, y), (3, None), (3, None), (None, "")]
    left = nd.one_of_each(corpus_cases.plain(spark, rows), 5, 80).collect()
    assert sorted([tuple(r) for r in left], key=str) == sorted(
        [(1, x), (2, y), (7, z + " more"), (3, None), (None, "")], key=str)
    # Without any id one row of the group stays all the same.
    left = nd.one_of_each(corpus_cases.plain(spark, [(None, z)] * 5 + [(None, z + " more")]), 5, 80).collect()
    assert len(left) == 1


def test_a_group_of_near_copies_needs_about_one_pair_each(spark, monkeypatch):
    pick = random.Random(4)
    base = [f"w{i}" for i in range(400)]
    docs = corpus_cases.plain(spark, [(i, " ".join(edited(base, pick, 2))) for i in range(300)])
    pairs, confirm = [], nd._confirmed

    def counting(near, sets, percent):
        pairs.append(near.count())
        return confirm(near, sets, percent)

    monkeypatch.setattr(nd, "_confirmed", counting)
    found = nd.near_duplicates(docs, 3, 85)
    assert {r.component_id for r in found.collect()} == {0}
    assert sum(pairs) < 2 * 300


def test_later_links_join_components_without_going_over_the_first_ones(spark, monkeypatch):
    first = [(i + 1, i) for i in range(1, 40) if i % 10]  # four chains of ten
    later = [(11, 3), (50, 25), (51, 50), (12, 4), (61, 60)]
    schema = "_a long, _b long"
    labels = nd.components(spark.createDataFrame(first, schema))
    seen = []
    components = nd.components
    monkeypatch.setattr(nd, "components", lambda links: seen.append(links.count()) or components(links))
    found = {tuple(r) for r in nd.merged(labels, spark.createDataFrame(later, schema)).collect()}
    assert seen == [len(later)]
    assert found == {tuple(r) for r in components(spark.createDataFrame(first + later, schema)).collect()}
