import corpus_cases
import pytest

from gridsight.llm import mixing


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Share by weight, stop at `most` sizes, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, rest = {}, set(), sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        left = rest - sum(most * sizes[s] for s in full)
        share = sum(weight[s] for s in open_)
        target = {s: most * sizes[s] if s in full else left * weight[s] / share for s in names}
        over = {s for s in open_ if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 1, "c": 1, None: 5}, {"a": 1, "b": 2, "c": 900, "d": 40},
    {"z": 0, "é": 10, "y": 10}, {"only": 7}, {"a": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "_source string, _size long")
    got = {r._source: r._target for r in mixing.targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in got)


def rows_of(spark, n=3000):
    # Half of all rows in one source, a third with one size.
    return spark.createDataFrame(
        [(i, "hot" if i % 2 else f"s{i % 7}", 50 if i % 3 == 0 else 1 + i % 97) for i in range(n)],
        "doc_id long, source string, size long")


@pytest.mark.parametrize("group_rows", [10, 2_000])
def test_takes_come_near_the_targets(spark, group_rows):
    found = mixing.mix(rows_of(spark), "size", group_rows=group_rows).collect()
    taken, target, size = {}, {}, {}
    for r in found:
        s = r.row.source
        taken[s] = taken.get(s, 0) + r.row.size * r.copies
        size[s] = size.get(s, 0) + r.row.size
        target[s] = r.target
        assert 0 <= r.copies <= 3 and r.source_size >= r.row.size
    want = brute_targets(size)
    for s in target:
        assert abs(target[s] - want[s]) < 1e-6
        assert abs(taken[s] - target[s]) <= 200


def test_partitions_do_not_matter(spark):
    runs = [sorted(tuple(r) for r in mixing.mix(rows_of(spark).repartition(n), "size", group_rows=g)
                   .select("row.doc_id", "copies").collect()) for n, g in ((1, 10), (7, 2_000), (60, 150), (3, 1e-4))]
    assert runs[0] == runs[1] == runs[2] == runs[3]  # the last one splits by more than four digits


def test_repeated_rows_are_separate(spark):
    df = corpus_cases.plain(spark, [(1, "x")] * 60).selectExpr("doc_id", "'s' AS source", "10L AS size", "text AS row")
    assert mixing.mix(df, "size").count() == 60
