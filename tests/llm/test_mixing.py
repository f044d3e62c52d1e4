import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sievelight.llm import mixing


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, size long")


def mixed(spark, rows, **more):
    return mixing.mix(rows_of(spark, rows), F.col("size"), **more).collect()


def water(sizes, weights, cap=3):
    """Targets by plain repetition."""
    capped = {}
    while True:
        rest = sum(sizes.values()) - sum(capped.values())
        open_ = {s: w for s, w in weights.items() if s not in capped}
        share = {s: rest * w / sum(open_.values()) for s, w in open_.items()}
        over = {s: cap * sizes[s] for s in share if share[s] >= cap * sizes[s]}
        if not over:
            return {**capped, **share}
        capped |= over


def test_targets_follow_weights_and_bounds(spark):
    sizes = {"a": 500, "b": 10, "c": 400, "d": 3, "e": 90, None: 7}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: i % 3 + 1 for i, s in enumerate(order)}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(water(sizes, weights))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_taken_words_are_near_the_target(spark):
    rng = random.Random(4)
    sources = ["a"] * 600 + ["b"] * 200 + ["c"] * 100 + [None] * 50
    rows = [(i, s, rng.randint(0, 300)) for i, s in enumerate(sources)]
    got = mixed(spark, rows)
    assert len(got) == len(rows)
    taken, largest = defaultdict(int), 300
    for r in got:
        assert 0 <= r.copies <= 3
        taken[r.source] += r["size"] * r.copies
    for r in got:
        assert abs(taken[r.source] - r.target) <= 2 * largest
    again = mixed(spark, rows[::-1])
    assert {(r.doc_id, r.copies) for r in got} == {(r.doc_id, r.copies) for r in again}


def test_copies_are_the_integers_passed_by_prefix_sums(spark):
    """One source of equal sizes: ranks are those of the hash order, whatever the partitions."""
    rows = [(i, "s", 5) for i in range(400)] + [(1000 + i, "t", 5) for i in range(100)]
    got = mixed(spark, rows)
    s = sum(r.copies for r in got if r.source == "s")
    target = next(r.target for r in got if r.source == "s") / 5
    assert abs(s - target) <= 1


def test_nulls_ties_repeats_and_clashing_names(spark):
    rows = [(1, "a", None), (1, "a", 4), (1, "a", 4), (None, None, 4), (2, None, 0)]
    df = rows_of(spark, rows).selectExpr("*", "'x' as TARGET", "7 as copies", "'k' as _mix_extra")
    got = mixing.mix(df, F.col("size"))
    assert got.columns == ["doc_id", "source", "_mix_extra", "size", "source_size", "target", "copies"]
    assert got.count() == 5


def test_empty_and_wordless(spark):
    assert mixed(spark, []) == []
    got = mixed(spark, [(1, "a", 0), (2, "b", None)])
    assert [(r.target, r.copies) for r in got] == [(0.0, 0), (0.0, 0)]


def test_emitted_repeats_rows(spark):
    got = mixing.mix(rows_of(spark, [(1, "a", 10), (2, "b", 100), (3, "c", 900)]), F.col("size"))
    want = sorted(r.doc_id for r in got.collect() for _ in range(r.copies))
    assert sorted(r.doc_id for r in mixing.emitted(got, ["doc_id"]).collect()) == want
