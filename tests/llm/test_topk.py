import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import topk


def brute(ids, matrix, query_ids, k):
    out = {}
    for q in query_ids:
        v = matrix[list(ids).index(q)].astype(object)
        scores = sorted((-int(v @ m.astype(object)), int(i)) for i, m in zip(ids, matrix, strict=True) if i != q)
        out[q] = [(i, -s) for s, i in scores[:k]]
    return out


@pytest.mark.parametrize("big", [3, 60, 10**5, 10**8])
@pytest.mark.parametrize("n", [1, 4, 60, 900])
def test_cells_are_exact(big, n):
    rng = np.random.default_rng(n + big % 97)
    matrix = rng.integers(-big, big, size=(n, 6)).astype(np.int32)
    matrix[n // 2 :] = matrix[: n - n // 2]  # ties
    ids = rng.permutation(n).astype(np.int64)
    names = ids[: min(n, 11)]
    q, c, s = topk.cell_top(names, matrix[: len(names)].astype(np.int64), ids, matrix, 5)
    want = brute(ids, matrix, names, 5)
    for i, name in enumerate(names):
        assert [(int(ids[y]), int(x)) for z, y, x in zip(q, c, s, strict=True) if z == i] == want[name]


def test_separated_candidates_are_found_before_the_lists_end():
    """Clusters far apart: the bounds decide early, and decide right."""
    rng = np.random.default_rng(7)
    matrix = (rng.integers(-3, 4, size=(500, 16)) + 40 * rng.integers(-1, 2, size=(500, 1))).astype(np.int32)
    ids = np.arange(500)
    q, c, s = topk.cell_top(ids[:20], matrix[:20].astype(np.int64), ids, matrix, 5)
    want = brute(ids, matrix, ids[:20], 5)
    for i in range(20):
        assert [(int(ids[y]), int(x)) for z, y, x in zip(q, c, s, strict=True) if z == i] == want[i]


def searched(spark, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    df = df.withColumn("values", topk.scaled(F.col("embedding")))
    found = topk.search(df, F.col("vec_id") % 50 == 0, k)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect())


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], "x"), (50, None, "x"), (100, [nan, 1.0], "x"), (150, [inf, 1.0], "x"),
        (200, [None, 1.0], "x"), (None, [1.0, 1.0], "x"), (1, [1.0, -0.5], "x"), (2, [1.0, 0.5, 9.0], "x"),
        (3, [-0.001, 0.0], "x"),
    ]
    # floor(256 * -0.001) is -1; vectors of another length are not compared
    assert searched(spark, rows) == [(0, 1, 1, 256 * 256 - 128 * 128), (0, 2, 3, -256)]


def test_large_finite_vectors_take_part(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(0, 1, size=(300, 3)).astype(np.float32)
    data[[7, 50, 61]] *= np.float32(3e6)  # scores within a long
    got = searched(spark, [(i, [float(x) for x in v], "") for i, v in enumerate(data)])
    want = brute(np.arange(300), np.floor(256 * data.astype(np.float64)).astype(np.int64), range(0, 300, 50), 5)
    assert got == [(q, r + 1, i, s) for q in sorted(want) for r, (i, s) in enumerate(want[q])]
    assert {7, 61} & {i for _, _, i, _ in got} and {q for q, *_ in got} == set(range(0, 300, 50))


def test_scores_beyond_a_long(spark):
    rows = [(0, [1.0, 1.0], ""), (1, [-3e38, 0.0], ""), (2, [2.0, 0.0], ""), (3, [-3e38, 1.0], "")]
    assert searched(spark, rows, k=1) == [(0, 1, 2, 512 * 256)]
    with pytest.raises(Exception, match="beyond the range of a long"):
        searched(spark, rows, k=2)


def test_ties_and_repeats(spark):
    rows = [(0, [1.0], ""), (0, [1.0], ""), (7, [0.5], ""), (5, [0.5], ""), (5, [0.5], ""), (9, [0.25], "")]
    got = searched(spark, rows, k=3)
    assert got == [(0, 1, 5, 256 * 128), (0, 2, 5, 256 * 128), (0, 3, 7, 256 * 128)]


def test_fewer_candidates_and_none(spark):
    assert searched(spark, [(50, [1.0], "")]) == []
    assert searched(spark, [(50, [1.0], ""), (1, [2.0], "")]) == [(50, 1, 1, 512 * 256)]
    assert searched(spark, []) == []


def test_whole_table_against_brute_force(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(0, 0.125, size=(1500, 24)).astype(np.float32)
    got = searched(spark, [(i, [float(x) for x in v], "") for i, v in enumerate(data)])
    matrix = np.floor(256 * data.astype(np.float64)).astype(np.int64)
    want = brute(np.arange(1500), matrix, range(0, 1500, 50), 5)
    assert got == [(q, r + 1, i, s) for q in sorted(want) for r, (i, s) in enumerate(want[q])]
