from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import whitening
from sievelight.llm.queries import QUERIES

SCHEMA = "vec_id long, values array<long>"


def plain_charpoly(matrix):
    """Faddeev and Leverrier's method, in fractions; from the constant coefficient on."""
    n = len(matrix)
    a = [[Fraction(int(v)) for v in row] for row in matrix]
    m, out = [[Fraction(0)] * n for _ in range(n)], [Fraction(1)]
    for k in range(1, n + 1):
        am = [[sum(a[i][x] * m[x][j] for x in range(n)) for j in range(n)] for i in range(n)]
        m = [[am[i][j] + (out[-1] if i == j else 0) for j in range(n)] for i in range(n)]
        out.append(-sum(a[i][x] * m[x][i] for i in range(n) for x in range(n)) / k)
    return [int(c) for c in out[::-1]]


def expected(rows, k=4):
    """Plain version: number, deviations by row, eigenvalue shares, eigenvalues, covariance and means of the fit list."""
    usable = [(i, v) for i, v in rows if v is not None]
    size = max((len(v) for _, v in usable), default=0)
    full = [(i, tuple(v) + (0,) * (size - len(v))) for i, v in usable]
    fit = sorted({v for _, v in full})
    n, sums = len(fit), [sum(v[d] for v in fit) for d in range(size)]
    x = np.array(fit, dtype=np.float64).reshape(n, size)
    centred = x - x.mean(axis=0)
    cov = centred.T @ centred / n
    deviations = [(i, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))) for i, v in full]
    return n, deviations, cov, np.linalg.eigvalsh(cov)[::-1], full, np.array(sums, dtype=np.float64) / n


def check(spark, rows, components=4):
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA), components).toPandas()
    n, deviations, cov, roots, full, mean = expected(rows)
    rank = int((roots > 1e-9 * max(roots[0], 1e-300)).sum())
    k = min(components, rank)
    assert len(got) == k * len(full) and (got.n == n).all()
    first = got[got.component == 1]
    assert sorted(zip(first.vec_id, first.deviation, strict=True)) == sorted(deviations)
    shares = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(shares, roots[:k] / np.trace(cov), rtol=1e-6)
    assert (got.identity_error < 1e-6).all()
    # whitened rows are a projection on k orthonormal eigenvectors
    by = {(i, c): w for i, c, w in zip(got.vec_id, got.component, got.whitened, strict=True)}
    white = np.array([[by[i, c] for c in range(1, k + 1)] for i, _ in full])
    x = np.array([v for _, v in full], dtype=np.float64) - mean
    projections = white * np.sqrt(roots[:k])
    basis = np.linalg.lstsq(x, projections, rcond=None)[0]
    assert np.allclose(x @ basis, projections, atol=1e-5 * max(1.0, np.abs(projections).max()))
    assert np.allclose(basis.T @ cov @ basis, np.diag(roots[:k]), atol=1e-6 * roots[0])
    return got


def test_polynomial_is_exact(spark):
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 7):
        x = rng.integers(-9, 9, size=(n + 2, n))
        matrix = (x.T @ x).astype(object)
        want = plain_charpoly(matrix)
        assert whitening.charpoly(spark, matrix) == want
        assert whitening.charpoly_mod(matrix, 101) == [c % 101 for c in want]
    wide = (matrix.astype(object) * 10**30 + np.diag([1] * 7)).astype(object)
    assert whitening.charpoly(spark, wide) == plain_charpoly(wide)
    zeros = np.zeros((4, 4), dtype=object)
    zeros[0, 3] = zeros[3, 0] = 0
    zeros[0, 0] = 7  # nothing to eliminate with
    assert whitening.charpoly(spark, zeros) == [0, 0, 0, -7, 1]


def test_primes():
    found = whitening.primes_for(1 << 100)
    assert found[0] == 2**31 - 1 and all(all(p % q for q in range(2, 1000)) for p in found) and len(set(found)) == 4
    assert whitening.remaindered({101: [100, 5], 103: [102, 5]}) == [-1, 5]


def test_roots_are_isolated_with_their_multiplicity():
    # (t - 5)^2 (t - 3) t
    poly = [0, -75, 55, -13, 1]
    roots = whitening.Roots(poly)
    assert [roots.above(a, 0) for a in (-1, 0, 2, 3, 4, 5)] == [4, 3, 3, 2, 2, 0]
    for j, want in ((1, 5), (2, 5), (3, 3)):
        number, scale = roots.largest(j, 13)
        assert abs(Fraction(number, 1 << scale) - want) < Fraction(1, 1 << 90)
    # t^2 - 2, whose positive root is irrational
    number, scale = whitening.Roots([-2, 0, 1]).largest(1, 2)
    assert abs(Decimal(number) / (1 << scale) - Decimal(2).sqrt()) < Decimal(10) ** -25


def test_gram_is_exact_for_wide_numbers():
    rng = np.random.default_rng(1)
    for high in (3, 1 << 19, 1 << 21, 1 << 45, 1 << 62):
        x = rng.integers(-high, high, size=(60, 3))
        x[0] = [-high, high - 1, -1]
        exact = x.astype(object)
        assert (whitening.gram(x) == exact.T @ exact).all()


@pytest.mark.parametrize("scale", [1, 1000])
def test_against_numpy(spark, scale):
    rng = np.random.default_rng(scale)
    x = rng.integers(-200, 200, size=(80, 6)) * scale
    x[:, 1] = x[:, 0] // 2
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(100 + i, rows[0][1]) for i in range(30)] + [(3, rows[3][1]), (500, None)]
    check(spark, rows)
    check(spark, rows, components=6)


def test_repeated_roots(spark):
    """A cross: all eigenvalues are equal, any orthonormal basis will do."""
    rows = [(2 * d + s, [(9 if s else -9) if e == d else 0 for e in range(5)]) for d in range(5) for s in (0, 1)]
    check(spark, rows)


def test_few_dimensions(spark):
    check(spark, [(1, [1]), (2, [4]), (3, [4]), (4, [-2])])
    check(spark, [(1, [1, 1]), (2, [2, 2]), (3, [5, 5])])  # one component has variance
    check(spark, [(1, [1, 2]), (2, [2]), (3, []), (4, [7, 9, 3])])  # short vectors end in zeros


def test_no_variance_and_empty(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [3, 4]), (2, [3, 4])]):
        got = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
        assert got.collect() == []
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(1, [1 << 62, 0]), (2, [0, 5]), (3, [-(1 << 62), 9]), (None, [0, 0])]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA), 2).collect()
    assert len(got) == 8 and all(r.deviation is None for r in got if r.vec_id in (1, 3))
    assert {r.vec_id for r in got} == {1, 2, 3, None}


def test_whole_components_and_extra_columns(spark):
    rows = [(1, [0.5, -0.001]), (2, [float("nan"), 1.0]), (3, [1.0, float("inf")]), (4, [None, 1.0]), (5, None), (6, []), (7, [3e38, -3e38])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r.v for r in df.select("vec_id", whitening.whole(F.col("embedding")).alias("v")).collect()}
    assert got == {1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: [], 7: [2**63 - 1, -(2**63)]}
    more = spark.createDataFrame([(1, [1, 2], "a", 5), (2, [4, 0], "b", 6)], "id long, x array<long>, component string, n int")
    assert whitening.whiten(more, 2, id="id", values="x").columns[:3] == ["id", "component", "n"]


def test_query_reruns_agree(spark, llm_tables):
    rows = [sorted(map(tuple, QUERIES["op13_embedding_whitening"](spark, llm_tables).collect())) for _ in range(2)]
    strip = [[r[:5] for r in some] for some in rows]
    assert strip[0] == strip[1] and rows[0] and all(r[6] <= 1e-4 for r in rows[0])
