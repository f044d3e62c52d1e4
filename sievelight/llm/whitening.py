"""Embedding whitening by the exact characteristic polynomial.

Vectors are whole numbers, so their scatter ``n * sum(x x') - S S'`` is an integer matrix, summed exactly in the tasks and
by Spark. Its characteristic polynomial is found modulo primes (reduction to Hessenberg form, one prime to a row of a Spark
job) and put together by Chinese remaindering; as many primes are taken as the bound on its coefficients asks for. All
its roots are real, so the sign changes of its coefficients after a shift count the roots above a point exactly. Bisection
by these counts gives the largest roots, with their multiplicities, to any precision. The components are null vectors of the
matrix less a root, by inverse iteration in decimal arithmetic; those of a repeated root are made orthogonal.

The driver holds a matrix of the vectors' dimension and one polynomial for each prime, whatever the number of rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, tidy

_LIMB = 20  # bits of the pieces whose products are summed in doubles
_ROWS = 4096  # of a matrix product: 2^12 products below 2^40 are exact in a double
_DIGIT = 40  # bits of the digits that Spark sums up
_BITS = 96  # relative precision of a root
_DIGITS = 80  # decimal digits of the inverse iteration


def whole(vector: Column, factor: int = 256) -> Column:
    """Long components floor(factor * c); null for a vector that is null or holds null or non-finite components.

    What lies beyond a long becomes the nearest long.
    """
    fine = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.when(fine, F.transform(vector, lambda c: F.floor(c.cast("double") * factor).cast("long")))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """List column as a matrix; lists that are shorter end in zeros."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    out = np.zeros((len(lengths), size), dtype=np.int64)
    out[np.arange(size) < lengths[:, None]] = flat
    return out


def gram(x: np.ndarray) -> np.ndarray:
    """Exact x'x of a matrix of longs, as Python numbers."""
    total = np.zeros((x.shape[1], x.shape[1]), dtype=object)
    for i in range(0, len(x), _ROWS):
        rest, limbs = x[i : i + _ROWS], []
        while True:
            low = rest if -(1 << _LIMB) < rest.min(initial=0) and rest.max(initial=0) < 1 << _LIMB else rest & ((1 << _LIMB) - 1)
            limbs.append(low.astype(np.float64))
            if low is rest:
                break
            rest = rest >> _LIMB
        for a, left in enumerate(limbs):
            for b, right in enumerate(limbs):
                total += (left.T @ right).astype(np.int64).astype(object) << (_LIMB * (a + b))
    return total


def _gram_digits(size: int):
    """Digits of the sums of products of the vectors of a task, each with a 1 at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1), dtype=object)
        for batch in batches:
            x = _matrix(batch.column(0), size)
            total += gram(np.column_stack([x, np.ones(len(x), dtype=np.int64)]))
        rows = []
        for i in range(size + 1):
            for j in range(i, size + 1):
                value, digit = total[i, j], 0
                while value:
                    last = -(1 << _DIGIT) < value < 1 << _DIGIT
                    rows.append((i, j, digit, value if last else value & ((1 << _DIGIT) - 1)))
                    value, digit = (0 if last else value >> _DIGIT), digit + 1
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[k], pa.int32()) for k in range(3)] + [pa.array(columns[3], pa.int64())],
            names=["i", "j", "digit", "value"],
        )

    return run


def sums_of_products(x: DataFrame, size: int) -> np.ndarray:
    """Exact sums of products of the vectors ``x``, whose last row and column hold their sums and their number."""
    digits = x.select("x").mapInArrow(tidy(_gram_digits(size)), "i int, j int, digit int, value long")
    total = np.zeros((size + 1, size + 1), dtype=object)
    for r in digits.groupBy("i", "j", "digit").agg(F.sum("value").alias("value")).collect():
        total[r["i"], r["j"]] += r["value"] << (_DIGIT * r["digit"])
    return np.triu(total) + np.triu(total, 1).T


def charpoly_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(t - matrix) modulo a prime below 2^31, from the constant one on."""
    h, n = (matrix % p).astype(np.int64), len(matrix)
    for m in range(1, n - 1):
        used = np.flatnonzero(h[m:, m - 1])
        if not len(used):
            continue
        swap = m + int(used[0])
        h[[m, swap]] = h[[swap, m]]
        h[:, [m, swap]] = h[:, [swap, m]]
        factors = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :, m - 1 :] = (h[m + 1 :, m - 1 :] - factors[:, None] * h[m, m - 1 :] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factors % p).sum(axis=1)) % p
    polys = np.zeros((n + 1, n + 1), dtype=np.int64)  # of the leading blocks
    polys[0, 0] = 1
    for k in range(1, n + 1):
        now = np.zeros(n + 1, dtype=np.int64)
        now[1:] = polys[k - 1, :-1]
        now -= h[k - 1, k - 1] * polys[k - 1] % p
        product = 1
        for i in range(k - 1, 0, -1):
            product = product * int(h[i, i - 1]) % p
            if not product:
                break
            now -= product * int(h[i - 1, k - 1]) % p * polys[i - 1] % p
        polys[k] = now % p
    return polys[n].tolist()


def _is_prime(n: int) -> bool:
    """Miller and Rabin with bases that decide all numbers below 2^32."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """The largest primes below 2^31 whose product is more than the bound."""
    found, product, n = [], 1, (1 << 31) + 1
    while product <= bound:
        n -= 2
        if _is_prime(n):
            found.append(n)
            product *= n
    return found


def remaindered(residues: dict[int, list[int]]) -> list[int]:
    """The numbers of smallest absolute value that have these residues modulo each prime."""
    values, modulus = [0] * len(next(iter(residues.values()))), 1
    for p, rest in residues.items():
        inverse = pow(modulus, -1, p)
        values = [v + modulus * ((r - v) * inverse % p) for v, r in zip(values, rest, strict=True)]
        modulus *= p
    return [v - modulus if 2 * v > modulus else v for v in values]


def charpoly(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Characteristic polynomial of a positive semidefinite integer matrix, from the constant coefficient on."""
    n, trace = len(matrix), int(np.trace(matrix))
    # coefficients are largest if all roots are equal
    bound = max(comb(n, k) * trace**k // n**k + 1 for k in range(n + 1))
    primes = primes_for(2 * bound)
    shared = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = [primes[i] for i in batch.column(0).to_pylist()]
            found = [charpoly_mod(shared.value, p) for p in mine]
            yield pa.RecordBatch.from_arrays(
                [pa.array(mine, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["prime", "poly"]
            )

    parts = min(len(primes), spark.sparkContext.defaultParallelism)
    rows = spark.range(0, len(primes), 1, parts).mapInArrow(tidy(run), "prime long, poly array<long>").collect()
    return remaindered({r["prime"]: r["poly"] for r in rows})


class Roots:
    """Counts the roots of a polynomial with integer coefficients and real roots only."""

    def __init__(self, poly: list[int]):
        self.poly = poly
        self.known: dict[tuple[int, int], int] = {}

    def above(self, a: int, scale: int) -> int:
        """How many roots, counted as often as they repeat, are above a / 2^scale."""
        if (a, scale) not in self.known:
            n = len(self.poly) - 1
            c = [v << (scale * (n - k)) for k, v in enumerate(self.poly)]
            for i in range(n):  # coefficients after a shift by a
                for k in range(n - 1, i - 1, -1):
                    c[k] += a * c[k + 1]
            signs = [v > 0 for v in c if v]
            self.known[a, scale] = sum(x != y for x, y in zip(signs, signs[1:], strict=False))
        return self.known[a, scale]

    def largest(self, j: int, most: int) -> tuple[int, int]:
        """The j-th largest root, which is above 0 and at most ``most``: a number and how often it is halved."""
        low, high, scale = 0, most, 0
        while not low or (high - low) << _BITS > low:
            if high - low == 1:
                low, high, scale = 2 * low, 2 * high, scale + 1
            middle = (low + high) // 2
            if self.above(middle, scale) >= j:
                low = middle
            else:
                high = middle
        return low + high, scale + 1


def null_vector(matrix: np.ndarray, root: Decimal, others: list[np.ndarray], seed: int) -> np.ndarray:
    """Unit vector that the matrix less a root takes to zero, orthogonal to the others; largest entry positive."""
    n = len(matrix)
    with localcontext() as context:
        context.prec = _DIGITS
        m = np.array([[Decimal(int(v)) for v in row] for row in matrix], dtype=object).reshape(n, n)
        m[np.arange(n), np.arange(n)] -= root
        tiny = (abs(root) + 1) * Decimal(10) ** (20 - _DIGITS)
        order = np.arange(n)
        for k in range(n):
            pivot = k + int(np.argmax(np.abs(m[k:, k])))
            m[[k, pivot]], order[[k, pivot]] = m[[pivot, k]], order[[pivot, k]]
            if abs(m[k, k]) < tiny:
                m[k, k] = tiny
            m[k + 1 :, k] = m[k + 1 :, k] / m[k, k]
            m[k + 1 :, k + 1 :] = m[k + 1 :, k + 1 :] - m[k + 1 :, k][:, None] * m[k, k + 1 :][None, :]
        rng = random.Random(seed)
        v = np.array([Decimal(rng.randint(1, 1 << 30)) for _ in range(n)], dtype=object)
        for _ in range(4):
            v = v[order].copy()
            for k in range(n):
                v[k + 1 :] = v[k + 1 :] - m[k + 1 :, k] * v[k]
            for k in range(n - 1, -1, -1):
                v[k] = v[k] / m[k, k]
                v[:k] = v[:k] - m[:k, k] * v[k]
            for _ in range(2):
                v = v / (v @ v).sqrt()
                for other in others:
                    v = v - (v @ other) * other
            v = v / (v @ v).sqrt()
        return -v if v[int(np.argmax(np.abs(v)))] < 0 else v


@dataclass(frozen=True)
class Whitening:
    """What whitening needs of the fit list: number and sums of its vectors, components with their roots."""

    n: int
    sums: list[int]
    components: list[list[float]]
    scales: list[float]  # square roots of the scatter's roots
    explained: list[float]


def solve(spark: SparkSession, products: np.ndarray, components: int) -> Whitening:
    """Components of the largest roots above 0, from the sums of products."""
    n, sums = int(products[-1, -1]), products[:-1, -1]
    scatter = n * products[:-1, :-1] - sums[:, None] * sums[None, :]
    trace = int(np.trace(scatter)) if len(scatter) else 0
    if not trace:
        return Whitening(n, sums.tolist(), [], [], [])
    roots = Roots(charpoly(spark, scatter))
    vectors, scales, explained = [], [], []
    for j in range(1, min(components, roots.above(0, 0)) + 1):
        number, scale = roots.largest(j, trace)
        with localcontext() as context:
            context.prec = _DIGITS
            root = Decimal(number) / (1 << scale)
            vectors.append(null_vector(scatter, root, vectors, j))
            scales.append(float(root.sqrt()))
            explained.append(float(root / trace))
    return Whitening(n, sums.tolist(), [[float(e) for e in v] for v in vectors], scales, explained)


def _centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    """n * x - S, in Python numbers where it needs more than 62 bits."""
    most = max(map(abs, model.sums), default=0) + model.n * int(max(x.max(initial=0), -int(x.min(initial=0))))
    return model.n * x.astype(np.int64 if most < 1 << 62 else object) - np.array(model.sums, dtype=object).astype(
        np.int64 if most < 1 << 62 else object
    )


def projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened rows, one column for each component."""
    centred = _centred(x, model).astype(np.float64)
    return np.stack(
        [(centred * np.array(v)).sum(axis=1) / s for v, s in zip(model.components, model.scales, strict=True)], axis=1
    )


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sums over the dimensions of (n * x - S)^2; null beyond a long."""
    centred = _centred(x, model)
    most = int(np.abs(centred).max(initial=0))
    if most * most * max(x.shape[1], 1) >= 1 << 63:
        centred = centred.astype(object)
    return [int(v) if v < 1 << 63 else None for v in (centred * centred).sum(axis=1).tolist()]


def identity_error(x: DataFrame, model: Whitening, size: int) -> float:
    """Largest entry of the whitened fit list's covariance less the identity, as an absolute number."""
    k = len(model.components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = projected(_matrix(batch.column(0), size), model)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in done.T], names=[f"w{i}" for i in range(k)])

    done = x.select("x").mapInArrow(tidy(run), ", ".join(f"w{i} double" for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = done.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(row, pairs, strict=True))


def whiten(vectors: DataFrame, components: int = 4, *, id: str = "vec_id", values: str = "values") -> DataFrame:
    """Rows ``id, component, n, deviation, whitened, explained, identity_error`` of every row and component.

    ``values`` holds long components; rows where it is null take no part. The fit list has each distinct vector once. Components
    are numbered from 1 by falling eigenvalue; the entry of largest size is positive. A component without variance has
    nothing to scale by and is left out, so a fit list of one vector, or of none, gives an empty result. A deviation beyond
    the range of a long is null. Vectors that are shorter than others count as zero beyond their end. Rows that repeat, and rows
    with a null id, are all returned. Other columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    usable = vectors.where(F.col(values).isNotNull()).select(F.col(id).alias("id"), F.col(values).alias("x"))
    size = usable.agg(F.max(F.size("x"))).first()[0] or 0
    numbers = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = T.StructType([vectors.select(F.col(id)).schema[0], *T._parse_datatype_string(numbers)])
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("x")))
    fit = staged(usable.select(padded.alias("x")).distinct(), "fit-list")
    model = solve(spark, sums_of_products(fit, size), components)
    k = len(model.components)
    if not k:
        return spark.createDataFrame([], schema)
    error = identity_error(fit, model, size)
    explained, names = np.array(model.explained), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rows = _matrix(batch.column(1), size), batch.num_rows
            of = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(of),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, model.n)),
                    pa.array(deviations(x, model), pa.int64()).take(of),
                    pa.array(projected(x, model).ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                names=names,
            )

    return usable.mapInArrow(tidy(run), schema)
