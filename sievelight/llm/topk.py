"""Exact top-k search by sequential reading of sorted lists (no random access).

The score of a vector is the sum of one number per dimension. A block of candidates has, for each
dimension, its values in sorted order; a query reads the list from the top where its own component is
positive and from the bottom where it is negative. After a depth, a value that was read is known, and one that was
not is at most the last one read: this gives upper bounds, and with the end of each list lower bounds,
of all scores. A candidate goes out when its upper bound is below the k-th best lower bound; reading
stops when few enough are left, whose scores are then resolved exactly. If bounds do not separate
the candidates, the lists are read to the end. Bounds are integers, so results are exact.

Queries and candidates meet in blocks of bounded size: each candidate block is sent once to every block of
queries, spread over many tasks, and the best k of each cell are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CANDIDATES = 4096  # in a block
_QUERIES = 1024  # in a block, on average
_SPREAD = 64  # tasks among which the cells of one block of queries are dealt
_WIDE = 1 << 27  # vectors with a component from here on are kept apart: their scores may need more than a long
_KEY = 1 << 2200  # above all scores
_STEPS = (0.25, 0.375, 0.5, 0.75, 1.0)  # parts of the lists after which bounds are compared


def scaled(vector: Column, factor: int = 256) -> Column:
    """Whole components floor(factor * x) as doubles, null for a vector that takes no part.

    Null vectors and vectors with a null, infinite or undefined component take no part.
    """
    grown = F.transform(vector, lambda x: x.cast("double") * factor)
    bad = F.exists(grown, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    # from 2^53 on, doubles are whole
    whole = F.transform(grown, lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x))
    return F.when(vector.isNotNull() & ~bad, whole)


def search(
    vectors: DataFrame, is_query: Column, k: int = 5, *, id: str = "vec_id", values: str = "values"
) -> DataFrame:
    """Rows ``query_id, rank, id, score`` (long): the ``k`` rows of highest inner product of each query.

    ``values`` holds integer components; rows where it is null take no part, and vectors are compared with those
    of equal length only. All rows are candidates but those with the query's own id; equal scores go to
    the smaller id. Rows that repeat are candidates each; a query that repeats is answered once.
    Rows with a null id take no part. Scores are ranked exactly whatever their size; one beyond the range of a long
    that is among the best ``k`` is an error. A query with fewer than ``k`` candidates gets all.
    """
    usable = vectors.where(F.col(values).isNotNull() & F.col(id).isNotNull()).select(
        F.col(id).cast("long").alias("id"), F.col(values).alias("v"), is_query.alias("q"), F.size(values).alias("dim")
    )
    asked = usable.where("q").select("id", "v", "dim").dropDuplicates(["id", "v"])
    blocks = max(1, -(-asked.count() // _QUERIES))
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).cast("int"))
    queries = numbered.groupBy("dim", "block").agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    packed = usable.select("id", "v", "dim").mapInArrow(
        _pack_blocks, "dim int, ids binary, matrix binary, part long"
    )
    salt = F.pmod(F.xxhash64("part", "ids"), F.lit(_SPREAD)).cast("int")
    cells = packed.select(
        "dim", "ids", "matrix", salt.alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    ).join(
        queries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SPREAD - 1)))),
        ["dim", "block", "salt"],
    )
    best = cells.select("dim", "ids", "matrix", "rows").mapInArrow(
        _search(k), "query_id long, id long, score long, side int, beyond binary"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("side"), F.desc("score"), F.desc("beyond"), "id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    error = F.raise_error(F.concat(F.lit("score beyond the range of a long: query "), F.col("query_id").cast("string")))
    score = F.when(F.col("side") == 0, F.col("score")).otherwise(error.cast("long")).alias("score")
    return ranked.select("query_id", "rank", F.col("id").alias(id), score)


def _pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates as blocks of one vector length: ids and a matrix of their components."""
    held: dict[tuple[int, bool], tuple[list, list]] = {}
    part = 0

    def block(kind: tuple[int, bool]) -> pa.RecordBatch:
        nonlocal part
        dim, (ids, rows) = kind[0], held.pop(kind)
        part += 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array([dim], pa.int32()),
                pa.array([np.concatenate(ids).tobytes()], pa.binary()),
                pa.array([np.concatenate(rows).tobytes()], pa.binary()),
                pa.array([part], pa.int64()),
            ],
            names=["dim", "ids", "matrix", "part"],
        )

    for batch in batches:
        ids, dims = np.array(batch.column(0), dtype=np.int64), np.array(batch.column(2))
        vectors = batch.column(1)
        flat, starts = vectors.values.to_numpy(zero_copy_only=False), np.array(vectors.offsets)
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            matrix = flat[starts[rows][:, None] + np.arange(dim)].reshape(len(rows), dim)
            wide = np.abs(matrix).max(axis=1, initial=0) >= _WIDE
            for kind, of in (((dim, False), ~wide), ((dim, True), wide)):
                some, values = ids[rows[of]], matrix[of].astype(np.float64 if kind[1] else np.int32)
                for i in range(0, len(some), _CANDIDATES):
                    kept = held.setdefault(kind, ([], []))
                    kept[0].append(some[i : i + _CANDIDATES])
                    kept[1].append(values[i : i + _CANDIDATES])
                    if sum(map(len, kept[0])) >= _CANDIDATES:
                        yield block(kind)
    for kind in list(held):
        yield block(kind)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.to_pylist():
                rows = cell["rows"]
                queries = np.array([r["v"] for r in rows], dtype=np.float64).reshape(len(rows), cell["dim"])
                names = np.array([r["id"] for r in rows], dtype=np.int64)
                ids = np.frombuffer(cell["ids"], dtype=np.int64)
                whole = np.int32 if len(cell["matrix"]) < 8 * len(ids) * cell["dim"] else np.float64
                matrix = np.frombuffer(cell["matrix"], dtype=whole).reshape(len(ids), cell["dim"])
                wide = np.abs(queries).max(axis=1, initial=0) >= _WIDE
                for of, kind in ((~wide, np.int64), (wide, np.float64)):
                    if of.any():
                        q, c, s = cell_top(names[of], queries[of].astype(kind), ids, matrix, k)
                        yield _scored(names[of][q], ids[c], s)

    return run


def _scored(names: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    """Scores that fit a long as such, others by side and a key in their order."""
    side, key = np.zeros(len(scores), dtype=np.int32), [None] * len(scores)
    if scores.dtype == object:
        for i, x in enumerate(scores.tolist()):
            if not -(1 << 63) <= x < 1 << 63:
                side[i], key[i], scores[i] = 1 if x > 0 else -1, (x + _KEY).to_bytes(280, "big"), 0
    return pa.RecordBatch.from_arrays(
        [pa.array(names), pa.array(ids), pa.array(scores.astype(np.int64)), pa.array(side), pa.array(key, pa.binary())],
        names=["query_id", "id", "score", "side", "beyond"],
    )


def _whole(values: np.ndarray, kind: type) -> np.ndarray:
    """The components in a type whose sums are exact."""
    if kind is not object:
        return values.astype(kind)
    return np.array([int(x) for x in values.ravel().tolist()], dtype=object).reshape(values.shape)


def cell_top(
    names: np.ndarray, queries: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and candidates and their scores: at least the best ``k`` of each query."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(matrix).max(initial=0)) * max(matrix.shape[1], 1)
    exact = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object
    values, asked = _whole(matrix, exact), _whole(queries, exact)
    up, down = np.maximum(asked, 0), np.minimum(asked, 0)
    size = len(ids)
    lists = np.sort(values, axis=0)  # the sorted list of each dimension
    low, high = lists[0], lists[-1]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    left = np.arange(len(names))  # queries that still read
    kind = object if exact is object else np.float64
    floor = np.full(len(names), -np.inf, dtype=kind)
    own = names[:, None] == ids[None, :]
    for part in _STEPS:
        depth = min(size, max(1, int(size * part)))
        # values at the reading position from the top and from the bottom
        top, bottom = lists[size - depth], lists[depth - 1]
        last = depth == size
        upper = up[left] @ np.maximum(values, top).T + down[left] @ np.minimum(values, bottom).T
        if last:
            lower = upper
        else:
            seen_up, seen_down = np.where(values >= top, values, low), np.where(values <= bottom, values, high)
            lower = up[left] @ seen_up.T + down[left] @ seen_down.T
        mine = own[left]
        bounds = np.where(mine, -np.inf, lower.astype(kind))
        if size > k:
            kth = np.partition(bounds, size - k, axis=1)[:, size - k]
            floor[left] = np.maximum(floor[left], kth)
        open_ = (upper >= floor[left][:, None]) & ~mine
        counts = open_.sum(axis=1)
        done = (counts <= max(4 * k, size // 32)) | last
        q, c = np.nonzero(open_[done])
        out.append((left[done][q], c))
        left = left[~done]
        if not len(left):
            break
    q, c = (np.concatenate([o[i] for o in out]) for i in (0, 1))
    # resolve the scores of those that are left, and cut to k with ties to the smaller id
    beyond = most >= 1 << 62
    scores = np.zeros(len(q), dtype=object if beyond else np.int64)
    for i in range(0, len(q), 1 << 16):
        a, b = q[i : i + (1 << 16)], c[i : i + (1 << 16)]
        if beyond:
            scores[i : i + (1 << 16)] = (asked[a] * values[b]).sum(axis=1)
        else:
            scores[i : i + (1 << 16)] = np.einsum("ij,ij->i", queries[a].astype(np.int64), matrix[b].astype(np.int64))
    if beyond:
        order = np.array(sorted(range(len(q)), key=lambda i: (q[i], -scores[i], ids[c[i]])), dtype=np.int64)
    else:
        order = np.lexsort((ids[c], -scores, q))
    q, c, scores = q[order], c[order], scores[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    return q[keep], c[keep], scores[keep]
