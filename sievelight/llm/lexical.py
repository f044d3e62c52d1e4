"""Ranked lexical search, term at a time with a limited number of accumulators.

An item's terms are worked off rarest first. Each posting adds to the accumulator of its document. The bound of
a term is its weight times its largest impact; once the bounds of the terms that are left sum up to less than the
k-th best partial score, a document without an accumulator cannot come among the best any more, and no more
accumulators are created. Those that can still reach the k-th best go on and get the exact rest of their scores.

Documents are indexed in blocks: a row of the index has the postings of some thousand documents, kept for the terms that
items may ask for. Items come in blocks too, and each block of items meets each block of documents once. The
k-th best score that a task has seen goes with it from block to block, so later blocks create few accumulators. The best
``k`` of each pair of blocks are merged per item. Everything is integer arithmetic, so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, tidy

#: A term: letters and digits of ASCII, and all other characters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# lower-cases A-Z and turns what separates terms into spaces; bytes from 128 on belong to other characters
_PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).translate(
    bytes.maketrans(_UPPER.encode(), _LOWER.encode())
)


@dataclass(frozen=True)
class Sizes:
    """Sizes of blocks and pieces; results do not depend on them."""

    bits: int = 1 << 22  # of the filter of asked terms, whatever their number
    piece: int = 1 << 17  # terms that are worked on at once
    chunk: int = 1 << 20  # bytes of a text that are split at once
    docs: int = 1 << 14  # in a block of the index, at most
    postings: int = 1 << 19  # in a block of the index, plus those of one piece
    items: int = 256  # in a block of items, on average
    spread: int = 64  # tasks among which the index meets one block of items


def terms_of(text: Column) -> Column:
    """All terms of a text, with repeats; none for null."""
    found = F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(TERM), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def _asked_filter(asked: DataFrame, size: int) -> np.ndarray:
    """Bits that the terms of the column ``term`` set, two each; a term without its bits is asked by no item.

    The filter has a fixed size. More terms make it let more through, which costs room in the index and changes nothing else.
    """
    hashed = asked.select(F.xxhash64("term").alias("h"))
    places = hashed.select(F.explode(F.array(F.col("h"), F.shiftrightunsigned("h", 32))).alias("p")).select(
        F.col("p").bitwiseAND(F.lit(size - 1)).alias("p")
    )
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")
    )
    bits = np.zeros(size // 64, dtype=np.uint64)
    for row in words.collect():
        bits[row["w"]] = row["b"] & ((1 << 64) - 1)
    return bits


def _chunks(body: bytes, size: int) -> Iterator[list[bytes]]:
    """Terms of a plain text, some at a time."""
    at = 0
    while at < len(body):
        end = body.find(b" ", at + size)
        end = len(body) if end < 0 else end
        yield body[at:end].split()
        at = end


class _Block:
    """Postings of some documents."""

    def __init__(self, bits: np.ndarray, sizes: Sizes):
        self.bits, self.limits = bits, sizes
        self.ids, self.sizes, self.vocabulary, self.found, self.postings = [], [], {}, [], 0
        self.words, self.docs, self.counts, self.held = [], [], [], 0

    def add(self, doc: int | None, text: bytes) -> None:
        at, size = len(self.ids), 0
        for words in _chunks(text.translate(_PLAIN), self.limits.chunk):
            size += len(words)
            self.words.append(words)
            self.docs.append(at)
            self.counts.append(len(words))
            self.held += len(words)
            if self.held >= self.limits.piece:
                self.settle()
        self.ids.append(doc)
        self.sizes.append(size)

    def settle(self) -> None:
        """Count the terms held, as far as they are asked for."""
        words = [w for some in self.words for w in some]
        hashes = np.fromiter(
            map(xxhash.xxh64_intdigest, words, repeat(42)), dtype=np.uint64, count=len(words)
        )
        asked = np.ones(len(words), dtype=bool)
        for h in (hashes, hashes >> np.uint64(32)):
            p = h & np.uint64(64 * len(self.bits) - 1)
            asked &= (self.bits[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        known = self.vocabulary
        terms = np.fromiter((known.setdefault(w, len(known)) for w in compress(words, asked)), dtype=np.int64)
        docs = np.repeat(np.array(self.docs, dtype=np.int64), self.counts)[asked]
        keys, times = np.unique(terms << 32 | docs, return_counts=True)
        self.found.append((keys, times))
        self.postings += len(keys)
        self.words, self.docs, self.counts, self.held = [], [], [], 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The block as one row of the index; none if it has no documents."""
        if not self.ids:
            return
        self.settle()
        keys, times = (np.concatenate([f[k] for f in self.found]) for k in (0, 1))
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        times = np.add.reduceat(times, first) if len(first) else times
        keys = keys[first]  # a document that was counted in pieces has one posting again
        starts = np.searchsorted(keys >> 32, np.arange(len(self.vocabulary) + 1))
        sizes = np.array(self.sizes, dtype=np.int64)
        columns = {
            "n_docs": pa.array([int((sizes > 0).sum())], pa.int64()),
            "n_terms": pa.array([int(sizes.sum())], pa.int64()),
            "terms": pa.array([[w.decode() for w in self.vocabulary]], pa.list_(pa.string())),
            "dfs": pa.array([np.diff(starts).tolist()], pa.list_(pa.int64())),
            "ids": pa.array([self.ids], pa.list_(pa.int64())),
            "sizes": pa.array([sizes.tobytes()], pa.binary()),
            "docs": pa.array([(keys & 0xFFFFFFFF).astype(np.int32).tobytes()], pa.binary()),
            "tfs": pa.array([times.astype(np.int32).tobytes()], pa.binary()),
        }
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


_INDEX = (
    "n_docs long, n_terms long, terms array<string>, dfs array<long>, ids array<long>, sizes binary, "
    "docs binary, tfs binary"
)


def index(
    docs: DataFrame, asked: DataFrame, *, id: str = "doc_id", text: str = "text", sizes: Sizes = Sizes()
) -> DataFrame:
    """Blocks of postings of all documents, for the terms in the column ``term`` of ``asked`` (and a few others)."""
    shared = docs.sparkSession.sparkContext.broadcast(_asked_filter(asked, sizes.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(shared.value, sizes)
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block.add(doc, value.as_buffer().to_pybytes() if value.is_valid else b"")
                if len(block.ids) >= sizes.docs or block.postings >= sizes.postings:
                    yield from block.rows()
                    block = _Block(shared.value, sizes)
        yield from block.rows()

    return docs.select(F.col(id).cast("long"), F.col(text)).mapInArrow(tidy(run), _INDEX)


class Searcher:
    """Finds the best documents of items in blocks of an index, one block after the other."""

    def __init__(self, n_docs: int, n_terms: int, k: int):
        self.n_docs, self.n_terms, self.k = n_docs, n_terms, k
        self.floors: dict = {}  # k-th best score of each item so far

    def open(self, row: dict) -> None:
        """Go on to this block."""
        self.ids = np.array([(1 << 63) - 1 if i is None else i for i in row["ids"]], dtype=np.int64)
        self.null = np.array([i is None for i in row["ids"]], dtype=bool)
        sizes = np.frombuffer(row["sizes"], dtype=np.int64).tolist()
        m = np.array([10 + 90 * n * self.n_docs // self.n_terms if n else 10 for n in sizes], dtype=np.int64)
        self.docs = np.frombuffer(row["docs"], dtype=np.int32)
        tfs = np.frombuffer(row["tfs"], dtype=np.int32).astype(np.int64)
        self.impacts = 1_000_000_000 * tfs // (1000 * tfs + 8 * m[self.docs])
        self.ends = np.cumsum(np.array(row["dfs"], dtype=np.int64))
        self.starts = self.ends - np.array(row["dfs"], dtype=np.int64)
        self.most = np.maximum.reduceat(self.impacts, self.starts) if len(self.starts) else self.starts
        self.places = {t: i for i, t in enumerate(row["terms"])}

    def best(self, item, terms: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the best documents of this block, at most ``k``.

        ``terms`` are pairs of a term and its weight, rarest first. Documents that cannot be among the best ``k`` of
        the blocks so far are left out.
        """
        here = [(self.places[t], w) for t, w in terms if t in self.places]
        bounds = [w * int(self.most[p]) for p, w in here]
        rest = np.cumsum([0, *bounds[::-1]])[::-1].tolist()  # of this term and those after it
        floor = self.floors.get(item, 1)
        scores = np.zeros(len(self.ids), dtype=np.int64)
        growing, left = True, np.zeros(0, dtype=np.int64)
        for j, (place, weight) in enumerate(here):
            if growing and rest[0] - rest[j] >= rest[j]:
                floor = max(floor, self._kth(scores))
            if growing and rest[j] < floor:
                growing = False
                left = np.flatnonzero(scores + rest[j] >= floor)
            run = slice(self.starts[place], self.ends[place])
            docs, impacts = self.docs[run], self.impacts[run]
            if growing:
                scores[docs] += weight * impacts
            elif len(left):
                at = np.minimum(np.searchsorted(docs, left), len(docs) - 1)
                hit = docs[at] == left
                scores[left[hit]] += weight * impacts[at[hit]]
                left = left[scores[left] + rest[j + 1] >= floor]
            else:
                break
        if growing:
            left = np.flatnonzero(scores)
        left = left[scores[left] >= floor]
        order = np.lexsort((self.null[left], self.ids[left], -scores[left]))[: self.k]
        left = left[order]
        if len(left) == self.k:
            self.floors[item] = max(floor, int(scores[left[-1]]))
        return left, scores[left]

    def _kth(self, scores: np.ndarray) -> int:
        """The k-th best partial score; 0 if fewer documents have one."""
        if len(scores) < self.k:
            return 0
        return int(np.partition(scores, len(scores) - self.k)[len(scores) - self.k])


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    *,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    sizes: Sizes = Sizes(),
) -> DataFrame:
    """Rows ``item, rank, id, score``: the ``k`` documents of highest score above 0 of each item.

    All rows of ``docs`` are searched by whole texts; null and empty texts have no terms. Equal scores go by
    ascending id, a null id last. Rows that repeat are documents of their own. Rows of ``items`` with the same id, null
    included, are one item with the terms of them all, each once; an item without known terms has no rows. Empty tables
    give an empty result. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col(item).alias("item"), F.explode(terms_of(F.col(item_text))).alias("term")).distinct()
    wanted = staged(wanted, "item-terms")
    blocks = staged(index(docs, wanted.select("term").distinct(), id=id, text=text, sizes=sizes), "postings")
    n_docs, n_terms = (v or 0 for v in blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    n_items = wanted.agg(F.count_distinct(F.struct("item"))).first()[0]
    counted = blocks.select(F.inline(F.arrays_zip("terms", "dfs"))).groupBy("terms").agg(F.sum("dfs").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weighed = wanted.join(counted, wanted.term == counted.terms).select("item", F.struct("df", "term", weight.alias("w")).alias("t"))
    parts = -(-n_items // sizes.items) or 1
    asked = (
        weighed.groupBy("item").agg(F.array_sort(F.collect_list("t")).alias("terms"))
        .groupBy(F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int").alias("part"))
        .agg(F.collect_list(F.struct("item", "terms")).alias("asked"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(sizes.spread - 1))))
    )
    columns = ("terms", "dfs", "ids", "sizes", "docs", "tfs")
    cells = blocks.select(
        *columns,
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
        F.pmod(F.xxhash64("docs", "ids"), F.lit(sizes.spread)).cast("int").alias("salt"),
    ).join(asked, ["part", "salt"])
    kind = items.select(F.col(item)).schema[0].dataType
    found = T.StructType().add("item", kind).add("id", "long").add("score", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(n_docs, n_terms, k)
        for batch in batches:
            wanted_type = batch.schema.field("asked").type.value_type.field("item").type
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                searcher.open(row)
                names, ids, scores = [], [], []
                for one in row["asked"]:
                    places, values = searcher.best(one["item"], [(t["term"], t["w"]) for t in one["terms"]])
                    names += [one["item"]] * len(places)
                    ids += [row["ids"][p] for p in places.tolist()]
                    scores += values.tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, wanted_type), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())],
                    names=["item", "id", "score"],
                )

    best = cells.select(*columns, "asked").mapInArrow(tidy(run), found)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), "rank", F.col("id").alias(id), "score")
