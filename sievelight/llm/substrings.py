"""Substring deduplication by factors relative to an index of all documents, after relative Lempel-Ziv parsing.

A window is ``WIDTH`` consecutive words; a window of a document is a duplicate if its words also start in a
document with a smaller id. A document is parsed against an index of reference blocks into factors, the longest runs of words that
follow one another under duplicate windows; what lies between factors is kept.

* Each window has an anchor, the 5 words in it whose hash is smallest (equal windows have equal anchors).
  The run of windows with one anchor is a block; a text has about one block in five words. The index
  has, for each block, the smallest document that holds it, and for each anchor, whether it heads different
  blocks.
* Blocks that a smaller document holds follow one another as one factor, as long as they last.
* At factor boundaries blocks differ although their anchor is known. There, and in the first document of each such block,
  windows are looked up one by one, and lengthen the factor or start one.

A factor's words may come from several documents, unlike a Lempel-Ziv factor, which has one source: removal needs the longest run
of known windows, whatever their sources.

Copies are combined inside each batch before the shuffle: of equal blocks only the smallest document of
a batch goes to the index. Anchors that are frequent in a batch go there by block instead of by
anchor, with one marker that makes the anchor known, so a passage that a third of all documents share
is spread. Blocks and windows are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, tidy, without

WIDTH = 13
ANCHOR = 5
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BASE = 0x9E3779B97F4A7C15  # odd, 5 modulo 8
_PIECE = 1 << 17  # words that are worked on at once, unless one text has more
_BATCH = 1 << 18  # blocks that are combined before the shuffle
_FREQUENT = 64  # blocks of one anchor in a batch from which it counts as frequent
NORMAL, SPREAD, KNOWN, MARKER = 0, 1, 2, 3


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Blocks:
    """Windows and blocks of some texts, each given as its list of words."""

    def __init__(self, texts: list[list[bytes]], width: int = WIDTH):
        self.sizes = np.array([len(w) for w in texts], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        total = int(self.starts[-1])
        words = np.fromiter(
            (h for t in texts for h in map(xxhash.xxh3_64_intdigest, t)), dtype=np.uint64, count=total
        )
        powers = np.full(total + 1, _BASE, dtype=np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        back = np.full(total + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        back[0] = 1
        np.cumprod(back, out=back)
        sums = np.zeros(total + 1, dtype=np.uint64)
        np.cumsum(words * powers[:-1], out=sums[1:])

        def run(first: np.ndarray, end: np.ndarray) -> np.ndarray:
            """Hash of the words from first to before end."""
            return mixed((sums[end] - sums[first]) * back[first] + (end - first).astype(np.uint64))

        # windows that lie in one text
        left = np.repeat(self.starts[1:], self.sizes) - np.arange(total)
        self.window = np.flatnonzero(left >= width)
        self.text = np.repeat(np.arange(len(texts)), np.maximum(self.sizes - width + 1, 0))
        self.hash = run(self.window, self.window + width)
        if not len(self.window):
            self.first = self.last = self.block = self.anchor = self.owner = np.zeros(0, dtype=np.int64)
            return
        at = np.arange(total - ANCHOR + 1)
        grams = run(at, at + ANCHOR)
        anchors = _leftmost_least(grams, width - ANCHOR + 1)[self.window]
        new = np.ones(len(anchors), dtype=bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (self.text[1:] != self.text[:-1])
        self.first = np.flatnonzero(new)  # of each block, into the windows
        self.last = np.concatenate([self.first[1:], [len(anchors)]]) - 1
        place = anchors[self.first]
        self.owner = self.text[self.first]
        self.anchor = grams[place]
        begin, end = self.window[self.first], self.window[self.last] + width
        self.block = mixed(run(begin, end) + (place - begin).astype(np.uint64))


def _leftmost_least(values: np.ndarray, span: int) -> np.ndarray:
    """For each place, the place of the first smallest of the next ``span`` values."""
    least, place = values, np.arange(len(values))
    done = 1
    while done < span:
        step = min(done, span - done)
        a, b = least[: len(least) - step], least[step:]
        right = b < a
        least, place = np.where(right, b, a), np.where(right, place[step:], place[: len(place) - step])
        done += step
    return place


def _pieces(batch_texts: list[str | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Texts as lists of words, some at a time: the place of the first, and the lists."""
    held, words, first = [], 0, 0
    for i, text in enumerate(batch_texts):
        held.append((text or "").encode().split())
        words += len(held[-1])
        if words >= _PIECE:
            yield first, held
            held, words, first = [], 0, i + 1
    if held:
        yield first, held


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


_INDEX = "anchor long, block long, doc long, kind int"


def _index_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            ids, texts = np.array(batch.column(0), dtype=np.int64), batch.column(1).to_pylist()
            for first, held in _pieces(texts):
                b = Blocks(held, width)
                found.append((b.anchor, b.block, ids[first + b.owner]))
                size += len(b.owner)
                if size >= _BATCH:
                    yield _combined(found)
                    found, size = [], 0
        if size:
            yield _combined(found)

    return run


def _combined(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Index rows of a batch: of equal blocks only the smallest document goes on to the index."""
    anchor, block, doc = (
        np.concatenate([f[k] for f in found]).astype(t)
        for k, t in enumerate((np.uint64, np.uint64, np.int64))
    )
    order = np.lexsort((doc, block, anchor))
    anchor, block, doc = anchor[order], block[order], doc[order]
    same = np.zeros(len(doc), dtype=bool)
    same[1:] = (anchor[1:] == anchor[:-1]) & (block[1:] == block[:-1])
    once = ~(same & np.concatenate([[False], doc[1:] == doc[:-1]]))
    anchor, block, doc, same = anchor[once], block[once], doc[once], same[once]
    # documents after the smallest know already that they repeat it
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))
    kind = np.where(same & (doc > doc[lead]), KNOWN, NORMAL)
    new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    group = np.cumsum(new) - 1
    many = np.bincount(group, weights=kind == NORMAL) >= _FREQUENT
    kind = np.where((kind == NORMAL) & many[group], SPREAD, kind)
    marks = np.flatnonzero(new)[many]
    keys = np.where(kind == SPREAD, mixed(block), np.where(kind == KNOWN, mixed(doc.view(np.uint64)), anchor))
    return pa.RecordBatch.from_arrays(
        [
            _signed(np.concatenate([keys, anchor[marks]])),
            _signed(np.concatenate([block, np.zeros(len(marks), dtype=np.uint64)])),
            pa.array(np.concatenate([doc, doc[marks]])),
            pa.array(np.concatenate([kind, np.full(len(marks), MARKER)]).astype(np.int32)),
        ],
        names=["anchor", "block", "doc", "kind"],
    )


def _among(keys: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_values, keys), len(sorted_values) - 1)
    return sorted_values[at] == keys


def _lists(column: pa.Array) -> list[np.ndarray]:
    """A list column as sorted unsigned arrays; null is empty."""
    empty = np.zeros(0, dtype=np.uint64)
    return [
        empty if not v.is_valid else np.sort(v.values.to_numpy(zero_copy_only=False).view(np.uint64))
        for v in column
    ]


def factors(windows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and lengths of the maximal runs of words under windows that start at these sorted places."""
    if not len(windows):
        return windows, windows
    breaks = np.flatnonzero(np.diff(windows) > width)
    first = windows[np.concatenate([[0], breaks + 1])]
    last = windows[np.concatenate([breaks, [len(windows) - 1]])]
    return first, last - first + width


def cut(text: str, starts: list[int], lengths: list[int]) -> str:
    """The text without the words of its factors; runs of kept words stay as they are, joined by one space."""
    if not starts:
        return text
    body = text.encode()
    spans = [m.span() for m in _WORD.finditer(body)]
    edges = [0, *(e for s, n in zip(starts, lengths, strict=True) for e in (s, s + n)), len(spans)]
    runs = [body[spans[a][0] : spans[b - 1][1]] for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]
    return b" ".join(runs).decode()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compress the texts for the shuffle."""
    zip_ = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = batch.column("text")
        packed = [None if not t.is_valid else zip_.compress(t.as_py().encode()) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in batch.schema.names if n != "text"), pa.array(packed, pa.binary())],
            names=[*(n for n in batch.schema.names if n != "text"), "zip"],
        )


def _packed(rows: DataFrame) -> DataFrame:
    """Rows whose column ``text`` is compressed, as ``zip``."""
    kept = [f for f in rows.schema if f.name != "text"]
    return rows.mapInArrow(tidy(_pack), T.StructType([*kept, T.StructField("zip", T.BinaryType())]))


def _unpacked(column: pa.Array) -> list[str | None]:
    unzip = zstandard.ZstdDecompressor()
    return [None if not z.is_valid else unzip.decompress(z.as_py()).decode() for z in column]


_PARSED = "doc long, mark long, known array<int>, asked array<long>, at array<int>"


def _parse(width: int):
    """Factor the texts: windows inside known blocks, and the windows at their ends that are to be looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, open_ = _lists(batch.column("known")), _lists(batch.column("open"))
            inside, asked, places = [], [], []
            for first, held in _pieces(_unpacked(batch.column("zip"))):
                b = Blocks(held, width)
                bounds = np.searchsorted(b.owner, np.arange(len(held) + 1))
                windows = np.searchsorted(b.text, np.arange(len(held) + 1))
                for k in range(len(held)):
                    i, mine = first + k, slice(bounds[k], bounds[k + 1])
                    block, runs = b.block[mine], b.last[mine] - b.first[mine] + 1
                    is_known = _among(block, known[i])
                    is_open = np.repeat(_among(block, open_[i]) & ~is_known, runs)
                    begin = b.window[windows[k] : windows[k + 1]] - b.starts[k]
                    inside.append(begin[np.repeat(is_known, runs)].astype(np.int32))
                    asked.append(b.hash[windows[k] : windows[k + 1]][is_open].view(np.int64))
                    places.append(begin[is_open].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"),
                    batch.column("mark"),
                    pa.array(inside, pa.list_(pa.int32())),
                    pa.array(asked, pa.list_(pa.int64())),
                    pa.array(places, pa.list_(pa.int32())),
                ],
                names=["doc", "mark", "known", "asked", "at"],
            )

    return run


_FACTORS = "doc long, mark long, starts array<int>, lengths array<int>"


def _join_factors(width: int):
    """Factors of each text, from the windows inside known blocks and those found one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, lengths = [], []
            rows = zip(batch.column("known"), batch.column("asked"), batch.column("at"), _lists(batch.column("found")), strict=True)
            for known, asked, at, mine in rows:
                keys = asked.values.to_numpy(zero_copy_only=False).view(np.uint64)
                places = at.values.to_numpy(zero_copy_only=False)[_among(keys, mine)]
                first, size = factors(np.union1d(known.values.to_numpy(zero_copy_only=False), places).astype(np.int32), width)
                starts.append(first)
                lengths.append(size)
            found = [batch.column("doc"), batch.column("mark"), *(pa.array(v, pa.list_(pa.int32())) for v in (starts, lengths))]
            whole = pa.RecordBatch.from_arrays(found, names=["doc", "mark", "starts", "lengths"])
            yield whole.filter(pa.array([len(v) > 0 for v in starts], pa.bool_()))

    return run


def _keyed(id: str, text: str) -> list[Column]:
    """Id as a long, its largest value for null, and a hash that tells texts of the same id apart."""
    return [F.coalesce(F.col(id).cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(F.col(text)).alias("mark")]


def repeated_factors(docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Rows ``doc, mark, starts, lengths``: the factors of each text, in words, that smaller documents hold.

    A factor is a maximal run of words each of which lies under a window of ``width`` words that also starts in a document with
    a smaller id. ``doc`` is the id as a long, its largest value for null; ``mark`` is the text's hash. Texts without a factor
    have no row, rows that repeat have one.
    """
    texts = docs.where(F.col(text).isNotNull()).select(*_keyed(id, text), F.col(text).alias("text"))
    marked = _lookups(texts.select("doc", "text").mapInArrow(tidy(_index_rows(width)), _INDEX))
    # texts move compressed, and what is written has places and hashes only
    parsed = staged(_packed(texts).join(marked, "doc").mapInArrow(tidy(_parse(width)), _PARSED), "parsed")
    windows = parsed.select("doc", F.explode(F.array_distinct("asked")).alias("window"))
    least = windows.groupBy("window").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    found = (
        windows.join(least.where("least < most"), "window")
        .where("doc > least")
        .groupBy("doc")
        .agg(F.collect_set("window").alias("found"))
    )
    joined = parsed.join(found, "doc", "left").mapInArrow(tidy(_join_factors(width)), _FACTORS)
    return joined.groupBy("doc", "mark").agg(F.any_value("starts").alias("starts"), F.any_value("lengths").alias("lengths"))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the factors out of the texts."""
    for batch in batches:
        texts, starts, lengths = (_unpacked(batch.column("zip")), *(batch.column(n).to_pylist() for n in ("starts", "lengths")))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row"),
                pa.array([t if not s else cut(t, s, n) for t, s, n in zip(texts, starts, lengths, strict=True)], pa.string()),
                pa.array([len((t or "").encode().split()) for t in texts], pa.int64()),
                pa.array([sum(n or ()) for n in lengths], pa.int64()),
            ],
            names=["row", "text", "n_words", "n_removed"],
        )


def remove_repeated_passages(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = WIDTH
) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, and ``n_words, n_removed`` (long).

    Every word under a window of ``width`` words is removed if the window also starts in a document with a
    smaller integer id; windows are those of the input. A null id is larger than any other and no
    smaller than itself; rows with equal ids do not repeat each other. Null texts stay null with 0 words; texts
    shorter than a window stay as they are. All rows and columns are returned, except that input columns
    named ``n_words`` or ``n_removed`` are replaced.
    """
    plain = without(docs, "n_words", "n_removed")
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(plain.columns) if c != text]
    rows = plain.select(F.struct(*rest).alias("row"), *_keyed(id, text), F.col(text).alias("text"))
    found = repeated_factors(docs, id=id, text=text, width=width)
    joined = _packed(rows).join(found, ["doc", "mark"], "left").select("row", "zip", "starts", "lengths")
    kinds = [rows.schema["row"], *T._parse_datatype_string("text string, n_words long, n_removed long")]
    done = joined.mapInArrow(tidy(_finish), T.StructType(kinds))
    columns = [F.col("text").alias(c) if c == text else F.col(f"row.c{i}").alias(c) for i, c in enumerate(plain.columns)]
    return done.select(*columns, "n_words", "n_removed")


def _lookups(index: DataFrame) -> DataFrame:
    """For each document the blocks that a smaller one holds, and those whose windows are to be looked up."""
    block, anchor = Window.partitionBy("anchor", "block"), Window.partitionBy("anchor")
    placed = (
        index.repartition("anchor")
        .withColumn("least", F.min("doc").over(block))
        .withColumn("several", F.min("block").over(anchor) != F.max("block").over(anchor))
    )
    known = (F.col("kind") == KNOWN) | (F.col("kind").isin(NORMAL, SPREAD) & (F.col("doc") > F.col("least")))
    opened = F.col("kind").isin(NORMAL, SPREAD) & ((F.col("kind") == SPREAD) | F.col("several"))
    told = placed.select(
        "doc",
        F.when(known, F.col("block")).alias("known"),
        F.when(~known & opened, F.col("block")).alias("open"),
    ).where("known is not null or open is not null")
    return told.groupBy("doc").agg(
        F.collect_list("known").alias("known"), F.collect_list("open").alias("open")
    )
