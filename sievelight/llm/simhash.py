"""Near-duplicates by SimHash, found with multi-index hashing.

A fingerprint's segments are its two halves. Each fingerprint enumerates the Hamming ball of radius one
inside each segment and is entered under the values so reached, together with the other
segment. Two fingerprints with at most two differing bits meet in at least one entry: there, each
has at most one bit changed. Since the key holds the whole value, an entry has at most 65
different fingerprints however large a group of copies is, so no bucket grows with the data and no
pairs of a group are made: the members of an entry are tied to its smallest one, after a check of
the complete distance. Keys on a segment alone would put all copies of a page into one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, tidy, unused
from .components import components

_SEGMENT = 32
_OFTEN = 1000


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text, as a signed number.

    A-Z are lower-cased, words split at ASCII white space; the shingles are ``width`` words joined
    by a space, repeats included. Shorter texts have one shingle, texts without words fingerprint 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(body, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *(ends[: len(words) - width]).tolist()]
        stops = (ends[width - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(body[a:b], seed) for a, b in zip(starts, stops, strict=True)]
    values = np.array(hashes, dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(values), 1 << 16):  # bits of a long text are counted in pieces
        part = values[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(values))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """Rows ``id, fp`` (signed long) of every row of ``docs``."""
    schema = T.StructType([docs.select(F.col(id)).schema[0], T.StructField("fp", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values, pa.int64())], names=[batch.schema.names[0], "fp"]
            )

    return docs.select(F.col(id), F.col(text)).mapInArrow(tidy(run), schema)


def linked(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links ``a, b`` that connect all values ``fp`` with at most ``max_bits`` (0 to 2) differing bits.

    ``fps`` has distinct values. Not every pair becomes a link, but any two values in reach are connected.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits is 0, 1 or 2")
    balls = [1 << (s + i) for s in (0, _SEGMENT) for i in range(_SEGMENT)] if max_bits else []
    flips = F.array(*[F.lit(b - (1 << 64) if b >> 63 else b) for b in (0, *balls)])
    entered = fps.select("fp", F.explode(flips).alias("flip")).select(
        F.col("fp").bitwiseXOR(F.col("flip")).alias("key"), "flip"
    )
    # an entry is its key and the set of bits by which its members differ from it
    entries = entered.groupBy("key").agg(
        F.bit_or("flip").alias("flips"), F.max(F.col("flip") == 0).alias("itself")
    )
    full = entries.where((F.bit_count("flips") + F.col("itself").cast("int")) > 1)
    if max_bits == 1:
        full = full.where("itself")
    others = F.expr("transform(filter(sequence(0, 63), i -> getbit(flips, i) = 1), i -> key ^ shiftleft(1L, i))")
    members = F.concat(F.when(F.col("itself"), F.array("key")).otherwise(F.expr("array()")), others)
    pairs = full.select(members.alias("m")).select(
        F.col("m")[0].alias("a"), F.explode(F.slice("m", F.lit(2), F.size("m") - 1)).alias("b")
    )
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)


def near_duplicates(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = 3, max_bits: int = 2
) -> DataFrame:
    """Rows ``id, fp, component``: the smallest id that can be reached over links, for every row.

    Equal fingerprints count once, with their smallest id, so a group of copies costs one
    row. Null texts count as empty; empty texts have fingerprint 0 and are linked like any other. Rows
    with a null id get the smallest id that is not null, or null if their group has none. Rows that
    repeat are all returned. Other columns are not read, whatever their names.
    """
    fps = staged(fingerprints(docs, id=id, text=text, width=width), "fingerprints", narrow=True)
    groups = staged(classes(fps, id, max_bits), "fingerprint-classes", narrow=True)
    # a fingerprint with a thousandth of all rows or more, of which there are a thousand at most, is looked up in place
    every = groups.agg(F.sum("n")).first()[0] or 0
    often = groups.where(F.col("n") * _OFTEN >= every).select("fp", F.struct("component").alias("known"))
    seen = fps.join(F.broadcast(often), "fp", "left")
    rare = seen.where("known is null").select(id, "fp").join(groups.select("fp", "component"), "fp")
    common = seen.where("known is not null").select(id, "fp", "known.component")
    return common.unionByName(rare.select(id, "fp", "component"))


def classes(fps: DataFrame, id: str, max_bits: int) -> DataFrame:
    """Rows ``fp, component, n`` of the distinct fingerprints, ``n`` the number of rows that have it."""
    counted = fps.groupBy("fp").agg(F.min(id).alias("first"), F.count(F.lit(1)).alias("n"))
    distinct = staged(counted, "distinct-fingerprints", narrow=True)
    roots = components(linked(distinct, max_bits))
    # the root of a component is in no row of its own
    every = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    grouped = every.join(distinct, every.node == distinct.fp).select("fp", "root", "first")
    least = grouped.groupBy("root").agg(F.min("first").alias("component"))
    placed = grouped.join(least, "root").select("fp", "component")
    return distinct.join(placed, "fp", "left").select(
        "fp", F.coalesce("component", "first").alias("component"), "n"
    )


def first_of_each(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = 3, max_bits: int = 2
) -> DataFrame:
    """``docs`` with one row of each group left: that of the smallest id.

    Rows that share this id are told apart by a hash of id and text, and the smallest one stays.
    """
    key, mark = unused(docs, "_key"), unused(docs, "_hash")
    hashed = F.xxhash64(F.col(id), F.col(text))
    keyed = docs.select(F.struct(F.col(id).alias("i"), hashed.alias("h")).alias(key), F.col(text))
    fps = fingerprints(keyed, id=key, text=text, width=width)
    rows = staged(fps.select("fp", f"{key}.i", f"{key}.h"), "fingerprints", narrow=True)
    groups = classes(rows.select(F.col("i").alias("id"), "fp"), "id", max_bits)
    group = F.coalesce(F.col("component").cast("string"), F.concat(F.lit("fp"), "fp"))
    order = F.struct(F.col("i").isNull(), "i", "h")
    least = rows.groupBy("fp").agg(F.min(order).alias("k"))  # one row for each fingerprint, however many copies
    firsts = least.join(groups, "fp").groupBy(group).agg(F.min("k").alias("k"))
    # id and hash in one column, so that documents whose hashes happen to agree stay apart and texts move once
    name = lambda i, h: F.concat(h.cast("string"), F.lit(":"), F.coalesce(i.cast("string"), F.lit("")))
    kept = firsts.select(name(F.col("k.i"), F.col("k.h")).alias(mark)).distinct()
    mine = docs.withColumn(mark, name(F.col(id), hashed))
    return mine.join(kept, mark, "left_semi").dropDuplicates([mark]).select(*docs.columns)
