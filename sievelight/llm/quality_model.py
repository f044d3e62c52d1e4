"""Quality classifier by importance resampling.

Two generative models of hashed word n-grams are counted, one of target texts (labelled good) and one of
all raw texts. The weight of a document is the likelihood ratio of the two; adding Gumbel noise to its
logarithm and keeping the ``k`` largest draws without replacement in proportion to the weights. The documents that are not
drawn are rejected. ``k`` is given as a share, or counted with labels: the number of documents whose key is at
least that of all but a thousandth of the good ones among labelled documents that the model has not seen. The draw is the same: the
k-th largest key of all is found by counting digits, and what lies below it goes.

The target model and the key are fit on a bounded sample of labelled rows; raw counts, weights and the k-th largest key
cover all documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, tidy, unit_noise, unused
from .substrings import mixed

BUCKETS = 1 << 16
#: Bound on the labelled rows that the target model and the share are fit on.
SAMPLE = 20_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_SCALE = 1 << 20  # keys are compared as multiples of 2^-20


def ngram_buckets(text: str | None) -> np.ndarray:
    """Buckets of the words, marks and pairs of neighbours of a text."""
    tokens = _TOKEN.findall(text or "")
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), dtype=np.uint64, count=len(tokens))
    pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]
    return (np.concatenate([words, mixed(pairs)]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for text, is_target in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            found = np.bincount(ngram_buckets(text.as_py()), minlength=BUCKETS)
            raw += found
            if is_target:
                target += found
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(target[used])],
        names=["bucket", "raw", "target"],
    )


def log_ratios(docs: DataFrame, sample: DataFrame, *, id: str, text: str, prior: float = 2.0) -> np.ndarray:
    """Log of the ratio of the two models for each bucket.

    The raw model is the prior of the target model: a bucket of ``t`` target n-grams, where the raw
    model expects ``e``, has the ratio (t + prior) / (e + prior), so what is rare says little.
    ``sample`` has at most ``SAMPLE`` rows ``id, quality, toxic``, so it is sent to every task; the
    model has one number for each bucket, whatever the size of the input.
    """
    good = sample.where("quality = 1 and coalesce(toxic, 0) = 0").select(id, F.lit(True).alias("_target"))
    rows = docs.select(id, text).join(F.broadcast(good), id, "left")
    counted = rows.select(text, F.coalesce("_target", F.lit(False)).alias("_target")).mapInArrow(
        tidy(_count), "bucket int, raw long, target long"
    )
    sums = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in sums.collect():
        raw[row["bucket"]] = row["raw"]
        target[row["bucket"]] = row["target"]
    share = raw / max(raw.sum(), 1.0)
    ratio = (target + prior) / (target.sum() * share + prior)
    return np.log(ratio) - np.log(max((share * ratio).sum(), 1e-300))


def with_log_weights(docs: DataFrame, ratios: np.ndarray, *, text: str, name: str = "log_weight") -> DataFrame:
    """``docs`` with their log weights in a new column ``name``; texts without words and marks weigh 1."""
    model = docs.sparkSession.sparkContext.broadcast(ratios)
    schema = T.StructType([*docs.schema, T.StructField(name, T.DoubleType(), False)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in batches:
            weights = [float(table[ngram_buckets(t.as_py())].sum()) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weights, pa.float64())], names=names)

    return docs.mapInArrow(tidy(run), schema)


def noise(id: str, seed: int) -> Column:
    """Gumbel noise fixed by the id."""
    return -F.log(-F.log(unit_noise(F.col(id), F.lit(seed))))


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The ``k``-th largest value of a long column, exactly; null if there are fewer.

    Four passes count the values by 16 bits at a time, so the driver sees at most 65,536
    counts in each and no task sorts.
    """
    place = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))
    left, prefix = k, 0
    for step in range(4):
        shift = 48 - 16 * step
        here = df if step == 0 else df.where(F.shiftrightunsigned(place, shift + 16) == prefix)
        digit = F.shiftrightunsigned(place, shift).bitwiseAND(F.lit(0xFFFF)).alias("d")
        counts = here.groupBy(digit).count().collect()
        for d, n in sorted(((r["d"], r["count"]) for r in counts), reverse=True):
            if n >= left:
                prefix = prefix << 16 | d
                break
            left -= n
        else:
            return None
    return prefix - (1 << 63)


def count_to_keep(keyed: DataFrame, held: DataFrame, id: str, spare: float) -> int | None:
    """How many documents to draw: those whose order is at least that of all but a share ``spare`` of the good held-out rows.

    Null without labels of both kinds: everything is kept.
    """
    seen = keyed.select(F.col(id).alias("_id"), "order").join(F.broadcast(held), F.col("_id") == F.col(id))
    good = seen.where("quality = 1").select("order")
    n_good, n_seen = good.count(), seen.count()
    if not n_good or n_good == n_seen:
        return None
    least = kth_largest(good, "order", n_good - int(spare * n_good))
    return keyed.where(F.col("order") >= least).count()


def resample(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    share: float | None = None,
    spare: float = 0.001,
    sample: int = SAMPLE,
    seed: int = 23,
) -> DataFrame:
    """Rows ``id, log_weight, key, kept`` of every row of ``docs``.

    ``labels`` has ``id, quality, toxic``; null qualities are left out, of repeated labels the worst
    holds. ``share`` of the rows is drawn; by default, as many as have keys that
    all but ``spare`` of the good labelled rows reach. Null texts
    count as empty; rows with the same id share their noise; rows with the key of the last one drawn are
    all kept. An empty table gives an empty result. Without labels all weights are 1 and everything is
    kept. Other columns are not read.
    """
    keyed, _, kept = _drawn(docs, labels, id, text, share, spare, sample, seed)
    return keyed.select(id, "log_weight", "key", kept(F.col("key")).alias("kept"))


def accepted(
    docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", seed: int = 23
) -> DataFrame:
    """``docs`` without the rejected rows.

    Texts are weighed a second time once the cutoff is known: neither do they move nor are they written.
    """
    _, ratios, kept = _drawn(docs, labels, id, text, None, 0.001, SAMPLE, seed)
    weight = unused(docs, "log_weight")
    weighed = with_log_weights(docs, ratios, text=text, name=weight)
    return weighed.where(kept(F.col(weight) + noise(id, seed))).select(*docs.columns)


def _drawn(
    docs: DataFrame, labels: DataFrame, id: str, text: str, share: float | None, spare: float, sample: int, seed: int
) -> tuple[DataFrame, np.ndarray, Callable[[Column], Column]]:
    """Weights and keys of all rows, written to the shared folder, the model, and whether a key is kept."""
    known = (
        labels.where(F.col("quality").isNotNull() & F.col(id).isNotNull())
        .groupBy(id)
        .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64(id, F.lit(seed)), id)
        .limit(sample)
    )
    # one half of the sample makes the model, the other tells where to cut, so texts it has not seen are safe
    halves = known.withColumn("_fit", F.pmod(F.xxhash64(id, F.lit(seed + 1)), F.lit(2)) == 0)
    labelled = staged(halves, "label-sample")
    chosen, held = labelled.where("_fit"), labelled.where("not _fit")
    any_good = bool(chosen.where("quality = 1 and coalesce(toxic, 0) = 0").take(1))
    ratios = log_ratios(docs, chosen, id=id, text=text) if any_good else np.zeros(BUCKETS)
    texts = docs.select(F.col(id), F.col(text).alias("_text"))
    weighed = with_log_weights(texts, ratios, text="_text").drop("_text")
    keyed = staged(weighed.withColumn("key", F.col("log_weight") + noise(id, seed)), "keys", narrow=True)
    ordered = keyed.withColumn("order", _order(F.col("key")))
    k = count_to_keep(ordered, held, id, spare) if share is None else round(share * keyed.count())
    if k is None:
        return keyed, ratios, lambda key: F.lit(True)
    last = kth_largest(ordered, "order", k) if k else None
    return keyed, ratios, lambda key: F.lit(False) if last is None else _order(key) >= last


def _order(key: Column) -> Column:
    """Keys as longs in their order."""
    return F.floor(key * _SCALE).cast("long")
