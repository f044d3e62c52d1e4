"""Language identification by the nearest of several centroids per language.

A text is a vector of byte n-grams in hashed buckets, weighted by TF-IDF and scaled to length 1. Document frequencies are
counted over all texts that are learned from. The vectors of a bounded sample of each language are clustered by their cosine;
half of the sample makes the centroids, the other half tells how far from its centroid a text of the language may lie. A text gets the language
of the centroid with the largest cosine, and is rejected if it lies farther from that centroid than its radius.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import staged, tidy, unit_noise

BUCKETS = 1 << 15
#: Bound on the rows of a language that its centroids and radii are fit on.
SAMPLE = 1_000
#: Bound on the number of languages, for each of which a task holds its centroids.
LANGUAGES = 200
_ORDERS = (2, 3, 4)  # bytes of an n-gram
_CHUNK = 1 << 20  # bytes of a text whose n-grams are held at once
_ASCII = re.compile("[A-Za-z]")
# whatever is no letter is a space; bytes from 128 on belong to other characters and stay
_SPACED = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def has_letters(text: str | None) -> bool:
    return bool(text) and (_ASCII.search(text) is not None or any(map(str.isalpha, text)))


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of a text, sorted, and how often each occurs."""
    body = b" " + b" ".join(text.lower().encode().translate(_SPACED).split()) + b" "
    total = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(body), _CHUNK):
        codes = np.frombuffer(body, dtype=np.uint8, offset=at, count=min(len(body) - at, _CHUNK + max(_ORDERS) - 1))
        grams = codes.astype(np.uint32)
        for order in range(2, max(_ORDERS) + 1):
            grams = grams[:-1] << np.uint32(8) | codes[order - 1 :]
            starts = grams[:_CHUNK]  # those from there on belong to the next chunk
            mixed = (starts + np.uint32(order * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            total += np.bincount(mixed >> np.uint32(17), minlength=BUCKETS)
    used = np.flatnonzero(total)
    return used, total[used]


def weighted(used: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of the buckets, as a vector of length 1."""
    w = (1 + np.log(times)) * idf[used]
    return w / np.sqrt((w * w).sum())


@dataclass(frozen=True)
class Model:
    """Centroids by language, ready to be compared."""

    languages: list[str]  # of each centroid
    centroids: np.ndarray  # one column each
    radii: np.ndarray  # smallest cosine that is not rejected
    idf: np.ndarray

    def nearest(self, text: str) -> tuple[str, float, bool]:
        """Language, cosine, and whether the text lies too far away; ties go to the first language."""
        used, times = ngrams(text)
        cosines = (weighted(used, times, self.idf)[:, None] * self.centroids[used]).sum(axis=0)
        best = int(np.argmax(cosines))
        score = min(max(float(cosines[best]), 0.0), 1.0)
        return self.languages[best], score, score < self.radii[best]


def clusters(vectors: np.ndarray, k: int, rounds: int = 10, least: float = 0.05) -> np.ndarray:
    """At most ``k`` centroids of length 1 of some vectors of length 1, by cosine; the same for the same rows.

    A cluster with less than a share ``least`` of the rows is odd texts or wrong labels: its centroid goes, the largest stays.
    """
    centroids = vectors[:0]
    nearest = np.full(len(vectors), -np.inf)
    start = vectors @ vectors.mean(axis=0)  # the most typical row, then the one farthest from those chosen
    for i in range(k):
        at = int(np.argmax(start)) if i == 0 else int(np.argmin(nearest))
        if nearest[at] > 1 - 1e-9:
            break
        centroids = np.vstack([centroids, vectors[at]])
        nearest = np.maximum(nearest, vectors @ vectors[at])
    for _ in range(rounds):
        own = np.argmax(vectors @ centroids.T, axis=1)
        sizes = np.bincount(own, minlength=len(centroids))
        enough = min(least * len(vectors), sizes.max())
        sums = np.stack([vectors[own == c].sum(axis=0) for c in np.flatnonzero(sizes >= max(enough, 1))])
        new = sums / np.linalg.norm(sums, axis=1, keepdims=True)
        if new.shape == centroids.shape and np.array_equal(new, centroids):
            break
        centroids = new
    return centroids


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of a task each bucket occurs; the last row is the number of texts."""
    df, texts = np.zeros(BUCKETS, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            if has_letters(text.as_py()):
                df[ngrams(text.as_py())[0]] += 1
                texts += 1
    used = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays(
        [pa.array([*used.tolist(), BUCKETS], pa.int32()), pa.array([*df[used].tolist(), texts], pa.int64())],
        names=["bucket", "texts"],
    )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [ngrams(t.as_py()) if has_letters(t.as_py()) else None for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("lang"),
                batch.column("noise"),
                pa.array([f and f[0].astype(np.int32).tobytes() for f in found], pa.binary()),
                pa.array([f and f[1].tobytes() for f in found], pa.binary()),
            ],
            names=["lang", "noise", "used", "times"],
        )


def _fit(idf: np.ndarray, k: int, quantile: float):
    """Centroids and radii of one language."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["noise"], r["used"], r["times"]))
        vectors = np.zeros((len(rows), BUCKETS), dtype=np.float32)
        for i, r in enumerate(rows):
            used = np.frombuffer(r["used"], dtype=np.int32)
            vectors[i, used] = weighted(used, np.frombuffer(r["times"], dtype=np.int64), idf)
        centroids = clusters(vectors[::2], k)
        held = vectors[1::2] @ centroids.T
        own, cosines = np.argmax(held, axis=1), held.max(axis=1, initial=-1.0)
        radii = [
            float(np.quantile(cosines[own == c], quantile, method="lower")) if (own == c).any() else 0.0
            for c in range(len(centroids))
        ]
        return pa.table(
            {
                "lang": pa.array([rows[0]["lang"]] * len(radii), pa.string()),
                "centroid": pa.array(range(len(radii)), pa.int32()),
                "weights": pa.array([c.astype(np.float32).tobytes() for c in centroids], pa.binary()),
                "radius": pa.array(radii, pa.float64()),
            }
        )

    return run


def learn(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    id: str = "doc_id",
    centroids: int = 4,
    quantile: float = 0.01,
    sample: int = SAMPLE,
    languages: int = LANGUAGES,
    seed: int = 31,
) -> Model | None:
    """Centroids of the languages of ``docs``; none if there is no text with letters and a language.

    Rows without a language or without letters are left out. Document frequencies are counted over all other rows; of each
    language at most ``sample`` rows, chosen by a hash of id and text, make up to ``centroids`` centroids and their
    radii, which leave out a share ``quantile`` of its texts. More than ``languages`` languages are an error.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), unit_noise(F.col(id), F.col(text), F.lit(seed)).alias("noise")
    )
    sizes = rows.groupBy("lang").count().limit(languages + 1).collect()
    if len(sizes) > languages:
        raise ValueError(f"more than {languages} languages")
    counted = rows.select("text").mapInArrow(tidy(_count), "bucket int, texts long")
    df = np.zeros(BUCKETS + 1)
    for r in counted.groupBy("bucket").agg(F.sum("texts").alias("texts")).collect():
        df[r["bucket"]] = r["texts"]
    if not df[BUCKETS]:
        return None
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1
    # a hash below this share leaves somewhat more rows than needed, of which the smallest are taken
    shares = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], min(1.0, 2.0 * sample / r["count"]))])
    thinned = rows.where(F.col("noise") <= F.element_at(shares, F.col("lang")))
    features = staged(
        thinned.mapInArrow(tidy(_features), "lang string, noise double, used binary, times binary").where("used is not null"),
        "language-sample",
    )
    order = Window.partitionBy("lang").orderBy("noise", "used", "times")
    chosen = features.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample).drop("_n")
    fitted = chosen.groupBy("lang").applyInArrow(
        _fit(idf, centroids, quantile), "lang string, centroid int, weights binary, radius double"
    )
    found = sorted(fitted.collect(), key=lambda r: (r["lang"], r["centroid"]))
    return Model(
        [r["lang"] for r in found],
        np.ascontiguousarray(np.stack([np.frombuffer(r["weights"], dtype=np.float32) for r in found], axis=1)),
        np.array([r["radius"] for r in found]),
        idf,
    )


def predict(docs: DataFrame, model: Model | None, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``id, lang_pred, score, rejected`` of every row of ``docs``.

    ``lang_pred`` is the language of the nearest centroid, ``score`` the cosine with it, ``rejected`` whether the text lies
    outside its radius. Null texts, texts without letters, and all texts without a model, get ``und``, score 0 and are not rejected.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(F.col(id)).schema[0]
    schema = T.StructType([kind, *T._parse_datatype_string("lang_pred string, score double, rejected boolean")])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = []
            for value in batch.column(1):
                body = value.as_py()
                found.append(model.nearest(body) if model and has_letters(body) else ("und", 0.0, False))
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()),
                    pa.array(columns[2], pa.bool_()),
                ],
                names=names,
            )

    return docs.select(F.col(id), F.col(text)).mapInArrow(tidy(run), schema)


def held_out(id: Column) -> Column:
    """Is the row kept out of learning: the CRC-32 of the id as text leaves 2 when divided by 4. A null id is not."""
    return F.coalesce(F.crc32(id.cast("string")) % 4 == 2, F.lit(False))


def identify(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang", **options
) -> DataFrame:
    """Rows ``id, held_out, lang_pred, score, rejected`` of every row of ``docs``.

    Learns from the rows that are not held out (see ``learn`` for ``options``) and predicts all rows by their whole texts alone.
    Rows that repeat are all returned; an empty table gives an empty result. Other columns are not read, whatever their names.
    """
    keyed = docs.select(
        F.struct(F.col(id).alias("id"), held_out(F.col(id)).alias("held_out")).alias("key"),
        F.col(text).alias("text"), F.col(lang).alias("lang"),
    )
    model = learn(keyed.where("not key.held_out"), id="key", **options)
    done = predict(keyed, model, id="key")
    return done.select(F.col("key.id").alias(id), "key.held_out", "lang_pred", "score", "rejected")
