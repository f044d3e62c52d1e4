"""The table of files in buckets, so that a batch rewrites only the buckets it touches.

Layout: ``<folder>/buckets-<n>/batch=<b>/bucket=<k>/``. A bucket folder of a batch holds all files of that bucket after
the batch; the current state of a bucket is its folder in the newest finished batch that has one. Nothing is overwritten in
place: a batch that dies leaves the state before it, and is written anew when it is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from .store import file_id_of

_COLUMNS = [f.name for f in schemas.FILES.fields]


def bucket_of(file_id: Column, buckets: int) -> Column:
    """Bucket of a file: the first 32 bits of its id (a hash) modulo the number of buckets."""
    return (F.conv(F.substring(file_id, 1, 8), 16, 10).cast("long") % buckets).cast("int")


def _hadoop(spark: SparkSession, folder: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _children(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers of the folders ``<prefix><number>`` below a folder."""
    at, system = _hadoop(spark, folder)
    if not system.exists(at):
        return []
    names = [s.getPath().getName() for s in system.listStatus(at)]
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


def _root(spark: SparkSession, folder: str, buckets: int | None) -> tuple[str, int] | None:
    """Root and number of buckets of the table; None where there is none and no number is given."""
    have = _children(spark, folder, "buckets-")
    if have and buckets is not None and have != [buckets]:
        raise ValueError(f"{folder} has {have[0]} buckets, not {buckets}")
    n = have[0] if have else buckets
    return None if n is None else (f"{folder}/buckets-{n}", n)


def finished_batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that were written to their end."""
    root = _root(spark, folder, None)
    if root is None:
        return []
    at, system = _hadoop(spark, root[0])
    path = spark._jvm.org.apache.hadoop.fs.Path
    return [b for b in _children(spark, root[0], "batch=") if system.exists(path(f"{root[0]}/batch={b}/_SUCCESS"))]


def bucket_versions(spark: SparkSession, folder: str) -> dict[int, int]:
    """The batch that holds the current state of each bucket: one entry per bucket, read from folder names."""
    root = _root(spark, folder, None)
    newest: dict[int, int] = {}
    for b in finished_batches(spark, folder):
        newest.update(dict.fromkeys(_children(spark, f"{root[0]}/batch={b}", "bucket="), b))
    return newest


def read_files(spark: SparkSession, folder: str, buckets: list[int] | None = None, *, versions: bool = False) -> DataFrame:
    """The current files, of all or the given buckets; ``versions`` adds ``bucket`` and ``batch``, the batch that wrote it.

    A table that has no batch yet gives no rows.
    """
    newest = bucket_versions(spark, folder)
    wanted = {k: b for k, b in newest.items() if buckets is None or k in set(buckets)}
    extra = ["bucket", "batch"] if versions else []
    if not wanted:
        empty = spark.createDataFrame([], schemas.FILES)
        return empty.withColumns({c: F.lit(None).cast("long" if c == "batch" else "int") for c in extra})
    root, _ = _root(spark, folder, None)
    paths = [f"{root}/batch={b}/bucket={k}" for k, b in sorted(wanted.items())]
    schema = T.StructType([*schemas.FILES.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
    rows = spark.read.schema(schema).option("basePath", root).parquet(*paths)
    return rows.select(*_COLUMNS, *extra)


def _changes(seen: DataFrame | None, flags: DataFrame | None) -> DataFrame:
    """One row per changed file: its newest observation and its flags.

    Combined before the shuffle, so a path that most of the batch is about is one row per task.
    """
    parts = []
    if seen is not None:
        parts.append(
            seen.filter("path is not null").select(
                file_id_of(F.col("path")).alias("file_id"), "path",
                F.struct(
                    F.col("seen_at").cast("long").alias("at"), F.col("mtime").cast("long").alias("mtime"),
                    F.col("size").cast("long").alias("size"),
                ).alias("_n"),
                F.lit(None).cast("boolean").alias("ignored"), F.lit(None).cast("boolean").alias("deleted"),
            )
        )
    if flags is not None:
        flag = {c: F.col(c) if c in flags.columns else F.lit(None) for c in ("ignored", "deleted")}
        parts.append(
            flags.filter("file_id is not null").select(
                F.col("file_id").cast("string").alias("file_id"), F.lit(None).cast("string").alias("path"),
                F.lit(None).cast("struct<at:bigint,mtime:bigint,size:bigint>").alias("_n"),
                *[e.cast("boolean").alias(c) for c, e in flag.items()],
            )
        )
    if not parts:
        raise ValueError("give observations, flags or both")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.groupBy("file_id").agg(
        F.max("path").alias("path"),
        F.max("_n").alias("_n"),
        F.min("_n.at").alias("_first"),
        F.max("ignored").alias("ignored"),
        F.max("deleted").alias("deleted"),
    )


def update_files(
    spark: SparkSession,
    folder: str,
    batch: int,
    *,
    seen: DataFrame | None = None,
    flags: DataFrame | None = None,
    buckets: int | None = None,
) -> list[int]:
    """Apply one batch to the table and return the buckets it rewrote; the other buckets are neither read nor written.

    ``seen(path, size, mtime, seen_at)`` are observations: known files get the size, the time and the last sighting of the
    newest one (equal sightings: the larger time, then size; a null keeps the old value), new paths are added. ``flags(file_id,
    ignored, deleted)`` set flags, either column may be absent or null; of several rows of a file, true wins. Flags of files
    that are not in the table and not seen in the batch change nothing; a null path or id is left out.

    Batches come in rising order. One that is not above the newest finished batch was applied before and changes nothing, so it
    may be called from ``foreachBatch`` as it is. ``buckets`` is fixed by the first batch (256 unless given); a bucket is
    worked on by one task, so choose it for some hundred MB a bucket.
    """
    done = finished_batches(spark, folder)
    if done and batch <= done[-1]:
        return []
    root, n = _root(spark, folder, buckets) or (f"{folder}/buckets-256", 256)
    staged = f"{folder}/_changes/batch={batch}"
    _changes(seen, flags).withColumn("bucket", bucket_of(F.col("file_id"), n)).write.mode("overwrite").parquet(staged)
    changes = spark.read.parquet(staged)  # read twice, computed once
    touched = sorted(r["bucket"] for r in changes.select("bucket").distinct().collect())  # at most n numbers
    news = changes.select(
        "bucket", "file_id", F.lit(None).cast(schemas.FILES).alias("_f"),
        F.struct("path", "_n", "_first", "ignored", "deleted").alias("_c"),
    )
    old = read_files(spark, folder, touched)
    state = old.select(
        bucket_of(F.col("file_id"), n).alias("bucket"), "file_id", F.struct(*_COLUMNS).alias("_f"),
        F.lit(None).cast(news.schema["_c"].dataType).alias("_c"),
    )
    # one shuffle, by bucket: the grouping and the write both use it
    both = state.unionByName(news).repartition("bucket").groupBy("bucket", "file_id").agg(
        F.first("_f", ignorenulls=True).alias("f"), F.first("_c", ignorenulls=True).alias("c")
    )
    after = both.filter(F.col("f").isNotNull() | F.col("c.path").isNotNull()).select(
        "file_id",
        F.coalesce("f.path", "c.path").alias("path"),
        F.coalesce("c._n.size", "f.size").alias("size"),
        F.coalesce("c._n.mtime", "f.mtime").alias("mtime"),
        F.coalesce("f.first_seen_at", "c._first").alias("first_seen_at"),
        F.coalesce("c._n.at", "f.last_seen_at").alias("last_seen_at"),
        F.coalesce("c.ignored", "f.ignored", F.lit(False)).alias("ignored"),
        (F.coalesce("c.deleted", F.lit(False)) | F.coalesce("f.deleted", F.lit(False))).alias("deleted"),
        "bucket",
    )
    after.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/batch={batch}")
    at, system = _hadoop(spark, staged)
    system.delete(at, True)
    return touched


def drop_old_versions(spark: SparkSession, folder: str, before: int) -> int:
    """Remove bucket folders that a finished batch up to ``before`` has replaced, and return their number.

    Readers that began before batch ``before`` may still need older folders, so keep it behind the newest batch by as
    many batches as a reader may last. The current state, and the newest batch, always stay.
    """
    root = _root(spark, folder, None)
    if root is None:
        return 0
    batches = finished_batches(spark, folder)
    later: dict[int, int] = {}
    removed = 0
    for b in reversed(batches):
        kept = 0
        for k in _children(spark, f"{root[0]}/batch={b}", "bucket="):
            if later.get(k, before + 1) <= before:
                at, system = _hadoop(spark, f"{root[0]}/batch={b}/bucket={k}")
                system.delete(at, True)
                removed += 1
            else:
                kept += 1
                if b <= before:
                    later.setdefault(k, b)
        if not kept and b != batches[-1]:
            at, system = _hadoop(spark, f"{root[0]}/batch={b}")
            system.delete(at, True)
    return removed
