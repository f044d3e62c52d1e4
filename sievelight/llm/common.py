"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.plans.session import checkpoint_dir

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def staged(df: DataFrame, label: str, *, narrow: bool = False) -> DataFrame:
    """Write a frame once to the shared folder and go on from the files.

    ``narrow`` rows, a few numbers each, are dealt to as many files as there are cores first: one small file for
    each task of a large scan costs more than their shuffle.

    Cuts the lineage, so that later steps neither repeat the work nor depend on an executor that
    may be lost. The folder is the one that the session names in ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    if narrow:
        df = df.repartition(spark.sparkContext.defaultParallelism)
    path = f"{checkpoint_dir(spark)}/llm/{label}-{uuid.uuid4().hex}"
    # beside Python workers a writer has to be small: it holds one row group, and other codecs keep
    # buffers outside the heap that live until the collector happens to run
    df.write.option("compression", "zstd").option("parquet.block.size", str(32 << 20)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a staged frame that nothing reads any more."""
    files = df.inputFiles()
    if files:
        jvm = df.sparkSession._jvm
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns whose names (in any case) an operator gives to its own results."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in small batches, so that its workers stay small beside the JVM."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def tidy(batches: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives its memory back at the end, because workers live on between tasks."""

    @functools.wraps(batches)
    def run(given: Iterator) -> Iterator:
        try:
            yield from batches(given)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_noise(*key: Column) -> Column:
    """Number in (0, 1) fixed by the key: 53 bits of its XXH64, never 0 or 1."""
    bits = F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 53))
