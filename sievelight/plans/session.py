"""Session-dependent helpers: checkpoint folder, pinned columns, lookup joins."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and stream state, as the cluster names it.

    Only where ``spark.checkpoint.dir`` is unset (tests on one machine) a fresh local folder is
    made.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sievelight-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows, written once to the shared folder, for frames that are read several times (a sort reads its input twice)."""
    path = f"{checkpoint_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, max_bytes: int = 4 << 20) -> None:
    """Hand large values to Python workers in batches of a few megabytes; a smaller bound of the session stays.

    A worker holds a batch several times over (as it arrives, as Python values, and what comes of them), so with Spark's
    64 MB the workers of an executor take gigabytes for documents or archives.
    """
    given = re.fullmatch(r"(-?\d+)b?", spark.conf.get(_BATCH_BYTES))
    if given and not 0 < int(given[1]) <= max_bytes:
        spark.conf.set(_BATCH_BYTES, str(max_bytes))


def pin(df: DataFrame, *columns: str) -> DataFrame:
    """Compute costly columns once before they are filtered on.

    A filter on a computed column is pushed below its projection, which would run the regexes
    behind it twice. Passing the columns through a generator of exactly one row stops that.
    """
    keep = [c for c in df.columns if c not in columns]
    packed = F.array(F.struct(*[F.col(c) for c in columns]))
    return df.select(*keep, F.inline_outer(packed)).select(*df.columns)


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str, *, hint: str | None = None) -> DataFrame:
    """Join a large table with a lookup table that is unique on ``on``.

    No side is broadcast by order: Spark broadcasts the lookup table when its statistics, or its
    measured size at run time, are below ``spark.sql.autoBroadcastJoinThreshold``. Otherwise both sides
    shuffle once, and adaptive execution splits the partitions of ``left`` that a frequent key makes
    large. ``how`` is one of inner, left, left_semi, left_anti, whose left side can be split. ``hint``
    fixes a strategy, for tests.
    """
    return left.join(right.hint(hint) if hint else right, on, how)
