"""Rows behind the watermark as data: a stream is split into rows on time and late rows, with counts.

Spark drops late rows inside its stateful operators and only counts them in the query's progress. Here a stream is routed
before such operators: late rows go to a table of their own, and what is on time is read on as a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

_COUNTS = "batch long, on_time long, late long, without_time long, newest_us long"


def _fs(spark: SparkSession, folder: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _counted(spark: SparkSession, store: str) -> list[int]:
    """Batches that are routed to their end."""
    at, system = _fs(spark, f"{store}/counts")
    if not system.exists(at):
        return []
    names = [s.getPath().getName() for s in system.listStatus(at)]
    path = spark._jvm.org.apache.hadoop.fs.Path
    done = [n for n in names if n.startswith("b-") and system.exists(path(f"{store}/counts/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("b-")) for n in done)


def _publish(spark: SparkSession, staged: str, target: str) -> None:
    """Move a finished folder to its place, as one step; one that is there already was moved before."""
    source, system = _fs(spark, staged)
    at, _ = _fs(spark, target)
    system.mkdirs(at.getParent())
    if system.exists(source) and not system.exists(at):
        if not system.rename(source, at):
            raise OSError(f"{staged} could not be moved to {target}")


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(f"`{ts}`").cast("timestamp"))


def route_late(batch: DataFrame, batch_id: int, store: str, ts: str, delay_seconds: float) -> None:
    """Split one micro-batch into ``<store>/on_time`` and ``<store>/late``, and count both in ``<store>/counts``.

    A row is late if its time lies more than ``delay_seconds`` before the newest time of all earlier batches; rows of one batch do
    not make each other late. Rows without a time are kept with the late ones. Rows keep all their columns as they are, so both
    tables together are the input. Each batch is one folder, written once and moved to its place; a batch that dies is routed
    anew with the same outcome, and a batch that was routed before changes nothing.
    """
    spark = batch.sparkSession
    done = _counted(spark, store)
    if done and batch_id <= done[-1]:
        return
    newest = None
    if done:
        newest = spark.read.schema(_COUNTS).parquet(f"{store}/counts/b-{done[-1]}").first()["newest_us"]
    flag = "_late"
    while flag in {c.lower() for c in batch.columns}:
        flag += "_"
    late = _micros(ts).isNull()
    if newest is not None:
        late = late | (_micros(ts) < F.lit(newest - round(delay_seconds * 1_000_000)))
    staged = f"{store}/_staged/b-{batch_id}"
    batch.withColumn(flag, late).write.mode("overwrite").partitionBy(flag).parquet(staged)
    # from what was written: the batch itself is computed once
    schema = StructType(batch.schema.fields).add(flag, "boolean")
    is_late, has_time = F.col(flag), _micros(ts).isNotNull()
    counts = spark.read.schema(schema).parquet(staged).agg(
        F.count_if(~is_late).alias("on_time"),
        F.count_if(is_late & has_time).alias("late"),
        F.count_if(~has_time).alias("without_time"),
        F.greatest(F.max(_micros(ts)), F.lit(newest).cast("long")).alias("newest_us"),
    ).first()
    _publish(spark, f"{staged}/{flag}=false", f"{store}/on_time/b-{batch_id}")
    _publish(spark, f"{staged}/{flag}=true", f"{store}/late/b-{batch_id}")
    # the counts come last: with them the batch is done
    row = spark.createDataFrame([(batch_id, *counts)], _COUNTS)
    row.coalesce(1).write.mode("overwrite").parquet(f"{store}/counts/b-{batch_id}")
    at, system = _fs(spark, staged)
    system.delete(at, True)


def late_router(
    rows: DataFrame, store: str, ts: str, delay_seconds: float, *, checkpoint: str
) -> DataStreamWriter:
    """Writer that routes a stream by :func:`route_late`; ``checkpoint`` is the stream's own folder."""
    return rows.writeStream.foreachBatch(
        lambda batch, batch_id: route_late(batch, batch_id, store, ts, delay_seconds)
    ).option("checkpointLocation", checkpoint)


def on_time_stream(spark: SparkSession, store: str, schema: StructType) -> DataFrame:
    """The rows on time as a stream. Whole batches arrive together and in order, so an operator whose watermark has the router's
    delay finds no row late. (No bound on files for each trigger is set for that reason.)"""
    at, system = _fs(spark, f"{store}/on_time")
    system.mkdirs(at)
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{store}/on_time")


def routed(spark: SparkSession, store: str, side: str, schema: StructType) -> DataFrame:
    """The rows of one side, ``on_time`` or ``late``, as a table."""
    at, system = _fs(spark, f"{store}/{side}")
    system.mkdirs(at)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{store}/{side}")


def late_counts(spark: SparkSession, store: str) -> DataFrame:
    """``batch, on_time, late, without_time, newest_us`` of each routed batch; ``newest_us`` is the newest time up to it."""
    names = [f"{store}/counts/b-{b}" for b in _counted(spark, store)]
    return spark.read.schema(_COUNTS).parquet(*names) if names else spark.createDataFrame([], _COUNTS)
