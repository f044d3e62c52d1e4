"""Activity sessions: events of a key with less than a quiet gap between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def session_activity(
    events: DataFrame, key: str, ts: str, quiet_seconds: int, *, late: str = "1 hour",
    **aggregates: Column,
) -> DataFrame:
    """Streaming sessions: ``key, session_start, session_end, n_events`` and the aggregates.

    Events that lie the gap or more apart are in different sessions, as in :func:`session_batch`. The watermark bounds the state;
    events later than that are dropped by Spark and show up in the query's progress. To keep them, route the stream first
    (``late.late_router``) and read on from ``late.on_time_stream``.
    """
    # Spark joins windows that touch, so the window ends a microsecond before the gap
    window = F.session_window(F.col(ts), f"{quiet_seconds * MICROS - 1} microseconds")
    return (
        events.withWatermark(ts, late)
        .groupBy(F.col(key), window.alias("w"))
        .agg(F.count(F.lit(1)).alias("n_events"), F.max(ts).alias("session_end"), *_named(aggregates))
        .select(
            key,
            F.col("w.start").alias("session_start"),
            "session_end",
            "n_events",
            *aggregates,
        )
    )


def _named(aggregates: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in aggregates.items()]


MICROS = 1_000_000
_MERGE = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.sum}
_FIRST = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def bucket_of(micros: Column, bucket_seconds: int) -> Column:
    return F.floor(micros / F.lit(bucket_seconds * MICROS))


def in_cells(
    events: DataFrame, key: str, ts: str, quiet_seconds: float, bucket_seconds: int = 3_600
) -> DataFrame:
    """Add ``_t`` (microseconds), ``_bucket`` and ``_run`` (start of the run inside the cell).

    Rows without a key or a time are left out. A cell is a key in a time bucket, so a key that holds a large part
    of all events is worked on by many tasks; this is the one shuffle of the events.
    """
    cell = W.partitionBy(key, "_bucket").orderBy("_t")
    laid = (
        events.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
        .withColumn("_bucket", bucket_of(F.col("_t"), bucket_seconds))
        .filter(F.col(key).isNotNull() & F.col("_bucket").isNotNull())
    )
    before = F.lag("_t").over(cell)
    starts = before.isNull() | (F.col("_t") - before >= F.lit(int(quiet_seconds * MICROS)))
    begun = laid.withColumn("_start", F.when(starts, F.col("_t")))
    return begun.withColumn("_run", F.last("_start", ignorenulls=True).over(cell)).drop("_start")


def across_cells(runs: DataFrame, key: str, quiet_seconds: float) -> DataFrame:
    """Add ``_session`` and ``_part`` to one row per run of a cell (``_run``, ``_end``).

    Only the first and the last run of a cell can go on in another cell. They meet in a window over
    the key, two rows per cell at most; every other run is a session by itself and has a partition of
    its own in that window. Rows with equal key, ``_part`` and ``_session`` are one session.
    """
    cell = W.partitionBy(key, "_bucket")
    inner = (F.col("_run") > F.min("_run").over(cell)) & (F.col("_run") < F.max("_run").over(cell))
    placed = runs.withColumn("_part", F.when(inner, F.col("_run")))
    order = W.partitionBy(key, "_part").orderBy("_run")
    before = F.lag("_end").over(order)
    starts = before.isNull() | (F.col("_run") - before >= F.lit(int(quiet_seconds * MICROS)))
    begun = placed.withColumn("_start", F.when(starts, F.col("_run")))
    return begun.withColumn("_session", F.last("_start", ignorenulls=True).over(order)).drop("_start")


def session_batch(
    events: DataFrame,
    key: str,
    ts: str,
    quiet_seconds: float,
    *,
    bucket_seconds: int = 3_600,
    **totals: tuple[str, str],
) -> DataFrame:
    """The sessions of a table: ``key, session_start, session_end, n_events`` and totals.

    A total is a pair of ``sum``, ``min``, ``max`` or ``count`` and a column. Events are summed up
    inside their cell first; runs that touch across cells are merged on these rows.
    """
    runs = (
        in_cells(events, key, ts, quiet_seconds, bucket_seconds)
        .groupBy(key, "_bucket", "_run")
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.max("_t").alias("_end"),
            *[_FIRST[how](column).alias(name) for name, (how, column) in totals.items()],
        )
    )
    return (
        across_cells(runs, key, quiet_seconds)
        .groupBy(key, "_part", "_session")
        .agg(
            F.sum("n_events").alias("n_events"),
            F.max("_end").alias("_end"),
            *[_MERGE[how](name).alias(name) for name, (how, _) in totals.items()],
        )
        .select(
            key,
            F.timestamp_micros("_session").alias("session_start"),
            F.timestamp_micros("_end").alias("session_end"),
            "n_events",
            *totals,
        )
    )
