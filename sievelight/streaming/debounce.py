"""Debounced file changes: one row per path once it has been quiet, or alive for too long."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .sessions import MICROS, across_cells, bucket_of, in_cells

QUIET_SECONDS = 2
CAP_SECONDS = 20

Entry = tuple[int, int, int | None, int | None]  # first and last change in ms, size and mtime of the last one

STATE = T.StructType(
    [T.StructField("path", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.ArrayType(T.LongType())) for n in ("first_seen_ms", "last_change_ms", "size", "mtime")]
)
OUTPUT = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("first_seen", T.TimestampType()),
        T.StructField("last_change", T.TimestampType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.LongType()),
        T.StructField("ready_at", T.TimestampType()),
    ]
)


class Debouncer(StatefulProcessor):
    """Keeps the pending entries of the paths of a bucket, and a timer for the moment the first of them becomes stable."""

    def __init__(self, quiet_ms: int, cap_ms: int, event_time: bool) -> None:
        self.quiet_ms = quiet_ms
        self.cap_ms = cap_ms
        self.event_time = event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", STATE)

    def _load(self) -> dict[str | None, Entry]:
        if not self.pending.exists():
            return {}
        paths, *numbers = self.pending.get()
        return dict(zip(paths, zip(*numbers, strict=True), strict=True))

    def _keep(self, entries: dict[str | None, Entry]) -> None:
        if entries:
            self.pending.update((list(entries), *map(list, zip(*entries.values(), strict=True))))
        else:
            self.pending.clear()

    def _due(self, entry: Entry) -> int:
        return min(entry[1] + self.quiet_ms, entry[0] + self.cap_ms)

    def _first_due(self, entries: dict[str | None, Entry]) -> int | None:
        return min(map(self._due, entries.values())) if entries else None

    def _timer(self, before: int | None, due: int | None) -> None:
        if before != due:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)

    def _frame(self, rows: list[tuple[str | None, Entry]]) -> pd.DataFrame:
        out = pd.DataFrame([(p, *e, self._due(e)) for p, e in rows], columns=OUTPUT.names)
        out = out.astype({"size": "int64", "mtime": "int64"})
        return out.assign(**{c: pd.to_datetime(out[c], unit="ms", utc=True) for c in ("first_seen", "last_change", "ready_at")})

    def _in_order(self, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[tuple]:
        """Path, time, size and mtime of all changes of the bucket in the batch, each path in time order.

        They may come in several chunks, which are not ordered among each other; four values of each row are kept.
        """
        kept = []
        for chunk in rows:
            if self.event_time:
                ms = pd.to_datetime(chunk["changed_at"], utc=True).astype("datetime64[ns, UTC]").astype("int64") // 1_000_000
            else:
                ms = pd.Series(timerValues.getCurrentProcessingTimeInMs(), index=chunk.index)
            kept.append(pd.DataFrame({"path": chunk["path"], "ms": ms, "size": chunk["size"], "mtime": chunk["mtime"]}))
        if kept:
            every = pd.concat(kept).sort_values(["ms", "mtime", "size"], kind="stable").astype({c: "int64" for c in ("ms", "size", "mtime")})
            yield from zip(*[every[c].tolist() for c in ("path", "ms", "size", "mtime")], strict=True)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        entries = self._load()
        due = self._first_due(entries)
        done = []
        for path, ms, size, mtime in self._in_order(rows, timerValues):
            entry = entries.get(path)
            if entry is not None and ms >= self._due(entry):
                done.append((path, entry))
                entry = None
            if entry is None:
                entries[path] = (ms, ms, size, mtime)
            elif ms >= entry[1]:
                entries[path] = (entry[0], ms, size, mtime)
            else:  # late, but still within the pending change
                entries[path] = (min(entry[0], ms), *entry[1:])
        if done:
            yield self._frame(done)
        if entries:
            self._keep(entries)
            self._timer(due, self._first_due(entries))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # one timer stands for the bucket: whatever else is due by now is stable too
        expired = expiredTimerInfo.getExpiryTimeInMs()
        now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        entries = self._load()
        stable = {p: e for p, e in entries.items() if self._due(e) <= expired or self._due(e) < now}
        left = {p: e for p, e in entries.items() if p not in stable}
        if stable:
            self._keep(left)
            yield self._frame(list(stable.items()))
        self._timer(None, self._first_due(left))

    def close(self) -> None:
        pass


def debounce(
    changes: DataFrame,
    *,
    quiet_seconds: float = QUIET_SECONDS,
    cap_seconds: float = CAP_SECONDS,
    event_time: bool = True,
    late: str = "10 seconds",
    buckets: int = 256,
) -> DataFrame:
    """Stable files from a stream of ``path, size, mtime, changed_at``.

    A path is emitted when nothing changed for ``quiet_seconds``, or ``cap_seconds`` after its
    first pending change. Event time makes results repeatable and needs a watermark (``late``);
    processing time uses the moment a change arrives. State is one row for each of ``buckets`` groups of paths by hash, with four
    numbers for each pending path: a Python call and its round trips to the state are paid per bucket and batch, not per path. Their
    number is part of the checkpoint.
    Streams need ``spark.sql.streaming.stateStore.providerClass`` to be the RocksDB provider.
    """
    processor = Debouncer(int(quiet_seconds * 1000), int(cap_seconds * 1000), event_time)
    rows = changes.select("path", "size", "mtime", "changed_at", F.pmod(F.xxhash64("path"), F.lit(buckets)).alias("bucket"))
    if event_time:
        rows = rows.withWatermark("changed_at", late)
    return rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="EventTime" if event_time else "ProcessingTime",
    )


def debounce_batch(
    changes: DataFrame,
    *,
    quiet_seconds: int = QUIET_SECONDS,
    cap_seconds: int = CAP_SECONDS,
    bucket_seconds: int = 3_600,
) -> DataFrame:
    """The event-time result of :func:`debounce` for a table of changes.

    Runs of changes without a quiet gap are found first, in cells of key and time bucket. A run shorter
    than the cap is one row, from aggregates alone. The changes of longer runs come from the same
    shuffle, are laid out one run after the other in time order and cut while they stream by, so no
    run is ever held in memory, and the runs of a busy path go to different tasks.
    """
    quiet, cap = int(quiet_seconds * MICROS), int(cap_seconds * MICROS)
    tagged = in_cells(
        changes.select("path", "size", "mtime", "changed_at"),
        "path", "changed_at", quiet_seconds, bucket_seconds,
    )
    # the last change of a run with its values; both results below need all of it, so they share its shuffle
    inside = tagged.groupBy("path", "_bucket", "_run").agg(F.max(F.array("_t", "mtime", "size")).alias("v"))
    parts = across_cells(inside.withColumn("_end", F.col("v")[0]), "path", quiet_seconds)
    session = W.partitionBy("path", "_part", "_session")
    runs = parts.withColumn("last", F.max(F.col("v")[0]).over(session))
    is_long = F.col("last") - F.col("_session") >= cap
    short = (
        runs.filter(~is_long)
        .groupBy("path", "_part", "_session")
        .agg(F.max("v").alias("v"))
        .select(
            "path", F.col("_session").alias("first"), F.col("v")[0].alias("last"),
            F.col("v")[2].alias("size"), F.col("v")[1].alias("mtime"),
        )
    )
    # the cells of long runs, with the run that each part of theirs belongs to
    long_cells = (
        runs.filter(is_long)
        .groupBy("path", bucket_of(F.col("_run"), bucket_seconds).alias("_bucket"))
        .agg(F.map_from_entries(F.collect_list(F.struct("_run", "_session"))).alias("_sessions"))
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, entry = None, None
        columns = ["path", "first", "last", "size", "mtime"]
        for batch in batches:
            done = []
            for path, session, t, size, mtime in zip(
                batch["path"], batch["_session"], batch["_t"], batch["size"], batch["mtime"]
            ):
                if run != (path, session) or t >= entry[1] + cap:
                    if entry is not None:
                        done.append(entry)
                    run, entry = (path, session), (path, t, t, size, mtime)
                else:
                    entry = (path, entry[1], t, size, mtime)
            if done:
                yield pd.DataFrame(done, columns=columns)
        if entry is not None:
            yield pd.DataFrame([entry], columns=columns)

    pieces = (
        tagged.join(long_cells, ["path", "_bucket"])
        .withColumn("_session", F.try_element_at("_sessions", F.col("_run")))
        .filter(F.col("_session").isNotNull())
        .select("path", "_session", "_t", "size", "mtime")
        .repartition("path", "_session")
        .sortWithinPartitions("path", "_session", "_t", "mtime", "size")
        .mapInPandas(cut, "path string, first long, last long, size long, mtime long")
    )
    return short.unionByName(pieces).select(
        "path",
        F.timestamp_micros("first").alias("first_seen"),
        F.timestamp_micros("last").alias("last_change"),
        "size",
        "mtime",
        F.timestamp_micros(
            F.least(F.col("last") + F.lit(quiet), F.col("first") + F.lit(cap))
        ).alias("ready_at"),
    )
