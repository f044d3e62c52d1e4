"""File changes found by comparing inventories of one folder, as they arrive."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = T.StructType(
    [T.StructField("path", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.ArrayType(T.LongType())) for n in ("seen_ms", "size", "mtime")]
)
OUTPUT = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("change", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.LongType()),
        T.StructField("changed_at", T.TimestampType()),
        T.StructField("is_file", T.BooleanType()),
    ]
)


class Comparer(StatefulProcessor):
    """Keeps how each path of a bucket was listed last, and a timer for the moment the first of them counts as gone."""

    def __init__(self, gone_ms: int) -> None:
        self.gone_ms = gone_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.listed = handle.getValueState("listed", STATE)

    def _load(self) -> dict[str, tuple[int, int, int]]:
        if not self.listed.exists():
            return {}
        paths, *numbers = self.listed.get()
        return dict(zip(paths, zip(*numbers, strict=True), strict=True))

    def _due(self, entries: dict[str, tuple[int, int, int]]) -> int | None:
        return min(e[0] for e in entries.values()) + self.gone_ms if entries else None

    def _keep(self, entries: dict[str, tuple[int, int, int]]) -> None:
        if entries:
            self.listed.update((list(entries), *map(list, zip(*entries.values(), strict=True))))
        else:
            self.listed.clear()

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=OUTPUT.names[:5]).astype({"size": "int64", "mtime": "int64"})
        frame["changed_at"] = pd.to_datetime(frame["changed_at"], unit="ms", utc=True)
        return frame.assign(is_file=True)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        entries = self._load()
        due, changed = self._due(entries), False
        listings: dict[str, dict[int, tuple[int, int]]] = {}  # one listing of a path for each inventory of the batch
        for chunk in rows:
            for path, *row in zip(*[chunk[c].tolist() for c in ("path", "ms", "mtime", "size")], strict=True):
                ms, listing = row[0], (row[1], row[2])
                seen = listings.setdefault(path, {})
                seen[ms] = max(seen.get(ms, (-1, -1)), listing)
        out = []
        for path, seen in listings.items():
            before = entry = entries.get(path)
            for ms, (mtime, size) in sorted(seen.items()):
                if entry is not None and ms <= entry[0]:
                    continue
                if entry is not None and ms - entry[0] > self.gone_ms:
                    out.append((path, "gone", entry[1], entry[2], entry[0] + self.gone_ms))
                    entry = None
                if entry is None:
                    out.append((path, "created", size, mtime, ms))
                elif entry[1:] != (size, mtime):
                    out.append((path, "changed", size, mtime, ms))
                entry = (ms, size, mtime)
            if entry != before:
                entries[path] = entry
                changed = True
        if changed:
            self._keep(entries)
            self._timer(due, self._due(entries))
        if out:
            yield self._frame(out)

    def _timer(self, before: int | None, due: int | None) -> None:
        if before != due:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        expired, watermark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        entries = self._load()
        # one timer stands for the bucket: whatever else is behind the watermark is gone too
        gone = {p: e for p, e in entries.items() if e[0] + self.gone_ms <= expired or e[0] + self.gone_ms < watermark}
        if gone:
            left = {p: e for p, e in entries.items() if p not in gone}
            self._keep(left)
            self._timer(None, self._due(left))
            yield self._frame([(p, "gone", size, mtime, seen + self.gone_ms) for p, (seen, size, mtime) in gone.items()])

    def close(self) -> None:
        pass


def inventory_changes(inventories: DataFrame, *, gone_seconds: float, late: str = "0 seconds", buckets: int = 256) -> DataFrame:
    """Stream of ``path, change, size, mtime, changed_at, is_file`` from a stream of ``path, size, mtime, taken_at``.

    Each inventory lists all files at one moment ``taken_at``. ``change`` is ``created``, ``changed`` (another size or mtime) or
    ``gone``: not listed for ``gone_seconds`` after the last listing, which has to be longer than inventories lie apart, and then gone at
    that moment. A file seen again later is created again. Spark's own file source never shows a file a second time; here a modified one is a
    change. Null sizes and mtimes count as 0, rows without path or moment are left out, repeated rows count once, of different rows
    for one moment the latest mtime and then the largest size holds. Inventories older than the last listing of a path, but within ``late``,
    change nothing for it. State is one row for each of ``buckets`` groups of paths by hash, with three numbers for each existing path: a Python
    call and its round trips to the state are paid per bucket and batch, not per path. Their number is part of the checkpoint. Needs the RocksDB state store, as ``debounce`` does.
    """
    rows = inventories.where("path is not null and taken_at is not null").select(
        "path", F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"),
        F.coalesce(F.col("mtime").cast("long"), F.lit(0)).alias("mtime"),
        F.unix_millis(F.col("taken_at").cast("timestamp")).alias("ms"), F.col("taken_at").cast("timestamp").alias("taken_at"),
    )
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)))
    return bucketed.withWatermark("taken_at", late).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Comparer(int(gone_seconds * 1000)),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="EventTime",
    )
