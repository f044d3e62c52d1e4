"""Live watch: change events in, alerts and stored tables out.

Stored tables are written as one folder per micro-batch, replaced when a batch is repeated, so
a restart neither loses nor doubles rows. Current state (files, reminders) is read back from
these logs with the same operators that batch jobs use.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .. import schemas
from ..operators.contextual import EntitySetting
from ..operators.fleet import authorize_alerts, fleet_retention
from ..operators.rules import Rule
from ..operators.store import append_scans, reminder_rows, upsert_files
from ..plans.scan import as_scans, scan, scan_paths, signals_only
from ..sources.files import (
    is_hidden_path,
    is_ignored_extension,
    is_in_watched_dirs,
)


def visible_changes(changes: DataFrame, roots: Sequence[str] = ()) -> DataFrame:
    """Changes of visible, finished files below the roots."""
    kept = changes.filter(
        F.col("is_file") & ~is_hidden_path("path") & ~is_ignored_extension("path")
    )
    return kept.filter(is_in_watched_dirs("path", roots)) if roots else kept


def change_stream(spark: SparkSession, path: str, roots: Sequence[str] = (), fmt: str = "parquet") -> DataFrame:
    """Stream of file changes (``FILE_CHANGES`` rows arriving as files in a folder)."""
    return visible_changes(
        spark.readStream.schema(schemas.FILE_CHANGES).format(fmt).load(path), roots
    )


def _log(df: DataFrame, path: str, batch: int | str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    """All batches of a log, None before the first one. A log that cannot be read is an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.parquet(path).drop("batch")


def current_files(spark: SparkSession, store: str) -> DataFrame | None:
    """Files as the last snapshot and the batches after it have them."""
    known, log = _state(spark, f"{store}/files")
    return known if log is None else upsert_files(known, log)


def current_reminders(spark: SparkSession, store: str) -> DataFrame | None:
    """First date written per file and threshold."""
    known, log = _state(spark, f"{store}/reminders")
    if known is not None and log is not None:
        log = known.unionByName(log)
    elif log is None:
        return known
    return log.groupBy("file_id", "threshold").agg(
        F.min("due_at").alias("due_at"), F.max("sent_at").alias("sent_at")
    )


def _state(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame | None]:
    """The newest snapshot of a log, and the batches that it does not hold."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    at = hadoop.Path(f"{path}_snapshots")
    system = at.getFileSystem(conf)
    names = [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []
    done = [n for n in names if system.exists(hadoop.Path(f"{path}_snapshots/{n}/_SUCCESS"))]
    if read_log(spark, path) is None:
        return None, None
    log = spark.read.parquet(path)
    if not done:
        return None, log.drop("batch")
    name, last = max(((n, _upto(n)) for n in done), key=lambda x: x[1])
    known = spark.read.parquet(f"{path}_snapshots/{name}")
    return known, log.filter(_batch_number() > last[0]).drop("batch")  # a filter on folders


def _upto(name: str) -> tuple[int, ...]:
    """Last batch of a snapshot ``upto-<batch>`` or ``upto-<batch>.<time it was trimmed>``."""
    return tuple(int(n) for n in name.removeprefix("upto-").split("."))


def _batch_number() -> Column:
    return F.split(F.col("batch").cast("string"), "-")[0].cast("long")


def snapshot(spark: SparkSession, store: str, *, drop: bool = False) -> None:
    """Write the current files and reminders, so that reading them no longer goes through all batches.

    To be called now and then, between runs of the stream. With ``drop`` the batches and snapshots that the new one replaces are
    removed once it is finished, but for the newest batch, which its retry may write again; otherwise logs stay as they are.
    Without new batches nothing is written.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for name, current in (("files", current_files), ("reminders", current_reminders)):
        path = f"{store}/{name}"
        if read_log(spark, path) is None:
            continue
        last = spark.read.parquet(path).agg(F.max(_batch_number())).first()[0]
        if last is None:
            continue
        target = f"{path}_snapshots/upto-{last}"
        system = hadoop.Path(path).getFileSystem(conf)
        if not system.exists(hadoop.Path(f"{target}/_SUCCESS")):
            current(spark, store).write.mode("overwrite").parquet(target)
        if drop:
            for folder, prefix in ((path, "batch="), (f"{path}_snapshots", "upto-")):
                for status in system.listStatus(hadoop.Path(folder)):
                    n = status.getPath().getName().removeprefix(prefix)
                    if n != status.getPath().getName() and int(n.split("-")[0]) < last:
                        system.delete(status.getPath(), True)


def store_batch(
    batch: DataFrame,
    batch_id: int,
    store: str,
    *,
    now: int,
    rules: Sequence[Rule] = (),
    entities: Sequence[EntitySetting] = (),
    ignored: DataFrame | None = None,
    salt: str = "",
    ignored_files: DataFrame | None = None,
    **options,
) -> None:
    """Scan one micro-batch of ``doc_id, path, size, mtime, text, secrets_enabled`` and store it.

    Every file is logged; files the user ignores are not scanned; only scans with a signal are
    stored, get reminders and an ``alert_created`` event.
    """
    spark = batch.sparkSession
    seen = batch.select("path", "size", "mtime", F.lit(now).cast("bigint").alias("seen_at"))
    _log(seen, f"{store}/files", batch_id)
    todo = batch
    if ignored_files is not None:
        skip = ignored_files.filter("ignored").select("path")
        todo = batch.join(skip, "path", "left_anti")
    reports = signals_only(
        scan(todo, rules=rules, entities=entities, ignored=ignored, salt=salt, **options)
    )
    _store_reports(reports, store, str(batch_id), now)


def _store_reports(
    reports: DataFrame, store: str, batch: str, now: int, errors: DataFrame | None = None
) -> None:
    """Scans with a signal, their reminders and the events of one batch."""
    spark = reports.sparkSession
    append_scans(as_scans(reports, F.lit(now)), f"{store}/scans", batch)
    # later outputs read what was just stored, so that texts are scanned once
    kept = spark.read.schema(schemas.SCANS).parquet(f"{store}/scans/batch={batch}")
    _log(reminder_rows(kept, F.col("scanned_at")), f"{store}/reminders", batch)
    events = kept.select(F.lit("alert_created").alias("event_type"), "file_id", "path", "risk_level")
    if errors is not None:
        events = events.unionByName(errors, allowMissingColumns=True)
    else:
        events = events.withColumn("error", F.lit(None).cast("string"))
    _log(events, f"{store}/events", batch)


def scan_stream(
    stable: DataFrame,
    store: str,
    *,
    checkpoint: str,
    clock: Callable[[], int],
    ignored: Callable[[], DataFrame | None] = lambda: None,
    ignored_files: Callable[[], DataFrame | None] = lambda: None,
    **options,
) -> DataStreamWriter:
    """Writer that scans a stream of stable documents with their texts into ``store``.

    ``checkpoint`` is the stream's own folder, one for each stream.

    The ignore lists are read anew for every micro-batch.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        store_batch(
            batch, batch_id, store, now=clock(), ignored=ignored(),
            ignored_files=ignored_files(), **options,
        )

    return stable.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def store_file_batch(
    batch: DataFrame,
    batch_id: int,
    store: str,
    *,
    now: int,
    ignored_files: DataFrame | None = None,
    chunk: int = 2_000,
    **options,
) -> None:
    """Open, scan and store the files of one micro-batch of ``path, size, mtime``.

    Files go through the same routing as a folder scan (:func:`scan_paths`), ``chunk`` paths at a time, so
    the driver never holds the paths of a whole batch. Files that are gone or hold unreadable parts become
    ``scan_error`` events.
    """
    spark = batch.sparkSession
    seen = batch.groupBy("path").agg(F.max_by(F.struct("size", "mtime"), "mtime").alias("s"))
    _log(
        seen.select("path", "s.size", "s.mtime", F.lit(now).cast("bigint").alias("seen_at")),
        f"{store}/files", batch_id,
    )
    todo = seen.select("path")
    if ignored_files is not None:
        todo = todo.join(ignored_files.filter("ignored").select("path"), "path", "left_anti")
    paths = (r["path"] for r in todo.orderBy("path").toLocalIterator())
    part = 0
    while some := list(itertools.islice(paths, chunk)):
        name = f"{batch_id}-{part}"
        reports = scan_paths(spark, some, **options)
        reports.write.mode("overwrite").parquet(f"{store}/reports/batch={name}")
        reports = spark.read.schema(reports.schema).parquet(f"{store}/reports/batch={name}")
        _store_reports(signals_only(reports.filter("size is not null")), store, name, now, scan_errors(reports))
        part += 1


def scan_errors(reports: DataFrame) -> DataFrame:
    """``scan_error`` events: files that are gone, and files with parts that could not be read."""
    gone = F.exists("reasons", lambda r: r["key"] == "reason.notAFile")
    return (
        reports.withColumn("error", F.when(gone, "reason.notAFile").otherwise(F.array_join("errors", ", ")))
        .filter(F.col("error") != "")
        .select(F.lit("scan_error").alias("event_type"), "path", "error")
    )


def scan_file_stream(
    stable: DataFrame,
    store: str,
    *,
    checkpoint: str,
    clock: Callable[[], int],
    ignored: Callable[[], DataFrame | None] = lambda: None,
    ignored_files: Callable[[], DataFrame | None] = lambda: None,
    **options,
) -> DataStreamWriter:
    """Writer that opens and scans a stream of stable files ``path, size, mtime`` into ``store``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        store_file_batch(
            batch, batch_id, store, now=clock(), ignored=ignored(), ignored_files=ignored_files(), **options
        )

    return stable.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def fleet_batch(batch: DataFrame, batch_id: int, store: str, devices: DataFrame) -> None:
    """Authorise one micro-batch of alerts and log accepted and refused ones."""
    spark = batch.sparkSession
    _log(authorize_alerts(batch, devices, F.col("received_at")), f"{store}/fleet_requests", batch_id)
    # authorised once; both outputs read what was stored
    judged = spark.read.parquet(f"{store}/fleet_requests/batch={batch_id}")
    accepted = judged.filter(F.col("status") == "accepted")
    _log(
        accepted.select(*[f.name for f in schemas.FLEET_ALERTS.fields]),
        f"{store}/fleet_alerts",
        batch_id,
    )
    _log(
        judged.groupBy("status").agg(F.count(F.lit(1)).alias("n")), f"{store}/fleet_status", batch_id
    )


def fleet_ingest(
    requests: DataFrame,
    store: str,
    devices: Callable[[], DataFrame],
    checkpoint: str,
    *,
    keep: int | None = None,
    trim_every: int = 100,
) -> DataStreamWriter:
    """Writer that collects fleet alerts; devices are read anew for every micro-batch.

    ``checkpoint`` is the stream's own folder. With ``keep`` the store is trimmed to that many alerts every ``trim_every`` batches.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        fleet_batch(batch, batch_id, store, devices())
        if keep is not None and batch_id % trim_every == trim_every - 1:
            trim_fleet_alerts(batch.sparkSession, store, keep)

    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def current_fleet_alerts(spark: SparkSession, store: str, keep: int | None = None) -> DataFrame | None:
    """Collected alerts, the last ``keep`` of them when given."""
    known, log = _state(spark, f"{store}/fleet_alerts")
    if log is None:
        return None
    alerts = log if known is None else known.unionByName(log)
    return alerts if keep is None else fleet_retention(alerts, keep)


def trim_fleet_alerts(spark: SparkSession, store: str, keep: int, *, requests: bool = False) -> None:
    """Keep the last ``keep`` alerts in the store itself, and remove the folders they no longer need.

    What is kept becomes a snapshot; batches up to it and older snapshots are removed once it is finished, so a trim that dies loses
    nothing, and readers use one or the other whole. The newest batch keeps its folder, which its retry may write again.
    To be called between batches, with no reader of older snapshots. ``requests`` removes the judged requests of these batches, too;
    their counts by status stay.
    """
    path = f"{store}/fleet_alerts"
    alerts = current_fleet_alerts(spark, store)
    if alerts is None:
        return
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    system = hadoop.Path(path).getFileSystem(conf)

    def names(folder: str, prefix: str) -> list[str]:
        at = hadoop.Path(folder)
        found = [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []
        return [n for n in found if n.startswith(prefix)]

    batches = {int(n.removeprefix("batch=")) for n in names(path, "batch=")}
    last, old = max(batches), names(f"{path}_snapshots", "upto-")
    again = 1 + max((u[1] for u in map(_upto, old) if u[0] == last and len(u) > 1), default=0)
    kept = f"upto-{last}.{again}"
    fleet_retention(alerts, keep).write.mode("overwrite").parquet(f"{path}_snapshots/{kept}")
    for n in old:
        system.delete(hadoop.Path(f"{path}_snapshots/{n}"), True)
    for folder in (path, f"{store}/fleet_requests") if requests else (path,):
        for n in names(folder, "batch="):
            if int(n.removeprefix("batch=")) < last:
                system.delete(hadoop.Path(f"{folder}/{n}"), True)
