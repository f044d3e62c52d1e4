"""Operators over the stored tables: files, scans, reminders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import fixed
from ..plans.session import lookup_join


def file_id_of(path: Column) -> Column:
    """Identifier of a file: a hash of its path, wide enough not to collide."""
    return F.sha2(path, 256)


def upsert_files(files: DataFrame | None, seen: DataFrame) -> DataFrame:
    """Files after the observations ``seen(path, size, mtime, seen_at)``.

    Known paths get new size, mtime and last_seen_at and keep the rest.
    """
    news = seen.groupBy("path").agg(
        F.max_by(F.struct("size", "mtime"), F.struct("seen_at", "mtime", "size")).alias("n"),
        F.min("seen_at").alias("first_at"),
        F.max("seen_at").alias("last_at"),
    )
    if files is None:
        files = seen.sparkSession.createDataFrame([], schemas.FILES)
    both = files.alias("f").join(news.alias("s"), "path", "full_outer")
    id_type = files.schema["file_id"].dataType
    return both.select(
        F.coalesce("f.file_id", file_id_of(F.col("path")).cast(id_type)).alias("file_id"),
        "path",
        F.coalesce("n.size", "f.size").alias("size"),
        F.coalesce("n.mtime", "f.mtime").alias("mtime"),
        F.coalesce("f.first_seen_at", "first_at").alias("first_seen_at"),
        F.coalesce("last_at", "f.last_seen_at").alias("last_seen_at"),
        F.coalesce("f.ignored", F.lit(False)).alias("ignored"),
        F.coalesce("f.deleted", F.lit(False)).alias("deleted"),
    )


def latest_scans(scans: DataFrame) -> DataFrame:
    """Most recent scan per file; equal times go to the higher scan id.

    An aggregate instead of a window: it combines before the shuffle, so a file with very many
    scans costs one row per input task.
    """
    newest = scans.groupBy("file_id").agg(
        F.max_by(
            F.struct(*[c for c in scans.columns if c != "file_id"]),
            F.struct("scanned_at", "scan_id"),
        ).alias("s")
    )
    return newest.select("file_id", "s.*")


def files_with_latest_scan(files: DataFrame, scans: DataFrame) -> DataFrame:
    newest = latest_scans(scans)
    extra = [c for c in newest.columns if c == "file_id" or c not in files.columns]
    return files.join(newest.select(*extra), "file_id")


def latest_report(files: DataFrame, scans: DataFrame, file_id) -> DataFrame:
    """The report of one file: its row and its most recent scan."""
    return files_with_latest_scan(
        files.filter(F.col("file_id") == file_id), scans.filter(F.col("file_id") == file_id)
    )


def encode_scan_json(scans: DataFrame) -> DataFrame:
    """Export form with reasons and findings as JSON text."""
    return scans.select(
        *[c for c in scans.columns if c not in ("reasons", "findings", "custom_findings")],
        F.to_json("reasons").alias("reasons_json"),
        F.to_json("findings").alias("findings_json"),
        F.to_json("custom_findings").alias("custom_findings_json"),
    )


def decode_findings(text: Column) -> Column:
    """Findings from JSON text, empty when it cannot be read."""
    return F.coalesce(
        F.from_json(text, schemas.FINDINGS, {"mode": "PERMISSIVE"}),
        F.array().cast(schemas.FINDINGS),
    )


def decode_reasons(text: Column) -> Column:
    return F.coalesce(
        F.from_json(text, schemas.REASONS, {"mode": "PERMISSIVE"}),
        F.array().cast(schemas.REASONS),
    )


def decode_risk_level(text: Column, default: str = "low") -> Column:
    """The level if it is a known one; alerts fall back to low, detectors to medium."""
    return F.when(text.isin(*fixed.RISK_LEVELS), text).otherwise(F.lit(default))


def append_scans(scans: DataFrame, path: str, batch: str) -> None:
    """Append scan rows as one batch; a repeated write of the same batch replaces itself, so a retry
    doubles no rows."""
    scans.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def drop_removed_categories(scans: DataFrame) -> DataFrame:
    """Scan rows that change when retired categories are removed and old suggestion texts are
    repaired, in their new form."""
    gone = fixed.REMOVED_CATEGORIES
    repaired = F.col("suggestion")
    for old, new in fixed.SUGGESTION_REPAIRS:
        repaired = F.replace(repaired, F.lit(old), F.lit(new))
    fresh = scans.withColumns(
        {
            "_findings": F.filter(
                "findings", lambda f: ~F.coalesce(f.category.isin(*gone), F.lit(False))
            ),
            "_reasons": F.filter(
                "reasons", lambda r: ~F.coalesce(r.vars["category"].isin(*gone), F.lit(False))
            ),
            "_suggestion": repaired,
        }
    ).filter(
        (F.size("_findings") != F.size("findings"))
        | (F.size("_reasons") != F.size("reasons"))
        | (F.col("_suggestion") != F.col("suggestion"))
    )
    replaced = {"findings": "_findings", "reasons": "_reasons", "suggestion": "_suggestion"}
    return fresh.select(*[F.col(replaced.get(c, c)).alias(c) for c in scans.columns])


def set_ignored(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Files after ``changes(file_id, ignored)``, one row per changed file."""
    new = changes.select("file_id", F.col("ignored").alias("_new"))
    return (
        lookup_join(files, new, ["file_id"], "left")
        .withColumn("ignored", F.coalesce("_new", "ignored"))
        .select(*files.columns)
    )


def mark_deleted(files: DataFrame, gone: DataFrame) -> DataFrame:
    """Files with ``deleted`` set for the ids in ``gone(file_id)``."""
    new = gone.select("file_id").distinct().withColumn("_gone", F.lit(True))
    return (
        lookup_join(files, new, ["file_id"], "left")
        .withColumn("deleted", F.coalesce("_gone", F.lit(False)) | F.col("deleted"))
        .select(*files.columns)
    )


# --- reminders --------------------------------------------------------------------------------


def reminder_rows(
    alerts: DataFrame, now: Column, hours: int = 24, days_7: int = 7, days_30: int = 30
) -> DataFrame:
    """Three reminders per alerted file: ``24h``, ``7j`` and ``30j`` after ``now``."""
    steps = F.array(
        *[
            F.struct(F.lit(name).alias("threshold"), F.lit(secs).cast("bigint").alias("secs"))
            for name, secs in (("24h", hours * 3600), ("7j", days_7 * 86400), ("30j", days_30 * 86400))
        ]
    )
    return alerts.select("file_id", now.alias("_now"), F.inline(steps)).select(
        "file_id",
        "threshold",
        (F.col("_now") + F.col("secs")).alias("due_at"),
        F.lit(None).cast("bigint").alias("sent_at"),
    )


def insert_or_ignore(
    existing: DataFrame, new: DataFrame, keys: list[str], order: str | None = None
) -> DataFrame:
    """``existing`` plus the rows of ``new`` whose key is free.

    With ``order`` the first of several new rows with one key wins; without it the keys of
    ``new`` must be unique.
    """
    columns = existing.columns
    if order is not None:
        rank = F.struct(order, *[c for c in columns if c != order])
        new = new.groupBy(*keys).agg(F.min_by(F.struct(*columns), rank).alias("r")).select("r.*")
    return existing.unionByName(new.join(existing.select(*keys), keys, "left_anti"))


def schedule_reminders(reminders: DataFrame, alerts: DataFrame, now: Column, **thresholds) -> DataFrame:
    """Reminders with those of newly alerted files added; existing ones keep their date."""
    first = alerts.groupBy("file_id").agg(F.min(now).alias("now"))
    new = reminder_rows(first, F.col("now"), **thresholds)
    return insert_or_ignore(reminders, new, ["file_id", "threshold"])


def due_reminders(reminders: DataFrame, files: DataFrame, now: int) -> DataFrame:
    """Unsent reminders due by ``now`` of files that are neither ignored nor deleted."""
    return reminders.filter((F.col("due_at") <= now) & F.col("sent_at").isNull()).join(
        files.filter(~F.col("ignored") & ~F.col("deleted")).select("file_id", "path"), "file_id"
    )


def send_reminders(
    reminders: DataFrame, files: DataFrame, inventory: DataFrame, now: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(events, reminders, files)`` after one reminder round.

    A due reminder whose file is still in ``inventory(path)`` becomes a ``reminder_due`` event.
    Files that are gone are flagged deleted. Either way the reminder counts as sent.
    """
    present = inventory.select("path").distinct().withColumn("_there", F.lit(True))
    due = due_reminders(reminders, files, now).join(present, "path", "left")
    events = due.filter(F.col("_there").isNotNull()).select(
        F.lit("reminder_due").alias("event_type"), "file_id", "threshold"
    )
    vanished = due.filter(F.col("_there").isNull()).select("file_id")
    keys = due.select("file_id", "threshold").withColumn("_sent", F.lit(now).cast("bigint"))
    sent = (
        reminders.join(keys, ["file_id", "threshold"], "left")
        .withColumn("sent_at", F.coalesce("sent_at", "_sent"))
        .select(*reminders.columns)
    )
    return events, sent, mark_deleted(files, vanished)
