"""Alert lists: the kept scans of local files and of a fleet of devices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.sql import NO_STRINGS, array
from ..functions.text import risk_rank
from .findings import has_signal
from .store import files_with_latest_scan

WEAK = "weak_archive_encryption"


def latest_alerts(files: DataFrame, scans: DataFrame) -> DataFrame:
    """Files not deleted whose most recent scan has a signal, worst first."""
    order = [F.col("risk_score").desc(), F.col("scanned_at").desc(), "file_id"]
    return alert_rows(files, scans).orderBy(*order)


def alert_rows(files: DataFrame, scans: DataFrame) -> DataFrame:
    """The rows of :func:`latest_alerts` in no order, for lists that are filtered and sorted later."""
    joined = files_with_latest_scan(files.filter(~F.col("deleted")), scans)
    return joined.filter(
        has_signal(
            F.col("findings"),
            F.col("custom_findings"),
            F.col("weak_zip_encryption"),
            F.col("risk_score"),
        )
    )


def _counted(findings: Column) -> Column:
    return F.filter(findings, lambda f: f["count"] > 0)


def _names(findings: Column) -> Column:
    return F.transform(findings, lambda f: f.category)


def alert_types(findings: Column, custom_findings: Column) -> Column:
    """Counted built-in categories, then counted rule names."""
    return F.concat(_names(_counted(findings)), _names(_counted(custom_findings)))


def alert_payload(reports: DataFrame) -> DataFrame:
    """What a device sends to its fleet server about a report."""
    return reports.select(
        "file_id",
        "path",
        "risk_level",
        "risk_score",
        alert_types(F.col("findings"), F.col("custom_findings")).alias("types"),
        "last_seen_at",
    )


def summarize_types(
    findings: Column, custom_findings: Column, weak_zip: Column, *, categories: int = 4, rules: int = 3
) -> Column:
    """``weak zip, category (n), ...`` for display: the first ``categories`` and ``rules``."""
    label = lambda f: F.concat(f.category, F.lit(" ("), f["count"].cast("string"), F.lit(")"))
    shown = F.filter(_counted(findings), lambda f: f.category != "file_name_signal")
    parts = F.concat(
        F.when(weak_zip, F.array(F.lit(WEAK))).otherwise(F.expr(NO_STRINGS)),
        F.transform(F.slice(shown, 1, categories), label),
        F.transform(F.slice(_counted(custom_findings), 1, rules), label),
    )
    return F.array_join(parts, ", ")


def primary_type(findings: Column, weak_zip: Column) -> Column:
    """Weak archive, else the category with the highest count, else the file name."""
    shown = F.filter(_counted(findings), lambda f: f.category != "file_name_signal")
    most = F.array_max(F.transform(shown, lambda f: f["count"]))
    top = F.element_at(F.filter(shown, lambda f: f["count"] == most), 1)["category"]
    return F.when(weak_zip, F.lit(WEAK)).otherwise(
        F.when(F.size(shown) > 0, top).otherwise("file_name_signal")
    )


def local_items(alerts: DataFrame) -> DataFrame:
    """Local alerts in the common list form."""
    plain = F.filter(
        alert_types(F.col("findings"), F.col("custom_findings")), lambda t: t != WEAK
    )
    types = F.concat(
        plain, F.when(F.col("weak_zip_encryption"), F.array(F.lit(WEAK))).otherwise(F.expr(NO_STRINGS))
    )
    return alerts.select(
        F.lit("local").alias("kind"),
        F.lit("local").alias("device_id"),
        F.lit("local").alias("device_name"),
        F.col("file_id").cast("string").alias("file_id"),
        "path",
        "risk_level",
        F.col("risk_score").cast("bigint").alias("risk_score"),
        F.col("last_seen_at").alias("alert_time"),
        types.alias("types"),
        primary_type(F.col("findings"), F.col("weak_zip_encryption")).alias("primary_type"),
        F.col("ignored"),
    )


def fleet_items(fleet_alerts: DataFrame) -> DataFrame:
    """Fleet alerts in the common list form."""
    return fleet_alerts.select(
        F.lit("server").alias("kind"),
        "device_id",
        "device_name",
        F.col("file_id").cast("string").alias("file_id"),
        "path",
        "risk_level",
        F.col("risk_score").cast("bigint").alias("risk_score"),
        F.col("received_at").alias("alert_time"),
        "types",
        F.when(F.size("types") > 0, F.get("types", F.lit(0))).otherwise("-").alias("primary_type"),
        F.lit(False).alias("ignored"),
    )


def union_local_remote(local: DataFrame, remote: DataFrame | None) -> DataFrame:
    items = local_items(local)
    return items if remote is None else items.unionByName(fleet_items(remote))


_SORTS = ("risk_desc", "risk_asc", "recent", "type")


def visible_alerts(
    local: DataFrame,
    remote: DataFrame | None = None,
    *,
    risks: Sequence[str] = (),
    types: Sequence[str] = (),
    device: str = "all",
    sort: str = "risk_desc",
    show_ignored: bool = False,
) -> DataFrame:
    """The filtered and sorted alert list.

    ``local`` are alerts in any order (:func:`alert_rows`); the list is sorted once, here. ``device``
    is ``all``, ``local`` or a device id. Any of the chosen ``types`` is enough.
    """
    if sort not in _SORTS:
        raise ValueError(f"sort must be one of {_SORTS}")
    shown = local if show_ignored else local.filter(~F.col("ignored"))
    items = union_local_remote(shown, remote)
    if risks:
        items = items.filter(F.col("risk_level").isin(*risks))
    if types:
        items = items.filter(F.arrays_overlap("types", F.expr(array(types))))
    if remote is not None and device != "all":
        items = items.filter(
            F.col("kind") == "local"
            if device == "local"
            else (F.col("kind") == "server") & (F.col("device_id") == device)
        )
    rank, recent = F.expr(risk_rank("risk_level")), F.col("alert_time").desc()
    order = {
        "risk_desc": [rank.desc(), recent],
        "risk_asc": [rank.asc(), recent],
        "recent": [recent],
        "type": [F.col("primary_type").asc()],
    }[sort]
    return items.orderBy(*order, "kind", "device_id", "file_id")


def type_options(local: DataFrame, remote: DataFrame | None = None) -> DataFrame:
    """Rule names that occur in alerts, in order; built-in categories are always offered."""
    names = local.select(F.explode(_names(F.col("custom_findings"))).alias("type")).filter(
        F.trim("type") != ""
    )
    if remote is not None:
        seen = remote.select(F.explode("types").alias("type"))
        names = names.unionByName(seen.filter(~F.col("type").isin(*fixed.CATEGORIES)))
    return names.distinct().orderBy("type")


def device_options(fleet_alerts: DataFrame, arrival: Column) -> DataFrame:
    """Devices that sent alerts, with the name in the last one to arrive, by name."""
    return (
        fleet_alerts.groupBy("device_id")
        .agg(F.max_by("device_name", arrival).alias("device_name"))
        .orderBy("device_name", "device_id")
    )
