"""Collecting alerts of many devices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import lookup_join
from .retention import newest_rows


def bearer_token(authorization: Column) -> Column:
    """Token of an ``Authorization`` header, empty when there is none."""
    header = F.trim(F.coalesce(authorization, F.lit("")))
    return F.when(header.startswith("Bearer "), F.substr(header, F.lit(8))).otherwise("")


def authorize_alerts(
    requests: DataFrame, devices: DataFrame, now: Column, authorization: str = "authorization",
    *, hint: str | None = None,
) -> DataFrame:
    """Add ``device_id, device_name, status`` to each request.

    ``status`` is ``missing_token``, ``unknown_token``, ``device_disabled``, ``device_expired``
    or ``accepted``, tested in that order.
    """
    known = devices.groupBy("token").agg(
        F.min_by(
            F.struct("device_id", "device_name", "enabled", "expires_at"),
            F.struct("paired_at", "device_id"),
        ).alias("_d")
    )
    asked = requests.withColumn("token", bearer_token(F.col(authorization)))
    joined = lookup_join(asked, known, ["token"], "left", hint=hint)
    status = (
        F.when(F.col("token") == "", "missing_token")
        .when(F.col("_d").isNull(), "unknown_token")
        .when(~F.col("_d.enabled"), "device_disabled")
        .when(F.col("_d.expires_at") <= now, "device_expired")
        .otherwise("accepted")
    )
    return joined.select(
        *requests.columns,
        F.col("_d.device_id").alias("device_id"),
        F.col("_d.device_name").alias("device_name"),
        status.alias("status"),
    )


def device_last_seen(devices: DataFrame, accepted: DataFrame) -> DataFrame:
    """Devices with ``last_seen_at`` moved to their latest accepted call."""
    calls = accepted.groupBy("device_id").agg(F.max("received_at").alias("_seen"))
    return (
        devices.join(calls, "device_id", "left")
        .withColumn("last_seen_at", F.greatest("last_seen_at", "_seen"))
        .select(*devices.columns)
    )


def fleet_retention(
    alerts: DataFrame, keep: int | None = None, *arrival: str
) -> DataFrame:
    """The last ``keep`` alerts by arrival, in no order; all without a number."""
    if keep is None:
        return alerts
    return newest_rows(alerts, keep, *(arrival or ("received_at", "device_id", "file_id")))


def fleet_alerts_top(alerts: DataFrame, limit: int = 50, *tie: str) -> DataFrame:
    """The ``limit`` most recent alerts."""
    order = [F.col("received_at").desc(), *[F.col(c) for c in (tie or ("device_id", "file_id"))]]
    return alerts.orderBy(*order).limit(limit)
