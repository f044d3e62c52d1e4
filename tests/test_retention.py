"""Newest rows by counting, and a store that shrinks."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from sievelight import schemas
from sievelight.operators.fleet import fleet_retention
from sievelight.operators.retention import cut_off, newest_rows
from sievelight.streaming.pipeline import _log, current_fleet_alerts, trim_fleet_alerts

BIG = (1 << 63) - 1


@pytest.mark.parametrize(
    "values",
    [[5, 5, 5, 5], [1, 2, None, 3, 3, None], [-BIG - 1, BIG, 0, -1, 1, BIG - 1], [1 << 40, (1 << 40) + 70_000, 1 << 20, 7], [-5, -70_000, -(1 << 33)]],
)
def test_cut_off(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    given = sorted((v for v in values if v is not None), reverse=True)
    for keep in range(1, len(values) + 1):
        least, left = cut_off(df, F.col("v"), keep)
        if keep > len(given):
            assert (least, left) == (None, keep - len(given))
        else:
            assert least == given[keep - 1] and left == keep - sum(v > least for v in given)


def test_newest_rows_against_a_sort(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, 7, 7, 7, rng.randrange(20)]), rng.choice("abc"), i) for i in range(200)]
    df = spark.createDataFrame(rows, "at int, d string, _place long").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]), reverse=True)
    for keep in (0, 1, 37, 100, 180, 200, 999):
        got = newest_rows(df, keep, "at", "d", "_place")
        assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(map(str, df.where(F.col("_place").isin([r[2] for r in order[:keep]])).collect()))
    assert newest_rows(df, 50, "at").count() == 50
    assert newest_rows(df.limit(0), 5, "at", "d").count() == 0


def test_other_arrivals(spark):
    when = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(when + dt.timedelta(microseconds=i), f"{i:02}") for i in range(30)], "t timestamp, s string")
    assert {r["s"] for r in newest_rows(df, 3, "t").collect()} == {"27", "28", "29"}
    assert {r["s"] for r in newest_rows(df, 3, "s").collect()} == {"27", "28", "29"}


def test_no_sort_of_what_is_kept(spark):
    df = spark.range(1000).withColumnsRenamed({"id": "received_at"}).withColumns({"device_id": F.lit("d"), "file_id": F.col("received_at").cast("string")})
    kept = fleet_retention(df, 500)
    assert kept.count() == 500
    assert "Sort" not in kept._jdf.queryExecution().executedPlan().toString() and "Limit" not in kept._jdf.queryExecution().executedPlan().toString()


def test_the_store_shrinks(spark, tmp_path):
    store = str(tmp_path / "fleet")
    columns = [f.name for f in schemas.FLEET_ALERTS.fields]

    def batch(n):
        rows = spark.range(n * 10, n * 10 + 10).select(
            *[(F.col("id") if c == "received_at" else F.lit(None)).cast(schemas.FLEET_ALERTS[c].dataType).alias(c) for c in columns]
        )
        _log(rows, f"{store}/fleet_alerts", n)
        _log(rows.select("received_at"), f"{store}/fleet_requests", n)

    def arrivals():
        return sorted(r["received_at"] for r in current_fleet_alerts(spark, store).collect())

    def folders(name):
        return sorted(n for n in os.listdir(f"{store}/{name}") if not n.startswith((".", "_")))

    trim_fleet_alerts(spark, store, 5)  # nothing there
    assert current_fleet_alerts(spark, store) is None
    for n in range(3):
        batch(n)
    trim_fleet_alerts(spark, store, 15)
    assert arrivals() == list(range(15, 30))
    assert folders("fleet_alerts") == ["batch=2"] and folders("fleet_requests") == ["batch=0", "batch=1", "batch=2"]
    batch(2)  # the newest batch is retried
    assert arrivals() == list(range(15, 30))
    batch(3)
    assert arrivals() == list(range(15, 40))
    trim_fleet_alerts(spark, store, 12, requests=True)
    trim_fleet_alerts(spark, store, 11)
    assert arrivals() == list(range(29, 40))
    assert folders("fleet_alerts") == ["batch=3"] == folders("fleet_requests") and len(folders("fleet_alerts_snapshots")) == 1
