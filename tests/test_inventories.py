import datetime as dt

from pyspark.sql import functions as F

from sievelight.streaming.inventories import Comparer, inventory_changes

SCHEMA = "path string, size bigint, mtime bigint, taken_at timestamp"
START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def test_modified_files_are_changes(spark, tmp_path):
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    arrivals = [
        [("/a", 1, 1, at(0)), ("/a", 1, 1, at(0)), ("/b", 1, 1, at(0)), (None, 1, 1, at(0)), ("/n", None, None, at(0)), ("/x", 1, 1, None)],
        [("/a", 2, 2, at(10)), ("/b", 1, 1, at(10)), ("/n", 0, 0, at(10)), ("/t", 5, 1, at(10)), ("/t", 4, 2, at(10))],
        [("/a", 9, 9, at(5))],  # late: the path has been listed since
        [("/a", 2, 2, at(20)), ("/a", 3, 3, at(30)), ("/n", 0, 0, at(20)), ("/n", 0, 0, at(30))],  # two inventories at once
        [("/b", 1, 1, at(60))],
        [("/end", 1, 1, at(10_000))],
    ]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in arrivals:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        changes = inventory_changes(spark.readStream.schema(SCHEMA).parquet(source), gone_seconds=15 * 60, late="10 minutes")
        running = (
            changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
            .trigger(availableNow=True).start()
        )
        running.awaitTermination()
    rows = spark.read.parquet(out).where("path <> '/end'").selectExpr(
        "path", "change", "size", "mtime", "cast((unix_seconds(changed_at) - 1704067200) / 60 as int) as minute", "is_file"
    )
    got = {}
    for r in rows.orderBy("path", "minute").collect():
        got.setdefault(r.path, []).append((r.change, r.size, r.mtime, r.minute))
    assert got == {
        "/a": [("created", 1, 1, 0), ("changed", 2, 2, 10), ("changed", 3, 3, 30), ("gone", 3, 3, 45)],
        "/b": [("created", 1, 1, 0), ("gone", 1, 1, 25), ("created", 1, 1, 60), ("gone", 1, 1, 75)],
        "/n": [("created", 0, 0, 0), ("gone", 0, 0, 45)],
        "/t": [("created", 4, 2, 10), ("gone", 4, 2, 25)],
    }


def test_empty_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    changes = inventory_changes(spark.readStream.schema(SCHEMA).parquet(source), gone_seconds=1)
    running = (
        changes.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start()
    )
    running.awaitTermination()
    assert running.exception() is None


def test_many_paths_share_few_calls(spark, tmp_path, monkeypatch):
    calls = spark.sparkContext.accumulator(0)
    handled = Comparer.handleInputRows

    def counted(self, key, rows, timerValues):
        calls.add(1)
        yield from handled(self, key, rows, timerValues)

    monkeypatch.setattr(Comparer, "handleInputRows", counted)
    source, n = str(tmp_path / "in"), 3000
    listing = ["concat('/p/', id) as path", "id as size", "{0}L as mtime", "timestamp_seconds(1704067200 + {0}) as taken_at"]
    for moment, kept in ((0, "true"), (60, "id % 2 = 0"), (120, "id % 3 = 0"), (100_000, "id = 0")):
        spark.range(n).where(kept).selectExpr(*[c.format(moment) for c in listing]).write.mode("append").parquet(source)
        changes = inventory_changes(spark.readStream.schema(SCHEMA).parquet(source), gone_seconds=90, buckets=16)
        running = (
            changes.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
            .trigger(availableNow=True).start()
        )
        running.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    got = {(r.change, r.at): r["count"] for r in out.groupBy("change", (F.unix_seconds("changed_at") - 1704067200).alias("at")).count().collect()}
    # multiples of 3 that are odd were listed at 0 and 120 only, which is more than the 90 seconds
    odd = sum(1 for i in range(n) if i % 3 == 0 and i % 2)
    assert got == {
        ("created", 0): n, ("gone", 90): n // 2, ("changed", 60): n // 2, ("gone", 150): n // 2 - n // 6, ("created", 120): odd,
        ("changed", 120): n // 3 - odd, ("gone", 210): n // 3, ("created", 100_000): 1,
    }
    assert calls.value <= 16 * 4
