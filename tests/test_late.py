"""Late rows as data: both sides together are the input, retries change nothing, sessions lose no row on time."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sievelight.streaming import late as L
from sievelight.streaming.sessions import session_activity, session_batch

START = datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp, n long, _late string, batch int"


def frame(spark, rows):
    return spark.createDataFrame([(k, None if s is None else START + timedelta(seconds=s), n, "x", 1) for k, s, n in rows], SCHEMA)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "store")


def ids(df):
    return sorted(r["n"] for r in df.select("n").collect())


def test_rows_against_brute_force(spark, folder):
    rng = random.Random(3)
    batches = [[(str(rng.randrange(3)), rng.randrange(200) + 100 * b if rng.random() < 0.9 else None, 1000 * b + i) for i in range(60)] for b in range(4)]
    batches.insert(2, [])
    newest, on_time, late, counts = None, [], [], []
    for rows in batches:
        behind = [r for r in rows if r[1] is None or (newest is not None and r[1] < newest - 80)]
        late += [r[2] for r in behind]
        on_time += [r[2] for r in rows if r not in behind]
        none = sum(r[1] is None for r in rows)
        counts.append((len(rows) - len(behind), len(behind) - none, none))
        newest = max([r[1] for r in rows if r[1] is not None] + ([] if newest is None else [newest]))
    for n, rows in enumerate(batches):
        L.route_late(frame(spark, rows), n, folder, "ts", 80)
    schema = frame(spark, []).schema
    assert ids(L.routed(spark, folder, "on_time", schema)) == sorted(on_time)
    assert ids(L.routed(spark, folder, "late", schema)) == sorted(late)
    assert [tuple(r)[1:4] for r in L.late_counts(spark, folder).orderBy("batch").collect()] == counts
    assert L.routed(spark, folder, "late", schema).columns == ["k", "ts", "n", "_late", "batch"]


def test_a_time_on_the_watermark_is_on_time(spark, folder):
    L.route_late(frame(spark, [("a", 100, 1), ("a", 0, 2)]), 0, folder, "ts", 10)
    L.route_late(frame(spark, [("a", 90, 3), ("a", 89, 4)]), 1, folder, "ts", 10)
    assert ids(L.routed(spark, folder, "late", frame(spark, []).schema)) == [4]


def test_a_repeated_batch_changes_nothing(spark, folder, tmp_path):
    schema = frame(spark, []).schema
    first, second = frame(spark, [("a", 100, 1)]), frame(spark, [("a", 5, 2), ("a", 101, 3)])
    L.route_late(first, 0, folder, "ts", 10)
    L.route_late(second, 1, folder, "ts", 10)
    L.route_late(second, 1, folder, "ts", 10)
    # died after its rows were moved, before it was counted
    (tmp_path / "store" / "counts" / "b-1" / "_SUCCESS").unlink()
    L.route_late(second, 1, folder, "ts", 10)
    assert ids(L.routed(spark, folder, "on_time", schema)) == [1, 3]
    assert ids(L.routed(spark, folder, "late", schema)) == [2]
    assert [r["late"] for r in L.late_counts(spark, folder).orderBy("batch").collect()] == [0, 1]


def test_empty_store(spark, folder):
    schema = frame(spark, []).schema
    assert L.late_counts(spark, folder).count() == 0
    assert L.routed(spark, folder, "late", schema).count() == 0
    L.route_late(frame(spark, []), 0, folder, "ts", 10)
    L.route_late(frame(spark, [("a", None, 1)]), 1, folder, "ts", 10)
    L.route_late(frame(spark, [("a", 3, 2)]), 2, folder, "ts", 10)
    assert [tuple(r) for r in L.late_counts(spark, folder).select("on_time", "late", "without_time").collect()].count((0, 0, 1)) == 1
    assert ids(L.routed(spark, folder, "on_time", schema)) == [2]


def test_sessions_of_rows_on_time_lose_none(spark, folder, tmp_path):
    rng = random.Random(5)
    source, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), frame(spark, []).schema
    rows = [[(str(rng.randrange(4)), 300 * b + rng.randrange(900), 1000 * b + i) for i in range(80)] for b in range(3)]
    for part in [*rows, [("end", 10**8, -1)]]:
        frame(spark, part).repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        L.late_router(stream, folder, "ts", 200, checkpoint=str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
        found = session_activity(L.on_time_stream(spark, folder, schema), "k", "ts", 30, late="200 seconds", total=F.sum("n"))
        writer = found.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "c2"))
        writer.trigger(availableNow=True).start().awaitTermination()
    kept = L.routed(spark, folder, "on_time", schema).where("k <> 'end'")
    assert 0 < L.routed(spark, folder, "late", schema).count() < 200
    got = spark.read.parquet(out).where("k <> 'end'")
    whole = session_batch(kept, "k", "ts", 30, total=("sum", "n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
