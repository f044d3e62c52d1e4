"""Streams: bounded runs against their batch twins and brute force."""

import random
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from test_files import flagged, make_zip

from sievelight import schemas
from sievelight.plans.scan import scan_files
from sievelight.plans.session import checkpoint_dir, lookup_join
from sievelight.streaming.debounce import Debouncer, debounce, debounce_batch
from sievelight.streaming.pipeline import (
    change_stream,
    current_files,
    current_fleet_alerts,
    current_reminders,
    fleet_ingest,
    read_log,
    scan_file_stream,
    scan_stream,
    snapshot,
)
from sievelight.streaming.sessions import session_activity, session_batch

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def brute_force(changes, quiet, cap):
    """Entries per path from changes ``(path, seconds, size)`` in time order."""
    out, pending = [], {}

    def emit(path):
        first, last, size = pending.pop(path)
        out.append((path, first, last, size, min(last + quiet, first + cap)))

    for path, t, size in sorted(changes, key=lambda c: (c[1], c[2])):
        if path in pending and t >= min(pending[path][1] + quiet, pending[path][0] + cap):
            emit(path)
        pending[path] = (pending[path][0] if path in pending else t, t, size)
    for path in list(pending):
        emit(path)
    return sorted(out)


def make_changes():
    rng = random.Random(5)
    out = []
    for p in range(12):
        t = float(rng.randint(0, 50))
        for i in range(rng.randint(1, 120)):
            out.append((f"/p{p}", t, p * 1000 + i))
            t += rng.choice([0.5, 0.5, 1.0, 1.5, 1.5, 2.0, 7.0]) if p else 1.0
    # exact borders
    out += [("/quiet", 0.0, 1), ("/quiet", 2.0, 2), ("/near", 0.0, 1), ("/near", 1.999, 2)]
    return out


def frame(spark, changes):
    rows = [(p, s, 0, T0 + timedelta(seconds=t), True) for p, t, s in changes]
    return spark.createDataFrame(rows, schemas.FILE_CHANGES)


def collected(df):
    at = lambda c: F.round(F.unix_micros(c) / 1e6 - T0.timestamp(), 3).alias(c)
    rows = df.select("path", at("first_seen"), at("last_change"), "size", at("ready_at")).collect()
    return sorted(tuple(r) for r in rows)


@pytest.mark.parametrize("bucket", [5, 3600])
def test_debounce_batch_equals_brute_force(spark, bucket):
    changes = make_changes()
    got = collected(debounce_batch(frame(spark, changes), bucket_seconds=bucket))
    assert got == brute_force(changes, 2, 20)


def shuffles(df):
    """Scans and new exchanges of a plan, without those that are used again."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    nodes = [re.sub(r"^[\s:+\-*()0-9]*", "", x) for x in plan.splitlines()]
    kinds = ("FileScan", "Exchange", "ReusedExchange")
    return [sum(n.startswith(k) for n in nodes) for k in kinds]


def test_sessions_and_debounce_read_and_shuffle_events_once(spark, tmp_path):
    frame(spark, make_changes()).write.parquet(str(tmp_path / "c"))
    changes = spark.read.parquet(str(tmp_path / "c"))
    assert shuffles(session_batch(changes, "path", "changed_at", 2)) == [1, 2, 0]
    # the changes are read and shuffled once; their shuffle is read again for the long runs
    assert shuffles(debounce_batch(changes)) == [1, 4, 2]


def test_busy_path_is_spread(spark):
    """A path with half of all changes, whose runs go on over many cells."""
    rows = [("/hot", i * 0.75 + (i % 50 == 0) * 0.25 + 5 * (i // 200), i) for i in range(3000)]
    rows += [(f"/p{i % 97}", i * 1.25, i) for i in range(3000)]
    for bucket in (7, 60, 3600):
        got = collected(debounce_batch(frame(spark, rows), bucket_seconds=bucket))
        assert got == brute_force(rows, 2, 20)


def run_stream(writer, name):
    query = writer.trigger(availableNow=True).queryName(name).start()
    query.awaitTermination()
    return query


def test_debounce_stream_equals_batch(spark, tmp_path):
    changes = make_changes()
    src = str(tmp_path / "changes")
    # one file per half minute, in order, then one far later to move the watermark past all timers
    for k in range(0, 200, 30):
        part = [c for c in changes if k <= c[1] < k + 30]
        if part:
            frame(spark, part).coalesce(1).write.mode("append").parquet(src)
    assert max(c[1] for c in changes) < 1000
    frame(spark, [c for c in changes if c[1] >= 210] + [("/end", 100_000.0, 1)]).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schemas.FILE_CHANGES).option("maxFilesPerTrigger", 1).parquet(src)
    writer = debounce(stream).writeStream.format("memory").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp"))
    run_stream(writer, "debounced")
    got = [r for r in collected(spark.table("debounced")) if r[0] != "/end"]
    assert got == brute_force(changes, 2, 20)


def test_debounced_paths_share_few_calls(spark, tmp_path, monkeypatch):
    calls = spark.sparkContext.accumulator(0)
    handled = Debouncer.handleInputRows

    def counted(self, key, rows, timerValues):
        calls.add(1)
        yield from handled(self, key, rows, timerValues)

    monkeypatch.setattr(Debouncer, "handleInputRows", counted)
    src, n = str(tmp_path / "changes"), 2000
    # all paths change at 0 and 30, the odd ones at 1 and 31 too; the watermark passes the first changes only
    changes = [(f"/p{i}", float(t), i + t) for i in range(n) for t in (0, 1, 30, 31) if t in (0, 30) or i % 2]
    for part in ([c for c in changes if c[1] < 10], [c for c in changes if c[1] > 10], [("/end", 100_000.0, 1)]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(src)
        stable = debounce(spark.readStream.schema(schemas.FILE_CHANGES).parquet(src), buckets=8)
        writer = stable.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "cp"))
        writer.trigger(availableNow=True).start().awaitTermination()
    assert [r for r in collected(spark.read.parquet(str(tmp_path / "out"))) if r[0] != "/end"] == brute_force(changes, 2, 20)
    assert calls.value <= 3 * 8


def test_sessions_stream_and_batch(spark, tmp_path):
    rng = random.Random(1)
    rows, want = [], {}
    for u in range(6):
        t, start, n = 0.0, 0.0, 0
        for _ in range(200):
            rows.append((u, T0 + timedelta(seconds=t), 1.0))
            n += 1
            step = rng.choice([1, 5, 20, 59, 61, 4000])
            if step >= 60:
                want[(u, start)] = (t, n)
                start, n = t + step, 0
            t += step
        if n:
            want[(u, start)] = (t - step, n)
    df = spark.createDataFrame(rows, "u int, ts timestamp, v double")
    sec = lambda c: (F.unix_micros(c) / 1e6 - T0.timestamp()).alias(c)

    def as_dict(out):
        return {(r["u"], r["session_start"]): (r["session_end"], r["n_events"], r["total"])
                for r in out.select("u", sec("session_start"), sec("session_end"), "n_events", "total").collect()}

    expected = {k: (e, n, float(n)) for k, (e, n) in want.items()}
    for bucket in (30, 100_000):
        out = session_batch(df.repartition(8), "u", "ts", 60, bucket_seconds=bucket, total=("sum", "v"))
        assert as_dict(out) == expected
    end = spark.createDataFrame([(99, T0 + timedelta(days=900), 1.0)], df.schema)
    src = str(tmp_path / "ev")
    df.coalesce(1).write.parquet(src)
    end.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    writer = session_activity(stream, "u", "ts", 60, total=F.sum("v")).writeStream.format("memory").outputMode(
        "append").option("checkpointLocation", str(tmp_path / "cp"))
    run_stream(writer, "sessions")
    assert as_dict(spark.table("sessions").filter("u <> 99")) == expected


def test_change_stream_filters(spark, tmp_path):
    src = str(tmp_path / "c")
    rows = [("/w/a.txt", 1, 1, T0, True), ("/w/.h/a.txt", 1, 1, T0, True), ("/w/a.part", 1, 1, T0, True),
            ("/w/dir", 1, 1, T0, False), ("/other/a", 1, 1, T0, True)]
    spark.createDataFrame(rows, schemas.FILE_CHANGES).write.parquet(src)
    writer = change_stream(spark, src, ["/w"]).writeStream.format("memory").option("checkpointLocation", str(tmp_path / "cp"))
    run_stream(writer, "kept")
    assert [r["path"] for r in spark.table("kept").collect()] == ["/w/a.txt"]


def test_scan_stream(spark, tmp_path):
    docs, store = str(tmp_path / "docs"), str(tmp_path / "store")
    schema = "doc_id string, path string, size bigint, mtime bigint, text string, secrets_enabled boolean"
    batch = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(docs)
    clock = iter([1000, 2000, 3000])
    flags = spark.createDataFrame([("/skip", True)], "path string, ignored boolean")

    def go():
        stream = spark.readStream.schema(schema).parquet(docs)
        now = next(clock)
        run_stream(scan_stream(stream, store, clock=lambda: now, checkpoint=str(tmp_path / "cp"),
                               ignored_files=lambda: flags), "scan")

    assert read_log(spark, f"{store}/scans") is None
    batch(("1", "/a", 5, 1, "ann@shop.org", True), ("2", "/b", 5, 1, "nothing", True), ("3", "/skip", 5, 1, "ann@shop.org", True))
    go()
    batch(("1", "/a", 9, 2, "ann@shop.org bob@shop.org", True))
    go()
    scans = read_log(spark, f"{store}/scans").orderBy("scanned_at").collect()
    assert [(r["path"], r["scanned_at"], r["findings"][0]["count"]) for r in scans] == [("/a", 1000, 1), ("/a", 2000, 2)]
    files = {r["path"]: r for r in current_files(spark, store).collect()}
    assert set(files) == {"/a", "/b", "/skip"}
    assert (files["/a"]["first_seen_at"], files["/a"]["last_seen_at"], files["/a"]["size"]) == (1000, 2000, 9)
    reminders = {r["threshold"]: r["due_at"] for r in current_reminders(spark, store).collect()}
    assert reminders == {"24h": 1000 + 86400, "7j": 1000 + 7 * 86400, "30j": 1000 + 30 * 86400}
    events = read_log(spark, f"{store}/events")
    assert [r["event_type"] for r in events.collect()] == ["alert_created"] * 2
    # a snapshot changes nothing, and later batches go on from it
    rows = lambda df: sorted(map(str, df.collect()))
    before = rows(current_files(spark, store)), rows(current_reminders(spark, store))
    snapshot(spark, store)
    assert (rows(current_files(spark, store)), rows(current_reminders(spark, store))) == before
    batch(("4", "/new", 1, 1, "carl@shop.org", True), ("1", "/a", 11, 3, "nothing", True))
    go()
    files = {r["path"]: r for r in current_files(spark, store).collect()}
    assert set(files) == {"/a", "/b", "/skip", "/new"} and files["/a"]["size"] == 11 and files["/a"]["first_seen_at"] == 1000
    assert current_reminders(spark, store).count() == 6
    inputs = current_files(spark, store)._jdf.queryExecution().executedPlan().toString()
    assert "bigint) > 1)" in inputs  # the batches of the snapshot are not read


def test_live_files_go_through_the_same_routing_as_folders(spark, tmp_path):
    """Archives, DOCX, NUL in text files, names with glob characters, damaged and missing files."""
    root = tmp_path / "in"
    root.mkdir()
    good = make_zip([("a.txt", "ann@shop.org"), ("b.txt", "bob@shop.org " * 40)])
    at = good.find(b"b.txt") + 5
    content = {
        "plain.txt": "ann@shop.org é".encode(), "nul.txt": b"ann@shop.org\0", "nul.dat": b"ann@shop.org\0",
        "odd[1]{x}*.txt": b"eve@shop.org", "box.zip": good, "weak.zip": flagged(good),
        "broken.zip": good[:at] + bytes(b ^ 0x5A for b in good[at : at + 9]) + good[at + 9 :],
        "doc.docx": make_zip([("word/document.xml", "<w>dora@shop.org</w>")]), "scan.pdf": b"ann@shop.org",
    }
    for name, data in content.items():
        (root / name).write_bytes(data)
    changes, store = str(tmp_path / "changes"), str(tmp_path / "store")
    rows = [(str(root / n), len(b), 1) for n, b in content.items()] + [(str(root / "gone.txt"), 0, 1)]
    schema = "path string, size bigint, mtime bigint"
    spark.createDataFrame(rows, schema).write.parquet(changes)
    stream = spark.readStream.schema(schema).parquet(changes)
    writer = scan_file_stream(stream, store, checkpoint=str(tmp_path / "cp"), clock=lambda: 7, chunk=4)
    run_stream(writer, "files")
    name = lambda r: r["path"].rsplit("/", 1)[1]
    mails = lambda rows: {name(r): sum(f["count"] for f in r["findings"] or [] if f["category"] == "email") for r in rows}
    live = read_log(spark, f"{store}/scans").collect()
    assert mails(live) == {
        "plain.txt": 1, "nul.txt": 1, "odd[1]{x}*.txt": 1, "box.zip": 41, "weak.zip": 40, "broken.zip": 1, "doc.docx": 1,
    }
    folder = scan_files(spark, [str(root)]).collect()
    assert {k: v for k, v in mails(folder).items() if v} == mails(live)
    assert [name(r) for r in live if r["weak_zip_encryption"]] == ["weak.zip"]
    events = read_log(spark, f"{store}/events").filter("event_type = 'scan_error'").collect()
    assert {(name(r), r["error"]) for r in events} == {("gone.txt", "reason.notAFile"), ("broken.zip", "b.txt: unreadable")}
    assert current_files(spark, store).count() == len(rows)


def test_a_damaged_log_is_an_error(spark, tmp_path):
    (tmp_path / "log" / "batch=0").mkdir(parents=True)
    (tmp_path / "log" / "batch=0" / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception, match="parquet"):
        read_log(spark, str(tmp_path / "log")).collect()


def test_fleet_ingest(spark, tmp_path):
    src, store = str(tmp_path / "req"), str(tmp_path / "store")
    schema = ("authorization string, received_at bigint, file_id string, path string, risk_level string, "
              "risk_score bigint, types array<string>, last_seen_at bigint")
    rows = [("Bearer t1", t, f"f{t}", "/p", "low", 1, ["email"], t) for t in range(1, 6)] + [("Bearer no", 9, "x", "/p", "low", 1, [], 9)]
    spark.createDataFrame(rows, schema).write.parquet(src)
    devices = spark.createDataFrame([("d1", "pc", "t1", 1, 4, True, None)], schemas.DEVICES)
    run_stream(fleet_ingest(spark.readStream.schema(schema).parquet(src), store, lambda: devices, str(tmp_path / "cp")), "fleet")
    assert current_fleet_alerts(spark, store).count() == 3
    assert [r["file_id"] for r in current_fleet_alerts(spark, store, keep=1).collect()] == ["f3"]
    status = {r["status"]: r["n"] for r in read_log(spark, f"{store}/fleet_status").collect()}
    assert status == {"accepted": 3, "device_expired": 2, "unknown_token": 1}


def test_checkpoint_folder_comes_from_the_session(spark):
    assert checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_ways_agree(spark, how):
    left = spark.range(1000).selectExpr("id", "case when id % 3 = 0 then 0 else id % 50 end as k")
    right = spark.range(0, 40, 2).selectExpr("id as k", "id * 10 as v")
    small = lookup_join(left, right, ["k"], how)
    for hint in ("merge", "shuffle_hash"):
        other = lookup_join(left, right, ["k"], how, hint=hint)
        assert sorted(map(str, small.collect())) == sorted(map(str, other.select(*small.columns).collect()))
    assert "Broadcast" in small._jdf.queryExecution().executedPlan().toString()
