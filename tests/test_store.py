"""Stored tables, alert lists and fleet operators on small tables."""

import pytest
from pyspark.sql import functions as F

from sievelight import schemas
from sievelight.functions import fixed
from sievelight.operators import alerts as A
from sievelight.operators import fleet, store

FIND = schemas.FINDINGS


def finding(c, n):
    return {"category": c, "count": n, "redacted_examples": []}


@pytest.fixture(scope="module")
def tables(spark):
    files = spark.createDataFrame(
        [("f1", "/a", 1, 1, 10, 20, False, False), ("f2", "/b", 1, 1, 10, 30, True, False),
         ("f3", "/c", 1, 1, 10, 40, False, True), ("f4", "/d", 1, 1, 10, 50, False, False),
         ("f5", "/e", 1, 1, 10, 60, False, False)],
        schemas.FILES,
    )
    def scan(i, f, at, level, score, found, custom=(), weak=False):
        return (i, f, "", at, level, score, weak, [], [finding(*x) for x in found], [finding(*x) for x in custom], "")

    scans = spark.createDataFrame(
        [scan("1", "f1", 5, "low", 3, [("email", 1)]), scan("2", "f1", 9, "high", 30, [("email", 2), ("iban", 2)], [("badge", 1)]),
         scan("3", "f1", 9, "medium", 12, [("email", 1), ("iban", 2)], [("badge", 3), ("zeta", 1)]),
         scan("4", "f2", 5, "critical", 90, [("secret", 9)]), scan("5", "f3", 5, "low", 2, [("email", 1)]),
         scan("6", "f4", 5, "low", 9, [("file_name_signal", 2)]), scan("7", "f5", 5, "high", 18, [(A.WEAK, 1)], weak=True)],
        schemas.SCANS,
    )
    return files, scans


def test_latest_scan_and_report(tables):
    files, scans = tables
    got = {r["file_id"]: r["scan_id"] for r in store.latest_scans(scans).collect()}
    assert got["f1"] == "3"
    row = store.latest_report(files, scans, "f1").first()
    assert (row["path"], row["risk_score"], row["last_seen_at"]) == ("/a", 12, 20)


def test_alerts_gate_and_order(tables):
    rows = A.latest_alerts(*tables).collect()
    assert [r["file_id"] for r in rows] == ["f2", "f5", "f1"]


def test_payload_types_and_summary(tables):
    files, scans = tables
    reports = store.files_with_latest_scan(files, scans)
    payload = {r["file_id"]: r["types"] for r in A.alert_payload(reports).collect()}
    assert payload["f1"] == ["email", "iban", "badge", "zeta"]
    weak = F.col("weak_zip_encryption")
    rows = {
        r["file_id"]: (r["s"], r["p"])
        for r in reports.select(
            "file_id",
            A.summarize_types(F.col("findings"), F.col("custom_findings"), weak).alias("s"),
            A.primary_type(F.col("findings"), weak).alias("p"),
        ).collect()
    }
    assert rows["f1"] == ("email (1), iban (2), badge (3), zeta (1)", "iban")
    assert rows["f4"] == ("", "file_name_signal")
    assert rows["f5"] == ("weak_archive_encryption, weak_archive_encryption (1)", "weak_archive_encryption")


def test_visible_alerts(spark, tables):
    local = A.latest_alerts(*tables)
    remote = spark.createDataFrame(
        [("d1", "pc", 100, "x", "/r", "critical", 80, ["badge"], 1), ("d2", "mac", 99, "y", "/s", "low", 1, [], 1),
         ("d1", "pc new", 101, "z", "/t", "high", 30, ["own"], 1)],
        schemas.FLEET_ALERTS,
    )
    ids = lambda **o: [r["file_id"] for r in A.visible_alerts(local, remote, **o).collect()]
    assert ids() == ["x", "z", "f5", "f1", "y"]
    assert ids(show_ignored=True)[:2] == ["x", "f2"]
    assert ids(sort="risk_asc") == ["y", "f1", "z", "f5", "x"]
    assert ids(sort="recent") == ["z", "x", "y", "f5", "f1"]
    assert ids(sort="type") == ["y", "x", "f1", "z", "f5"]
    assert ids(risks=["high"]) == ["z", "f5"]
    assert ids(types=["badge", "weak_archive_encryption"]) == ["x", "f5", "f1"]
    assert ids(device="local") == ["f5", "f1"]
    assert ids(device="d1") == ["x", "z"]
    with pytest.raises(ValueError):
        A.visible_alerts(local, sort="size")
    assert [r["type"] for r in A.type_options(local, remote).collect()] == ["badge", "own", "zeta"]
    names = A.device_options(remote, F.col("received_at")).collect()
    assert [(r["device_id"], r["device_name"]) for r in names] == [("d2", "mac"), ("d1", "pc new")]


def test_upsert_keeps_first_seen_and_flags(spark, tables):
    files, _ = tables
    seen = spark.createDataFrame([("/b", 7, 8, 100), ("/b", 9, 9, 90), ("/new", 1, 2, 50), ("/new", 3, 4, 60)],
                                 "path string, size bigint, mtime bigint, seen_at bigint")
    got = {r["path"]: r for r in store.upsert_files(files, seen).collect()}
    assert len(got) == 6
    b, n = got["/b"], got["/new"]
    assert (b["file_id"], b["size"], b["mtime"], b["first_seen_at"], b["last_seen_at"], b["ignored"]) == ("f2", 7, 8, 10, 100, True)
    assert (n["size"], n["first_seen_at"], n["last_seen_at"], n["ignored"], n["deleted"]) == (3, 50, 60, False, False)
    assert len(n["file_id"]) == 64


def test_reminders(spark, tables):
    files, _ = tables
    alerted = files.select("file_id")
    empty = spark.createDataFrame([], schemas.REMINDERS)
    first = store.schedule_reminders(empty, alerted.filter("file_id < 'f4'"), F.lit(1000))
    again = store.schedule_reminders(first, alerted, F.lit(9000))
    due = {(r["file_id"], r["threshold"]): r["due_at"] for r in again.collect()}
    assert len(due) == 15
    assert due[("f1", "24h")] == 1000 + 86400 and due[("f1", "7j")] == 1000 + 7 * 86400
    assert due[("f4", "30j")] == 9000 + 30 * 86400
    now = 9000 + 86400
    # f2 is ignored, f3 deleted
    assert {r["file_id"] for r in store.due_reminders(again, files, now).collect()} == {"f1", "f4", "f5"}
    inventory = spark.createDataFrame([("/a",), ("/e",)], "path string")
    events, sent, after = store.send_reminders(again, files, inventory, now)
    assert {(r["event_type"], r["file_id"]) for r in events.collect()} == {("reminder_due", "f1"), ("reminder_due", "f5")}
    assert sent.filter("sent_at is not null").count() == 3
    assert {r["file_id"] for r in after.filter("deleted").collect()} == {"f3", "f4"}
    assert store.due_reminders(sent, after, now).count() == 0


def test_flags_and_insert_or_ignore(spark, tables):
    files, _ = tables
    changes = spark.createDataFrame([("f1", True), ("f2", False)], "file_id string, ignored boolean")
    assert {r["file_id"] for r in store.set_ignored(files, changes).filter("ignored").collect()} == {"f1"}
    old = spark.createDataFrame([("a", 1)], "k string, n int")
    new = spark.createDataFrame([("a", 0), ("b", 5), ("b", 4)], "k string, n int")
    assert sorted(tuple(r) for r in store.insert_or_ignore(old, new, ["k"], "n").collect()) == [("a", 1), ("b", 4)]


def test_json_round_trip_and_retired_categories(spark, tables, tmp_path):
    _, scans = tables
    out = store.encode_scan_json(scans).select("scan_id", store.decode_findings(F.col("findings_json")).alias("f"))
    assert {r["scan_id"]: len(r["f"]) for r in out.collect()}["3"] == 2
    bad = spark.createDataFrame([("nope",), (None,), ("[]",)], "j string")
    assert [r[0] for r in bad.select(store.decode_findings(F.col("j"))).collect()] == [[], [], []]
    old, new = fixed.SUGGESTION_REPAIRS[0]
    changed = scans.withColumn("suggestion", F.when(F.col("scan_id") == "4", old).otherwise("x")).withColumn(
        "findings", F.when(F.col("scan_id") == "5", F.array_append("findings", F.struct(
            F.lit("rcu_id").alias("category"), F.lit(1).cast("bigint").alias("count"),
            F.array().cast("array<string>").alias("redacted_examples")))).otherwise(F.col("findings")))
    got = {r["scan_id"]: r for r in store.drop_removed_categories(changed).collect()}
    assert set(got) == {"4", "5"}
    assert got["4"]["suggestion"] == new
    assert [f["category"] for f in got["5"]["findings"]] == ["email"]
    store.append_scans(scans, str(tmp_path / "s"), "1")
    store.append_scans(scans, str(tmp_path / "s"), "1")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 7


def test_authorize_order(spark):
    devices = spark.createDataFrame(
        [("d1", "a", "t1", 1, 100, True, None), ("d2", "b", "t2", 1, 100, False, None), ("d3", "c", "t3", 1, 50, True, 60)],
        schemas.DEVICES,
    )
    asked = spark.createDataFrame(
        [(1, "Bearer t1", 99), (2, "Bearer t1", 100), (3, "Bearer t2", 200), (4, " Bearer t3 ", 49), (5, "t1", 1), (6, None, 1), (7, "Bearer x", 1)],
        "id int, authorization string, received_at bigint",
    )
    for hint in (None, "merge", "broadcast"):
        judged = fleet.authorize_alerts(asked, devices, F.col("received_at"), hint=hint)
        got = {r["id"]: r["status"] for r in judged.collect()}
        assert got == {1: "accepted", 2: "device_expired", 3: "device_disabled", 4: "accepted", 5: "missing_token",
                       6: "missing_token", 7: "unknown_token"}
    seen = fleet.device_last_seen(devices, judged.filter("status = 'accepted'"))
    assert {r["device_id"]: r["last_seen_at"] for r in seen.collect()} == {"d1": 99, "d2": None, "d3": 60}


def test_fleet_limits(spark):
    rows = spark.range(600).selectExpr("'d' as device_id", "cast(id as string) as file_id", "id as received_at")
    assert fleet.fleet_alerts_top(rows, 3).count() == 3
    assert fleet.fleet_alerts_top(rows, 9999).count() == 600
    assert fleet.fleet_retention(rows).count() == 600
    assert fleet.fleet_alerts_top(rows).first()["received_at"] == 599
    assert fleet.fleet_retention(rows, 10).agg(F.min("received_at")).first()[0] == 590
