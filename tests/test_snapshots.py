"""Snapshots of the stored files, and logs that shrink."""

import os

from sievelight.streaming.pipeline import _log, current_files, snapshot


def test_batches_behind_a_snapshot_are_dropped(spark, tmp_path):
    store = str(tmp_path / "store")

    def seen(batch, *rows):
        _log(spark.createDataFrame(list(rows), "path string, size long, mtime long, seen_at long"), f"{store}/files", batch)

    def files():
        return sorted((r["path"], r["size"], r["first_seen_at"], r["last_seen_at"]) for r in current_files(spark, store).collect())

    def folders(name):
        return sorted(n for n in os.listdir(f"{store}/{name}") if not n.startswith((".", "_")))

    snapshot(spark, store, drop=True)  # nothing there
    for n in range(3):
        seen(n, ("/a", n, n, 10 + n), (f"/f{n}", 1, 1, 10 + n))
    before = files()
    snapshot(spark, store)
    snapshot(spark, store)  # no new batch
    assert files() == before and len(folders("files")) == 3
    snapshot(spark, store, drop=True)
    assert files() == before and folders("files") == ["batch=2"]
    seen(2, ("/a", 2, 2, 12), ("/f2", 1, 1, 12))  # the newest batch is retried
    seen(3, ("/f0", 5, 5, 13))
    want = sorted([r for r in before if r[0] != "/f0"] + [("/f0", 5, 10, 13)])
    assert files() == want
    snapshot(spark, store, drop=True)
    assert files() == want and folders("files") == ["batch=3"] and folders("files_snapshots") == ["upto-3"]
