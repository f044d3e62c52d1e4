"""The bucketed table of files: only touched buckets change, retries change nothing, and it agrees with the plain upsert."""

import pytest
from pyspark.sql import functions as F

from sievelight.operators import file_table as T
from sievelight.operators import store

SEEN = "path string, size long, mtime long, seen_at long"


def seen(spark, *rows):
    return spark.createDataFrame(list(rows), SEEN)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("path", "size", "mtime", "first_seen_at", "last_seen_at", "ignored", "deleted").collect())


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "files")


def test_agrees_with_the_plain_upsert_over_batches(spark, folder):
    batches = [
        [(f"/f{i}", i, 10, 100 + i) for i in range(300)],
        [("/f7", 70, 20, 500), ("/f7", 71, 20, 500), ("/new", 1, 1, 501), ("/f8", None, None, 502), (None, 1, 1, 1)],
        [("/f7", 1, 1, 50)],  # an older sighting: its values are taken, as the plain upsert takes them
    ]
    plain = None
    for n, b in enumerate(batches):
        T.update_files(spark, folder, n, seen=seen(spark, *b), buckets=16)
        good = seen(spark, *[r for r in b if r[0] is not None])
        plain = store.upsert_files(plain, good)
        plain = spark.createDataFrame(plain.collect(), plain.schema)
    assert rows_of(T.read_files(spark, folder)) == rows_of(plain)


def test_only_touched_buckets_are_written(spark, folder):
    T.update_files(spark, folder, 0, seen=seen(spark, *[(f"/f{i}", 1, 1, 1) for i in range(500)]), buckets=32)
    touched = T.update_files(spark, folder, 5, seen=seen(spark, ("/f3", 2, 2, 2)))
    assert len(touched) == 1
    by_batch = {r["batch"]: r["count"] for r in T.read_files(spark, folder, versions=True).groupBy("batch").count().collect()}
    assert set(by_batch) == {0, 5} and sum(by_batch.values()) == 500 and by_batch[5] < 60
    assert {k for k, b in T.bucket_versions(spark, folder).items() if b == 5} == set(touched)


def test_a_repeated_batch_changes_nothing(spark, folder):
    T.update_files(spark, folder, 0, seen=seen(spark, ("/a", 1, 1, 1)), buckets=4)
    T.update_files(spark, folder, 1, seen=seen(spark, ("/a", 2, 2, 2)))
    before = rows_of(T.read_files(spark, folder))
    assert T.update_files(spark, folder, 0, seen=seen(spark, ("/a", 1, 1, 1))) == []
    assert T.update_files(spark, folder, 1, seen=seen(spark, ("/a", 9, 9, 9))) == []
    assert rows_of(T.read_files(spark, folder)) == before


def test_an_unfinished_batch_is_not_read_and_is_written_anew(spark, folder, tmp_path):
    T.update_files(spark, folder, 0, seen=seen(spark, ("/a", 1, 1, 1), ("/b", 1, 1, 1)), buckets=2)
    T.update_files(spark, folder, 1, seen=seen(spark, ("/a", 2, 2, 2)))
    (tmp_path / "files" / "buckets-2" / "batch=1" / "_SUCCESS").unlink()
    assert {r[1] for r in rows_of(T.read_files(spark, folder))} == {1}
    T.update_files(spark, folder, 1, seen=seen(spark, ("/a", 3, 3, 3)))
    assert [r[:2] for r in rows_of(T.read_files(spark, folder))] == [("/a", 3), ("/b", 1)]


def test_flags_of_known_files(spark, folder):
    T.update_files(spark, folder, 0, seen=seen(spark, ("/a", 1, 1, 1), ("/b", 1, 1, 1)), buckets=8)
    flags = spark.createDataFrame(
        [("/a", True, None), ("/a", False, None), ("/b", None, True), ("/unknown", True, True)], "path string, ignored boolean, deleted boolean"
    ).select(store.file_id_of(F.col("path")).alias("file_id"), "ignored", "deleted")
    T.update_files(spark, folder, 1, flags=flags)
    assert [(r[0], r[5], r[6]) for r in rows_of(T.read_files(spark, folder))] == [("/a", True, False), ("/b", False, True)]
    # taken back; a sighting keeps flags; a flag without the other column
    T.update_files(spark, folder, 2, seen=seen(spark, ("/b", 5, 5, 5)), flags=flags.where("ignored = false").select("file_id", "ignored"))
    assert [(r[0], r[1], r[5], r[6]) for r in rows_of(T.read_files(spark, folder))] == [("/a", 1, False, False), ("/b", 5, False, True)]


def test_empty_tables(spark, folder):
    assert T.read_files(spark, folder).count() == 0
    assert T.read_files(spark, folder, versions=True).columns[-2:] == ["bucket", "batch"]
    assert T.update_files(spark, folder, 0, seen=seen(spark), buckets=4) == []
    assert T.finished_batches(spark, folder) == [0] and T.read_files(spark, folder).count() == 0
    assert T.drop_old_versions(spark, folder, 9) == 0
    with pytest.raises(ValueError):
        T.update_files(spark, folder, 1)


def test_number_of_buckets_is_fixed(spark, folder):
    T.update_files(spark, folder, 0, seen=seen(spark, ("/a", 1, 1, 1)), buckets=4)
    with pytest.raises(ValueError, match="4 buckets"):
        T.update_files(spark, folder, 1, seen=seen(spark, ("/a", 1, 1, 1)), buckets=8)


def test_old_versions_are_dropped_and_the_state_stays(spark, folder):
    T.update_files(spark, folder, 0, seen=seen(spark, *[(f"/f{i}", 1, 1, 1) for i in range(50)]), buckets=4)
    for n in (1, 2, 3):
        T.update_files(spark, folder, n, seen=seen(spark, ("/f1", n, n, n)))
    before = rows_of(T.read_files(spark, folder))
    assert T.drop_old_versions(spark, folder, 2) == 2  # the bucket of /f1 in batches 0 and 1; batch 2 is kept for readers
    assert rows_of(T.read_files(spark, folder)) == before
    assert T.drop_old_versions(spark, folder, 3) == 1
    assert T.drop_old_versions(spark, folder, 3) == 0
    assert rows_of(T.read_files(spark, folder)) == before
    assert T.finished_batches(spark, folder) == [0, 3]


def test_reading_a_bucket_opens_its_folder_only(spark, folder):
    T.update_files(spark, folder, 0, seen=seen(spark, *[(f"/f{i}", 1, 1, 1) for i in range(50)]), buckets=4)
    one = T.read_files(spark, folder, [1], versions=True)
    assert all("/bucket=1/" in f for f in one.inputFiles())
    assert [r[0] for r in one.select("bucket").distinct().collect()] == [1]
