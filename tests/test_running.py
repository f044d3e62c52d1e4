"""Running totals over keys that cross partitions, against plain sums."""

import random

import pytest
from pyspark.sql import functions as F

from sievelight.operators.reveal import trim_reveal_pairs
from sievelight.operators.running import running_totals
from sievelight.sources.archives import zip_budget
from sievelight.sources.sheets import sheet_cells_to_text


@pytest.fixture
def many_partitions(spark):
    """Sorts into eight partitions, however small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_against_plain_sums(many_partitions):
    rng = random.Random(1)
    keys = ["hot"] * 300 + [None] * 40 + [f"k{i}" for i in range(60) for _ in range(rng.randrange(1, 4))]
    rng.shuffle(keys)
    rows = [(k, i, rng.choice([None, *range(5)])) for i, k in enumerate(keys)]
    df = many_partitions.createDataFrame(rows, "k string, i long, _at long")
    got = running_totals(df, ["k"], [F.col("i").desc()], n=F.lit(1), total=F.col("_at"))
    assert got.columns == ["k", "i", "_at", "n", "total"]
    want, seen = {}, {}
    for k, i, v in sorted(rows, key=lambda r: -r[1]):
        n, t = seen.get(k, (0, 0))
        want[i] = seen[k] = (n + 1, t + (v or 0))
    assert {r["i"]: (r["n"], r["total"]) for r in got.collect()} == want


def test_a_hot_key_is_worked_on_by_many_tasks(many_partitions):
    df = many_partitions.range(4000).select(F.lit("one").alias("k"), "id")
    got = running_totals(df, ["k"], ["id"], n=F.lit(1))
    assert got.filter(F.col("n") != F.col("id") + 1).count() == 0
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert got.count() == 4000 and max(sizes) < 4000


def test_ties_repeats_and_empty_tables(many_partitions):
    df = many_partitions.createDataFrame([("a", 1)] * 5 + [("b", 1)], "k string, i int")
    got = running_totals(df, ["k"], ["i"], n=F.lit(1)).collect()
    assert sorted((r["k"], r["n"]) for r in got) == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("a", 5), ("b", 1)]
    assert running_totals(df.limit(0), ["k"], ["i"], n=F.lit(1)).count() == 0
    again = running_totals(df.withColumn("n", F.lit(7)), ["k", "i"], ["n"], N=F.col("n"))
    assert again.columns == ["k", "i", "N"] and again.agg(F.max("N")).first()[0] == 35


def test_one_archive_and_one_sheet_with_most_rows(many_partitions):
    rng = random.Random(2)
    entries = [("big" if i % 10 else f"s{i}", i, rng.randrange(1, 9), i % 7 == 0) for i in range(600)]
    df = many_partitions.createDataFrame(entries, "path string, part int, size long, encrypted boolean")
    kept, seen = [], {}
    for path, part, size, enc in entries:
        n, total = seen.get(path, (0, 0))
        seen[path] = n, total = n + 1, total + (0 if enc else size)
        if n <= 400 and total <= 1200 and size <= 7 and not enc:
            kept.append(part)
    got = zip_budget(df, max_entries=400, max_total_bytes=1200, max_entry_bytes=7)
    assert got.columns == df.columns and sorted(r["part"] for r in got.collect()) == kept

    cells = [("f", i // 200, f"n{i // 200}", i, 0, rng.choice(["abc", "é", None])) for i in range(600)]
    sheets = many_partitions.createDataFrame(cells, "path string, sheet_no int, sheet string, row int, col int, value string")
    texts = {r["sheet_no"]: r["text"] for r in sheet_cells_to_text(sheets, max_bytes=900).collect()}
    want, left, stopped = {}, 900, False
    for _, no, name, row, _, value in cells:
        head = f"sheet:{name}\n" if row % 200 == 0 else ""
        if stopped or (head and left <= 0 and not no == 0):
            break
        line = "" if value is None else value + "\n"
        need = len((head + line).encode())
        if head:
            want[no] = head
        if need > left:
            stopped = True
        else:
            want[no] += line
            left -= need
    assert texts == want


def test_pairs_of_one_document(many_partitions):
    rng = random.Random(4)
    rows = [("d" if i % 5 else "e", rng.choice("abc"), i) for i in range(500)]
    got = trim_reveal_pairs(many_partitions.createDataFrame(rows, "id string, category string, pos int"), "id", 100, 150)
    want = []
    for doc in "de":
        mine = sorted(r for r in rows if r[0] == doc)
        top = [r for c in "abc" for r in [x for x in mine if x[1] == c][:100]]
        order = sorted(top, key=lambda r: (r[1], -r[2]))
        want += order[max(0, len(order) - 150):]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_rows_are_made_once(many_partitions):
    made = many_partitions.sparkContext.accumulator(0)

    @F.udf("long")
    def costly(i):
        made.add(1)
        return i

    rows = many_partitions.range(500).select(costly("id").alias("i"), (F.col("id") % 3).alias("k"))
    assert running_totals(rows, ["k"], ["i"], n=F.lit(1)).agg(F.sum("n")).first()[0] == 2 * sum(range(168)) + sum(range(167))
    assert made.value == 500
