import random

import pytest
from helpers import lowered, roots, sample_documents, simhash
from pyspark.sql import functions as F

from sievelight.llm import simhash as op
from sievelight.llm.components import components

FIELDS = "doc_id long, text string"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def bits(a, b):
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


@pytest.mark.parametrize("text", [None, "", "  ", "A", "a B", "a b c", "a b c a b c", "É é x Y", "w " * 3000])
def test_fingerprint(text):
    assert op.fingerprint(text) == signed(simhash(text))


def test_links_connect_what_is_in_reach(spark):
    rng = random.Random(5)
    values = {0, 1, 3, 7, (1 << 64) - 1, 1 << 63, (1 << 63) + 1}
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(rng.choice((1, 2, 9))):
            value = base
            for _ in range(rng.randint(0, 3)):
                value ^= 1 << rng.randrange(64)
            values.add(value)
    values = [signed(v) for v in values]
    fps = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, fp long")
    for most in (0, 1, 2):
        got = {r.fp: r.component for r in op.classes(fps, "doc_id", most).collect()}
        want = roots(range(len(values)), lambda a, b: bits(values[a], values[b]) <= most)  # noqa: B023
        assert got == {values[i]: r for i, r in want.items()}
    with pytest.raises(ValueError):
        op.linked(fps.select("fp"), 3)


def test_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(5, 5), (7, 6)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(1, 200)}}


def grouped(rows):
    fps = {i: signed(simhash(t)) for i, t in rows}
    return fps, roots(sorted(fps), lambda a, b: bits(fps[a], fps[b]) <= 2)


def test_whole_table_against_brute_force(spark):
    rows = [(r[0], r[1]) for r in sample_documents()]
    got = op.near_duplicates(spark.createDataFrame(rows, FIELDS)).collect()
    fps, want = grouped(rows)
    assert {r.doc_id: r.fp for r in got} == fps
    assert {r.doc_id: r.component for r in got} == want


def test_nulls_repeats_and_other_columns(spark):
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (2, "A b c D"), (None, "q r s t u"), (9, None), (8, "")]
    df = spark.createDataFrame(rows, FIELDS).selectExpr("*", "1 as fp", "2 as component", "3 as first", "4 as _hash")
    got = op.near_duplicates(df)
    assert got.columns == ["doc_id", "fp", "component"] and got.count() == 7
    by = {(r.doc_id, r.component) for r in got.collect()}
    assert by == {(None, 2), (4, 2), (2, 2), (None, None), (9, 8), (8, 8)}
    kept = op.first_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in kept.collect() if r.doc_id) == [
        (False, 2, "A b c D"), (False, 8, ""),
    ]
    assert kept.where("doc_id is null").count() == 1
    empty = df.where(F.lit(False))
    assert op.near_duplicates(empty).count() == op.first_of_each(empty).count() == 0


def test_frequent_fingerprints_are_looked_up_in_place(spark, monkeypatch):
    rows = [(i, f"w{i} x{i} y{i} z{i}") for i in range(50)] + [(100 + i, "a b c d") for i in range(200)] + [(None, "q r s"), (None, "q r s")]
    df = spark.createDataFrame(rows, FIELDS)
    want = {(r.doc_id, r.component) for r in op.near_duplicates(df).collect()}
    monkeypatch.setattr(op, "_OFTEN", 3)
    found = op.near_duplicates(df).collect()
    assert {(r.doc_id, r.component) for r in found} == want and len(found) == len(rows)
    assert {(r.doc_id, r.component) for r in found if r.doc_id and r.doc_id >= 100} == {(100 + i, 100) for i in range(200)}


def test_lower_case_is_ascii_only():
    assert op.fingerprint("ÀB c d") == op.fingerprint("Àb C D") != op.fingerprint("àb c d")
    assert lowered("ÀB") == "Àb"
