import random

import numpy as np
import pytest
from helpers import kept_words, sample_documents, words

from sievelight.llm import substrings as op

FIELDS = "doc_id long, text string"


def done(spark, rows, parts=4, **more):
    return op.remove_repeated_passages(spark.createDataFrame(rows, FIELDS).repartition(parts), **more)


def check(spark, rows, width=13, parts=4):
    got = {r.doc_id: r for r in done(spark, rows, parts, width=width).collect()}
    want = kept_words(dict(rows), width)
    for key, text in rows:
        assert words(got[key].text) == want[key]
        assert got[key].n_words == len(words(text))
        assert got[key].n_removed == len(words(text)) - len(want[key])


@pytest.mark.parametrize("parts", [1, 5])
def test_sample_against_brute_force(spark, parts):
    check(spark, [(r[0], r[1]) for r in sample_documents()], parts=parts)


@pytest.mark.parametrize("seed", range(4))
def test_random_texts_of_few_words(spark, seed):
    """Few words make every window frequent and anchors tie; shuffled ids mix the order."""
    rng = random.Random(seed)
    some = "ab" if seed % 2 else "abcdefgh"
    ids = rng.sample(range(1000), 60)
    pool = [" ".join(rng.choice(some) for _ in range(40)) for _ in range(5)]
    rows = []
    for i in ids:
        text = " ".join(rng.choice(some) for _ in range(rng.randint(0, 30)))
        if rng.random() < 0.6:
            p = rng.choice(pool).split()
            a = rng.randint(0, 20)
            text += " " + " ".join(p[a : a + rng.randint(10, 20)]) + " " + text[:9]
        rows.append((i, text))
    check(spark, rows, width=13 if seed < 2 else 6, parts=3)


def test_passage_in_many_documents(spark):
    """A passage that all documents share, in copies and in ever new surroundings."""
    passage = " ".join(f"p{i}" for i in range(15))
    rows = [(i, f"x{i} y{i} {passage} z{i % 7}") for i in range(400)]
    check(spark, rows, parts=2)
    check(spark, rows, parts=6)


def test_frequent_anchor_in_new_blocks(spark):
    """Five frequent words with other words around, more often than a batch counts as frequent."""
    rng = random.Random(2)
    middle = "m1 m2 m3 m4 m5"
    side = lambda: " ".join(rng.choice("abc") for _ in range(8))
    check(spark, [(i, f"{side()} {middle} {side()}") for i in range(500)], parts=3)


def test_layout_of_kept_text_stays():
    text = " a  b\nc\td e "
    assert op.cut(text, [], []) == text
    assert op.cut(text, [2], [1]) == "a  b d e"
    assert op.cut(text, [0, 3], [2, 2]) == "c"
    assert op.cut(text, [0], [5]) == ""


def test_factors_are_maximal_runs():
    first, size = op.factors(np.array([0, 1, 5, 11, 30, 31]), 6)
    assert first.tolist() == [0, 30] and size.tolist() == [17, 7]
    assert [v.tolist() for v in op.factors(np.array([], dtype=int), 6)] == [[], []]


def test_factors_of_documents(spark):
    """A factor runs on over what two documents hold, and the text between factors is in none."""
    a, b = (" ".join(f"{c}{i}" for i in range(20)) for c in "ab")
    rows = [(1, a), (2, b), (3, f"x {a} y {b[:40]}"), (3, f"{a} {b}"), (4, "x " + a), (5, None)]
    got = op.repeated_factors(spark.createDataFrame(rows + rows[2:3], FIELDS)).collect()
    assert sorted((r.doc, list(zip(r.starts, r.lengths))) for r in got) == [(3, [(0, 40)]), (3, [(1, 20)]), (4, [(0, 21)])]


def test_nulls_repeats_and_clashing_names(spark):
    long = " ".join(map(str, range(20)))
    rows = [(None, long), (3, long), (3, long), (2, None), (1, ""), (None, long + " x")]
    df = spark.createDataFrame(rows, FIELDS).selectExpr("*", "'k' as N_WORDS", "1 as _doc", "2 as other", "3 as mark", "4 as row", "5 as zip", "6 as starts")
    got = op.remove_repeated_passages(df)
    assert got.columns == ["doc_id", "text", "_doc", "other", "mark", "row", "zip", "starts", "n_words", "n_removed"]
    assert got.where("_doc <> 1 or other <> 2 or mark <> 3 or row <> 4 or zip <> 5 or starts <> 6").count() == 0
    found = sorted((r.doc_id or 99, r.text, r.n_removed) for r in got.where("text is not null").collect())
    assert found == [(1, "", 0), (3, long, 0), (3, long, 0), (99, "", 20), (99, "x", 20)]
    assert [tuple(r)[8:] for r in got.where("doc_id = 2").collect()] == [(0, 0)]
    assert op.remove_repeated_passages(df.where("false")).count() == 0
