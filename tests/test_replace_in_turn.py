import random

import pytest
from checks.registry import QUERIES
from checks import queries_store  # noqa: F401
from sievelight.operators.builtin import with_builtin_hits
from sievelight.operators.rewrite import neutralize, replace_in_turn


def one_by_one(text, pairs):
    n = 0
    for old, new in pairs:
        n += text.count(old)
        text = text.replace(old, new)
    return text, n


@pytest.mark.parametrize("seed", range(6))
def test_same_as_one_after_the_other(seed):
    r = random.Random(seed)
    word = lambda low, high, letters="abé*": "".join(r.choice(letters) for _ in range(r.randint(low, high)))
    for _ in range(600):
        text = word(0, 60)
        pairs = [(word(1, 6), word(0, 5)) for _ in range(r.randint(1, 12))]
        pairs.sort(key=lambda p: -len(p[0].encode()) if seed % 2 else 0)
        assert replace_in_turn(text, pairs) == one_by_one(text, pairs), (text, pairs)


def test_many_values_are_not_read_one_by_one():
    values = [f"user{k}@shop{k % 7}.org" for k in range(40_000)]
    text, n = replace_in_turn(" ".join(values), [(v, "use***@" + v.split("@")[1]) for v in sorted(values, key=len, reverse=True)])
    assert n == 40_000 and "user" not in text and text.count("use***@shop") == 40_000


def test_texts_with_few_and_many_values_and_null(spark):
    few, many = "ada7@bell.org and carl8@dell.org", " ".join(f"user{k}@shop.org" for k in range(100))
    rows = spark.createDataFrame([(0, few), (1, many), (2, None), (3, "none")], "id int, text string")
    got = {r.id: (r.redacted_text, r.replaced_total) for r in neutralize(with_builtin_hits(rows)).collect()}
    assert got[1][1] == 100 and "user1" not in got[1][0]
    assert got[0][1] == 2 and got[2][0] is None and got[3] == ("none", 0)


def test_neutralize_many_holds_all_customers_in_three_texts(spark, tmp_path):
    spark.range(900).selectExpr("id as c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    rows = QUERIES["neutralize_many"](spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.replaced_total, r.clear) for r in rows} == {0: (300, 0), 1: (300, 0), 2: (300, 0)}
