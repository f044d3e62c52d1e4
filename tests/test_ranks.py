import random

import pytest
from pyspark.sql import functions as F

from sievelight.operators.ranks import page, with_places


@pytest.mark.parametrize("parts", [1, 7])
def test_places_against_plain_sort(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([None, rng.randint(0, 40), 5]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "v int, id int").repartition(parts).selectExpr("*", "'k' as _at", "0 as RANK")
    got = with_places(df.orderBy(F.desc_nulls_last("v"), "id"))
    assert got.columns == ["v", "id", "_at", "rank"]
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r.v, r.id) for r in sorted(got.collect(), key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 3001))
    assert sorted(r.id for r in page(got, 3, 100).collect()) == sorted(i for _, i in want[200:300])


def test_empty_order(spark):
    df = spark.createDataFrame([], "v int").orderBy("v")
    assert with_places(df).collect() == [] and page(with_places(df), 1, 10).collect() == []
