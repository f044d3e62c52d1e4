import random

import pytest
from pyspark.sql import functions as F

from sievelight.operators.builtin import HITS_TYPE
from sievelight.operators.findings import with_risk
from sievelight.operators.merge import merge_findings, merge_matches
from sievelight.operators.rules import Rule

RULES = [Rule("badge", "critical"), Rule("alpha", "low")]
SCHEMA = f"path string, part int, weak boolean, hits {HITS_TYPE}, custom_hits {HITS_TYPE}"


def reports(df, **options):
    found = with_risk(df, RULES, custom_hits="custom_hits", **options)
    rows = found.select("path", "weak", "findings", "custom_findings", "reasons", "risk_score", "risk_level").collect()
    return sorted(rows, key=lambda r: (r.path is not None, r.path or ""))


def both(spark, rows):
    parts = spark.createDataFrame(rows, SCHEMA)
    one = reports(merge_matches(parts.withColumns({c: F.coalesce(c, F.array().cast(HITS_TYPE)) for c in ("hits", "custom_hits")}), "path", "part", "weak"))
    two = reports(merge_findings(parts, "path", "part", "weak"), summarized=True)
    assert one == two
    return two


def test_same_reports_as_from_all_values(spark):
    rng = random.Random(5)
    value = lambda: rng.choice(["a@b.example", "0123456789abcdef0123456789abcdef", "x", "", "long value of many words"])
    values = lambda: [value() for _ in range(rng.randint(1, 8))]
    rows = [
        (
            rng.choice(["/big.zip"] * 9 + ["/b.zip", "/c.zip", None]), i, rng.random() < 0.01,
            [(c, values()) for c in ("email", "cookie", "user_id", "iban") if rng.random() < 0.3],
            [(c, values()) for c in ("badge", "alpha") if rng.random() < 0.2],
        )
        for i in range(400)
    ]
    got = both(spark, rows)
    assert len(got) == 4 and max(f["count"] for r in got for f in r.findings) > 300


def test_empty_null_and_tied_parts(spark):
    email = [("email", ["a@b.example", "c@d.example"])]
    rows = [("/a", 1, False, [], []), ("/b", 1, True, None, None), ("/c", None, None, email, []), ("/c", 3, False, email, []), ("/c", 3, False, email, [])]
    got = both(spark, rows)
    assert [(r.path, len(r.findings), r.weak) for r in got] == [("/a", 0, False), ("/b", 0, True), ("/c", 1, False)]
    assert got[2].findings[0]["count"] == 6 and len(got[2].findings[0].redacted_examples) == 5
    assert both(spark, []) == []


def test_few_rows_of_a_category_are_shuffled(spark):
    merged = merge_findings(spark.createDataFrame([("/a", 1, True, [("email", ["a@b.example"])], [])], SCHEMA), "path", "part")
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("examples", [1, 3])
def test_examples(spark, examples):
    parts = spark.createDataFrame([("/a", i, False, [("email", [f"u{i}@b.example"] * 2)], []) for i in range(9)], SCHEMA)
    (row,) = merge_findings(parts.repartition(5), "path", "part", examples=examples).collect()
    (whole,) = merge_findings(parts, "path", "part", examples=99).collect()
    assert row.hits[0].redacted_examples == whole.hits[0].redacted_examples[:examples] and row.hits[0]["count"] == 18
