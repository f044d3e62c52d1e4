import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievelight.functions.literals import folded, needed_literals
from sievelight.operators.rule_index import split_rules, with_indexed_rule_hits
from sievelight.operators.rules import Rule, with_rule_hits
from sievelight.sources.catalog import load_rules


@pytest.mark.parametrize(
    ("pattern", "needed"),
    [
        ("badge", {"badge"}), (r"\bBadge-\d+\b", {"badge-"}), ("(?i)Wert|Preis", {"wert", "preis"}), ("ab|cde", set()), ("x(?:abc|defg)+y", {"abc", "defg"}),
        ("(?:abc)?defg", {"defg"}), ("ab+cde", {"bcde"}), ("abcd*ef", {"abc"}), ("a{3}", set()), ("abc{0}d", set()), (r"\d{4}", set()), ("(abc)(def)", {"abcdef"}),
        (r"\Qa.b\E", {"a.b"}), (r"(?=abcd)\w+", set()), (r"(?!abcd)xyz", {"xyz"}), ("[a]bcd", {"bcd"}), ("a.bcd", {"bcd"}), (r"abc\Rdefg", {"defg"}), ("preßx", {"pre"}),
        (r"(abcd)\1", set()), (r"(?:abc){2,3}", {"abc"}), ("(?:abc|)", set()), ("(", set()), ("", set()), (r"a\.b\wcde", {"a.b"}), ("(?i:ABC)", {"abc"}), (r"abc^def", {"abcdef"}),
    ],
)
def test_needed_literals(pattern, needed):
    assert needed_literals(pattern) == needed


def test_folding_covers_case_insensitive_matches(spark):
    """Any character that the engine takes for an ASCII letter is folded to it."""
    every = spark.range(1, 0x11000).where("id not between 55296 and 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    for letter in "iks":
        for (c,) in every.where(F.expr(rf"c rlike '(?iU){letter}'")).collect():
            assert letter in folded(c), (letter, c)


RULES = [
    Rule("badge", value_regex=r"(?i)badge \d{3}"),
    Rule("any_number", value_regex=r"\d{2}"),
    Rule("two", value_regex="abc|xyz+"),
    Rule("Field", field_name_regex="^token$"),
    Rule("name", filename_regex="csv$", value_regex="abc"),
    Rule("kelvin", value_regex="(?i)kisser"),
    Rule("zero", value_regex="(?:abc)?(?=xyz)"),
]


def same(df, rules, **options):
    a = with_rule_hits(df, rules, **options).collect()
    b = with_indexed_rule_hits(df, rules, **options).collect()
    assert a == b
    return b


def test_same_rows_as_one_by_one(spark):
    texts = [None, "", "Badge 123 badge 45", "token: abc xyzz", "Kißer KIſſER kisser", "abcxyz 12 34 56", "x" * 100_000 + "abc" * 1000]
    rows = [(i, t, n) for i, t in enumerate(texts) for n in (None, "a/b.csv")] * 2
    df = spark.createDataFrame(rows, "id int, text string, path string")
    got = same(df, RULES, name_col="path")
    assert [h.category for h in got[6].custom_hits] == ["Field", "name", "two", "zero"]
    assert same(df, RULES, name_col="path", cap=1, unicode=False)
    assert same(df, RULES[:1]) and same(df, RULES[3:4], name_col="path") and same(df, [])
    assert same(df.where("false"), RULES) == []


def test_catalog_rules_find_the_same(spark):
    catalog = load_rules(spark, "fr").collect()
    rules = [Rule(r.id, value_regex=r.value_regex) for r in catalog if r.value_regex]
    rng = random.Random(3)
    words = "FR76 mac 3c:07:54:1b:9e:10 vat DE123456789 nir 188888888888888 carte badge matricule 12345678 salaire".split()
    df = spark.createDataFrame([(i, " ".join(rng.choices(words, k=30))) for i in range(50)], "id int, text string")
    assert any(r.custom_hits for r in same(df, rules))


def test_plan_does_not_grow_with_the_rules(spark):
    df = spark.createDataFrame([(1, "code 0777 and code 0778, code 07771")], "id int, text string")
    plans = []
    for n in (1_000, 5_000):
        rules = [Rule(f"r{i:05}", value_regex=rf"code {i:04}\b") for i in range(n)]
        found = with_indexed_rule_hits(df, rules)
        plans.append(len(found._jdf.queryExecution().optimizedPlan().toString()))
        assert [(h.category, h.vals) for h in found.first().custom_hits] == [("r00777", ["code 0777"]), ("r00778", ["code 0778"])]
    assert abs(plans[0] - plans[1]) < 100


def test_refusals(spark):
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    with pytest.raises(ValueError, match="repeat"):
        with_indexed_rule_hits(df, [Rule("a", value_regex="abc")] * 2)
    with pytest.raises(ValueError, match="max_bytes"):
        with_indexed_rule_hits(df, [Rule("a", value_regex="abcdef")], max_bytes=10)
    with pytest.raises(ValueError, match="unsafe"):
        with_indexed_rule_hits(df, [Rule("a", value_regex="abc(a+)+b")])


def test_rules_without_a_needed_string():
    by_index, rest = split_rules(RULES)
    assert [r.name for r in by_index] == ["badge", "two", "kelvin"]
    assert [r.name for r in rest] == ["any_number", "Field", "name", "zero"]


@settings(max_examples=200, deadline=None)
@given(st.text("abcAB|()?*+.", max_size=12), st.text("abcAB", max_size=12))
def test_each_match_holds_a_needed_string(pattern, text):
    import re

    try:
        found = re.search(pattern, text)
    except (re.error, RecursionError):
        return
    needed = needed_literals(pattern, shortest=1)
    assert not found or not needed or any(n in folded(found[0]) for n in needed)
