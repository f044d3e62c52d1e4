"""Rules, catalogs, locales and the labelled cases."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from sievelight.operators.builtin import with_builtin_hits
from sievelight.operators.evaluate import confusion, dedup_cases, evaluate_cases
from sievelight.operators.rules import (
    Rule,
    active_rules,
    compile_rules,
    detect_rules,
    field_pairs,
    locale_matches,
    validate_rule_regex,
    with_rule_hits,
)
from sievelight.sources.cases import read_labelled_cases
from sievelight.sources.catalog import load_rules, locale_candidates

CASES = os.path.join(os.path.dirname(__file__), "data", "labelled_cases.jsonl")


def test_labelled_cases(spark):
    cases = read_labelled_cases(spark, CASES)
    assert cases.count() == 52
    judged = evaluate_cases(cases, compile_rules(load_rules(spark, "fr")))
    assert [r["id"] for r in judged.filter("outcome in ('MISS', 'FALSE_POS')").collect()] == []
    counts = {r["target_type"]: (r["hit"], r["clean"]) for r in confusion(judged).collect()}
    assert len(counts) == 15
    assert counts["mac_address"] == (3, 3)


def test_a_case_runs_the_detectors_of_its_own_type(spark):
    text = "a@b.fr sid: abcdef 4111111111111111 key_x: one badge B7"
    rules = [Rule("badge", value_regex=r"\bB\d\b"), Rule("keyed", field_name_regex="^key_x$"), Rule("email", value_regex="sid")]
    types = ["email", "credit_card", "cookie", "phone", "badge", "keyed", "none", None]
    rows = [(i, t, text, s) for i, (t, s) in enumerate((t, s) for t in types for s in (True, False, None))]
    rows += [(90, "email", None, True), (91, "badge", "B7x", False), (92, "keyed", "key_x= 1", False)]
    cases = spark.createDataFrame(rows, "id int, target_type string, text string, should_detect boolean")
    judged = evaluate_cases(cases, rules)
    has = F.array_contains("detected", F.col("target_type"))
    want = F.when(F.col("should_detect") & has, "HIT").when(F.col("should_detect"), "MISS").when(has, "FALSE_POS").otherwise("CLEAN")
    assert judged.columns == [*cases.columns, "detected", "outcome"]
    assert judged.filter(~want.eqNullSafe(F.col("outcome"))).collect() == []
    assert {r["outcome"] for r in judged.collect()} == {"HIT", "MISS", "FALSE_POS", "CLEAN"}
    only = with_rule_hits(with_builtin_hits(cases, target="target_type"), rules, target="target_type")
    found = only.selectExpr("target_type as t", "transform(concat(hits, custom_hits), h -> h.category) as c").collect()
    assert all(set(r["c"]) <= {r["t"]} for r in found) and sum(bool(r["c"]) for r in found) == 10


def test_broken_case_line_fails(spark, tmp_path):
    path = tmp_path / "cases.jsonl"
    path.write_text('{"id": "a", "text": "x", "should_detect": true}\n{"id": \n')
    with pytest.raises(Exception, match="FAILFAST"):
        read_labelled_cases(spark, str(path)).collect()


def test_dedup_cases_first_wins(spark):
    rows = [("b", "t", "x", True, 2), ("a", "t", "x", True, 1), ("c", "t", "x", False, 0), ("d", "s", "x", False, 0)]
    df = spark.createDataFrame(rows, "id string, target_type string, text string, should_detect boolean, n int")
    assert [r["id"] for r in dedup_cases(df, "n").collect()] == ["d", "a", "c"]


PAIR = re.compile(r"([A-Za-z0-9_\-.]{2,80})\s*(?:[:=]|->)\s*([^\n\r]{1,300})", re.ASCII)


def test_generic_pairs_equal_the_plain_pattern(spark):
    rng = random.Random(7)
    alphabet = ["a", "B", "9", "_", "-", ".", ">", ":", "=", " ", "\n", "\r", "é", "->", "key", "x" * 79, "y" * 160, "v " * 170]
    samples = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    samples += ["a-->b", "foo->bar", "ab--->c", "x: y", "k" * 200 + "->v", "-" * 90 + "> z", "q" * 85 + "-> z"]
    df = spark.createDataFrame(list(enumerate(samples)), "id int, text string").repartition(8)
    for r in df.selectExpr("id", "text", f"{field_pairs('text')} as p").collect():
        want = [(m.group(1), m.group(2)) for m in PAIR.finditer(r["text"])]
        assert [(x["key"], x["value"]) for x in r["p"]] == want, repr(r["text"])


def test_pair_and_rule_caps(texts):
    lines = "\n".join(f"token: v{i}" for i in range(301))
    df = texts(lines, "x " * 400)
    rows = detect_rules(df, "text", "id", [Rule("r", field_name_regex="^token$"), Rule("x", value_regex="x")])
    counts = {(r["id"], r["category"]): r["count"] for r in rows.groupBy("id", "category").count().collect()}
    assert counts == {(0, "r"): 301, (1, "x"): 400}
    capped = detect_rules(df, "text", "id", [Rule("r", field_name_regex="^token$")], cap=250)
    assert capped.count() == 250


def test_rule_order_name_field_value(spark):
    df = spark.createDataFrame([(1, "/a/secret.txt", "code = 42\n99")], "id int, path string, text string")
    rule = Rule("r", filename_regex="secret", field_name_regex="code", value_regex=r"\d+")
    rows = detect_rules(df, "text", "id", [rule], "path").orderBy("pos").collect()
    assert [r["value"] for r in rows] == ["secret.txt", "42", "42", "99"]


@pytest.mark.parametrize(
    ("requirement", "locale", "expected"),
    [
        (None, "fr", True), ("", "fr", True), ("fr", "fr", True), ("fr", "fr_FR.UTF-8", True),
        ("FR", "fr-CA", True), ("en-US", "en-GB", False), ("en-US", "en_US@x", True),
        ("en-US", "en", False), ("gb", "en-GB", True), ("usa", "en-USA", True), ("fr", "en-FR", True),
        ("de", "fr", False), ("fr", "", False),
    ],
)
def test_locale_matches(spark, requirement, locale, expected):
    col = locale_matches(F.lit(requirement).cast("string"), locale)
    assert spark.range(1).select(col.alias("m")).first()["m"] is expected


def test_locale_candidates():
    assert locale_candidates("fr_FR.UTF-8") == ["fr_FR", "fr_fr", "fr"]
    assert locale_candidates("en-GB@euro") == ["en-GB", "en-gb", "en"]
    assert locale_candidates("") == []


def test_active_rules_by_locale(spark):
    rules = load_rules(spark, "fr_FR.UTF-8")
    names = lambda loc: {r["id"] for r in active_rules(rules, loc).collect()}
    common = {"mac_address", "organization", "bitcoin", "ethereum"}
    assert names("fr") == common | {"fr_nir", "fr_tva"}
    assert names("en-GB") == common | {"uk_nhs", "uk_nino"}
    assert "custom_test" not in names(None)
    assert rules.filter("id = 'custom_test'").first()["key_labels"] == ["mon_secret"]
    assert rules.filter("origin = 'standard/base'").count() == 27


def test_layers_last_writer_wins(spark, tmp_path):
    user = tmp_path / "user.yaml"
    user.write_text(
        '{"types": [{"id": "bitcoin", "risk_level": "critical", "category": "pii", "enabled": true, "value_regex": "coin"},'
        ' {"id": "badge", "risk_level": "low", "category": "pii", "enabled": true, "value_regex": "B[0-9]+",'
        ' "advanced": {"filename_keywords": [{"keyword": "k", "score": 3}]}}]}'
    )
    host = tmp_path / "host.yaml"
    host.write_text("not: [a catalog")
    with pytest.warns(UserWarning, match="host.yaml"):
        rules = load_rules(spark, "", user_file=str(user), host_file=str(host))
    got = {r["id"]: r for r in rules.collect()}
    assert (got["bitcoin"]["risk_level"], got["bitcoin"]["origin"]) == ("critical", "custom")
    assert got["badge"]["filename_keywords"] == {"k": 3}
    assert load_rules(spark, "", user_file=str(tmp_path / "absent.yaml")).count() == 27


def test_regex_validation(spark):
    assert validate_rule_regex(spark, " ") == "empty regex"
    assert "too long" in validate_rule_regex(spark, "a" * 513)
    assert validate_rule_regex(spark, "a" * 512) is None
    assert "alternatives" in validate_rule_regex(spark, "|".join("a" * 34))
    assert validate_rule_regex(spark, "|".join("a" * 33)) is None
    assert "invalid" in validate_rule_regex(spark, "(")
    layer = [("custom", [{"id": "broken", "risk_level": "low", "enabled": True, "value_regex": "["}])]
    with pytest.raises(ValueError, match="rule broken, value_regex"):
        compile_rules(load_rules(spark, "", layers=layer))


def test_query_validates_every_rule(spark, monkeypatch):
    """``checked`` stands in the rows of all rules, so all patterns are tried."""
    from checks import queries_stream

    tried = []
    monkeypatch.setattr(queries_stream, "validate_rule_regex", lambda _, pattern: tried.append(pattern))
    sf = "/root/testdata/sf0.001"
    queries_stream.rules_from_table(spark, sf)
    assert len(tried) == len(set(tried)) == spark.read.parquet(f"{sf}/part.parquet").select("p_brand").distinct().count() > 3
