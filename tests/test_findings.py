"""Findings, scores, levels, redaction, reveal, ignore list, rewriting."""

import re

import pytest
from pyspark.sql import functions as F

from sievelight.functions.redaction import redact
from sievelight.operators.findings import risk_level, with_risk
from sievelight.operators.ignore import apply_ignored_values, mark_ignored, unmark_ignored
from sievelight.operators.reveal import (
    reveal_pairs,
    revealed_report,
    trim_reveal_hits,
    trim_reveal_pairs,
)
from sievelight.operators.rewrite import neutralize, write_neutralized
from sievelight.operators.rules import Rule
from sievelight.plans.scan import scan, signals_only
from sievelight.sources.tables import scan_table_text

HITS = "array<struct<category:string,vals:array<string>>>"


@pytest.mark.parametrize(
    ("score", "max_rank", "high", "level"),
    [
        (9, 3, 2, "low"), (10, 3, 2, "medium"), (24, 3, 2, "medium"), (25, 3, 2, "high"),
        (54, 3, 2, "high"), (55, 3, 2, "critical"), (55, 3, 1, "high"), (55, 2, 2, "high"),
        (90, 1, 0, "medium"), (90, 0, 0, "low"),
    ],
)
def test_risk_level(spark, score, max_rank, high, level):
    row = spark.range(1).selectExpr(f"{risk_level(str(score), str(max_rank), str(high))} as l").first()
    assert row["l"] == level


def scored(spark, hits, custom=(), rules=(), **cols):
    row = {"hits": [{"category": c, "vals": v} for c, v in hits],
           "custom_hits": [{"category": c, "vals": v} for c, v in custom],
           "bonus": 0, "weak": False, **cols}
    df = spark.createDataFrame([row], f"hits {HITS}, custom_hits {HITS}, bonus bigint, weak boolean")
    return with_risk(df, rules, custom_hits="custom_hits", bonus="bonus", weak_zip="weak").first()


@pytest.mark.parametrize(("count", "score"), [(1, 2), (21, 42), (22, 42)])
def test_count_is_capped_at_21(spark, count, score):
    assert scored(spark, [("email", ["a@b.cc"] * count)])["risk_score"] == score


def test_hash_discount_is_integer(spark):
    h = "0123456789abcdef" * 2
    assert scored(spark, [("cookie", [h])])["risk_score"] == 2
    assert scored(spark, [("user_id", [h])])["risk_score"] == 1
    assert scored(spark, [("cookie", [h, "plain1"])])["risk_score"] == 4
    assert scored(spark, [("cookie", [h, "plain1", "plain2"])])["risk_score"] == 12
    # all values count
    assert scored(spark, [("cookie", ["plain1"] * 6 + [h] * 30)])["risk_score"] == 2 * 21
    assert scored(spark, [("cookie", [h] * 10 + ["plain1"] * 11)])["risk_score"] == 4 * 21
    keys = [r["key"] for r in scored(spark, [("email", ["a"]), ("user_id", [h])])["reasons"]]
    assert keys == ["reason.categoryCount", "reason.hashLike", "reason.categoryCount"]


def test_rules_score_and_levels(spark):
    rules = [Rule("nir", "critical", value_regex="x"), Rule("tva", "high", value_regex="x")]
    row = scored(spark, [], [("nir", ["1"] * 21), ("other", ["2"]), ("tva", ["3"])], rules)
    assert row["risk_score"] == 10 * 20 + 4 + 7
    assert row["risk_level"] == "critical"
    assert row["reasons"][1]["vars"] == {"category": "other", "count": "1", "risk": "medium"}
    assert row["custom_findings"][0]["redacted_examples"] == ["*"] * 5
    assert scored(spark, [], [("nir", ["1"] * 21)], rules)["risk_level"] == "high"


def test_weak_archive_counts_as_two_high_types(spark):
    row = scored(spark, [("weak_archive_encryption", ["ZipCrypto"])], weak=True, bonus=40)
    assert row["risk_score"] == 8 + 10 + 40
    # built-ins never exceed high
    assert row["risk_level"] == "high"
    rules = [Rule("nir", "critical", value_regex="x")]
    row = scored(spark, [("weak_archive_encryption", ["ZipCrypto"])], [("nir", ["1"] * 9)], rules, weak=True)
    assert row["risk_level"] == "critical"
    assert [r["key"] for r in row["reasons"]] == [
        "reason.categoryCount", "reason.weakZipEncryption", "reason.customCategoryCount",
    ]


@pytest.mark.parametrize(
    ("category", "value", "masked"),
    [
        ("email", "johnny@x.org", "joh***@x.org"), ("email", "a@b@cdefg", "a@b@cd***"), ("email", "j@x.org", "j***@x.org"),
        ("phone", "06 12 34 57 89", "06 ** ** ** 89"), ("phone", "1234", "****"), ("phone", "1-2-3-4-5", "1-2-*-4-5"),
        ("iban", "de89 3704 0044 0532 0130 00", "DE89" + "*" * 15 + "000"), ("iban", "ab12c", "AB12*"),
        ("credit_card", "4539148803436467", "*" * 12 + "6467"), ("ip_address", "172.15.0.1", "172.15.***"),
        ("address", "12 rue Victor", "12 rue Vic***"), ("postal_code", "75001", "75***"),
        ("date_of_birth", "1990-03-1", "1990*****"), ("cookie", "abcd", "****"), ("cookie", "abcde", "*bcde"),
        ("user_id", "", "*"), ("secret", "éàüöß", "*àüöß"), ("file_name_signal", "client_secret", "client_secre*"),
        ("weak_archive_encryption", "ZipCrypto", "ZipCrypto"), ("some_rule", "123456", "**3456"),
    ],
)
def test_redaction(spark, category, value, masked):
    df = spark.createDataFrame([(category, value)], "c string, v string")
    assert df.selectExpr(f"{redact('c', 'v')} as r").first()["r"] == masked


def test_reveal_limits(spark):
    hits = [("email", 120), ("cookie", 100), ("phone", 250), ("iban", 150), ("secret", 100), ("address", 60)]
    data = [{"category": c, "vals": [f"{c}{i}" for i in range(n)]} for c, n in hits]
    df = spark.createDataFrame([(1, data)], f"id int, hits {HITS}")
    trimmed = {h["category"]: len(h["vals"]) for h in df.selectExpr(f"{trim_reveal_hits('hits', 100, 500)} as h").first()["h"]}
    # 560 after the first cut: address gives all 60
    assert trimmed == {"email": 100, "cookie": 100, "phone": 100, "iban": 100, "secret": 100, "address": 0}
    flat = [(1, c, i, f"{c}{i}") for c, n in hits for i in range(n)]
    pairs = spark.createDataFrame(flat, "id int, category string, pos bigint, clear string")
    long = {r["category"]: r["count"] for r in trim_reveal_pairs(pairs, "id", 100, 500).groupBy("category").count().collect()}
    assert long == {c: n for c, n in trimmed.items() if n}
    assert {h["category"]: len(h["vals"]) for h in df.selectExpr(f"{trim_reveal_hits('hits')} as h").first()["h"]} == dict(hits)
    assert trim_reveal_pairs(pairs, "id").count() == sum(n for _, n in hits)


def test_a_rule_named_like_a_category_is_masked_as_a_rule(spark):
    matches = spark.createDataFrame(
        [(1, "builtin", "phone", 0, "0612345678"), (1, "custom", "phone", 0, "EMP-0612345")],
        "id int, scope string, category string, pos bigint, value string",
    )
    got = {r["scope"]: r["redacted"] for r in reveal_pairs(matches).collect()}
    assert got == {"builtin": "06******78", "custom": "*******2345"}
    pairs = reveal_pairs(matches)
    marked = mark_ignored(None, spark.createDataFrame([("phone", "EMP-0612345")], "category string, value string"), "s", 1)
    assert [r["scope"] for r in revealed_report(pairs, marked, "s").collect()] == ["builtin"]


def test_every_value_is_neutralised(spark):
    from sievelight.operators.builtin import with_builtin_hits

    text = " ".join(f"user{i}@shop.org" for i in range(300))
    done = neutralize(with_builtin_hits(spark.createDataFrame([(1, text)], "doc_id int, text string"))).first()
    assert done["replaced_total"] == 300
    assert not re.search(r"user\d", done["redacted_text"])


def test_ignored_values(spark):
    matches = spark.createDataFrame(
        [(1, "builtin", "email", 0, "Ann@Shop.org"), (1, "builtin", "phone", 0, "06 12"), (1, "custom", "email", 0, "ann@shop.org"),
         (1, "builtin", "user_id", 0, "ann@shop.org")],
        "id int, scope string, category string, pos bigint, value string",
    )
    values = spark.createDataFrame([("email", " ann@shop.ORG "), ("phone", "0-6-1-2")], "category string, value string")
    marked = mark_ignored(None, values, "s", 5)
    again = mark_ignored(marked, values, "s", 9)
    assert {r["created_at"] for r in again.collect()} == {5}
    for hint in (None, "merge"):
        kept = apply_ignored_values(matches, again, "s", hint=hint)
        assert {(r["scope"], r["category"]) for r in kept.collect()} == {("custom", "email"), ("builtin", "user_id")}
    assert unmark_ignored(again, values, "s").count() == 0
    assert apply_ignored_values(matches, again, "other salt").count() == 4


def test_neutralize(spark, tmp_path):
    text = "mail ann@shop.org and ann@shop.org.uk; pwd=12345678 12345678; card 4539 1488 0343 6467"
    df = spark.createDataFrame([(1, "/a/x.txt", text), (2, "/a/x.pdf", text), (3, "/a/y.log", "nothing")], "doc_id int, path string, text string")
    from sievelight.operators.builtin import with_builtin_hits

    done = neutralize(with_builtin_hits(df), path_col="path").orderBy("doc_id")
    rows = done.collect()
    # the longer address goes first; cards are stored as digits, so the spaced form stays
    assert rows[0]["redacted_text"] == (
        "mail ann***@shop.org and ann***@shop.org.uk; pwd=****5678 ****5678; card 4539 1488 0343 6467"
    )
    assert rows[0]["replaced_total"] == 4
    assert rows[1]["redacted_text"] is None
    assert (rows[2]["redacted_text"], rows[2]["replaced_total"]) == ("nothing", 0)
    write_neutralized(done, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_scan_gate_and_file_rules(spark):
    rows = [
        (1, "/a/cv.txt", "nothing"), (2, "/a/iban rib.txt", "nothing"), (3, "/a/x.txt", "ann@shop.org"),
        (4, "/a/export.ics", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dozjgNryP4J3jVmNHl0w5N"),
    ]
    corpus = scan_table_text(spark.createDataFrame(rows, "id int, path string, text string"), "id", "text", path_col="path")
    rules = [Rule("exports", "low", filename_regex="export", value_regex="zzz")]
    kept = {r["doc_id"]: r for r in signals_only(scan(corpus, rules=rules)).collect()}
    assert set(kept) == {2, 3, 4}
    assert kept[2]["risk_score"] == 12 + 3 * 2
    assert [f["count"] for f in kept[4]["custom_findings"]] == [1]
    twice = {r["doc_id"]: r for r in scan(corpus, rules=rules, compat=True).collect()}
    assert [f["count"] for f in twice[4]["custom_findings"]] == [2]
    technical = corpus.withColumn("secrets_enabled", F.col("ext") != "ics")
    found = {r["doc_id"]: [f["category"] for f in r["findings"]] for r in scan(technical).collect()}
    assert found[4] == ["file_name_signal"]


def test_scan_runs_without_a_shuffle(spark):
    corpus = scan_table_text(spark.range(10).selectExpr("id", "cast(id as string) as t"), "id", "t")
    plan = scan(corpus)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count(r"{1,64}@") == 1


def test_risk_overview(spark):
    from sievelight.operators.builtin import HITS_TYPE
    from sievelight.operators.findings import risk_overview

    rows = [
        (1, "a", [("email", ["x", "y"]), ("iban", ["z"])]), (2, "a", [("email", ["x"])]), (3, None, [("email", ["x"])]), (4, "b", []), (5, "b", None),
    ]
    df = spark.createDataFrame(rows, f"doc_id int, source string, hits {HITS_TYPE}")
    got = {(r.level, r.source, r.category): (r.matches, r.docs) for r in risk_overview(df, "source").collect()}
    assert got == {
        ("source_category", "a", "email"): (3, 2), ("source_category", "a", "iban"): (1, 1), ("source_category", None, "email"): (1, 1),
        ("source", "a", None): (4, 2), ("source", None, None): (1, 1), ("category", None, "email"): (4, 3), ("category", None, "iban"): (1, 1),
        ("total", None, None): (5, 3),
    }
    assert risk_overview(df.where("size(hits) = 0"), "source").count() == 0
