import random
import re

import pytest
from pyspark.sql import functions as F

from sievelight.catalog import shipped
from sievelight.functions import fixed
from sievelight.functions.patterns import Refused, quick_start, safe_pattern
from sievelight.functions.sql import NO_STRINGS, lit
from sievelight.operators.rules import Rule, detect_rules, validate_rule_regex

REWRITTEN = [
    (r"(?:\w|\s)+;", r"(?:(?<![\w\s])|\G)[\w\s]+;"),
    (r"(?:a|[0-9]|\.|-)+@", r"(?:(?<![a[0-9]\.\-])|\G)[a[0-9]\.\-]+@"),
    (r"(?i)\w{2,}=x", r"(?i)(?:(?<!\w)|\G)\w{2,}=x"),
    (r"(?:[a-z]+ )+;", r"(?:(?<![a-z])|\G)(?:[a-z]+ )++;"),
    (r"(?i)\b(?:foo|bar)+\d", r"(?i)\b(?:foo|bar)++\d"),
    (r"x(?:ab)*", r"x(?:ab)*+"),
    (r"(?:ab)*c?", r"(?:ab)*+c?"),
    (r"\Qa+\E(?:b|c){300}", r"a\+[bc]{300}"),
    (r"(?:(?:a|bc){150}d){150}", r"(?:(?:a|bc){150}+d){150}"),
]
KEPT = [
    r"a+ab", r"a*b", r"a+", r"a+\b", r"(?:ab|c)?d", r"(\d{3}-){5}", r"([ab])\1+", r"x(?:a+b)++c", "(", ")", "[a", "a|b", r"^\s*$", r"(?=a|b)c", r"[]a]b*", r"(?<n>x)y",
    r"(?:x|y){2,100}z",
]
REFUSED = [
    r"(a+)+b", r"(?:ab|a)*c", r"(?:x y)+\b", r"(?:\d{3},)*\d{3}", r"(?:a*)*b", r"(?:(a)\1)+", r"(?:ab)+?", r"(?:.|\n)*x", r"(?:ab)+a",
    r"(?:é|ñx)+a", r"(?x)(?: a b)+", r"(?:(?:a|ab){20}){20}",
]


@pytest.mark.parametrize("pattern, want", REWRITTEN)
def test_rewritten(pattern, want):
    assert safe_pattern(pattern) == want


@pytest.mark.parametrize("pattern", KEPT)
def test_kept(pattern):
    assert safe_pattern(pattern) == pattern


@pytest.mark.parametrize("pattern", REFUSED)
def test_refused(pattern):
    with pytest.raises(Refused):
        safe_pattern(pattern)


def test_shipped_patterns_are_safe():
    rules = [*shipped.BASE_RULES, *(r for rows in shipped.LOCALE_RULES.values() for r in rows)]
    patterns = [p for r in rules for p in r[4:] if p]
    assert len(patterns) == 18 and [safe_pattern(p) for p in patterns] == patterns


def random_pattern(rng, depth=0):
    def atom():
        return rng.choice(["a", "b", "c", "[ab]", "[^a]", r"\d", "1", "."])

    out = []
    for _ in range(rng.randint(1, 3)):
        if depth < 2 and rng.random() < 0.5:
            inner = "|".join(random_pattern(rng, depth + 1) for _ in range(rng.randint(1, 2)))
            out.append(f"(?:{inner})" + rng.choice(["", "+", "*", "?", "{2}", "{1,300}"]))
        else:
            out.append(atom() + rng.choice(["", "", "+", "*", "?"]))
    return "".join(out)


def test_rewritten_patterns_find_the_same():
    """All matches of random patterns, as they are and rewritten, on random texts."""
    rng, changed = random.Random(4), 0
    for _ in range(4000):
        pattern = random_pattern(rng)
        try:
            safe = safe_pattern(pattern)
        except Refused:
            continue
        if safe == pattern:
            continue
        try:
            safe = safe.split("|\\G)", 1)[-1]  # where to start: see the next test
            old, new = re.compile(pattern), re.compile(re.sub(r"\[((?:[abc1.]|\\d|\[\^?\w+\])+)\](?=[+*{])", _plain_union, safe))
        except re.error:
            continue
        changed += 1
        for _ in range(15):
            text = "".join(rng.choice("abc1\n") for _ in range(rng.randint(0, 12)))
            assert [m.span() for m in old.finditer(text)] == [m.span() for m in new.finditer(text)], (pattern, safe, text)
    assert changed > 100


def test_runs_start_where_they_did(spark):
    """Spark's engine finds the same with and without the condition where a run starts."""
    rng, pairs = random.Random(8), {}
    while len(pairs) < 60:
        pattern = random_pattern(rng)
        try:
            safe = safe_pattern(pattern)
        except Refused:
            continue
        if "\\G" in safe and "300" not in pattern:
            pairs[pattern] = safe
    rows = [("".join(rng.choice("abc1") for _ in range(rng.randint(0, 14))),) for _ in range(300)]
    df = spark.createDataFrame(rows, "text string")
    found = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    differ = [F.count_if(~found(a).eqNullSafe(found(b))).alias(str(i)) for i, (a, b) in enumerate(pairs.items())]
    assert sum(df.agg(*differ).first()) == 0


def _plain_union(m):
    """A class with classes in it, as alternatives, for an engine without unions."""
    parts = re.findall(r"\[\^?\w+\]|\\d|.", m[1])
    return "(?:" + "|".join(parts) + ")" if any(len(p) > 2 for p in parts) else m[0]


def test_a_million_characters(spark):
    texts = ["ab cd1 " * 150_000 + ";", "ab cd " * 170_000 + ";", "x" * 1_000_000, "ab " * 2_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rules = [Rule("mixed", value_regex=r"(?:\w|\s)+;"), Rule("words", value_regex=r"(?:[a-z]+ )+;"), Rule("no", value_regex=r"(?:x|y)+;")]
    got = detect_rules(df, "text", "id", rules).select("id", "category", F.length("value").alias("n")).collect()
    assert sorted((r.id, r.category, r.n) for r in got) == [
        (0, "mixed", len(texts[0])), (1, "mixed", len(texts[1])), (1, "words", len(texts[1])),
    ]


def test_refused_rules_are_named(spark, texts):
    assert "unsafe regex: repeated group (?:...)*" in validate_rule_regex(spark, r"(?:ab|a)*c")
    assert validate_rule_regex(spark, r"(?:\w|\s)+;") is None
    with pytest.raises(ValueError, match="rule bad: unsafe regex"):
        detect_rules(texts("a"), "text", "id", [Rule("bad", value_regex="(a+)+b")])
    assert len(fixed.CATEGORIES) > 5


@pytest.mark.parametrize("pattern, want", [
    (r"(?i)\bDE\d{9}\b", r"(?i)(?=DE\d)\bDE\d{9}\b"),
    (r"\b(?:x[_\s-]*api|-)k", r"(?=[\-x][[_\s-]ak])\b(?:x[_\s-]*api|-)k"),
    (r"\b(?:\d[ -]?){13,19}\b", r"(?=\d)\b(?:\d[ -]?){13,19}\b"),
    *[(p, p) for p in (r"\ba|b", r"\b.x", r"\b\d?", r"\b(a", r"\b(a)\1", r"\b(?=x)a", r"\b+a", "a", r"(?x)\b a")],
])
def test_first_characters_are_tested_before_a_word_boundary(pattern, want):
    assert quick_start(pattern) == want


def test_quick_start_finds_the_same(spark):
    rng = random.Random(11)
    plain = [fixed.EMAIL, fixed.PHONE, fixed.IBAN, fixed.CARD, fixed.ID_KV, fixed.SECRET_KV, fixed.BEARER, fixed.GUID, fixed.JWT,
             fixed.ADDRESS_KV, fixed.POSTAL_KV, fixed.BIRTH_DATE, fixed.DEVICE_HINT, r"(?i)\b(?:sik|k-|[s-u]x?)\b", r"\b\Q-]\Ea",
             *[r[5] for r in [*shipped.BASE_RULES, *shipped.LOCALE_RULES["fr"]]]]
    pieces = ["user id", "uſer ıd: ", "SID", "ſid", "K", "k-", "sİk", ": abcdefgh", "= ", "-> ", "a", "é", "\u0301", "_", " ", "\n", "٣", "12", "4539 1488 0343 6467",
              "DE4", "FR12", "0x", "bc1", "-]a", "@", "a.b@c.de", "token", "Bearer ", "adresse: 12 rue x y", "plz: 12345", "dob 01/02/1990", "eyJabcdefghijk.abcdefghijk.abcdefghijk"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    for u in ("", "(?U)"):
        pairs = [(lit(u + p), lit(u + quick_start(p))) for p in plain]
        same = " and ".join(f"coalesce(regexp_extract_all(text, {a}, 0), {NO_STRINGS}) = regexp_extract_all(text, {b}, 0)" for a, b in pairs)
        assert df.where(f"not ({same})").collect() == []
