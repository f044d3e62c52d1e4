"""Contextual entities, also against a direct reading of the rules in Python."""

import random
import re

import pytest

from sievelight.functions import fixed
from sievelight.operators.contextual import (
    EntitySetting,
    default_entities,
    detect_contextual,
    load_entities,
    split_indicators,
    with_contextual_hits,
)

ORG = re.compile(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:" + "|".join(fixed.ORG_SUFFIXES) + ")")
PATTERN = {"person": re.compile(fixed.PERSON), "organization": ORG, "location": re.compile(fixed.LOCATION)}


def expected(text, s):
    out = []
    for m in PATTERN[s.entity_type].finditer(text):
        v = m.group()
        if s.entity_type == "person" and v.startswith(tuple(fixed.NOT_A_NAME_STARTS)):
            continue
        if s.entity_type == "location" and any(w in v for w in fixed.NOT_A_PLACE_WORDS):
            continue
        ctx = text[: m.start()].split()[-5:] + text[m.end():].split()[:5]
        hits = lambda words: sum(any(p.lower() in w.lower() for p in words) for w in ctx)
        score = 0.5
        if s.positive is not None:
            score += min(hits(s.positive) * 0.1, 0.35)
        if s.negative is not None:
            score -= min(hits(s.negative) * 0.1, 0.25)
        if 5 <= len(v.encode()) <= 40:
            score += 0.1
        score = max(0.0, min(1.0, score))
        if s.entity_type == "organization" and v.endswith(tuple(fixed.ORG_BONUS_SUFFIXES)):
            score = min(score + 0.15, 1.0)
        if score >= s.threshold:
            at = len(text[: m.start()].encode())
            out.append((len(out), v, round(score, 9), at, at + len(v.encode())))
    return out


def entity(name, pos, neg, threshold):
    return EntitySetting(name, split_indicators(pos), split_indicators(neg), threshold)


def run(df, s):
    rows = detect_contextual(df, "text", "id", [s], spans=True).orderBy("id", "k").collect()
    out = {}
    for r in rows:
        out.setdefault(r["id"], []).append(
            (r["k"], r["value"], round(r["confidence"], 9), r["start_byte"], r["end_byte"])
        )
    return out


def test_known_cases(texts):
    df = texts("signed by John Smith for more information", "Company: Acme Corp Inc provides services", "Product Feature")
    person = entity("person", "contact,name,author,signed by", "product,feature", 0.60)
    assert run(df, person)[0] == [(0, "John Smith", 0.6, 10, 20)]
    assert [v[1] for v in run(df, entity("organization", "company,inc,ltd", "product", 0.70))[1]] == ["Acme Corp Inc"]
    assert 2 not in run(df, entity("person", "contact", "product,feature", 0.75))


def test_suffix_is_leftmost_alternative(texts):
    df = texts("Acme SARL", "Acme GmbHolding Inc", "Foo AcmeHolding Inc", "Acme Incredible Ltd x", "Acme Inc Foo")
    got = run(df, entity("organization", "zzz", None, 0.1))
    assert {i: [v[1] for v in vs] for i, vs in got.items()} == {
        0: ["Acme SA"], 1: ["Acme GmbH"], 2: ["Holding Inc"], 3: ["Acme Incredible Ltd"], 4: ["Acme Inc"],
    }


@pytest.mark.parametrize("name", ["person", "organization", "location"])
def test_random_texts(spark, name):
    rng = random.Random(3)
    words = ["John", "Smith", "Acme", "Inc", "Incredible", "SA", "SARL", "GmbH", "Gmb", "GmbHolding", "Ltd", "Ltdx", "The",
             "March", "city", "from", "(Paris", "London,Rome", "a-Big-Name", "é", "Éric", "\n", "  ", "product", "name:", "H",
             "McDonald", "street", "x y", "﷐Foo", "Bar﷑"]
    samples = [rng.choice(["", " "]) + " ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    samples += ["John" * 30 + "Smith", "", "word", "Paris-Rome-Oslo-Bern-Kyiv from the city"]
    df = spark.createDataFrame(list(enumerate(samples)), "id int, text string").repartition(8)
    s = entity(name, "name,city,from,street,inc", "product,the", 0.5)
    got = run(df, s)
    for i, text in enumerate(samples):
        assert got.get(i, []) == expected(text, s), repr(samples[i])


def test_long_capitalised_runs(texts):
    body = " ".join(["Word"] * 60_000)
    got = run(texts(body + " Ltd", body), entity("organization", "zzz", None, 0.1))
    assert [len(v[1]) for v in got[0]] == [60_000 * 5 + 3]
    assert 1 not in got
    place = run(texts(body), entity("location", "zzz", None, 0.1))
    assert place[0][0][4] == 60_000 * 5 - 1


def test_defaults_settings_table_and_hits(spark, texts):
    names = [e.entity_type for e in default_entities()]
    assert names == ["person", "organization", "location"]
    settings = spark.createDataFrame(
        [("organization", "contextual", True, ["company"], None, None), ("email", "pure", True, None, None, None),
         ("person", "contextual", False, None, None, 0.1)],
        "entity_type string, entity_category string, enabled boolean, positive array<string>, negative array<string>, threshold double",
    )
    loaded = load_entities(settings)
    assert [e.entity_type for e in loaded] == ["organization"]
    rows = with_contextual_hits(texts("the company Acme Ltd", None), loaded).orderBy("id").collect()
    assert [(h["category"], h["vals"]) for h in rows[0]["entity_hits"]] == [("organization", ["Acme Ltd"])]
    assert rows[1]["entity_hits"] == []
