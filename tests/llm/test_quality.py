import math
import random
import re

import numpy as np
import pytest
from helpers import sample_documents, words
from pyspark.sql import functions as F

from sievelight.llm import quality_model, quality_rules

FIELDS = "doc_id long, text string, lang string"


# --- rules


def counted(text):
    found = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = [tuple(found[i : i + 8]) for i in range(len(found) - 7)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return (
        len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)), len(hit), len(lines), sum(c.isupper() for c in text or ""),
    )


TEXTS = [
    None, "", " \n ", "a", "A b\nA b\n\nA b ", "x " * 30, "a b c d e f g h " * 3 + "i", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8",
    "#a *b $c %d &e |f <g>  x y É😀", "a b c d e f g a b c d e f g", "w\r\nw\r\n",
]


def test_counts(spark):
    texts = TEXTS + [r[1] for r in sample_documents() if len(r[1] or "") < 3000]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], FIELDS)
    for r in quality_rules.text_counts(df).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines, r.n_capitals)
        assert got == counted(texts[r.doc_id]), texts[r.doc_id]


def tail(n, k, p):
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))


def test_binomial_tail(spark):
    rng = random.Random(2)
    cases = [(n, k) for n in (1, 5, 40, 700, 30_000, 2_000_000) for k in {0, 1, int(n * 0.005), int(n * 0.012), rng.randint(0, n)} if k <= n]
    df = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.0125).alias("p"))
    for r in df.collect():
        want = tail(r.n, r.k, 0.0125) if r.k < r.n * 0.0125 else 1.0
        assert r.p == pytest.approx(want, rel=1e-8, abs=1e-300)


def test_verdicts_against_plain_python(spark):
    """Cutoffs chosen again in Python from the same labels."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(2600):
        bad = rng.random() < 0.25
        text = " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(20, 40)))
        if bad or rng.random() < 0.001:
            text = " ".join(w + "%" * rng.randint(1, 4) for w in text.split())
        rows.append((i, text, rng.choice(["a", "a", "a", "b"]) if i % 50 else None))
        if i % 3:
            labels.append((i, int(not bad)))
    got = quality_rules.quality_rules(
        spark.createDataFrame(rows, FIELDS), spark.createDataFrame(labels, "doc_id long, quality int")
    ).collect()
    quality, rules, grid = dict(labels), quality_rules.RULES, quality_rules.GRID
    rate = lambda r: {
        "symbols": r.n_symbols / r.word_chars, "capitals": r.n_capitals / r.word_chars,
        "lines": r.n_dup_lines / r.n_lines, "repeats": r.n_repeat_words / r.n_words,
    }
    lang = {r[0]: r[2] or "" for r in rows}
    strata, cuts = sorted(set(lang.values())), {}
    for s in strata:
        for rule in rules:
            mine = [(rate(r)[rule], quality[r.doc_id]) for r in got if lang[r.doc_id] == s and r.doc_id in quality and not r.base_failed]
            good, bad = [v for v, q in mine if q], [v for v, q in mine if not q]
            best = (0.0, None)
            for c in grid:
                k = sum(v > c for v in good)
                p = tail(len(good), k, 0.05 / 4) if k < len(good) * 0.05 / 4 else 1.0
                if p > 0.05 / 4 / len(strata):
                    break
                gain = (sum(v > c for v in bad) / len(bad) if bad else 0) - 20 * k / len(good)
                if gain > best[0] + 1e-12:
                    best = (gain, c)
            cuts[s, rule] = best[1]
    assert cuts["a", "symbols"] is not None and cuts["", "symbols"] is None
    for r in got:
        broken = any(cuts[lang[r.doc_id], k] is not None and v > cuts[lang[r.doc_id], k] for k, v in rate(r).items())
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and not broken)


def strata_of_few_labels():
    """Strata with 400, 130, 90 and 60 good labels; some good documents repeat a line."""
    rng = random.Random(6)
    rows, labels = [], []
    for lang, n in (("a", 400), ("b", 130), ("c", 90), ("d", 60)):
        for i in range(3 * n):
            text = " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randint(20, 40)))
            bad = i % 10 == 9
            if bad:
                text = " ".join(w + "%" * rng.randint(1, 4) for w in text.split())
            elif rng.random() < 0.04:
                text = "so it is\n" * 2 + text
            rows.append((len(rows), text, lang))
            if bad and i % 20 == 9 or not bad and sum(q for x, q, _ in labels if rows[x][2] == lang) < n:
                labels.append((len(rows) - 1, int(not bad), 0))
    return rows, labels


def test_joint_cutoffs_of_small_strata(spark):
    rows, labels = strata_of_few_labels()
    docs = spark.createDataFrame(rows, FIELDS)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, known, joint=True).collect()}
    for lang in "abcd":
        junk = [kept[i] for i, t, x in rows if x == lang and "%" in t]
        clean = [kept[i] for i, t, x in rows if x == lang and "%" not in t]
        assert all(clean) and any(junk) == all(junk) == (lang == "d")


def test_joint_cutoffs_against_plain_python(spark):
    rows, labels = strata_of_few_labels()
    rows = [(i, t.replace("%", "") if i % 7 == 0 else t + " %%%%" if i % 31 == 0 else t, x) for i, t, x in rows]
    counts = quality_rules.text_counts(spark.createDataFrame(rows, FIELDS), keep=("lang",)).cache()
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["_stratum"]: r for r in quality_rules.joint_cutoffs(counts, known, "lang").collect()}
    quality, grid = {i: q for i, q, _ in labels}, quality_rules.GRID
    rate = lambda r: [r.n_symbols / r.word_chars, r.n_capitals / r.word_chars, r.n_dup_lines / r.n_lines, r.n_repeat_words / r.n_words]
    found = counts.where(~quality_rules.base_failed()).collect()
    for lang in "abcd":
        mine = [(rate(r), quality.get(r.doc_id)) for r in found if r.lang == lang]
        of = lambda q: [v for v, x in mine if x == q]  # noqa: E731, B023
        good, bad, other = of(1), of(0), of(None)
        ranks = []
        for rule in range(4):
            for at, c in enumerate(grid):
                b, u = (sum(v[rule] > c for v in vs) for vs in (bad, other))
                if b:
                    ranks.append((-(b / len(bad) * (len(other) + 1) / (u + 0.5)), at, rule))
        vector, best, gain = [None] * 4, [None] * 4, 0.0
        for _, at, rule in sorted(ranks):
            vector[rule] = min(vector[rule] or 1, grid[at])
            k, b = (sum(any(c is not None and x > c for x, c in zip(v, vector, strict=True)) for v in vs) for vs in (good, bad))
            if k >= len(good) * 0.05 or tail(len(good), k, 0.05) > 0.05 / 4:
                break
            if b / len(bad) - 20 * k / len(good) > gain + 1e-12:
                gain, best = b / len(bad) - 20 * k / len(good), list(vector)
        assert [got[lang][f"_c_{n}"] if lang in got else None for n in quality_rules.RULES] == best, lang


def test_risk_holds_on_new_documents(spark):
    """Good documents that were not labelled are rejected no more often than the risk allows."""
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice(["word", "Word", "w%"]) if rng.random() < 0.1 else "plain" + str(rng.random()) for _ in range(40))
    rows = [(i, text(), "x") for i in range(3000)]
    junk = [(5000 + i, " ".join("j%%%%" + str(rng.random()) for _ in range(40)), "x") for i in range(300)]
    labels = [(i, 1) for i in range(1500)] + [(5000 + i, 0) for i in range(150)]
    got = quality_rules.quality_rules(
        spark.createDataFrame(rows + junk, FIELDS), spark.createDataFrame(labels, "doc_id long, quality int")
    )
    kept = {r.doc_id: r.kept for r in got.collect()}
    assert sum(not kept[i] for i in range(1500, 3000)) <= 0.05 * 1500
    assert not any(kept[5000 + i] for i in range(300))


def test_rules_nulls_repeats_and_empty(spark):
    rows = [(None, None, None), (1, "a " * 3, "x"), (1, "a " * 3, "x"), (2, " ".join(map(str, range(30))), None)]
    df = spark.createDataFrame(rows, FIELDS).selectExpr("*", "1 as n_words", "2 as kept", "3 as _stratum")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_rules.quality_rules(df, none)
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in got.collect()) == [
        (0, 0, False), (1, 3, False), (1, 3, False), (2, 30, True),
    ]
    assert quality_rules.quality_rules(df.where("false"), none).count() == 0


# --- importance resampling


def test_kth_largest(spark):
    rng = random.Random(3)
    values = [rng.choice([rng.randint(-(1 << 60), 1 << 60), rng.randint(-5, 5), 0]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 250, 499, 500):
        assert quality_model.kth_largest(df, "v", k) == ordered[k - 1]
    assert quality_model.kth_largest(df, "v", 501) is None


def corpus(n=600):
    rng = random.Random(12)
    good = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        ok = rng.random() < 0.8
        size = rng.randint(15, 80)
        body = [rng.choice(good) for _ in range(size)]
        rows.append((i, " ".join(body) if ok else " ".join(w + "!!" if rng.random() < 0.8 else w.upper() for w in body)))
        if i % 2:
            labels.append((i, int(ok), 0))
        elif i % 3 == 0:
            labels.append((i, None, None))
    return rows, labels


def test_held_out_documents(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_model.resample(docs, known).collect()}
    new = [i for i, _ in rows if i % 2 == 0]
    clean = {i for i, t in rows if "!!" not in t}
    assert np.mean([got[i].kept for i in new if i in clean]) >= 0.99
    assert np.mean([got[i].kept for i in new if i not in clean]) <= 0.05
    kept = quality_model.accepted(docs, known)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_kept_against_plain_python(spark):
    """The k-th key of a plain sort, k counted with the labels that the model has not seen."""
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fit = {r.doc_id for r in known.where(F.pmod(F.xxhash64("doc_id", F.lit(24)), F.lit(2)) == 0).collect()}
    for spare in (0.001, 0.1, 0.5):
        got = quality_model.resample(docs, known, spare=spare).collect()
        order = {r.doc_id: math.floor(r.key * (1 << 20)) for r in got}
        good = sorted(order[i] for i, q, _ in labels if q == 1 and i not in fit)
        k = sum(v >= good[int(spare * len(good))] for v in order.values())
        last = sorted(order.values(), reverse=True)[k - 1]
        assert {r.doc_id for r in got if r.kept} == {i for i, v in order.items() if v >= last}


def test_weights_against_plain_python(spark):
    rows, labels = corpus(80)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sample = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ratios = quality_model.log_ratios(docs, sample, id="doc_id", text="text")
    raw, target = np.zeros(quality_model.BUCKETS), np.zeros(quality_model.BUCKETS)
    good = {i for i, q, _ in labels if q == 1}
    for i, text in rows:
        for b in quality_model.ngram_buckets(text).tolist():
            raw[b] += 1
            target[b] += i in good
    plain = raw / raw.sum() * (target + 2) / (target.sum() * raw / raw.sum() + 2)
    used = raw > 0
    assert ratios[used] == pytest.approx(np.log(plain[used] / plain.sum() / (raw[used] / raw.sum())))
    for r in quality_model.with_log_weights(docs, ratios, text="text").collect():
        assert r.log_weight == pytest.approx(ratios[quality_model.ngram_buckets(rows[r.doc_id][1])].sum())


def test_gumbel_top_k_draws_by_weight(spark):
    """With equal weights a share is drawn at random, by noise alone."""
    docs = spark.createDataFrame([(i, "") for i in range(4000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_model.resample(docs, none, share=0.25).collect()
    assert sum(r.kept for r in got) == 1000
    noise = np.array([r.key for r in got])
    assert abs(noise.mean() - 0.5772) < 0.1 and abs(noise.std() - math.pi / 6**0.5) < 0.1
    assert min(r.key for r in got if r.kept) >= max(r.key for r in got if not r.kept)


def test_resample_nulls_repeats_and_empty(spark):
    rows = [(None, None), (1, "a"), (1, "a"), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as log_weight_", "3 as kept")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_model.resample(df, none)
    assert got.columns == ["doc_id", "log_weight", "key", "kept"]
    assert [r.kept for r in got.collect()] == [True] * 4
    assert quality_model.accepted(df, none).columns == df.columns
    assert quality_model.resample(df.where("false"), none).count() == 0
