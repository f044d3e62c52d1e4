import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import language
from sievelight.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORDS = {
    "aa": "kalo mira sento pako lumi taro vesi".split(),
    "bb": "strz grod wlk chrz prst dvor zlom".split(),
    "cc": "ñoña ción ésta año él sólo güe".split(),
}


def plain_ngrams(text):
    body = " ".join(re.sub(r"[\x00-\x7f]", lambda m: m[0] if m[0].isalpha() else " ", text.lower()).split(" "))
    body = b" " + b" ".join(body.encode().split()) + b" "
    found = Counter()
    for order in (2, 3, 4):
        for i in range(len(body) - order + 1):
            code = int.from_bytes(body[i : i + order], "big")
            mixed = (code + (order * 0x3C6EF372 & 0xFFFFFFFF)) * 0x9E3779B1 & 0xFFFFFFFF
            found[mixed >> 17] += 1
    return found


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice("aa aa aa bb cc".split())
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(2, 60))) + ".", lang))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


@pytest.mark.parametrize("text", ["a", "Ab, c!\n42 Éé 한국 x", "  ...x", "word " * 300])
@pytest.mark.parametrize("chunk", [3, 64, 1 << 20])
def test_ngrams_against_plain(monkeypatch, text, chunk):
    monkeypatch.setattr(language, "_CHUNK", chunk)
    used, times = language.ngrams(text)
    assert dict(zip(used.tolist(), times.tolist(), strict=True)) == dict(plain_ngrams(text))


def test_letters():
    for text, want in ((None, False), ("", False), ("12 _ ½ ² .", False), ("́", False), ("x", True), ("一", True), ("1é", True), ("ªʰ", True)):
        assert language.has_letters(text) is want, text


def test_predictions_are_the_nearest_centroids(spark):
    rows = corpus(1, 120)
    model = language.learn(frame(spark, rows))
    assert set(model.languages) == {"aa", "bb", "cc"} and model.languages == sorted(model.languages)
    assert np.allclose(np.linalg.norm(model.centroids, axis=0), 1, atol=1e-5)
    df, n = Counter(b for _, t, _ in rows for b in plain_ngrams(t)), len(rows)
    got = {r.doc_id: r for r in language.predict(frame(spark, rows), model).collect()}
    for i, text, lang in rows:
        counts = plain_ngrams(text)
        w = {b: (1 + np.log(c)) * (np.log((1 + n) / (1 + df[b])) + 1) for b, c in counts.items()}
        norm = np.sqrt(sum(v * v for v in w.values()))
        cosines = [sum(v / norm * model.centroids[b, k] for b, v in w.items()) for k in range(len(model.languages))]
        assert got[i].lang_pred == model.languages[int(np.argmax(cosines))] == lang
        assert abs(got[i].score - max(cosines)) < 1e-6


def test_far_texts_are_rejected(spark):
    model = language.learn(frame(spark, corpus(2, 150)))
    odd = [(1, "kalo mira sento pako lumi taro", None), (2, "qqqq xxyy qxqx yyqq", None), (3, None, None), (4, "12 !", "aa")]
    got = {r.doc_id: r for r in language.predict(frame(spark, odd), model).collect()}
    assert not got[1].rejected and got[2].rejected
    assert [(got[i].lang_pred, got[i].score, got[i].rejected) for i in (3, 4)] == [("und", 0.0, False)] * 2


def test_held_out_rows_are_predicted_by_text_alone(spark):
    rows = corpus(3, 200)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    changed = [(i, t, "zz" if held(i) else lang) for i, t, lang in rows]
    a = {r.doc_id: r for r in language.identify(frame(spark, rows)).collect()}
    b = {r.doc_id: r for r in language.identify(frame(spark, changed)).collect()}
    assert a == b and {i for i in a if a[i].held_out} == {i for i, _, _ in rows if held(i)}
    assert all(a[i].lang_pred == lang for i, _, lang in rows if held(i))
    # a held-out text of another kind changes nothing either
    more = [(i, "qq" if held(i) else t, lang) for i, t, lang in rows]
    c = {r.doc_id: r for r in language.identify(frame(spark, more)).collect()}
    assert all(a[i] == c[i] for i in a if not held(i))


def test_odd_rows_copies_and_extra_columns(spark):
    rows = corpus(4, 80) + [(500 + i, "kalo kalo kalo", "aa") for i in range(300)]
    rows += [(None, "kalo mira", "aa"), (900, None, "aa"), (901, "", "bb"), (902, "x" * 50_000 + " y", None), (903, "strz", None), (903, "strz", None)]
    df = frame(spark, rows).select("*", F.lit(1).alias("score"), F.lit("k").alias("key"), F.lit(2).alias("noise"))
    runs = [sorted(map(tuple, language.identify(df, sample=50).collect()), key=str) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    got = {r[0]: r for r in runs[0]}
    assert got[None][1] is False and got[None][2] == "aa" and got[903][2] == "bb" and got[900][2] == got[901][2] == "und"
    assert sum(r[0] == 903 for r in runs[0]) == 2


def test_nothing_to_learn_from(spark):
    rows = [(1, "kalo", None), (2, None, "aa"), (3, "12", "bb")]
    got = language.identify(frame(spark, rows)).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)} and len(got) == 3
    assert language.identify(frame(spark, rows).where("false")).collect() == []


def test_languages_are_bounded(spark):
    with pytest.raises(ValueError, match="more than 2 languages"):
        language.learn(frame(spark, corpus(5, 60)), languages=2)


def test_odd_clusters_go():
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(0, 0.05, size=(100, 8)))
    x[:, 0] += 1
    x[:40, 1] += 1
    x[0] = np.eye(8)[7]  # one wrong label
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = language.clusters(x.astype(np.float32), 4)
    assert 1 <= len(found) <= 3 and found[:, 7].max() < 0.2
    assert len(language.clusters(x[:1], 4)) == 1 and len(language.clusters(np.repeat(x[:1], 9, axis=0), 4)) == 1


def test_held_out_accuracy(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    got = QUERIES["op12_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out").select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows) > 200
