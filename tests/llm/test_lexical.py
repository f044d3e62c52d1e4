import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from helpers import lowered
from sievelight.llm import lexical

TERM = re.compile(lexical.TERM)


def brute(docs, items, k):
    """Items with their best documents, from rows (id, text) and (item, text)."""
    counts = [(i, Counter(TERM.findall(lowered(t)))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item].update(TERM.findall(lowered(text)))
    out = {}
    for item, terms in asked.items():
        scored = []
        for i, c, n in counts:
            m = 100 - 90 + 90 * n * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms
                if t in c
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out[item] = [(r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return {item: rows for item, rows in out.items() if rows}


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    return dict(out)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.4)) % 900}" for _ in range(2000)] + ["É", "é", "ΑΣ", "한국", "x1", "X1"]
    text = lambda size: rng.choice([" ", "-", "_", "\n"]).join(rng.choice(words) for _ in range(size))
    docs = [(i, text(rng.randint(0, 60))) for i in range(n)]
    docs += [(n + i, docs[i][1]) for i in range(0, n, 4)]  # copies tie
    docs += [(n, None), (None, text(30)), (None, text(30)), (n + 1, ""), (3, text(40)), (-5, " .!_ ")]
    docs += [(9000, text(30_000))]
    items = [(i, text(rng.randint(1, 40))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "nowhere"), (None, text(9)), (4, text(5)), (33, "w1 W1 w1"), (34, "É")]
    return docs, items


def tables(spark, docs, items):
    return (
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
    )


@pytest.mark.parametrize(
    "sizes",
    [
        lexical.Sizes(),
        lexical.Sizes(docs=7, piece=50, chunk=1000, items=8, spread=3),
        lexical.Sizes(bits=64, postings=300),  # a filter that lets most terms through
    ],
)
def test_against_brute_force(spark, sizes):
    docs, items = corpus(sizes.docs, 150)
    assert found(lexical.search(*tables(spark, docs, items), 10, sizes=sizes)) == brute(docs, items, 10)


def test_names_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "z", 5), (2, "b", "z", 6)], "id long, body string, item string, score int")
    items = spark.createDataFrame([("q", "B", 1, 2)], "item string, ask string, rank int, doc long")
    got = lexical.search(docs, items, 2, id="id", text="body", item="item", item_text="ask")
    assert got.columns == ["item", "rank", "id", "score"]
    assert [(r["item"], r["rank"], r["id"]) for r in got.orderBy("rank").collect()] == [("q", 1, 2), ("q", 2, 1)]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    for d, i in ((docs.where("false"), items), (docs, items.where("false")), (none, items), (docs.where("false"), items.where("false"))):
        assert lexical.search(d, i).collect() == []


def test_accumulators_are_limited():
    """Once the rest cannot lift a new document to the k-th best, frequent terms reach survivors only."""
    n = 2000
    rare, common = np.array([3, 500, 700]), np.arange(n)
    row = {
        "ids": list(range(n)),
        "sizes": np.full(n, 10, dtype=np.int64).tobytes(),
        "terms": ["rare", "common"],
        "dfs": [len(rare), n],
        "docs": np.concatenate([rare, common]).astype(np.int32).tobytes(),
        "tfs": np.ones(n + 3, dtype=np.int32).tobytes(),
    }
    searcher = lexical.Searcher(n, 10 * n, 2)
    searcher.open(row)
    places, scores = searcher.best("q", [("rare", 6000), ("common", 1)])
    assert places.tolist() == [3, 500] and scores.tolist() == [6001 * int(searcher.impacts[0])] * 2
    assert searcher.floors["q"] == scores[1]
