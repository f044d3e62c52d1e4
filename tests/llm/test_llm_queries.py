"""Every query of the subpackage: against its SQL, or run on small odd tables; the pipeline by stages."""

import os

import duckdb
import pytest
from helpers import kept_words, roots, simhash, words
from pyspark.sql import functions as F

import corpus_pipeline
from sievelight.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "labels", "conversations", "embeddings", "pages", "benchmark")


def rows_of(folder, sql, name):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def key(row):
    return [(v is None, v if isinstance(v, (int, float, str)) else str(v)) for v in row]


@pytest.mark.parametrize("name", sorted(SQL))
@pytest.mark.parametrize("given", ["odd", "given"])
def test_against_sql(spark, llm_tables, name, given):
    if given == "given" and not os.path.isdir(SF):
        pytest.skip("no test tables")
    folder = llm_tables if given == "odd" else SF
    names, want = rows_of(folder, SQL[name], name)
    df = QUERIES[name](spark, folder)
    assert set(names) == set(df.columns)
    got = [tuple(r[n] for n in names) for r in df.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_odd_tables(spark, llm_tables, name):
    if name.startswith("op13_"):
        pytest.skip("one row for each component: see test_whitening")
    table = "pages" if "page_id" in QUERIES[name](spark, llm_tables).columns else "documents"
    rows = spark.read.parquet(f"{llm_tables}/{table}.parquet").count()
    assert QUERIES[name](spark, llm_tables).count() == rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, llm_tables, tmp_path, name):
    for t in TABLES:
        spark.read.parquet(f"{llm_tables}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == (1 if name.startswith("op3_") else 0)


def test_pipeline_stages_against_brute_force(spark, llm_tables):
    docs = spark.read.parquet(f"{llm_tables}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality_classifier"](spark, docs, llm_tables)
    verdicts = QUERIES["op9_quality_classifier"](spark, llm_tables)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in verdicts.where("kept").collect()}

    single = stages["simhash_dedup"](spark, docs, llm_tables)
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: simhash(t) for i, t in texts.items()}
    want = set(roots(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2).values())
    assert sorted(r.doc_id for r in single.collect()) == sorted(want)

    cut = stages["substring_dedup"](spark, docs, llm_tables)
    left = kept_words(texts)
    for r in cut.collect():
        assert words(r.text) == left[r.doc_id] and r.n_chars == (None if r.text is None else len(r.text))

    mixed = stages["mix_sources"](spark, docs, llm_tables)
    taken = {r.doc_id: r.taken for r in QUERIES["op1_mix_sources"](spark, llm_tables).collect()}
    for r in mixed.groupBy("doc_id").count().collect():
        assert r["count"] * len(words(texts[r.doc_id])) == taken[r.doc_id]
    for stage in (kept, single, cut, mixed):
        assert stage.columns == docs.columns


def test_stages_keep_clashing_columns_and_empty_tables(spark, llm_tables):
    docs = spark.read.parquet(f"{llm_tables}/documents.parquet").limit(60)
    taken = ["size", "copies", "target", "n_words", "_doc", "_hash", "log_weight", "key", "fp", "_mix_row", "id", "component"]
    more = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in taken])
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, more, llm_tables)
        if name != "bpe_round_trip":
            assert got.columns == more.columns, name
            assert got.where(F.col("copies") != F.concat(F.lit("copies"), "doc_id")).count() == 0, name
            assert got.where(F.col("n_words") != F.concat(F.lit("n_words"), "doc_id")).count() == 0, name
        got.count()
        assert stage(spark, more.where("false"), llm_tables).count() == 0, name


def test_pipeline_runs(spark, llm_tables):
    got = corpus_pipeline.run(spark, llm_tables)
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded"]
    assert got.where(F.size("ids") != F.col("n_tokens")).count() == 0 and got.count() > 50
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "simhash_dedup", "substring_dedup", "mix_sources", "bpe_round_trip",
    ]
