"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, language, lexical, mixing, pages, quality_model, quality_rules, simhash, substrings, tokens, topk, whitening
from .common import WORD, small_batches, staged, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; one without SQL is tested against a brute-force version."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


WORDS = "regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')"


@query(
    "op1_mix_sources",
    f"""
    with d as (
        select doc_id, source, coalesce(len({WORDS}), 0)::bigint as size from documents
    ), s as (
        select source, sum(size)::bigint as source_size from d group by source
    ), w as (
        select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as weight from s
    ), r as (
        select *, 3::double * source_size / weight as ratio from w
    ), x as (
        select *, sum(source_size) over ()::double as every, sum(weight) over () as weights,
            coalesce(sum(source_size) over before, 0)::double as used,
            coalesce(sum(weight) over before, 0) as taken
        from r
        window before as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)
    ), y as (
        select *, (every - 3::double * used) / (weights - taken) as share from x
    ), z as (
        select *, max(case when ratio > share then share end) over () as level from y
    ), t as (
        select source, source_size,
            case when ratio <= share then 3::double * source_size else weight * level end as target,
            ('0x' || substr(md5('17:' || coalesce(source, 'null')), 1, 8))::bigint / 4294967296::double as u
        from z
    ), k as (
        select doc_id, source, size, row_number() over (
            partition by source order by size, md5('17:' || coalesce(doc_id::varchar, 'null')), doc_id
        )::double as rank
        from d
    ), c as (
        select doc_id, size, source_size, target, u, rank,
            case when source_size > 0 then target / source_size else 0 end as rate
        from k join t on k.source is not distinct from t.source
    )
    select doc_id, size, source_size, target,
        (size * least(floor(u + rank * rate) - floor(u + (rank - 1) * rate), 3))::bigint as taken
    from c
    """,
)
def op1_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        "doc_id", "source", word_count(F.col("text")).alias("size")
    )
    mixed = mixing.mix(staged(docs, "mix-sizes", narrow=True), F.col("size"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.quality_rules(
        table(spark, sf, "documents"), table(spark, sf, "labels"), joint=True
    ).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


#: A conversation whose texts hold control strings, as a record of another layout.
CONTROL_RECORD = (
    '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, '
    '{"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'
)


@query(
    "op3_chat_format",
    r"""
    with turns as (
        select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
        union all
        select -7, 0, 'user', '</s>[INST] ok [/INST]'
        union all
        select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), escaped as (
        select *, regexp_replace(
            regexp_replace(text,
                '([<])(\\*(?:\|turn\|>|\|text\|>|\|end\|>|s>|/s>|SYS>|/SYS>|\|endoftext\|>))', '\1\\\2', 'g'),
            '(\[)(\\*(?:INST\]|/INST\]))', '\1\\\2', 'g') as body
        from turns
    )
    select conv_id, count(*)::bigint as n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
        coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
        sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
        sum(length(role) + length(body) + 23)::bigint as formatted_chars
    from escaped group by conv_id
    """,
)
def op3_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(1).select(
        F.lit(-7).cast("long").alias("id"), F.parse_json(F.lit(CONTROL_RECORD)).alias("record")
    )
    turns = chat.turns_of_rows(rows).unionByName(chat.turns_of_records(control, "id", "record"))
    read = chat.formatted(turns).select(
        F.col("id").alias("conv_id"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.inline(
            F.array(
                F.struct(
                    chat.read_back("formatted").alias("_turns"),
                    chat.under_mask("formatted", "loss_spans").alias("_loss"),
                )
            )
        ),
    )
    digest = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(digest, ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"), width=3, max_bits=2)
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query(
    "op7_substring_dedup",
    f"""
    with d as (
        select doc_id, coalesce({WORDS}, []) as w from documents
    ), k as (
        select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i, w from d
    ), x as (
        select doc_id, i, word, case when i + 12 <= len(w) then array_to_string(w[i:i + 12], ' ') end as win from k
    ), m as (
        select win, min(doc_id) as first from x where win is not null group by win
    ), y as (
        select x.doc_id, i, word, max(case when first < x.doc_id then 1 else 0 end) over (
            partition by x.doc_id order by i rows between 12 preceding and current row) as gone
        from x left join m on x.win = m.win
    ), z as (
        select doc_id, count(*) as n_words, sum(gone) as n_removed,
            string_agg(word, ' ' order by i) filter (gone = 0) as kept
        from y group by doc_id
    )
    select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
        sha256(coalesce(kept, '')) as kept_sha256
    from d left join z on d.doc_id = z.doc_id
    """,
)
def op7_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    done = substrings.remove_repeated_passages(docs)
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    kept = F.sha2(F.array_join(words, " "), 256).alias("kept_sha256")
    return done.select("doc_id", "n_words", "n_removed", kept)


def vocabulary(name: str) -> str:
    """Place of an installed public vocabulary; elsewhere a path is handed to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        F.struct("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n")).alias("key"),
        "text",
    )
    counted = tokens.token_counts(docs, vocabulary("byte_bpe_50k.json"), id="key")
    return counted.select(
        "key.doc_id", F.col("key.n").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 512).alias("over_limit")
    )


@query("op8_bpe_round_trip")
def op8_bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    encoded = bpe.encode_documents(docs, vocabulary("word_bpe_49k.json"), text_as="plain")
    return digests(encoded, F.sha2("plain", 256).alias("text_sha256"))


def digests(encoded: DataFrame, *more: Column) -> DataFrame:
    """Digests of the ids and texts of an encoded frame."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )


@query(
    "op2_top_k",
    """
    with v as (
        select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v
        from embeddings
        where embedding is not null and vec_id is not null
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), s as (
        select q.vec_id as query_id, c.vec_id,
            list_inner_product(q.v, c.v)::bigint as score
        from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)
    ), r as (
        select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
    )
    select query_id, rank::int as rank, vec_id, score from r where rank <= 5
    """,
)
def op2_top_k(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select("vec_id", topk.scaled(F.col("embedding")).alias("values"))
    return topk.search(vectors, F.col("vec_id") % 50 == 0, k=5)


@query("op6_main_text")
def op6_main_text(spark: SparkSession, sf: str) -> DataFrame:
    extracted = pages.extract(table(spark, sf, "pages").select("page_id", "url", "html"))
    return extracted.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return quality_model.resample(table(spark, sf, "documents"), table(spark, sf, "labels"))


_TERMS = r"""regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""


@query(
    "op11_lexical_search",
    f"""
    with d as (
        select doc_id, row_number() over () as row, {_TERMS} as terms from documents
    ), size as (
        select row, doc_id, len(terms)::bigint as n from d where len(terms) > 0
    ), every as (
        select count(*)::bigint as docs, sum(n)::bigint as terms from size
    ), item as (
        select distinct item_id, unnest({_TERMS}) as term from benchmark
    ), posting as (
        select row, term, count(*)::bigint as tf from (select row, unnest(terms) as term from d) group by row, term
    ), asked as (
        select term, row, tf from posting where term in (select term from item)
    ), weight as (
        select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)))::bigint as w
        from asked, every group by term
    ), part as (
        select item_id, row, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // every.terms))) as part
        from item join weight using (term) join asked using (term) join size using (row), every
    ), score as (
        select item_id, doc_id, sum(part)::bigint as score from part join size using (row) group by item_id, row, doc_id
    ), ranked as (
        select *, row_number() over (partition by item_id order by score desc, doc_id nulls last)::int as rank
        from score where score > 0
    )
    select item_id, rank, doc_id, score from ranked where rank <= 10
    """,
)
def op11_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=10)


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select("vec_id", whitening.whole(F.col("embedding")).alias("values"))
    return whitening.whiten(vectors, 4)


@query("op12_language_id")
def op12_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(table(spark, sf, "documents"))
