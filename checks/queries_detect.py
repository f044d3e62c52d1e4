"""Detectors, rules and contextual entities over the whole test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelight.functions import fixed
from sievelight.functions.redaction import redact, redact_last
from sievelight.functions.text import (
    file_name_from_path,
    is_internet_url,
    normalize_file_stem,
    normalize_pua,
    suggestion_for,
)
from sievelight.functions.values import normalize_value, value_hash
from sievelight.operators.builtin import (
    detect_builtin,
    detect_filename,
    explode_hits,
    with_builtin_hits,
)
from sievelight.operators.contextual import EntitySetting, detect_contextual, split_indicators
from sievelight.operators.findings import risk_overview, summarize_long, with_risk
from sievelight.operators.merge import merge_findings
from sievelight.operators.rule_index import with_indexed_rule_hits
from sievelight.operators.rules import (
    Rule,
    compile_rules,
    detect_rules,
    field_rule,
    with_rule_hits,
)
from sievelight.plans.scan import scan, signals_only
from sievelight.plans.session import lookup_join
from sievelight.sources.catalog import load_rules
from sievelight.sources.tables import scan_table_text, spread

from . import corpora
from . import detect_sql as D
from .registry import (
    DOCS,
    ORDER_NOTES,
    PROFILES,
    documents,
    joined,
    order_notes,
    profiles,
    query,
    table,
)

MATCH_COLUMNS = ["doc_id", "category", "pos", "value", "redacted"]


def _with_redacted(matches):
    return matches.withColumn("redacted", F.expr(redact("category", "value"))).select(
        *MATCH_COLUMNS
    )


def _matches_sql(cte: str, name: str, categories, locale: str = "other") -> str:
    return (
        f"with {cte}, m as ({D.matches(name, categories, locale)}) "
        f"select doc_id, category, pos, value, {D.redact('category', 'value')} as redacted from m"
    )


def _scan_query(name: str, source, cte: str, cte_name: str, categories, locale: str = "other"):
    @query(name, _matches_sql(cte, cte_name, categories, locale))
    def run(spark, sf):
        found = detect_builtin(
            source(spark, sf), "text", "doc_id", categories=categories, phone_locale=locale
        )
        return _with_redacted(found)


for _name, _cats in (
    ("scan_emails", ["email"]),
    ("scan_ips", ["ip_address"]),
    ("scan_cards", ["credit_card"]),
):
    _scan_query(_name, documents, DOCS, "docs", _cats)

# few documents hold a whole number that counts as a phone; each gets one, of every other length
_CALLED = "concat(text, chr(10), 'tel ', substr(concat('06', (doc_id * 982451653 % 900000000 + 100000000)::string, '71'), 1, (8 + doc_id % 6)::int), ' ;')"


def _called(spark, sf):
    return documents(spark, sf).selectExpr("doc_id", f"{_CALLED} as text")


_scan_query("scan_phones", _called, f"cd as (select doc_id, {_CALLED} as text from documents)", "cd", ["phone"])

for _name, _cats in (
    ("scan_kv_ids", ["cookie", "user_id"]),
    ("scan_secrets", ["secret"]),
    ("scan_iban", ["iban"]),
    ("scan_birth_dates", ["date_of_birth"]),
    ("scan_addresses", ["address"]),
    ("scan_postal_codes", ["postal_code"]),
    ("scan_profile_ips", ["ip_address"]),
    ("scan_profile_cards", ["credit_card"]),
    ("scan_profile_emails", ["email"]),
    ("scan_profile_phones", ["phone"]),
    ("redact_all", None),
):
    _scan_query(_name, profiles, PROFILES, "profiles", _cats)

_scan_query("scan_phones_fr", profiles, PROFILES, "profiles", ["phone"], "fr")
_scan_query("scan_phones_es", profiles, PROFILES, "profiles", ["phone"], "es")


# card numbers of all networks: prefix and length, a body from the key, and the check digit
_NETWORKS = [
    ("4", 13), ("4", 16), ("4", 19), ("51", 16), ("55", 16), ("2221", 16), ("2720", 16), ("34", 15), ("37", 15), ("6011", 16), ("65", 19),
    ("644", 16), ("3528", 16), ("3589", 16), ("300", 14), ("305", 14), ("36", 14), ("38", 14), ("56", 16), ("2721", 16), ("306", 14), ("35", 15),
]


_PREFIX = corpora._pick([p for p, _ in _NETWORKS], "c_custkey")
_LENGTH = corpora._pick([str(n) for _, n in _NETWORKS], "c_custkey")
_CARD_STEPS = [
    f"c_custkey as doc_id, {_PREFIX} as prefix, ({_LENGTH})::int as n, (c_custkey * 7919 % 10007 * 982451653 % 1000000000)::string as seed",
    "doc_id, concat(prefix, lpad(seed, (n - 1 - length(prefix))::int, '7283')) as body",
    "doc_id, body, reverse(body) as back",
    "doc_id, body, ("
    + " + ".join(
        f"coalesce(try_cast(substr(back, {i}, 1) as int), 0)"
        + (f" * 2 - case when coalesce(try_cast(substr(back, {i}, 1) as int), 0) > 4 then 9 else 0 end" if i % 2 else "")
        for i in range(1, 19)
    )
    + ") as total",
    "doc_id, body, (10 - total % 10) % 10 as digit",
    "doc_id, concat('paid with ', body, digit::string, ', refused ', body, ((digit + 1) % 10)::string, '.') as text",
]


def _card_notes(spark, sf):
    notes = table(spark, sf, "customer")
    for step in _CARD_STEPS:
        notes = notes.selectExpr(f"inline(array(struct({step})))")  # a generator: steps are not merged
    return notes


def _nested(steps: list[str], source: str) -> str:
    for step in steps:
        source = f"(select {step} from {source})"
    return source


_scan_query(
    "scan_card_networks", _card_notes, f"cn as (select * from {_nested(_CARD_STEPS, 'customer')})", "cn", ["credit_card"]
)


# pages and conversations are scanned by the same detectors
def _pages(spark, sf):
    return spread(
        table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")),
        "doc_id",
    )


_scan_query("scan_pages", _pages, "pg as (select page_id as doc_id, html as text from pages)", "pg", None)


@query(
    "scan_conversations",
    f"""with t as (select conv_id * 1000 + turn as doc_id, role, text from conversations),
    m as ({D.matches('t')}), n as (select doc_id, count(*) as n from m group by doc_id)
    select role, count(*) as n_turns, count(n) as n_found, coalesce(sum(n), 0)::bigint as n_values
    from t left join n using (doc_id) group by role""",
)
def scan_conversations(spark, sf):
    turns = spread(
        table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn"
    )
    counted = with_builtin_hits(turns).selectExpr(
        "role", "aggregate(hits, 0L, (n, h) -> n + size(h.vals)) as n"
    )
    return counted.groupBy("role").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.count_if(F.col("n") > 0).alias("n_found"),
        F.sum("n").alias("n_values"),
    )


# --- file names -------------------------------------------------------------------------------


@query(
    "filename_signals",
    f"""with {PROFILES}, n as ({D.file_signals('profiles')})
    select doc_id, 'file_name_signal' as category, row_number() over (partition by doc_id order by i) - 1 as pos,
           value, sum(score) over (partition by doc_id)::bigint as bonus from n""",
)
def filename_signals(spark, sf):
    return detect_filename(profiles(spark, sf).select("doc_id", "path"), "path", "doc_id")


_PART_PATH = (
    "concat('/x/', p_name, case p_partkey % 6 when 0 then ' IBAN-export' when 1 then '_client_secret v2' when 2 then ' ribbon' "
    "when 3 then ' cv' else '' end, '.', case when p_partkey % 7 = 0 then 'PST' else p_brand end)"
)


@query(
    "filename_signals_parts",
    f"""with p as (select p_partkey as doc_id, {_PART_PATH} as path from part),
    n as ({D.file_signals('p')})
    select doc_id, 'file_name_signal' as category, row_number() over (partition by doc_id order by i) - 1 as pos,
           value, sum(score) over (partition by doc_id)::bigint as bonus from n""",
)
def filename_signals_parts(spark, sf):
    paths = table(spark, sf, "part").selectExpr(
        "p_partkey as doc_id", f"{_PART_PATH} as path"
    )
    return detect_filename(paths, "path", "doc_id")


# --- findings and reports ---------------------------------------------------------------------


@query(
    "findings",
    f"""with {PROFILES}, m as materialized ({D.matches('profiles')})
    select doc_id, category, count(*) as cnt,
      array_to_string(list(redacted order by pos) filter (where pos < 5), '|') as examples
    from (select *, {D.redact('category', 'value')} as redacted from m) group by all""",
)
def findings(spark, sf):
    found = detect_builtin(profiles(spark, sf), "text", "doc_id")
    return summarize_long(found, "doc_id").select(
        "doc_id", "category", "cnt", joined(F.col("redacted_examples")).alias("examples")
    )


def _flat_report(reports):
    line = lambda f: F.concat(
        f.category, F.lit("="), f["count"].cast("string"), F.lit("["),
        joined(f.redacted_examples), F.lit("]"),
    )
    reason = lambda r: F.concat(
        r.key,
        F.lit(":"),
        F.concat_ws(
            ",", r.vars["keyword"], r.vars["category"], r.vars["bonus"], r.vars["count"], r.vars["risk"]
        ),
    )
    return reports.select(
        "doc_id",
        "risk_score",
        "risk_level",
        joined(F.transform("findings", line), ";").alias("findings"),
        joined(F.transform("custom_findings", line), ";").alias("custom_findings"),
        joined(F.transform("reasons", reason), ";").alias("reasons"),
    )


_NO_CUSTOM = "nc as (select null::bigint as doc_id, '' as category, 0 as pos, '' as value where false)"
_NO_NAMES = "nn as (select null::bigint as doc_id, 0 as i, '' as value, 0 as score where false)"


@query(
    "risk_report",
    f"""with {DOCS}, m as materialized ({D.matches('docs')}), {_NO_CUSTOM}, {_NO_NAMES},
    {D.risk_report('docs', 'm', 'nc', 'nn', {})}
    select doc_id, risk_score, risk_level, findings, custom_findings, reasons from report""",
)
def risk_report(spark, sf):
    corpus = scan_table_text(documents(spark, sf), "doc_id", "text")
    return _flat_report(scan(corpus))


PROFILE_RULES = [
    Rule("badge", "critical", field_name_regex=r"(?i)^(?:api_key|password)$"),
    Rule("order_file", "low", filename_regex=r"(?i)\.(?:json|yaml)$", value_regex=r"\bS-?[0-9a-f]{32}\b"),
    Rule("tel", "medium", value_regex=r"\btel \{\d+\}"),
]


def _rule_sql(rule: Rule, docs: str, name_expr: str | None = None) -> str:
    """``doc_id, category, pos, value`` of one rule: name, then fields, then values."""
    parts = []
    if rule.filename_regex and name_expr:
        parts.append(f"case when regexp_matches({name_expr}, {D.q(rule.filename_regex)}) then [{name_expr}] else [] end")
    if rule.field_name_regex:
        pairs = f"list_zip({D.all_matches(D.GENERIC_KV, 1)}, {D.all_matches(D.GENERIC_KV, 2)})"
        parts.append(
            f"list_transform(list_filter({pairs}, lambda p: regexp_matches(p[1], {D.q(rule.field_name_regex)})), lambda p: p[2])"
        )
    if rule.value_regex:
        parts.append(D.all_matches(rule.value_regex))
    expr = parts[0]
    for p in parts[1:]:
        expr = f"list_concat({expr}, {p})"
    return (
        f"select doc_id, {D.q(rule.name)} as category, unnest(range(len(v))) as pos, unnest(v) as value "
        f"from (select doc_id, ({expr}) as v from {docs})"
    )


def _rules_sql(rules, docs: str, name_expr: str | None = None) -> str:
    return " union all ".join(f"({_rule_sql(r, docs, name_expr)})" for r in rules)


_NAME = "regexp_extract(path, '[^/]+$')"


@query(
    "profile_risk_report",
    f"""with {PROFILES}, m0 as materialized ({D.matches('profiles')}), names as ({D.file_signals('profiles')}),
    m as (select * from m0 union all
          select doc_id, 12, 'file_name_signal', row_number() over (partition by doc_id order by i) - 1, value from names),
    custom as ({_rules_sql(PROFILE_RULES, 'profiles', _NAME)}),
    {D.risk_report('profiles', 'm', 'custom', 'names', {r.name: r.risk_level for r in PROFILE_RULES})}
    select doc_id, risk_score, risk_level, findings, custom_findings, reasons, {D.SUGGESTION} as suggestion from report""",
)
def profile_risk_report(spark, sf):
    corpus = scan_table_text(profiles(spark, sf), "doc_id", "text", path_col="path")
    reports = scan(corpus.withColumn("secrets_enabled", F.lit(True)), rules=PROFILE_RULES)
    flat = _flat_report(reports)
    return flat.withColumn("suggestion", F.expr(suggestion_for("risk_level")))


@query(
    "risk_overview",
    f"""with {DOCS}, m as materialized ({D.matches('docs')}),
    j as (select doc_id, category, source from m join documents using (doc_id))
    select case grouping(source, category) when 0 then 'source_category' when 1 then 'source' when 2 then 'category' else 'total' end as level,
      source, category, count(*) as matches, count(distinct doc_id) as docs
    from j group by grouping sets ((source, category), (source), (category), ())""",
)
def risk_overview_query(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id")
    return risk_overview(with_builtin_hits(docs), "source")


# half of all profiles are parts of one archive, the others of many
_ARCHIVE = "case when doc_id % 2 = 0 then 0 else 1 + doc_id % 50 end"
_IN_ARCHIVES = (
    f"(select {_ARCHIVE} as doc_id, * exclude (doc_id, pos), row_number() over (partition by {_ARCHIVE}, category order by doc_id, pos) - 1 as pos from "
)


@query(
    "merged_findings",
    f"""with {PROFILES}, m0 as materialized ({D.matches('profiles')}), c0 as ({_rules_sql(PROFILE_RULES, 'profiles')}),
    m as {_IN_ARCHIVES} m0), custom as {_IN_ARCHIVES} c0), z as (select distinct {_ARCHIVE} as doc_id from profiles),
    {_NO_NAMES}, {D.risk_report('z', 'm', 'custom', 'nn', {r.name: r.risk_level for r in PROFILE_RULES})}
    select doc_id, risk_score, risk_level, findings, custom_findings, reasons from report""",
)
def merged_findings(spark, sf):
    found = with_rule_hits(with_builtin_hits(profiles(spark, sf)), PROFILE_RULES)
    parts = found.withColumnRenamed("doc_id", "part").withColumn("doc_id", F.expr(_ARCHIVE.replace("doc_id", "part")))
    merged = merge_findings(parts, "doc_id", "part")
    return _flat_report(with_risk(merged, PROFILE_RULES, custom_hits="custom_hits", summarized=True))


@query(
    "risk_levels",
    f"""with {DOCS}, m as materialized ({D.matches('docs')}), {_NO_CUSTOM}, {_NO_NAMES},
    {D.risk_report('docs', 'm', 'nc', 'nn', {})}
    select source, lang, risk_level, count(*) as n, sum(risk_score)::bigint as total_score
    from report join documents using (doc_id) where findings <> '' group by all""",
)
def risk_levels(spark, sf):
    docs = spread(
        table(spark, sf, "documents").select("doc_id", "source", "lang", "text"), "doc_id"
    )
    corpus = scan_table_text(docs, "doc_id", "text", keep=("source", "lang"))
    kept = signals_only(scan(corpus, keep=["source", "lang"]))
    return kept.groupBy("source", "lang", "risk_level").agg(
        F.count(F.lit(1)).alias("n"), F.sum("risk_score").alias("total_score")
    )


@query(
    "file_size_gate",
    f"""with {PROFILES}, small as (select * from profiles where strlen(text) <= 900),
    m0 as materialized ({D.matches('small')}), names as ({D.file_signals('profiles')}),
    m as (select * from m0 union all
          select doc_id, 12, 'file_name_signal', row_number() over (partition by doc_id order by i) - 1, value from names),
    {_NO_CUSTOM}, {D.risk_report('profiles', 'm', 'nc', 'names', {})}
    select r.doc_id, risk_score, risk_level, findings, strlen(text) > 900 as too_large
    from report r join profiles using (doc_id)""",
)
def file_size_gate(spark, sf):
    corpus = scan_table_text(profiles(spark, sf), "doc_id", "text", path_col="path")
    reports = scan(corpus, max_file_bytes=900)
    large = F.exists("reasons", lambda r: r.key == "reason.fileTooLarge")
    return reports.withColumn("too_large", large).transform(
        lambda df: df.select(
            "doc_id", "risk_score", "risk_level", "too_large",
            joined(
                F.transform(
                    "findings",
                    lambda f: F.concat(
                        f.category, F.lit("="), f["count"].cast("string"), F.lit("["),
                        joined(f.redacted_examples), F.lit("]"),
                    ),
                ),
                ";",
            ).alias("findings"),
        )
    )


# --- rules ------------------------------------------------------------------------------------

TOKEN_RULE = field_rule(["token"], "quoted_token")


@query(
    "rules_field",
    f"""with {DOCS}, m as ({_rule_sql(TOKEN_RULE, 'docs')})
    select doc_id, 'custom' as scope, category, pos, value, {D.mask_custom('value')} as redacted from m""",
)
def rules_field(spark, sf):
    found = detect_rules(documents(spark, sf), "text", "doc_id", [TOKEN_RULE])
    return found.withColumn("redacted", F.expr(redact_last("value")))


def _catalog_rules(locale: str | None) -> list[Rule]:
    """Shipped rules by locale, chosen here by hand for the SQL side."""
    from sievelight.catalog import shipped

    fits = {
        "fr_FR.UTF-8": {None, "fr"}, "en-US": {None, "en-US"}, "en_GB": {None, "en-GB"},
        "es": {None, "es"}, "de_DE@euro": {None, "de"},
    }
    rows = list(shipped.BASE_RULES) + shipped.LOCALE_RULES["fr"]
    return [
        Rule(i, risk, None, field, value)
        for i, _, risk, req, field, value in rows
        if locale is None or req in fits[locale]
    ]


def _rules_query(name: str, locale: str):
    sql = f"with {ORDER_NOTES}, m as ({_rules_sql(_catalog_rules(locale), 'notes')}) select doc_id, category, pos, value from m"

    @query(name, sql)
    def run(spark, sf):
        rules = compile_rules(load_rules(spark, locale), locale)
        return detect_rules(order_notes(spark, sf), "text", "doc_id", rules).select(
            "doc_id", "category", "pos", "value"
        )


for _name, _locale in (
    ("rules_locale_fr", "fr_FR.UTF-8"),
    ("rules_locale_us", "en-US"),
    ("rules_locale_gb", "en_GB"),
    ("rules_locale_es", "es"),
    ("rules_locale_de", "de_DE@euro"),
):
    _rules_query(_name, _locale)


# documents hold no number of the catalog's kinds; each gets one
_NUMBERED = (
    "concat(text, chr(10), case doc_id % 6 when 0 then concat('mac 3c:07:54:1b:9e:', lpad((doc_id % 90 + 10)::string, 2, '0')) "
    "when 1 then concat('vat DE', (doc_id % 900000000 + 100000000)::string) when 2 then concat('nir 1', lpad(doc_id::string, 14, '8')) "
    "when 3 then concat('id 0x', md5(doc_id::string), '12345678') when 4 then concat('dni ', (doc_id % 9000000 + 1000000)::string, '-K') else 'none' end)"
)


@query(
    "rules_all_documents",
    f"""with docs as (select doc_id, {_NUMBERED} as text from documents), m as ({_rules_sql(_catalog_rules(None), 'docs')})
    select category, count(*) as n, count(distinct doc_id) as n_docs from m group by category""",
)
def rules_all_documents(spark, sf):
    rules = compile_rules(load_rules(spark, "fr"))
    numbered = documents(spark, sf).selectExpr("doc_id", f"{_NUMBERED} as text")
    found = detect_rules(numbered, "text", "doc_id", rules)
    return found.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs")
    )


DOCUMENT_RULES = [
    Rule("hex_token", "high", field_name_regex="^token$", value_regex=r"\b[0-9a-f]{40}\b"),
    Rule("long_number", "medium", value_regex=r"\b\d{16}\b"),
    Rule("mail_host", "low", value_regex=r"(?i)@mail\d\.[a-z.]+"),
]


@query(
    "rules_documents",
    f"""with {DOCS}, m as ({_rules_sql(DOCUMENT_RULES, 'docs')})
    select source, lang, category, count(*) as n, count(distinct doc_id) as n_docs
    from m join documents using (doc_id) group by all""",
)
def rules_documents(spark, sf):
    docs = spread(
        table(spark, sf, "documents").select("doc_id", "source", "lang", "text"), "doc_id"
    )
    hits = with_rule_hits(docs, DOCUMENT_RULES, "text")
    found = explode_hits(hits, ["doc_id", "source", "lang"], "custom_hits", "custom")
    return found.groupBy("source", "lang", "category").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs")
    )


_FILE_RULES = [
    Rule("exports", "medium", filename_regex=r"(?i)(?:export|paie|scan)"),
    Rule("office", "low", filename_regex=r"\.(?:csv|json)$"),
]


# a rule for each name, brand and type of parts that finds the order lines of 20 pieces and more
_LINE = "concat(l_quantity::int::string, ' x ', p_name, ', ', p_brand, ', ', p_type)"


@query(
    "rules_indexed",
    """select concat_ws(', ', p_name, p_brand, p_type) as category, count(*) as n, count(distinct l_orderkey) as n_docs
    from lineitem join part on p_partkey = l_partkey where l_quantity::int between 20 and 49 group by category""",
)
def rules_indexed(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    wanted = parts.select("p_name", "p_brand", "p_type").distinct().selectExpr(
        "concat_ws(', ', p_name, p_brand, p_type) as id", "'medium' as risk_level", "true as enabled",
        "cast(null as string) as locale_requirement", "cast(null as string) as filename_regex",
        "cast(null as string) as field_name_regex",
        r"concat('(?i)\\b[2-4]\\d X ', p_name, ', ', p_brand, ', ', p_type, '\\b') as value_regex",
    )
    rules = compile_rules(wanted, max_rules=20_000)
    lines = lookup_join(
        table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", F.col("l_partkey").alias("p_partkey")),
        parts, ["p_partkey"], "inner",
    ).select("l_orderkey", F.expr(_LINE.replace("::int::string", "").replace("l_quantity", "cast(cast(l_quantity as int) as string)")).alias("line"))
    # the lines of an order are its text
    texts = lines.groupBy("l_orderkey").agg(F.array_join(F.collect_list("line"), "\n").alias("text"))
    hits = with_indexed_rule_hits(texts, rules)
    found = explode_hits(hits, ["l_orderkey"], "custom_hits", "custom")
    return found.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("n_docs")
    )


@query(
    "rules_filename",
    f"""with {PROFILES}, m as ({_rules_sql(_FILE_RULES, 'profiles', _NAME)})
    select doc_id, category, pos, value from m""",
)
def rules_filename(spark, sf):
    found = detect_rules(profiles(spark, sf), "text", "doc_id", _FILE_RULES, "path")
    return found.select("doc_id", "category", "pos", "value")


# --- contextual entities ----------------------------------------------------------------------

ENTITIES = {
    name: EntitySetting(name, split_indicators(pos), split_indicators(neg), threshold)
    for name, pos, neg, threshold in fixed.ENTITY_DEFAULTS
}
# lower thresholds, so that texts with few indicators give results too
LOW = {"person": 0.6, "organization": 0.6, "location": 0.6}
PROFILE = {"person": 0.4, "organization": 0.7, "location": 0.65}


def _indicator_test(words, v: str) -> str:
    return "(" + " or ".join(f"contains(lower({v}), {D.q(w.lower())})" for w in words) + ")"


def _entity_sql(entity: str, docs: str, threshold: float) -> str:
    """Entities by position: each match's texts before and after are split into words."""
    setting = ENTITIES[entity]
    pattern = {
        "person": fixed.PERSON,
        "location": fixed.LOCATION,
        "organization": r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:" + "|".join(fixed.ORG_SUFFIXES) + ")",
    }[entity]
    bonus = " or ".join(f"value like '%{s}'" for s in fixed.ORG_BONUS_SUFFIXES)
    accept = {
        "person": "not (" + " or ".join(f"starts_with(value, '{w}')" for w in fixed.NOT_A_NAME_STARTS) + ")",
        "location": "not (" + " or ".join(f"contains(value, '{w}')" for w in fixed.NOT_A_PLACE_WORDS) + ")",
        "organization": "true",
    }[entity]
    score = (
        "greatest(0.0::double, least(1.0::double, 0.5::double "
        f"+ least(len(list_filter(ctx, lambda w: {_indicator_test(setting.positive, 'w')})) * 0.1::double, 0.35::double) "
        f"- least(len(list_filter(ctx, lambda w: {_indicator_test(setting.negative, 'w')})) * 0.1::double, 0.25::double) "
        "+ case when strlen(value) between 5 and 40 then 0.1::double else 0.0::double end))"
    )
    if entity == "organization":
        score = f"case when {bonus} then least({score} + 0.15::double, 1.0::double) else {score} end"
    words = lambda t: f"list_filter(string_split_regex({t}, '\\s+'), lambda w: w <> '')"
    return f"""
      found as (select doc_id, text, unnest(range(len(vals))) as k, unnest(vals) as value, unnest(gaps[:len(vals)]) as gap
        from (select doc_id, text, {D.all_matches(pattern)} as vals, string_split_regex(text, {D.q(pattern)}) as gaps from {docs})),
      placed as (select doc_id, k, value, text,
        sum(length(gap) + length(value)) over (partition by doc_id order by k) as stop,
        sum(strlen(gap) + strlen(value)) over (partition by doc_id order by k) as stop_byte from found),
      around as (select doc_id, k, value, stop_byte, list_concat(
          {words('left(text, (stop - length(value))::int)')}[-5:], {words('substr(text, stop::int + 1)')}[:5]) as ctx
        from placed where {accept}),
      judged as (select *, {score} as confidence from around)
      select doc_id, '{entity}' as entity, (row_number() over (partition by doc_id order by k) - 1)::int as k, value, round(confidence, 4) as confidence,
             (stop_byte - strlen(value))::bigint as start_byte, stop_byte::bigint as end_byte
      from judged where confidence >= {threshold}::double"""


def _entity_query(name: str, entity: str, source, cte: str, cte_name: str, threshold: float):
    @query(name, f"with {cte}, {_entity_sql(entity, cte_name, threshold).strip()}")
    def run(spark, sf):
        setting = ENTITIES[entity]
        chosen = EntitySetting(entity, setting.positive, setting.negative, threshold)
        found = detect_contextual(source(spark, sf), "text", "doc_id", [chosen], spans=True)
        return found.withColumn("confidence", F.round("confidence", 4)).select(
            "doc_id", "entity", "k", "value", "confidence", "start_byte", "end_byte"
        )


# documents name no firm; each gets one
_FIRMED = "concat(text, chr(10), 'the company ', initcap_, ' Holding ', case doc_id % 4 when 0 then 'Inc' when 1 then 'GmbH' when 2 then 'Ltd' else 'Limited' end, ' from here')"
_FIRMED = _FIRMED.replace("initcap_", "concat('Acme', substr('abcdefghij', (doc_id % 10 + 1)::int, 1))")


def _firmed(spark, sf):
    return documents(spark, sf).selectExpr("doc_id", f"{_FIRMED} as text")


for _entity in ("person", "organization", "location"):
    if _entity != "organization":
        _entity_query(f"contextual_{_entity}", _entity, documents, DOCS, "docs", LOW[_entity])
    else:
        _entity_query(
            "contextual_organization", _entity, _firmed,
            f"fd as (select doc_id, {_FIRMED} as text from documents)", "fd", LOW[_entity],
        )
    _entity_query(
        f"contextual_profile_{_entity}", _entity, profiles, PROFILES, "profiles",
        PROFILE[_entity],
    )


def _entity_rows(entity: str, docs: str) -> str:
    """Values of one entity in the long form of rule matches."""
    return (
        f"select doc_id, entity as category, row_number() over (partition by doc_id order by k) - 1 as pos, value "
        f"from (with {_entity_sql(entity, docs, PROFILE[entity]).strip()})"
    )


@query(
    "scan_with_entities",
    f"""with {PROFILES}, m as materialized ({D.matches('profiles')}),
    nn as (select null::bigint as doc_id, 0 as i, '' as value, 0 as score where false),
    custom as ({_rules_sql(PROFILE_RULES[2:], 'profiles')} union all ({_entity_rows('organization', 'profiles')})
               union all ({_entity_rows('location', 'profiles')})),
    {D.risk_report('profiles', 'm', 'custom', 'nn', {r.name: r.risk_level for r in PROFILE_RULES})}
    select doc_id, risk_score, risk_level, findings, custom_findings, reasons from report""",
)
def scan_with_entities(spark, sf):
    entities = [
        EntitySetting(n, ENTITIES[n].positive, ENTITIES[n].negative, PROFILE[n])
        for n in ("organization", "location")
    ]
    corpus = scan_table_text(profiles(spark, sf), "doc_id", "text")
    return _flat_report(scan(corpus, rules=PROFILE_RULES[2:], entities=entities))


# --- scalar functions -------------------------------------------------------------------------


@query(
    "normalize_hash",
    f"""with {PROFILES}, m as materialized ({D.matches('profiles')})
    select doc_id, category, pos, nv, sha256(concat('pepper', chr(10), nv)) as value_hash
    from (select *, case category when 'email' then lower(trim(value)) when 'iban' then upper(regexp_replace(value, '[^A-Za-z0-9]', '', 'g'))
                 when 'phone' then regexp_replace(value, '[^0-9]', '', 'g') else trim(value) end as nv from m)""",
)
def normalize_hash(spark, sf):
    found = detect_builtin(profiles(spark, sf), "text", "doc_id")
    return found.selectExpr(
        "doc_id", "category", "pos",
        f"{normalize_value('category', 'value')} as nv",
        f"{value_hash('pepper', 'category', 'value')} as value_hash",
    )


_OLD_GLYPHS = "".join(
    chr(c)
    for c in (
        0xF8EB, 0xF8ED, 0xF8EF, 0xF8F0, 0xF8F1, 0xF8F2, 0xF8F3, 0xF8F4, 0xF8F6, 0xF8F9, 0xF8FA, 0xF8FB, 0xF8FC, 0xF8FD, 0xF8FE,
    )
)


@query(
    "normalize_names",
    r"""with p as (select page_id, url from pages)
    select page_id, regexp_extract(url, '[^/\\]*$') as file_name,
           regexp_replace(lower(regexp_replace(case when regexp_extract(url, '([^/]+)/*$', 1) = '' then url else regexp_extract(url, '([^/]+)/*$', 1) end,
             '(?s)^(.+)\.[^.]*$', '\1')), '[^a-z0-9]', ' ', 'g') as stem,
           concat(url, '⎛⎝⎢⎣⎧⎨⎩⎪⎞⎤⎥⎦⎫⎬⎭', url) as glyphs from p""",
)
def normalize_names(spark, sf):
    pages = table(spark, sf, "pages").select(
        "page_id", "url", F.concat("url", F.lit(_OLD_GLYPHS), "url").alias("twice")
    )
    return pages.selectExpr(
        "page_id",
        f"{file_name_from_path('url')} as file_name",
        f"{normalize_file_stem('url')} as stem",
        f"{normalize_pua('twice')} as glyphs",
    )


_HOSTS = (
    "case page_id % 7 when 0 then url when 1 then concat('http://10.0.0.', page_id % 250, '/a') "
    "when 2 then concat('https://172.', 10 + page_id % 30, '.0.1:8080/') when 3 then 'ftp://host/x' "
    "when 4 then concat('http://printer', page_id, '.local/') when 5 then 'https://localhost:3000' "
    "else concat('https://8.8.8.', page_id % 250) end"
)


@query(
    "url_locality",
    f"""with p as (select page_id, {_HOSTS} as u from pages),
    h as (select page_id, u, lower(regexp_extract(u, '^([a-z]+)://', 1)) as scheme,
          lower(regexp_extract(u, '^[a-z]+://([^/:?#]*)', 1)) as host from p)
    select page_id, u, case when scheme in ('http', 'https') and host <> '' then
      not (host = 'localhost' or host like '%.local' or host like '10.%' or host like '127.%' or host like '192.168.%'
           or host like '169.254.%' or host = '0.0.0.0'
           or (regexp_matches(host, '^172\\.[0-9]+\\.') and try_cast(split_part(host, '.', 2) as int) between 16 and 31)) end as internet
    from h""",
)
def url_locality(spark, sf):
    pages = table(spark, sf, "pages").selectExpr("page_id", f"{_HOSTS} as u")
    return pages.selectExpr("*", f"{is_internet_url('u')} as internet")


# --- rules whose groups repeat, on long texts ----------------------------------------------------

# patterns that Spark's engine cannot run as they stand on texts of this length
_LONG_RULES = {
    "letters": r"(?:[a-z]|[A-Z]|,|\s)+\.",
    "numbered": r"(?:[A-Za-z]+ )+[0-9]{4,}",
    "pairs": r"(?:[a-z]{2}|[0-9]{2}|[A-Z])+;",
}
_LONG_TEXTS = "select {div} as doc_id, {agg} as text from documents where text is not null group by {div}"


def _long_sql() -> str:
    texts = _LONG_TEXTS.format(div="doc_id // 100", agg="string_agg(text, ' ' order by doc_id)")
    found = " union all ".join(
        f"select doc_id, {D.q(name)} as rule, regexp_extract_all(text, {D.q(p)}) as vals from long" for name, p in _LONG_RULES.items()
    )
    return f"""with long as materialized ({texts}), found as ({found})
    select doc_id, rule, len(vals)::bigint as n, md5(array_to_string(vals, '|')) as vals_md5 from found where len(vals) > 0"""


@query("rules_long_texts", _long_sql())
def rules_long_texts(spark, sf):
    """Rules with repeated groups over texts of a hundred documents each."""
    docs = table(spark, sf, "documents").where("text is not null").selectExpr("doc_id div 100 as part", "doc_id", "text")
    listed = F.sort_array(F.collect_list(F.struct("doc_id", "text")))
    long = docs.groupBy(F.col("part").alias("doc_id")).agg(F.array_join(listed["text"], " ").alias("text"))
    rules = [Rule(name, value_regex=p) for name, p in _LONG_RULES.items()]
    hits = with_rule_hits(long, rules).selectExpr("doc_id", "inline_outer(custom_hits)").where("category is not null")
    return hits.select(
        "doc_id", F.col("category").alias("rule"), F.size("vals").cast("bigint").alias("n"),
        F.md5(F.array_join("vals", "|").cast("binary")).alias("vals_md5"),
    )
