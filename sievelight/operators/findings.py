"""Findings, score, reasons and risk level, computed inside the row of a document.

The input is the ``hits`` / ``custom_hits`` columns of the detectors
(``array<struct<category, vals>>``), so nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.redaction import redact, redact_last
from ..functions.sql import (
    NO_STRINGS,
    each,
    fold,
    in_list,
    keep,
    lit,
    lookup,
    struct,
)
from ..functions.text import risk_name, risk_rank
from ..functions.validators import looks_like_hash
from .builtin import EMPTY_HITS
from .rules import Rule

REASONS_TYPE = "array<struct<key:string,vars:map<string,string>>>"
SUMMARIES_TYPE = "array<struct<category:string,count:bigint,hashes:bigint,redacted_examples:array<string>>>"
EMPTY_SUMMARIES = f"cast(array() as {SUMMARIES_TYPE})"
_NO_REASONS = f"cast(array() as {REASONS_TYPE})"


def weight_of(category: str) -> str:
    return lookup(category, fixed.WEIGHTS, "0")


def builtin_rank(category: str) -> str:
    """Rank of a built-in category's risk: from its weight, never above high."""
    ranks = {c: 2 if w >= 6 else 1 if w >= 3 else 0 for c, w in fixed.WEIGHTS.items()}
    return lookup(category, ranks, "0")


def rule_level(name: str, rules: Sequence[Rule]) -> str:
    """Risk level of a rule by name, medium when the rule is unknown."""
    return lookup(name, {r.name: r.risk_level for r in rules}, "'medium'")


def summarize(hits: str, custom: bool = False, examples: int = 5) -> str:
    """Category, count and a few redacted examples for display, in the order of ``hits``."""
    mask = (lambda h, v: redact_last(v)) if custom else (lambda h, v: redact(f"{h}.category", v))
    return each(
        hits,
        lambda h: struct(
            category=f"{h}.category",
            count=f"cast(size({h}.vals) as bigint)",
            redacted_examples=each(f"slice({h}.vals, 1, {examples})", lambda v: mask(h, v)),
        ),
    )


def count_of(h: str, summarized: bool = False) -> str:
    return f"{h}.count" if summarized else f"cast(size({h}.vals) as bigint)"


def hash_count(h: str) -> str:
    """How many cookie or user-id values look like hashes; 0 for other categories."""
    some = in_list(f"{h}.category", ["cookie", "user_id"])
    return f"case when {some} then cast(size({keep(f'{h}.vals', looks_like_hash)}) as bigint) else 0L end"


def _hash_like(h: str, summarized: bool) -> str:
    """At least half of the cookie or user-id values look like hashes."""
    hashes = f"{h}.hashes" if summarized else hash_count(h)
    return f"({in_list(f'{h}.category', ['cookie', 'user_id'])} and {hashes} * 2 >= {count_of(h, summarized)})"


def score_parts(hits: str, summarized: bool = False) -> str:
    """``array<struct<category, count, hashy, points>>`` for each category with hits."""
    counted = each(
        hits,
        lambda h: struct(
            category=f"{h}.category", count=count_of(h, summarized), hashy=_hash_like(h, summarized)
        ),
    )
    points = lambda p: (
        f"(case when {p}.hashy then {weight_of(f'{p}.category')} * 60 div 100 "
        f"else {weight_of(f'{p}.category')} end) * least({p}.count, 21L)"
    )
    return each(
        counted,
        lambda p: struct(
            category=f"{p}.category", count=f"{p}.count", hashy=f"{p}.hashy", points=points(p)
        ),
    )


def _shown(summaries: str) -> str:
    """Findings of summaries."""
    return each(
        summaries,
        lambda h: struct(category=f"{h}.category", count=f"{h}.count", redacted_examples=f"{h}.redacted_examples"),
    )


def _reason(key: str, **variables: str) -> str:
    pairs = ", ".join(f"'{k}', cast({v} as string)" for k, v in variables.items())
    empty = f"map_from_arrays({NO_STRINGS}, {NO_STRINGS})"
    return struct(key=lit(key), vars=f"map({pairs})" if pairs else empty)


def _only_if(condition: str, reason: str) -> str:
    return f"case when {condition} then array({reason}) else {_NO_REASONS} end"


def with_risk(
    df: DataFrame,
    rules: Sequence[Rule] = (),
    *,
    hits: str = "hits",
    custom_hits: str | None = None,
    bonus: str | None = None,
    weak_zip: str | None = None,
    signals: str | None = None,
    too_large: str | None = None,
    size: str = "size",
    summarized: bool = False,
) -> DataFrame:
    """Add ``findings, custom_findings, reasons, risk_score, risk_level``.

    With ``summarized`` the hits are summaries of ``merge_findings`` instead of values.
    Optional inputs are column names: file-name ``bonus``, the ``weak_zip`` flag, file-name
    ``signals`` (for their reasons) and the ``too_large`` flag with ``size``.
    """
    custom = custom_hits or (EMPTY_SUMMARIES if summarized else EMPTY_HITS)
    bonus = bonus or "0L"
    weak = weak_zip or "false"

    custom_parts = each(
        custom,
        lambda h: struct(
            category=f"{h}.category",
            count=count_of(h, summarized),
            level=rule_level(f"{h}.category", rules),
        ),
    )
    rule_points = lambda p: (
        f"{lookup(f'{p}.level', fixed.RULE_WEIGHTS, '4')} * least({p}.count, 20L)"
    )
    score = (
        f"{fold('_parts', '0L', lambda a, p: f'{a} + {p}.points')} + "
        f"{fold('_custom_parts', '0L', lambda a, p: f'{a} + {rule_points(p)}')} + "
        f"case when {bonus} > 0 then {bonus} else 0L end + "
        f"case when {weak} then {fixed.WEAK_ZIP_BONUS} else 0 end"
    )
    ranks = (
        f"concat(array(case when {weak} then 2 else 0 end), "
        f"{each('_parts', lambda p: builtin_rank(f'{p}.category'))}, "
        f"{each('_custom_parts', lambda p: risk_rank(f'{p}.level'))})"
    )
    high_builtin = keep("_parts", lambda p: f"{builtin_rank(f'{p}.category')} >= 2")
    high_custom = keep("_custom_parts", lambda p: f"{risk_rank(f'{p}.level')} >= 2")
    # built-in types and rules count apart; the weak archive also counts once as such
    builtin_name = lambda p: f"concat('builtin ', {p}.category)"
    high_types = (
        f"size(array_distinct(concat({each(high_builtin, builtin_name)}, "
        f"{each(high_custom, lambda p: f'{p}.category')}, "
        f"case when {weak} then array('weak_archive_encryption') else {NO_STRINGS} end)))"
    )
    keyword_reasons = (
        each(signals, lambda k: _reason("reason.filenameKeyword", keyword=k))
        if signals
        else _NO_REASONS
    )
    size_reason = (
        _only_if(too_large, _reason("reason.fileTooLarge", bytes=size))
        if too_large
        else _NO_REASONS
    )
    category_reasons = each(
        "_parts",
        lambda p: (
            f"concat({_only_if(f'{p}.hashy', _reason('reason.hashLike', category=f'{p}.category'))}, "
            f"array({_reason('reason.categoryCount', category=f'{p}.category', count=f'{p}.count')}))"
        ),
    )
    rule_reasons = each(
        "_custom_parts",
        lambda p: _reason(
            "reason.customCategoryCount",
            category=f"{p}.category", count=f"{p}.count", risk=f"{p}.level",
        ),
    )
    reasons = (
        f"concat({keyword_reasons}, {size_reason}, flatten({category_reasons}), "
        f"{_only_if(f'{bonus} > 0', _reason('reason.filenameSignal', bonus=bonus))}, "
        f"{_only_if(weak, _reason('reason.weakZipEncryption'))}, {rule_reasons})"
    )
    out = ["findings", "custom_findings", "reasons", "risk_score", "risk_level"]
    kept = [f"`{c}`" for c in df.columns if c not in out]
    return (
        df.selectExpr(
            *kept, f"{score_parts(hits, summarized)} as _parts", f"{custom_parts} as _custom_parts"
        )
        .selectExpr(
            *kept,
            f"{_shown(hits) if summarized else summarize(hits)} as findings",
            f"{_shown(custom) if summarized else summarize(custom, custom=True)} as custom_findings",
            f"cast({reasons} as {REASONS_TYPE}) as reasons",
            f"{score} as risk_score",
            f"array_max({ranks}) as _max_rank",
            f"{high_types} as _high_types",
        )
        .selectExpr(
            *kept,
            *out[:4],
            f"{risk_level('risk_score', '_max_rank', '_high_types')} as risk_level",
        )
    )


def risk_level_from_score(score: str) -> str:
    """Rank 0..3 by score alone."""
    return f"(case when {score} >= 55 then 3 when {score} >= 25 then 2 when {score} >= 10 then 1 else 0 end)"


def risk_level(score: str, max_rank: str, high_types: str) -> str:
    """Level by score; critical needs two high types; never above the highest evidence."""
    rank = risk_level_from_score(score)
    allowed = f"case when {rank} = 3 and {high_types} < 2 then 2 else {rank} end"
    return risk_name(f"least({allowed}, {max_rank})")


def has_signal(
    findings: Column, custom_findings: Column, weak_zip: Column, score: Column
) -> Column:
    """The rule for keeping a scan as an alert."""
    counted = lambda f: f["count"] > 0
    return (
        F.exists(findings, lambda f: counted(f) & (f.category != "file_name_signal"))
        | weak_zip
        | F.exists(custom_findings, counted)
        | (
            F.exists(findings, lambda f: counted(f) & (f.category == "file_name_signal"))
            & (score >= 10)
        )
    )


# --- long form --------------------------------------------------------------------------------


def summarize_long(matches: DataFrame, id_col: str, examples: int = 5) -> DataFrame:
    """Findings from long-form matches: ``scope, category, cnt, redacted_examples``.

    Counting combines map-side. A match is an example only if fewer than ``examples`` precede it,
    so no more than these are collected for one group.
    """
    masked = (
        f"case when scope = 'custom' then {redact_last('value')} "
        f"else {redact('category', 'value')} end"
    )
    return (
        matches.selectExpr(
            "*", f"case when pos < {examples} then named_struct('pos', pos, 'red', {masked}) end as _ex"
        )
        .groupBy(id_col, "scope", "category")
        .agg(
            F.count(F.lit(1)).alias("cnt"),
            F.transform(
                F.array_sort(F.collect_list("_ex")), lambda x: x.red
            ).alias("redacted_examples"),
        )
    )


# --- overview ---------------------------------------------------------------------------------


def risk_overview(documents: DataFrame, source: str, *, hits: str = "hits") -> DataFrame:
    """Matches and exact numbers of documents by source and category, by each of them, and in total.

    ``documents`` has one row per document with its hits. Its categories differ from each other, so a document adds one to
    each group it is in, and no distinct count is needed: one shuffle of sums that are combined before. ``level`` is
    ``source_category``, ``source``, ``category`` or ``total`` and tells a null source from all sources. Documents
    without hits do not count; without any hits there are no rows.
    """
    name, none = f"cast(`{source}` as string)", "cast(null as string)"
    size = lambda h: f"cast(size({h}.vals) as bigint)"
    entry = lambda level, a, b, n: struct(level=lit(level), source=a, category=b, n=n)
    every = f"aggregate({hits}, 0L, (a, h) -> a + {size('h')})"
    groups = (
        f"concat({each(hits, lambda h: entry('source_category', name, f'{h}.category', size(h)))}, "
        f"{each(hits, lambda h: entry('category', none, f'{h}.category', size(h)))}, "
        f"array({entry('source', name, none, every)}, {entry('total', none, none, every)}))"
    )
    found = documents.selectExpr(f"inline(case when size({hits}) > 0 then {groups} end)")
    return found.groupBy("level", "source", "category").agg(F.sum("n").alias("matches"), F.count(F.lit(1)).alias("docs"))
