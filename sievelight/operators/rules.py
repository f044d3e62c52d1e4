"""Rule detectors: file-name, field-name and value patterns supplied as data."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.patterns import Refused, safe_pattern
from ..functions.sql import (
    NO_STRINGS,
    each,
    find_all,
    first_n,
    guarded,
    in_list,
    keep,
    lit,
    struct,
)
from ..functions.text import file_name
from .builtin import HITS_TYPE, PAIRS_TYPE, explode_hits


@dataclass(frozen=True)
class Rule:
    """One compiled rule; at least one of the three patterns is set."""

    name: str
    risk_level: str = "medium"
    filename_regex: str | None = None
    field_name_regex: str | None = None
    value_regex: str | None = None


def _rejected(spark: SparkSession, patterns: Sequence[str]) -> str | None:
    """Why Spark does not accept one of the patterns, None when it accepts all."""
    listed = f"array({', '.join(map(lit, patterns))})"
    try:  # one expression, however many patterns
        spark.sql(f"select transform({listed}, p -> regexp_like('', p)) as ok").collect()
    except PySparkException as error:
        return str(error).splitlines()[0]
    return None


def _out_of_bounds(pattern: str) -> str | None:
    if not pattern:
        return "empty regex"
    if len(pattern.encode("utf-8")) > fixed.RULE_REGEX_MAX_BYTES:
        return f"regex too long (max {fixed.RULE_REGEX_MAX_BYTES} bytes)"
    if pattern.count("|") > fixed.RULE_REGEX_MAX_ALTERNATIVES:
        return f"too many alternatives (max {fixed.RULE_REGEX_MAX_ALTERNATIVES})"
    return None


def _unsafe(pattern: str) -> str | None:
    """Why the pattern may end a job on a long text, None if it cannot."""
    try:
        safe_pattern(pattern)
    except Refused as reason:
        return f"unsafe regex: {reason}"
    return None


def validate_rule_regex(spark: SparkSession, pattern: str) -> str | None:
    """None when the pattern is usable, otherwise what is wrong with it.

    Patterns that cannot be shown to be safe on texts of any length are refused, see ``functions/patterns.py``.
    """
    p = pattern.strip()
    error = _out_of_bounds(p)
    if error is None:
        rejected = _rejected(spark, [p])
        error = f"invalid regex: {rejected}" if rejected else _unsafe(p)
    return error


def safe_rule(rule: Rule) -> Rule:
    """The rule with patterns that find the same on texts of any length; an error if there are none."""
    fields = ("filename_regex", "field_name_regex", "value_regex")
    try:
        return replace(rule, **{f: p and safe_pattern(p) for f in fields for p in [getattr(rule, f)]})
    except Refused as reason:
        raise ValueError(f"rule {rule.name}: unsafe regex: {reason}") from None


def locale_parts(locale: Column) -> tuple[Column, Column]:
    """Language and region (null if absent) of a locale such as ``fr_FR.UTF-8``."""
    base = F.lower(
        F.replace(F.regexp_extract(F.trim(locale), r"^[^.@]*", 0), F.lit("_"), F.lit("-"))
    )
    parts = F.split(base, "-")
    region = F.try_element_at(parts, F.lit(2))
    return parts[0], F.when(region != "", region)


def locale_matches(requirement: Column, locale: str) -> Column:
    """Does a rule's locale requirement admit ``locale``?"""
    lang, region = locale_parts(F.lit(locale))
    req_lang, req_region = locale_parts(requirement)
    blank = requirement.isNull() | (F.trim(requirement) == "")
    return F.when(blank, True).otherwise(
        (lang != "")
        & (req_lang != "")
        & F.when(
            req_region.isNotNull(), (req_lang == lang) & req_region.eqNullSafe(region)
        ).otherwise(
            ((F.length(req_lang) == 2) & (req_lang == lang)) | region.eqNullSafe(req_lang)
        )
    )


def active_rules(rules: DataFrame, locale: str | None = None) -> DataFrame:
    """Enabled rules that fit the locale and have a pattern; ``locale=None`` admits all."""
    patterns = ["filename_regex", "field_name_regex", "value_regex"]
    wanted = F.col("enabled") & (F.trim(F.concat_ws("", *patterns)) != "")
    if locale is not None:
        wanted = wanted & locale_matches(F.col("locale_requirement"), locale)
    return rules.filter(wanted)


def compile_rules(rules: DataFrame, locale: str | None = None, max_rules: int = 5_000) -> list[Rule]:
    """Validated rules in name order, ready to become literal patterns of a plan.

    Rules are configuration: their number is checked, and a bad pattern fails with its name.
    """
    rows = (
        active_rules(rules, locale)
        .select("id", "risk_level", "filename_regex", "field_name_regex", "value_regex")
        .orderBy("id")
        .limit(max_rules + 1)
        .collect()
    )
    if len(rows) > max_rules:
        raise ValueError(f"more than {max_rules} active rules")
    fields = ("filename_regex", "field_name_regex", "value_regex")
    found = [{f: (r[f] or "").strip() or None for f in fields} for r in rows]
    every = [p for named in found for p in named.values() if p]
    spark = rules.sparkSession
    if any(_out_of_bounds(p) or _unsafe(p) for p in every) or (every and _rejected(spark, every)):
        for r, named in zip(rows, found):
            for field, pattern in named.items():
                error = pattern and validate_rule_regex(spark, pattern)
                if error:
                    raise ValueError(f"rule {r['id']}, {field}: {error}")
    return [Rule(r["id"], r["risk_level"], **named) for r, named in zip(rows, found)]


# The generic pair pattern of the fixed values, matched in linear time. A key is the end of a
# whole run of key characters (80 of them at most), so a run without a separator behind it is
# given up at once instead of from each of its characters. A run that ends in '-' before '>' is
# a key followed by '->'.
_KEY_CHAR = r"[A-Za-z0-9_\-.]"
_PAIR = (
    rf"(?:(?<!{_KEY_CHAR})|\G){_KEY_CHAR}{{2,}}+(?:\s*(?:[:=]|->)|(?<={_KEY_CHAR}{{2}}-)>)"
    r"\s*[^\n\r]{1,300}"
)
_PAIR_PARTS = rf"(?s)^({_KEY_CHAR}+?)(?:\s*[:=]|\s*->)\s*(.+)$"


def field_pairs(text: str, unicode: bool = True) -> str:
    """All generic ``key separator value`` pairs of a text.

    By the fixed pattern a key is at most the last 80 characters of its run, and a value the first 300 of
    its line.
    """
    found = find_all(text, _PAIR, 0, unicode)
    parts = lit(("(?U)" if unicode else "") + _PAIR_PARTS)
    part = lambda m, g: f"regexp_extract({m}, {parts}, {g})"
    return each(found, lambda m: struct(key=f"right({part(m, 1)}, 80)", value=part(m, 2)))


def rule_values(
    rule: Rule, text: str, name: str | None, pairs: str, cap: int | None, unicode: bool
) -> str:
    """Values of one rule: the file name, then fields, then text hits."""
    parts = []
    if rule.filename_regex and name:
        parts.append(
            f"case when {name} rlike {lit(rule.filename_regex)} then array({name}) else {NO_STRINGS} end"
        )
    if rule.field_name_regex:
        fields = keep(pairs, lambda kv: f"{kv}.key rlike {lit(rule.field_name_regex)}")
        parts.append(each(fields, lambda kv: f"{kv}.value"))
    if rule.value_regex:
        parts.append(find_all(text, rule.value_regex, 0, unicode))
    return first_n(f"concat({', '.join(parts) or NO_STRINGS})", cap)


def with_rule_hits(
    df: DataFrame,
    rules: Sequence[Rule],
    text_col: str | None = "text",
    name_col: str | None = None,
    out: str = "custom_hits",
    *,
    cap: int | None = None,
    unicode: bool = True,
    target: str | None = None,
) -> DataFrame:
    """Add all rule matches as ``array<struct<category, vals>>`` in rule-name order.

    Patterns are literals of the plan, so each compiles once per task; they are rewritten so that no text can overflow
    the engine's stack, and a rule with a pattern that cannot be is an error before the job starts. The generic key-value
    pairs are found once and shared by all field-name rules. All values are reported, unless
    ``cap`` bounds them per rule and row. ``target`` is a column with the name of the one rule that is wanted of a row; others do
    not run on it.
    """
    of = lambda names, e, empty=NO_STRINGS: e if target is None else guarded(in_list(target, names), e, empty)
    text = text_col or "cast(null as string)"
    ordered = sorted(map(safe_rule, rules), key=lambda r: r.name)
    entries = ", ".join(
        struct(
            category=lit(r.name),
            vals=of([r.name], rule_values(r, text, "_name" if name_col else None, "_pairs", cap, unicode)),
        )
        for r in ordered
    )
    hits = keep(f"array({entries})", lambda h: f"size({h}.vals) > 0") if entries else "array()"
    helpers = []
    keyed = [r.name for r in rules if r.field_name_regex]
    if keyed:
        helpers.append(f"{of(keyed, field_pairs(text, unicode), f'cast(array() as {PAIRS_TYPE})')} as _pairs")
    if name_col:
        helpers.append(f"{file_name(name_col)} as _name")
    kept = [f"`{c}`" for c in df.columns if c != out]
    return df.selectExpr("*", *helpers).selectExpr(*kept, f"cast({hits} as {HITS_TYPE}) as {out}")


def detect_rules(
    df: DataFrame,
    text_col: str,
    id_col: str,
    rules: Sequence[Rule],
    name_col: str | None = None,
    **options,
) -> DataFrame:
    """Rule matches in long form with ``scope = 'custom'``."""
    cols = [id_col, text_col] + ([name_col] if name_col else [])
    hits = with_rule_hits(df.select(*dict.fromkeys(cols)), rules, text_col, name_col, **options)
    return explode_hits(hits, [id_col], "custom_hits", "custom")


def field_rule(keys: Sequence[str], name: str, risk_level: str = "high") -> Rule:
    """A field-name rule for exact, case-insensitive keys."""
    body = "|".join(re.escape(k) for k in keys)
    return Rule(name, risk_level, field_name_regex=f"(?i)^(?:{body})$")
