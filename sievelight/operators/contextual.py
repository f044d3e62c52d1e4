"""Context-scored entities: people, organisations, places.

A match is scored by the five words before and after it. To find those words without offsets,
matches are marked in the text with two noncharacters, the marked text is split into words
once, and every match then reads a slice of that word array. The work per document is linear.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.sql import (
    any_of,
    contains_any,
    each,
    each_at,
    find_all,
    keep,
    let,
    lit,
    struct,
    zipped,
)
from .builtin import EMPTY_HITS, HITS_TYPE

_OPEN, _CLOSE, _OTHER = "\ufdd0", "\ufdd1", "\ufffd"
_WORD = r"[A-Z][a-z]+"
_SUFFIX = "(?:" + "|".join(fixed.ORG_SUFFIXES) + ")"

# Runs of capitalised words, matched without backtracking into the run, so that very long runs
# cannot overflow the regex engine's stack. An organisation is the part of a run (with the
# suffix that follows it) up to the last suffix that stands after white space. "GmbH" begins like
# a word of its own, so its last letter is added to a run that ends in "Gmb".
_RUN = rf"{_WORD}(?:\s+{_WORD})*+"
_ORG_RUN = rf"{_WORD}(?:(?:\s+{_WORD})++(?:(?<=\sGmb)H|\s+{_SUFFIX})?|\s+{_SUFFIX})?"
_ORG_IN_RUN = rf"(?s)^.+\s{_SUFFIX}"


@dataclass(frozen=True)
class EntitySetting:
    """What to look for, the words that raise or lower the score, and the threshold."""

    entity_type: str
    positive: Sequence[str] | None = None
    negative: Sequence[str] | None = None
    threshold: float | None = None
    enabled: bool = True


def split_indicators(text: str | None) -> list[str] | None:
    return None if text is None else [p.strip() for p in text.split(",")]


def default_entities() -> list[EntitySetting]:
    return [
        EntitySetting(name, split_indicators(pos), split_indicators(neg), threshold)
        for name, pos, neg, threshold in fixed.ENTITY_DEFAULTS
    ]


def load_entities(settings: DataFrame, max_rows: int = 1_000) -> list[EntitySetting]:
    """Enabled contextual settings from a table of entity settings."""
    rows = (
        settings.filter(F.col("enabled") & (F.col("entity_category") == "contextual"))
        .orderBy("entity_type")
        .limit(max_rows + 1)
        .collect()
    )
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} entity settings")
    return [EntitySetting(r["entity_type"], r["positive"], r["negative"], r["threshold"]) for r in rows]


_DEFAULT_THRESHOLD = {"person": 0.75, "organization": 0.70, "location": 0.65}


def _run_pattern(entity: str) -> str:
    return {"person": fixed.PERSON, "organization": _ORG_RUN, "location": _RUN}[entity]


def _unmark(text: str) -> str:
    return f"translate({text}, {lit(_OPEN + _CLOSE)}, '')"


def _starts(word: str) -> str:
    """For each opening mark in a word: the part of the word before it."""
    return let(
        f"split({word}, {lit(_OPEN)}, -1)",
        lambda parts: each(
            f"sequence(1, size({parts}) - 1)",
            lambda k: _unmark(f"array_join(slice({parts}, 1, {k}), '')"),
        ),
    )


def _ends(word: str) -> str:
    """For each closing mark in a word: the part of the word after it."""
    return let(
        f"split({word}, {lit(_CLOSE)}, -1)",
        lambda parts: each(
            f"sequence(1, size({parts}) - 1)",
            lambda k: _unmark(f"array_join(slice({parts}, {k} + 1, size({parts})), '')"),
        ),
    )


def _places(words: str, mark: str, inside) -> str:
    """``array<struct<i, part>>`` of all marks in document order; ``i`` is the word index."""
    marked = keep(
        each_at(words, lambda w, i: struct(i=i, w=w)), lambda x: f"contains({x}.w, {lit(mark)})"
    )
    return "flatten(" + each(
        marked, lambda x: each(inside(f"{x}.w"), lambda part: struct(i=f"{x}.i", part=part))
    ) + ")"


def _count_matches(context: str, indicators: Sequence[str]) -> str:
    lowered = [p.lower() for p in indicators]
    hits = keep(context, lambda w: let(f"lower({w})", lambda x: contains_any(x, lowered)))
    return f"cast(size({hits}) as double)"


def context_score(context: str, value: str, setting: EntitySetting) -> str:
    """0.5, plus and minus bounded indicator counts, plus 0.1 for 5 to 40 bytes; in [0, 1]."""
    score = "0.5D"
    if setting.positive is not None:
        score += f" + least({_count_matches(context, setting.positive)} * 0.1D, 0.35D)"
    if setting.negative is not None:
        score += f" - least({_count_matches(context, setting.negative)} * 0.1D, 0.25D)"
    score += f" + case when octet_length({value}) between 5 and 40 then 0.1D else 0.0D end"
    return f"greatest(0.0D, least(1.0D, {score}))"


def _accept(value: str, entity: str) -> str:
    if entity == "person":
        starts = any_of(f"startswith({value}, {lit(w)})" for w in fixed.NOT_A_NAME_STARTS)
        return f"not {starts}"
    if entity == "location":
        return f"not {contains_any(value, fixed.NOT_A_PLACE_WORDS)}"
    return f"{value} <> ''"


def _confidence(context: str, value: str, setting: EntitySetting) -> str:
    score = context_score(context, value, setting)
    if setting.entity_type != "organization":
        return score
    ends = any_of(f"endswith({value}, {lit(x)})" for x in fixed.ORG_BONUS_SUFFIXES)
    return let(
        score, lambda x: f"case when {ends} then least({x} + 0.15D, 1.0D) else {x} end"
    )


def _context(words: str, c: str) -> str:
    """Up to five words on either side of a place, partial words at its edges included."""
    plain = lambda ws: keep(each(ws, _unmark), lambda w: f"{w} <> ''")
    i, j = f"{c}.s.i", f"{c}.e.i"
    before = (
        f"case when {c}.s.part = '' then "
        f"{plain(f'slice({words}, greatest({i} - 4, 1), least({i}, 5))')} else concat("
        f"{plain(f'slice({words}, greatest({i} - 3, 1), least({i}, 4))')}, array({c}.s.part)) end"
    )
    after = (
        f"case when {c}.e.part = '' then {plain(f'slice({words}, {j} + 2, 5)')} "
        f"else concat(array({c}.e.part), {plain(f'slice({words}, {j} + 2, 4)')}) end"
    )
    return f"concat({before}, {after})"


_FOUND_TYPE = "array<struct<value:string,confidence:double>>"


def _values(text: str, entity: str, u: str) -> str:
    """One value per run of the pattern, empty for a run without an organisation."""
    runs = find_all(text, u + _run_pattern(entity))
    if entity != "organization":
        return runs
    return each(runs, lambda run: f"regexp_extract({run}, {lit(u + _ORG_IN_RUN)}, 0)")


def _marked(text: str, entity: str, u: str) -> str:
    """The text with a mark before and after each match."""
    clean = f"translate({text}, {lit(_OPEN + _CLOSE)}, {lit(_OTHER * 2)})"
    marked = (
        f"regexp_replace({clean}, {lit(u + _run_pattern(entity))}, {lit(_OPEN + '$0' + _CLOSE)})"
    )
    if entity != "organization":
        return marked
    # the closing mark moves to the end of the organisation
    split_run = rf"{_OPEN}([^{_CLOSE}]*\s{_SUFFIX})([^{_CLOSE}]*){_CLOSE}"
    return f"regexp_replace({marked}, {lit(split_run)}, {lit(_OPEN + '$1' + _CLOSE + '$2')})"


def with_entity_candidates(
    df: DataFrame, setting: EntitySetting, text_col: str, out: str, unicode: bool = True
) -> DataFrame:
    """Add ``array<struct<value, confidence>>`` with one element per run of the pattern: the
    match when it reaches the threshold, else null."""
    entity = setting.entity_type
    u = "(?U)" if unicode else ""
    splitter = lit(u + r"\s+")
    words = f"split({_marked(text_col, entity, u)}, {splitter}, -1)"
    places = zipped(
        _places("_words", _OPEN, _starts),
        _places("_words", _CLOSE, _ends),
        lambda s, e: struct(s=s, e=e),
    )
    threshold = setting.threshold if setting.threshold is not None else _DEFAULT_THRESHOLD[entity]

    def judge(value: str, place: str) -> str:
        def decide(confidence: str) -> str:
            found = struct(value=value, confidence=confidence)
            return f"case when {confidence} >= {threshold!r}D then {found} end"

        scored = let(
            let(_context("_words", place), lambda x: _confidence(x, value, setting)), decide
        )
        return f"case when {_accept(value, entity)} then {scored} end"

    kept = [f"`{c}`" for c in df.columns]
    none = f"cast(array() as {_FOUND_TYPE})"
    return (
        df.selectExpr("*", f"{_values(text_col, entity, u)} as _values")
        .selectExpr("*", f"case when size(_values) > 0 then {words} end as _words")
        .selectExpr("*", f"case when size(_values) > 0 then {places} end as _places")
        .selectExpr(
            *kept,
            f"cast(coalesce({zipped('_values', '_places', judge)}, {none}) as {_FOUND_TYPE}) as {out}",
        )
    )


_KNOWN = ("person", "organization", "location")


def _used(entities: Sequence[EntitySetting]) -> list[EntitySetting]:
    return [e for e in entities if e.enabled and e.entity_type in _KNOWN]


def with_contextual_hits(
    df: DataFrame,
    entities: Sequence[EntitySetting],
    text_col: str = "text",
    out: str = "entity_hits",
    unicode: bool = True,
) -> DataFrame:
    """Add entity matches as ``array<struct<category, vals>>``, settings in the given order."""
    used = _used(entities)
    kept = [f"`{c}`" for c in df.columns]
    for n, e in enumerate(used):
        df = with_entity_candidates(df, e, text_col, f"_entity{n}", unicode)
    accepted = lambda n: keep(f"_entity{n}", lambda d: f"{d} is not null")
    entries = ", ".join(
        struct(category=lit(e.entity_type), vals=each(accepted(n), lambda d: f"{d}.value"))
        for n, e in enumerate(used)
    )
    hits = keep(f"array({entries})", lambda h: f"size({h}.vals) > 0") if entries else EMPTY_HITS
    return df.selectExpr(*kept, f"cast({hits} as {HITS_TYPE}) as {out}")


def detect_contextual(
    df: DataFrame,
    text_col: str,
    id_col: str,
    entities: Sequence[EntitySetting],
    *,
    spans: bool = False,
    unicode: bool = True,
) -> DataFrame:
    """Entities in long form: ``entity, k, value, confidence``, with ``spans`` also
    ``start_byte, end_byte``. ``k`` numbers a document's detections of one kind from 0.

    All kinds are found in one pass over the texts. Spans come from a running sum of the lengths
    of matches and gaps; for that, lengths and values are shuffled by document, never texts.
    """
    used = _used(entities)
    if not used:
        raise ValueError("no enabled contextual entity")
    base = df.select(id_col, text_col)
    for n, e in enumerate(used):
        base = with_entity_candidates(base, e, text_col, f"_entity{n}", unicode)
    if spans:
        return _with_spans(base, used, text_col, id_col, unicode)
    rows = []
    for n, e in enumerate(used):
        accepted = keep(f"_entity{n}", lambda d: f"{d} is not null")
        rows.append(
            each_at(
                accepted,
                lambda d, k, e=e: struct(
                    entity=lit(e.entity_type), k=k, value=f"{d}.value", confidence=f"{d}.confidence"
                ),
            )
        )
    return base.selectExpr(id_col, f"inline_outer(concat({', '.join(rows)}))").filter(
        F.col("value").isNotNull()
    )


def _with_spans(
    base: DataFrame, used: Sequence[EntitySetting], text_col: str, id_col: str, unicode: bool
) -> DataFrame:
    u = "(?U)" if unicode else ""
    size = lambda r: f"cast(octet_length(coalesce({r}, '')) as bigint)"
    pieces = []
    for n, e in enumerate(used):
        pattern = u + _run_pattern(e.entity_type)
        lengths = zipped(
            f"split({text_col}, {lit(pattern)}, -1)",
            find_all(text_col, pattern),
            lambda g, r: struct(gap=size(g), run=size(r)),
        )
        pieces.append(
            let(
                zipped(lengths, f"_entity{n}", lambda p, d: struct(p=p, d=d)),
                lambda ps, e=e: each_at(
                    ps,
                    lambda x, i: struct(
                        entity=lit(e.entity_type), pos=i, gap=f"{x}.p.gap", run=f"{x}.p.run",
                        value=f"{x}.d.value", confidence=f"{x}.d.confidence",
                    ),
                ),
            )
        )
    order = W.partitionBy(id_col, "entity").orderBy("pos")
    end = F.col("start_byte") + F.octet_length("value")
    return (
        base.selectExpr(id_col, f"inline_outer(concat({', '.join(pieces)}))")
        .withColumn("start_byte", F.sum(F.col("gap") + F.col("run")).over(order) - F.col("run"))
        .filter(F.col("value").isNotNull())
        .withColumn("k", (F.row_number().over(order) - 1).cast("int"))
        .select(
            id_col, "entity", "k", "value", "confidence", "start_byte", end.cast("bigint").alias("end_byte")
        )
    )
