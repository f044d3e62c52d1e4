"""Many value rules at once: only rules whose needed strings occur in a text are searched in it."""

from __future__ import annotations

from collections.abc import Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.literals import folded, needed_literals
from ..functions.sql import NO_STRINGS, each, first_n, keep, struct
from .builtin import HITS_TYPE
from .rules import Rule, safe_rule, with_rule_hits


def split_rules(rules: Sequence[Rule]) -> tuple[list[Rule], list[Rule]]:
    """Rules that an index can find by needed strings, and the rest: of names, of fields, or without such a string."""
    by_index: list[Rule] = []
    rest: list[Rule] = []
    for r in rules:
        only_value = r.value_regex and not (r.filename_regex or r.field_name_regex)
        (by_index if only_value and needed_literals(r.value_regex) else rest).append(r)
    return by_index, rest


def _asked(text: Column, rules: Sequence[Rule], unicode: bool, max_bytes: int) -> Column:
    """``array<struct<name, pattern>>``: the rules that may match a text, in the order given."""
    flag = "(?U)" if unicode else ""
    listed = [(r.name, flag + safe_rule(r).value_regex, sorted(needed_literals(r.value_regex))) for r in rules]
    size = sum(len(s.encode()) for name, pattern, needed in listed for s in (name, pattern, *needed))
    if size > max_bytes:
        raise ValueError(f"the rules take {size} bytes, more than max_bytes={max_bytes}")
    searches: list[ahocorasick.Automaton] = []  # one for each task

    def search() -> ahocorasick.Automaton:
        if not searches:
            places: dict[str, list[int]] = {}
            for i, (_, _, needed) in enumerate(listed):
                for s in needed:
                    places.setdefault(s, []).append(i)
            made = ahocorasick.Automaton()
            for s, which in places.items():
                made.add_word(s, tuple(which))
            made.make_automaton()
            searches.append(made)
        return searches[0]

    kind = T.ArrayType(T.StructType().add("name", T.StringType()).add("pattern", T.StringType()))
    arrow_kind = pa.list_(pa.struct([("name", pa.string()), ("pattern", pa.string())]))

    @F.arrow_udf(kind)
    def asked(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts:
            value = text.as_py()
            found = {i for _, which in search().iter(folded(value)) for i in which} if value else ()
            out.append([{"name": listed[i][0], "pattern": listed[i][1]} for i in sorted(found)])
        return pa.array(out, arrow_kind)

    return asked(text)


def with_indexed_rule_hits(
    df: DataFrame,
    rules: Sequence[Rule],
    text_col: str = "text",
    name_col: str | None = None,
    out: str = "custom_hits",
    *,
    cap: int | None = None,
    unicode: bool = True,
    max_bytes: int = 32 << 20,
) -> DataFrame:
    """``with_rule_hits`` for thousands of rules: the same rows, and a plan that does not grow with their number.

    One pass over a text finds all needed strings of all rules; only the rules of which one occurs are then searched by
    their patterns, in the JVM. Rules of file names or fields, and those whose pattern needs no string of three characters,
    go through ``with_rule_hits``, and the plan grows with these alone. Rules are configuration that every task holds: more than
    ``max_bytes`` of them are an error, and so are repeated names. Nothing is shuffled.
    """
    names = [r.name for r in rules]
    if len(set(names)) < len(names):
        raise ValueError("names of rules repeat")
    by_index, rest = split_rules(rules)
    kept = [f"`{c}`" for c in df.columns if c != out]
    plain = with_rule_hits(df, rest, text_col, name_col, "_rest", cap=cap, unicode=unicode)
    if not by_index:
        return plain.selectExpr(*kept, f"_rest as {out}")
    ordered = sorted(by_index, key=lambda r: r.name)
    asked = plain.withColumn("_asked", _asked(F.col(text_col), ordered, unicode, max_bytes))
    found = each(
        "_asked",
        lambda a: struct(
            category=f"{a}.name",
            vals=first_n(f"coalesce(regexp_extract_all({text_col}, {a}.pattern, 0), {NO_STRINGS})", cap),
        ),
    )
    hits = keep(found, lambda h: f"size({h}.vals) > 0")
    every = f"concat(cast({hits} as {HITS_TYPE}), _rest)"
    # without rules of the other kind the hits are in order already
    return asked.selectExpr(*kept, f"{f'array_sort({every})' if rest else every} as {out}")
