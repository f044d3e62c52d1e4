"""Helpers to write Spark SQL expressions.

The detectors and scoring rules are SQL expressions, written as text and handed to Spark in one
piece (``F.expr``, ``selectExpr``). Large expressions put together from single ``Column`` calls
cost seconds of driver time per plan, which a micro-batch cannot afford.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

from .patterns import quick_start

_numbers = itertools.count()


def lit(text: str) -> str:
    """String literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array(values: Iterable[str]) -> str:
    """``array<string>`` literal; an empty list keeps its type."""
    inner = ", ".join(lit(v) for v in values)
    return f"array({inner})" if inner else NO_STRINGS


NO_STRINGS = "cast(array() as array<string>)"


def _lambda(body: Callable[..., str], arity: int = 1) -> str:
    names = [f"_v{next(_numbers)}" for _ in range(arity)]
    head = names[0] if arity == 1 else f"({', '.join(names)})"
    return f"{head} -> {body(*names)}"


def each(values: str, body: Callable[[str], str]) -> str:
    return f"transform({values}, {_lambda(body)})"


def each_at(values: str, body: Callable[[str, str], str]) -> str:
    """As :func:`each`, with the index from 0 as second argument."""
    return f"transform({values}, {_lambda(body, 2)})"


def keep(values: str, test: Callable[[str], str]) -> str:
    return f"filter({values}, {_lambda(test)})"


def some(values: str, test: Callable[[str], str]) -> str:
    return f"exists({values}, {_lambda(test)})"


def fold(values: str, start: str, step: Callable[[str, str], str]) -> str:
    return f"aggregate({values}, {start}, {_lambda(step, 2)})"


def zipped(left: str, right: str, body: Callable[[str, str], str]) -> str:
    return f"zip_with({left}, {right}, {_lambda(body, 2)})"


def let(value: str, body: Callable[[str], str]) -> str:
    """Evaluate ``value`` once and use it any number of times inside ``body``."""
    return f"element_at({each(f'array({value})', body)}, 1)"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in fields.items()) + ")"


def any_of(tests: Iterable[str]) -> str:
    joined = " or ".join(tests)
    return f"({joined})" if joined else "false"


def in_list(value: str, names: Iterable[str | int]) -> str:
    """Membership in a few constants, as equalities: inside lambdas Spark evaluates a short IN
    list far more slowly than these. Long lists become hash sets."""
    values = [lit(n) if isinstance(n, str) else str(n) for n in names]
    if len(values) > 10:
        return f"{value} in ({', '.join(values)})"
    return any_of(f"{value} = {v}" for v in values)


def contains_any(text: str, parts: Iterable[str]) -> str:
    return any_of(f"contains({text}, {lit(p)})" for p in parts)


def lookup(key: str, table: dict[str, object], default: str) -> str:
    """Constant table as a CASE; numbers stay numbers."""
    value = lambda v: lit(v) if isinstance(v, str) else str(v)
    arms = " ".join(f"when {lit(k)} then {value(v)}" for k, v in table.items())
    return f"(case {key} {arms} else {default} end)" if arms else default


def find_all(text: str, pattern: str, group: int = 0, unicode: bool = False) -> str:
    """All non-overlapping matches as ``array<string>``, empty when the text is null."""
    p = ("(?U)" if unicode else "") + quick_start(pattern)
    return f"coalesce(regexp_extract_all({text}, {lit(p)}, {group}), {NO_STRINGS})"


def guarded(guard: str, found: str, empty: str = NO_STRINGS) -> str:
    """Skip a pattern when a cheap test shows that it cannot match."""
    return f"case when {guard} then {found} else {empty} end"


def first_n(values: str, n: int | None) -> str:
    return values if n is None else f"slice({values}, 1, {n})"
