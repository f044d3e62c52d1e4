"""Strings without which a pattern cannot match."""

from __future__ import annotations

from functools import lru_cache

from .patterns import Part, Refused, _Reader

#: Characters beyond ASCII that a case-insensitive pattern takes for these letters.
_ALIKE = str.maketrans("ſıİK", "siik")


def folded(text: str) -> str:
    """Lower case, so that a needed string of a pattern is found in each text that the pattern matches."""
    return text.translate(_ALIKE).lower()


def _character(part: Part) -> str | None:
    """The one ASCII character of a part, None if it may be another."""
    t = part.text
    plain = len(t) == 1 and t != "."
    quoted = len(t) == 2 and t[0] == "\\" and not t[1].isalnum()
    return t[-1].lower() if (plain or quoted) and t[-1].isascii() else None


def _best(found: list[frozenset[str]]) -> frozenset[str]:
    """The set whose shortest string is longest; of these the smallest."""
    return max(found, key=lambda s: (min(map(len, s), default=0), -len(s)), default=frozenset())


def _sequence(parts: list[Part]) -> frozenset[str]:
    found: list[frozenset[str]] = []
    run = ""

    def end() -> None:
        nonlocal run
        if run:
            found.append(frozenset([run]))
        run = ""

    def walk(listed: list[Part]) -> None:
        nonlocal run
        for p in listed:
            if p.kind == "flags" or p.kind == "check" and p.text not in ("\\R", "\\X"):
                continue
            once = p.low == p.high == 1
            c = _character(p) if p.kind == "set" else None
            if c is not None and p.low:
                run += c
                if not once:
                    end()
                    run = c if p.high else ""
                continue
            if p.kind == "group" and once and len(p.branches) == 1:
                walk(p.branches[0])
                continue
            end()
            if p.kind == "group" and p.low:
                ways = [_sequence(b) for b in p.branches]
                if all(ways):
                    found.append(frozenset().union(*ways))

    walk(parts)
    end()
    return _best(found)


@lru_cache(maxsize=1 << 15)
def needed_literals(pattern: str, *, shortest: int = 3) -> frozenset[str]:
    """Folded strings of which every match holds at least one; empty if none of ``shortest`` characters are known.

    Only ASCII characters take part. What is in optional parts or behind a look-around is not needed.
    """
    reader = _Reader(pattern)
    try:
        tree = reader.branches()
    except Refused:
        return frozenset()
    if reader.at < len(pattern) or not reader.balanced:
        return frozenset()
    ways = [_sequence(b) for b in tree]
    found = frozenset().union(*ways) if all(ways) else frozenset()
    return found if found and min(map(len, found)) >= shortest else frozenset()
