"""Patterns that cannot overflow the stack of the regex engine.

Spark's engine goes one step deeper for each round of a repeated group that has alternatives or parts of different
lengths, so ``(?:\\w|\\s)+;`` ends a job on a text of a few thousand characters. ``safe_pattern`` reads a pattern into a syntax tree and

* turns a repeated group whose alternatives are single characters into one character class,
* makes a repeated group possessive if every choice in it and after it is decided by the next character, so that
  going back into it could not find anything else (such rounds are a plain loop of the engine),
* refuses other repeated groups, with the reason,
* lets a pattern that begins with a run of characters, such as ``\\w+;``, start only where a run starts or the last match ended: from
  within a run it would find what it finds from its start, so long runs that lead to nothing cost linear time.

Groups with few rounds stay as they are. A repeated group is still tried from each of its rounds, so a text of n rounds that lead to
nothing costs time in proportion to the square of n.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import lru_cache

_ROUNDS = 200  # of a group, at most, that go deeper one by one
_FOREVER = 1 << 30
# all ASCII characters, and one of each kind beyond
_SAMPLE = [chr(c) for c in range(128)] + list("éÉſ٣\u00a0\u2003\u2028中€²_\u0301😀")
ALL = frozenset(range(len(_SAMPLE)))
END = frozenset([-1])


class Refused(ValueError):
    """The pattern may be right, but nothing shows that it is safe."""


@dataclass
class Part:
    """A part of a pattern: its text, what it is, and how often it is repeated."""

    kind: str  # set, group, check (of width 0) or flags
    text: str  # without the quantifier; of a group only what opens it
    first: frozenset = ALL
    branches: list[list[Part]] = field(default_factory=list)
    low: int = 1
    high: int = 1
    mode: str = ""  # "", "?" or "+"
    times: str = ""  # the quantifier as written


@lru_cache(maxsize=4096)
def _members(text: str, fold: bool) -> frozenset:
    """Sample characters that a one-character pattern may match, with Unicode or without; all of them if that is not known."""
    if any(ord(c) > 127 for c in text) or re.search(r"\\[^wWdDsStnrf\W]|&&|(?<!^)\[", text):
        return ALL
    try:
        ways = [re.compile(text, a | b | re.DOTALL) for a in {0, re.IGNORECASE * fold} for b in (0, re.ASCII)]
    except re.error:
        return ALL
    return frozenset(i for i, c in enumerate(_SAMPLE) if any(w.fullmatch(c) for w in ways))


class _Reader:
    def __init__(self, pattern: str):
        self.text, self.at, self.balanced = pattern, 0, True
        self.fold = re.search(r"\(\?[a-zA-Z]*i", pattern) is not None

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def take(self, end: int) -> str:
        taken, self.at = self.text[self.at : end], end
        return taken

    def branches(self) -> list[list[Part]]:
        found: list[list[Part]] = [[]]
        while self.at < len(self.text) and self.peek() != ")":
            if self.peek() == "|":
                self.at += 1
                found.append([])
            else:
                found[-1].extend(self.parts())
        return found

    def parts(self) -> list[Part]:
        if self.peek(2) == "\\Q":
            end = self.text.find("\\E", self.at)
            end = len(self.text) if end < 0 else end
            quoted = self.text[self.at + 2 : end]
            self.at = min(end + 2, len(self.text))
            made = [self._one(re.escape(c)) for c in quoted]
            if made:
                self._quantified(made[-1])
            return made
        part = self._atom()
        self._quantified(part)
        return [part]

    def _one(self, text: str) -> Part:
        return Part("set", text, _members(text, self.fold))

    def _atom(self) -> Part:
        c = self.peek()
        if c == "(":
            opened = re.compile(r"\((?:\?(?:[:=!>]|<[=!]|<[A-Za-z]\w*>|[A-Za-z]*(?:-[A-Za-z]+)?[:)]))?").match(self.text, self.at)
            head = self.take(opened.end())
            if re.match(r"\(\?[A-Za-z-]+[:)]", head) and "x" in head:
                raise Refused("comments mode")
            if head.startswith("(?") and head.endswith(")"):
                return Part("flags", head, frozenset())
            if re.match(r"\(\?(?:[=!]|<[=!])", head):
                return Part("check", head, branches=self._closed())
            return Part("group", head, branches=self._closed())
        if c == "[":
            return self._one(self.take(self._class_end()))
        if c == "\\":
            n = self.text[self.at + 1 : self.at + 2]
            if n and n in "bBAGzZ":
                return Part("check", self.take(self.at + 2))
            long = re.compile(r"\\(?:[pP](?:\{[^}]*\}|.)|x\{[^}]*\}|x..|u....|0[0-7]{1,3}|c.|N\{[^}]*\}|k<\w+>|[1-9]\d*|.)", re.S)
            text = self.take(long.match(self.text, self.at).end())
            if re.match(r"\\(?:[1-9]|k<)", text):
                raise Refused("back reference")
            return Part("check", text) if text in ("\\R", "\\X") else self._one(text)
        if c in "^$":
            return Part("check", self.take(self.at + 1))
        return self._one(self.take(self.at + 1))

    def _closed(self) -> list[list[Part]]:
        inner = self.branches()
        self.balanced &= self.peek() == ")"
        self.at += 1
        return inner

    def _class_end(self) -> int:
        depth, i = 0, self.at
        while i < len(self.text):
            c = self.text[i]
            if c == "\\":
                i += 1
            elif c == "[":
                depth += 1
                if self.text[i + 1 : i + 2] == "^":
                    i += 1
                if self.text[i + 1 : i + 2] == "]":
                    i += 1
            elif c == "]":
                depth -= 1
                if not depth:
                    return i + 1
            i += 1
        raise Refused("open character class")

    def _quantified(self, part: Part) -> None:
        found = re.compile(r"(\*|\+|\?|\{(\d+)(,(\d*))?\})([?+]?)").match(self.text, self.at)
        if not found:
            return
        self.at = found.end()
        part.times, part.mode = found[1], found[5]
        if found[2] is not None:
            part.low = int(found[2])
            part.high = part.low if found[3] is None else int(found[4]) if found[4] else _FOREVER
        else:
            part.low, part.high = {"*": (0, _FOREVER), "+": (1, _FOREVER), "?": (0, 1)}[found[1]]


def _nullable(parts: list[Part]) -> bool:
    return all(_may_be_empty(p) for p in parts)


def _may_be_empty(p: Part) -> bool:
    if p.kind == "flags":
        return True
    return p.kind != "check" and (p.low == 0 or p.kind == "group" and any(_nullable(b) for b in p.branches))


def _starts(parts: list[Part], follow: frozenset) -> frozenset:
    """What may come first; a check may depend on anything."""
    found: frozenset = frozenset()
    for p in parts:
        found |= ALL | END if p.kind == "check" else _first(p)
        if not _may_be_empty(p):
            return found
    return found | follow


def _first(p: Part) -> frozenset:
    if p.kind == "group":
        return frozenset().union(*(_starts(b, frozenset()) for b in p.branches))
    return p.first


def _decided(parts: list[Part], follow: frozenset) -> bool:
    """Is each choice in the parts decided by the next character?"""
    for i, p in enumerate(parts):
        after = _starts(parts[i + 1 :], follow)
        if p.kind == "check":
            return False
        if p.kind == "flags":
            continue
        if p.low != p.high and (p.mode == "?" or _first(p) & after):
            return False
        if p.kind == "group":
            if p.text == "(?>":
                return False
            again = after | _first(p) if p.high > 1 else after
            if p.high > 1 and any(_nullable(b) for b in p.branches):
                return False
            starts = [_starts(b, again) for b in p.branches]
            if any(a & b for k, a in enumerate(starts) for b in starts[k + 1 :]):
                return False
            if not all(_decided(b, again) for b in p.branches):
                return False
    return True


def _as_class(p: Part) -> str | None:
    """The group as one character class, if each alternative is one character."""
    if any(len(b) != 1 or b[0].kind != "set" or b[0].times or b[0].text == "." for b in p.branches):
        return None
    if p.text not in ("(", "(?:"):
        return None
    inner = "".join("\\" + b[0].text if b[0].text in "&^-" else b[0].text for b in p.branches)
    return f"[{inner}]"


def _written(branches: list[list[Part]], follow: frozenset, rounds: int) -> str:
    return "|".join(_sequence(b, follow, rounds) for b in branches)


def _sequence(parts: list[Part], follow: frozenset, rounds: int) -> str:
    """The text of some parts, which are gone through ``rounds`` times."""
    out = []
    for i, p in enumerate(parts):
        after = _starts(parts[i + 1 :], follow)
        if p.kind == "check" and p.branches:
            out.append(p.text + _written(p.branches, END, rounds) + ")" + p.times + p.mode)
            continue
        if p.kind != "group":
            out.append(p.text + p.times + p.mode)
            continue
        inner = max(p.high, 1) * rounds
        if p.high > 1 and inner > _ROUNDS and p.mode != "+":
            as_class = _as_class(p)
            if as_class:
                out.append(as_class + p.times + p.mode)
                continue
            if p.mode == "?" or not _decided([p], after):
                raise Refused(f"repeated group {p.text}...){p.times}{p.mode} may have to go back into its rounds")
            p.mode = "+"
        again = after | _first(p) if p.high > 1 else after
        out.append(p.text + _written(p.branches, again, 1 if p.mode == "+" else inner) + ")" + p.times + p.mode)
    return "".join(out)


def _leading_run(parts: list[Part]) -> str | None:
    """The characters of a run at the very start that cannot go on into what follows."""
    for i, p in enumerate(parts):
        if p.kind == "flags":
            continue
        if p.kind == "group" and len(p.branches) == 1 and p.low and p.text in ("(", "(?:"):
            return _leading_run(p.branches[0])
        if p.kind != "set" or not p.low or p.high < _FOREVER or p.mode == "?":
            return None
        after = _starts(parts[i + 1 :], END)
        return None if after & (p.first | END) else p.text
    return None


def safe_pattern(pattern: str) -> str:
    """The pattern with the same matches, safe on texts of any length; ``Refused`` if that cannot be shown.

    Groups keep their contents but not their numbers. The result is for searching through a text, not for matching all of it.
    """
    reader = _Reader(pattern)
    try:
        tree = reader.branches()
    except Refused as reason:
        # without a repeated group there is nothing to refuse
        if re.search(r"\)(?:[*+]|\{\d+,\d*\}|\{\d{3,})", pattern):
            raise Refused(f"repeated group in a pattern with {reason}") from None
        return pattern
    if reader.at < len(pattern) or not reader.balanced:
        return pattern  # the engine says what is wrong
    safe = _written(tree, END, 1)
    run = _leading_run(tree[0]) if len(tree) == 1 else None
    as_class = _as_class(tree[0][0]) if len(tree) == 1 and tree[0] and tree[0][0].kind == "group" else None
    if as_class and tree[0][0].low and tree[0][0].high == _FOREVER and tree[0][0].mode != "?":
        members = _first(tree[0][0])
        run = None if _starts(tree[0][1:], END) & (members | END) else as_class
    flags = re.match(r"(?:\(\?[a-zA-Z]+\))*", safe)[0]
    return f"{flags}(?:(?<!{run})|\\G){safe[len(flags):]}" if run else safe


_TESTED = 3  # characters behind a leading word boundary that are tested before it


def _beginnings(parts: list[Part], n: int) -> set[tuple[str, ...]]:
    """What the first ``n`` characters may be, one by one; shorter where that ends or is not known."""
    if not n or not parts:
        return {()}
    p, rest = parts[0], parts[1:]
    if p.kind == "set" and p.text != ".":
        left = replace(p, low=max(p.low - 1, 0), high=p.high if p.high == _FOREVER else p.high - 1)
        more = _beginnings([left, *rest] if left.high else rest, n - 1) if p.high else set()
        return {(p.text, *m) for m in more} | (set() if p.low else _beginnings(rest, n))
    if p.kind == "group" and p.text in ("(", "(?:") and p.low:
        return set().union(*(_beginnings([*b, *rest] if p.high == 1 else b, n) for b in p.branches))
    return {()}


@lru_cache(maxsize=4096)
def quick_start(pattern: str) -> str:
    """The pattern with the same matches, where the first characters are tested before a leading ``\\b``.

    The engine looks up both neighbours of a word boundary with all their properties, at each place of a text. The next characters
    rule out most places for less.
    """
    flags = re.match(r"((?:\(\?[a-zA-Z]+\))*)\\b(?![*+?{])", pattern)
    if not flags:
        return pattern
    reader = _Reader(pattern)
    try:
        tree = reader.branches()
    except Refused:
        return pattern
    if len(tree) > 1 or reader.at < len(pattern) or not reader.balanced:
        return pattern
    parts = [p for p in tree[0][: 1 + flags[1].count("(")] if p.kind != "flags"]
    after = tree[0][1 + flags[1].count("(") :]
    tested = [sorted(set(at)) for at in zip(*_beginnings(after, _TESTED))] if [p.text for p in parts] == ["\\b"] else []
    if not tested:
        return pattern
    inside = lambda t: "\\" + t if len(t) == 1 and t.isascii() and not t.isalnum() and not t.isspace() else t
    classes = "".join(at[0] if len(at) == 1 else f"[{''.join(map(inside, at))}]" for at in tested)
    return f"{flags[1]}(?={classes}){pattern[len(flags[1]):]}"
