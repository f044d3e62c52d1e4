"""Replacing found values in texts by their redacted form."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.redaction import redact, redact_last
from ..functions.sql import each, each_at, find_all, fold, in_list, keep, let, struct
from ..functions.text import file_extension
from ..functions.validators import card_ok, digits_only, strip


def replacements(hits: str) -> str:
    """``array<struct<rank, c, p, old, new>>`` to apply in order: longest values first, then the
    order in which they were found. Values that redaction leaves unchanged are not replaced."""
    ranked = each_at(
        hits,
        lambda h, c: each_at(
            f"array_distinct({each(f'{h}.vals', strip)})",
            lambda v, p: struct(
                rank=f"-octet_length({v})", c=c, p=p, old=v, new=redact(f"{h}.category", v)
            ),
        ),
    )
    useful = keep(f"flatten({ranked})", lambda r: f"{r}.old <> '' and {r}.old <> {r}.new")
    return f"array_sort({useful})"


def _replace_step(state: str, pair: str) -> str:
    text, old = f"{state}.text", f"{pair}.old"
    count = f"(octet_length({text}) - octet_length(replace({text}, {old}, ''))) div octet_length({old})"
    return struct(
        text=f"replace({text}, {old}, {pair}.new)", total=f"{state}.total + cast({count} as bigint)"
    )


class _Patched:
    """A text in which ranges are replaced by pieces; places are ``(position in the first text, offset in the piece there)``."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.gone = bytearray(len(text))
        self.pieces: dict[int, tuple[int, str]] = {}  # start -> end and new text
        self.starts: dict[int, int] = {}  # end -> start

    def read(self, place: tuple[int, int], size: int) -> tuple[str, tuple[int, int]]:
        """At most ``size`` characters from a place on, and the place behind them; nothing from a place that is no more."""
        p, o = place
        if p < len(self.text) and self.gone[p] and o >= len(self.pieces.get(p, (0, ""))[1]) > 0 or o and p not in self.pieces:
            return "", place
        parts = []
        while size and p < len(self.text):
            if self.gone[p]:
                if p not in self.pieces:
                    break
                end, new = self.pieces[p]
                parts.append(new[o : o + size])
                size -= len(parts[-1])
                p, o = (p, o + len(parts[-1])) if o + len(parts[-1]) < len(new) else (end, 0)
            else:
                end = self.gone.find(1, p, p + size)
                end = min(p + size, len(self.text)) if end < 0 else end
                parts.append(self.text[p:end])
                size -= end - p
                p = end
        return "".join(parts), (p, o)

    def before(self, p: int, size: int) -> tuple[list[str], list[tuple[int, int]]]:
        """Parts of at most ``size`` characters up to the start of a piece, last one first, and their places."""
        parts, places = [], []
        while size > 0 and p > 0:
            if self.gone[p - 1]:
                start = self.starts[p]
                new = self.pieces[start][1]
                cut = max(len(new) - size, 0)
                parts.append(new[cut:])
                places.append((start, cut))
                p = start
            else:
                start = self.gone.rfind(1, max(p - size, 0), p) + 1 or max(p - size, 0)
                parts.append(self.text[start:p])
                places.append((start, 0))
                p = start
            size -= len(parts[-1])
        return parts, places

    def put(self, first: tuple[int, int], last: tuple[int, int], new: str) -> int:
        """Replace what lies between two places; the start of the piece that holds the new text."""
        (start, o), (end, r) = first, last
        if o:
            new = self.pieces[start][1][:o] + new
        if r:
            end, old = self.pieces[end]
            new += old[r:]
        p = self.gone.find(1, start, end)
        while p >= 0:
            stop, _ = self.pieces.pop(p)
            del self.starts[stop]
            p = self.gone.find(1, stop, end)
        self.gone[start:end] = b"\1" * (end - start)
        self.pieces[start], self.starts[end] = (end, new), start
        return start


def replace_in_turn(text: str, pairs: list[tuple[str, str]]) -> tuple[str, int]:
    """The text after ``replace(old, new)`` for one pair after the other, and the number of replacements.

    The places of all values are found in one pass, and after a replacement only what lies around it is searched again, so the work is
    linear in text, values and places where pairs one by one would read the whole text for each.
    """
    ranks: dict[str, list[int]] = {}
    for k, (old, _) in enumerate(pairs):
        ranks.setdefault(old, []).append(k)
    search = ahocorasick.Automaton()
    for old, listed in ranks.items():
        search.add_word(old, (len(old), listed))
    search.make_automaton()
    longest = [*accumulate((len(old) for old, _ in reversed(pairs)), max)][::-1] + [0]  # of a pair and those behind it
    found: list[list[tuple[int, int]] | None] = [None] * len(pairs)

    def note(k: int, place: tuple[int, int]) -> None:
        if found[k] is None:
            found[k] = []
        found[k].append(place)

    for last, (size, listed) in search.iter(text):
        for k in listed:
            note(k, (last + 1 - size, 0))
    patched, n = _Patched(text), 0
    for k, (old, new) in enumerate(pairs):
        taken, behind = [], (0, 0)
        for place in sorted(set(found[k] or ())):
            if place >= behind:
                there, end = patched.read(place, len(old))
                if there == old:
                    taken.append((place, end))
                    behind = end
        found[k] = None
        n += len(taken)
        # from behind, so that places in front stay what they are
        changed = {patched.put(*place, new) for place in reversed(taken)}
        reach = longest[k + 1] - 1
        for start in changed if reach >= 0 else ():
            if start not in patched.pieces:
                continue  # it has become part of another piece
            parts, places = patched.before(start, reach)
            parts, places = parts[::-1], places[::-1]
            head = sum(map(len, parts))
            end, piece = patched.pieces[start]
            p, room = end, reach
            parts.append(piece)
            places.append((start, 0))
            while room > 0 and p < len(text):
                size = len(patched.pieces[p][1]) if patched.gone[p] else patched.gone.find(1, p, p + room) - p
                part = patched.text[p : p + (size if size >= 0 else room)] if not patched.gone[p] else patched.pieces[p][1][:room]
                parts.append(part)
                places.append((p, 0))
                p = patched.pieces[p][0] if patched.gone[p] else p + len(part)
                room -= len(part)
            at = [0, *accumulate(map(len, parts))]
            for last, (size, listed) in search.iter("".join(parts)):
                first = last + 1 - size
                if first < head + len(piece) and last + 1 > head and listed[-1] > k:
                    i = bisect_right(at, first) - 1
                    p, o = places[i]
                    o += first - at[i]
                    place = (p, o) if p in patched.pieces else (p + o, 0)
                    for later in listed:
                        if later > k:
                            note(later, place)
    parts, p = [], 0
    while p < len(text):
        if patched.gone[p]:
            p, new = patched.pieces[p]
            parts.append(new)
        else:
            end = patched.gone.find(1, p)
            end = len(text) if end < 0 else end
            parts.append(text[p:end])
            p = end
    return "".join(parts), n


@F.arrow_udf(T.StructType().add("text", T.StringType()).add("total", T.LongType()))
def _replace_in_turn(texts: pa.Array, olds: pa.Array, news: pa.Array) -> pa.Array:
    out = []
    for text, old, new in zip(texts, olds, news, strict=True):
        done = (None, 0) if text.as_py() is None else replace_in_turn(text.as_py(), [*zip(old.as_py(), new.as_py(), strict=True)])
        out.append({"text": done[0], "total": done[1]})
    return pa.array(out, pa.struct([("text", pa.string()), ("total", pa.int64())]))


# above so many values a text is not read once for each of them any more
_MANY_VALUES = 64


def neutralize(
    df: DataFrame,
    hits_col: str = "hits",
    text_col: str = "text",
    path_col: str | None = None,
) -> DataFrame:
    """Add ``redacted_text`` and ``replaced_total``.

    ``hits_col`` holds the built-in matches of the text, found without a cap; all literal occurrences
    of all of them are replaced in the whole text, inside the row. With ``path_col`` only files with a text suffix are
    rewritten, others get nulls. A text with few values is read once for each, in SQL; one with many goes to Python (:func:`replace_in_turn`),
    where the work is linear in text, values and places.
    """
    start = struct(text=text_col, total="0L")
    done = (
        f"case when size(_pairs) = 0 then {start} when size(_pairs) > {_MANY_VALUES} then _many "
        f"else {fold('_pairs', start, _replace_step)} end"
    )
    if path_col:
        allowed = in_list(file_extension(path_col), fixed.NEUTRALIZABLE_EXTENSIONS)
        done = f"case when {allowed} then {done} end"
    kept = [f"`{c}`" for c in df.columns]
    paired = df.selectExpr("*", f"{replacements(hits_col)} as _pairs")
    many = lambda c: F.when(F.size("_pairs") > _MANY_VALUES, F.col(c))
    return (
        paired.withColumn("_many", _replace_in_turn(many(text_col), many("_pairs.old"), many("_pairs.new")))
        .selectExpr(*kept, f"{done} as _done")
        .selectExpr(*kept, "_done.text as redacted_text", "_done.total as replaced_total")
    )


def masked_values(hits: str, text: str, unicode: bool = True) -> str:
    """``array<struct<old, new>>``: values as the text has them, and what each becomes.

    Cards are taken from the text once more, as they are written there, with spaces or dashes. A value that redaction leaves
    as it is becomes stars.
    """

    def pair(category: str, v: str) -> str:
        hidden = lambda new: f"case when {new} = {v} then repeat('*', length({v})) else {new} end"
        return struct(old=v, new=let(redact(category, v), hidden))

    found = each(
        hits, lambda h: each(f"array_distinct({each(f'{h}.vals', strip)})", lambda v: pair(f"{h}.category", v))
    )
    cards = keep(find_all(text, fixed.CARD, 0, unicode), lambda v: let(digits_only(v), card_ok))
    trimmed = each(cards, lambda v: f"regexp_replace({v}, '[ -]+$', '')")
    written = each(f"array_distinct({trimmed})", lambda v: struct(old=v, new=redact_last(v)))
    any_card = f"case when exists({hits}, h -> h.category = 'credit_card') then {written} end"
    every = f"concat(flatten({found}), coalesce({any_card}, array()))"
    return keep(every, lambda r: f"{r}.old <> ''")


def spans(text: str, values: dict[str, str]) -> list[tuple[int, int, str]]:
    """Start, end and new form of all places of the values in the text, by start, the longest first.

    All values are searched in one pass. A place inside a longer word does not count.
    """
    search = ahocorasick.Automaton()
    for old, new in values.items():
        search.add_word(old, (len(old), new))
    search.make_automaton()
    word = lambda i: text[i] == "_" or text[i].isalnum()
    found = []
    for last, (size, new) in search.iter(text):
        start, end = last + 1 - size, last + 1
        if start and word(start - 1) and word(start) or end < len(text) and word(last) and word(end):
            continue
        found.append((start, end, new))
    return sorted(found, key=lambda s: (s[0], -s[1]))


def splice(text: str, values: dict[str, str]) -> tuple[str, int]:
    """The text with the union of all places of the values replaced, and the number of replacements.

    Places that overlap are one. It takes the new form of the value that covers it, unless that shows one of the others, and
    otherwise becomes stars.
    """
    parts, at, n = [], 0, 0
    found = spans(text, values) if values else []
    i = 0
    while i < len(found):
        start, end, new = found[i]
        first, covered = i, end
        while i < len(found) and found[i][0] < end:
            end = max(end, found[i][1])
            i += 1
        shown = any(text[s:e] in new for s, e, _ in found[first + 1 : i])
        parts += [text[at:start], "*" * (end - start) if shown or covered < end else new]
        at, n = end, n + 1
    return "".join([*parts, text[at:]]), n


@F.arrow_udf(T.StructType().add("text", T.StringType()).add("total", T.LongType()))
def _splice(texts: pa.Array, pairs: pa.Array) -> pa.Array:
    out = []
    for text, listed in zip(texts.to_pylist(), pairs.to_pylist(), strict=True):
        values: dict[str, str] = {}
        for p in listed or ():
            values.setdefault(p["old"], p["new"])
        done, n = (None, 0) if text is None else splice(text, values)
        out.append({"text": done, "total": n})
    return pa.array(out, pa.struct([("text", pa.string()), ("total", pa.int64())]))


def neutralize_spans(df: DataFrame, hits_col: str = "hits", text_col: str = "text", *, unicode: bool = True) -> DataFrame:
    """Add ``redacted_text`` and ``replaced_total``; no value that was found stays in clear.

    Every place of every found value that is a word of its own is replaced, cards also where they are written with
    spaces or dashes. Places that overlap are replaced together. Values are searched in one pass and the text is put together
    once, so the work is linear in text, values and places, however many values there are. A null text stays null with 0
    replacements. Texts without values are not sent to Python.
    """
    kept = [f"`{c}`" for c in df.columns]
    paired = df.selectExpr("*", f"{masked_values(hits_col, text_col, unicode)} as _pairs")
    any_value = F.size("_pairs") > 0
    done = paired.withColumn("_done", _splice(F.when(any_value, F.col(text_col)), F.when(any_value, F.col("_pairs"))))
    return done.selectExpr(
        *kept, f"coalesce(_done.text, {text_col}) as redacted_text", "coalesce(_done.total, 0L) as replaced_total"
    )


def write_neutralized(df: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write ``id, redacted_text, replaced_total``; sources are never overwritten."""
    (
        df.filter(F.col("redacted_text").isNotNull())
        .select(id_col, "redacted_text", "replaced_total")
        .write.mode("errorifexists")
        .parquet(path)
    )
