"""Chat formatting: records of many layouts to canonical turns, turns to text with a loss mask.

A record's layout is recognised by its schema fingerprint, the hash of its nested field paths. The
fingerprint selects a declarative mapping, a list of turns each made of a role and a path, or one
array path with the names of its role and text fields. New layouts are added as data. Everything
is built-in SQL functions; records of mixed layouts are VARIANT values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.functions.sql import lit

from .common import without


@dataclass(frozen=True)
class Fields:
    """A layout with one field for each turn: pairs of role and path, in the order of turns."""

    turns: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Messages:
    """A layout with an array of messages, after an optional system text."""

    path: str
    role: str
    text: str
    system: str | None = None


#: Layouts by the shape of their records: nested field names in alphabetical order, without types.
LAYOUTS: dict[str, Fields | Messages] = {
    "OBJECT<prompt, response>": Fields((("user", "$.prompt"), ("assistant", "$.response"))),
    "OBJECT<completion, prompt>": Fields((("user", "$.prompt"), ("assistant", "$.completion"))),
    "OBJECT<prompt, response, system>": Fields(
        (("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response"))
    ),
    "OBJECT<answer, question>": Fields((("user", "$.question"), ("assistant", "$.answer"))),
    "OBJECT<instruction, output>": Fields((("user", "$.instruction"), ("assistant", "$.output"))),
    "OBJECT<input, instruction, output>": Fields(
        (("system", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))
    ),
    "OBJECT<messages: ARRAY<OBJECT<content, role>>>": Messages("$.messages", "role", "content"),
    "OBJECT<messages: ARRAY<OBJECT<content, role>>, system>": Messages(
        "$.messages", "role", "content", "$.system"
    ),
    "OBJECT<conversations: ARRAY<OBJECT<from, value>>>": Messages("$.conversations", "from", "value"),
    "OBJECT<conversations: ARRAY<OBJECT<from, value>>, system>": Messages(
        "$.conversations", "from", "value", "$.system"
    ),
    "OBJECT<turns: ARRAY<OBJECT<speaker, text>>>": Messages("$.turns", "speaker", "text"),
}
#: Tables that hold one turn in a row, by shape: id, position, role and text columns.
ROW_LAYOUTS: dict[str, tuple[str, str, str, str]] = {
    "OBJECT<conv_id, role, text, turn>": ("conv_id", "turn", "role", "text"),
    "OBJECT<content, conversation_id, position, role>": (
        "conversation_id", "position", "role", "content",
    ),
}
#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def shape_of_type(kind: T.DataType) -> str:
    """Nested field names of a column type, as in ``LAYOUTS``; scalars have none."""
    if isinstance(kind, T.StructType):
        inner = sorted((f.name, shape_of_type(f.dataType)) for f in kind.fields)
        return "OBJECT<" + ", ".join(n + (f": {s}" if s else "") for n, s in inner) + ">"
    if isinstance(kind, T.ArrayType):
        inner = shape_of_type(kind.elementType)
        return f"ARRAY<{inner}>" if inner else "ARRAY"
    return ""


def shape_of(record: str) -> Column:
    """Nested field names of a VARIANT value, as in ``LAYOUTS``."""
    named = F.regexp_replace(
        F.schema_of_variant(record), r": (?!OBJECT<|ARRAY<)[A-Z_]+(?:\([0-9,]+\))?", ""
    )
    return F.regexp_replace(named, r"ARRAY<(?!OBJECT<|ARRAY<)[A-Z_]+(?:\([0-9,]+\))?>", "ARRAY")


def fingerprint(shape: Column) -> Column:
    return F.xxhash64(shape)


def _hashed(shape: str) -> int:
    """``fingerprint`` of a shape that is known when the plan is built."""
    unsigned = xxhash.xxh64_intdigest(shape.encode(), 42)
    return unsigned - (1 << 64) if unsigned >> 63 else unsigned


def _mapped(layout: Fields | Messages, record: str) -> str:
    """SQL for the turns of one layout, ``array<struct<role, text>>``."""

    def one(role: str, path: str) -> str:
        return f"struct({role} as role, try_variant_get({record}, {lit(path)}, 'string') as text)"

    if isinstance(layout, Fields):
        return f"array({', '.join(one(lit(r), p) for r, p in layout.turns)})"
    kind = f"array<struct<`{layout.role}` string, `{layout.text}` string>>"
    array = (
        f"transform(coalesce(try_variant_get({record}, {lit(layout.path)}, {lit(kind)}), array()), "
        f"m -> struct(m.`{layout.role}` as role, m.`{layout.text}` as text))"
    )
    return array if layout.system is None else f"concat(array({one(lit('system'), layout.system)}), {array})"


def _paths(layout: Fields | Messages) -> int:
    """How many paths a layout needs."""
    return len(layout.turns) if isinstance(layout, Fields) else 3 + (layout.system is not None)


def _fits(layout: Fields | Messages, record: str) -> str:
    """SQL: does a record have all paths of a layout, among others? An empty array of messages has them."""

    def has(value: str, path: str) -> str:
        return f"try_variant_get({value}, {lit(path)}, 'variant') is not null"

    if isinstance(layout, Fields):
        return " and ".join(has(record, p) for _, p in layout.turns)
    array = f"try_variant_get({record}, {lit(layout.path)}, 'array<variant>')"
    inner = " and ".join(f"exists({array}, m -> {has('m', '$.' + f)})" for f in (layout.role, layout.text))
    system = f" and {has(record, layout.system)}" if layout.system else ""
    return f"{array} is not null and (size({array}) = 0 or {inner}){system}"


def _records_mapped(
    records: DataFrame, id: str, record: str, layouts: Mapping[str, Fields | Messages]
) -> DataFrame:
    """``id``, ``shape``, ``fingerprint`` and the array ``_turns`` of records, null for an unknown layout."""
    marked = records.select(F.col(id), F.col(record).alias("_record")).withColumn("shape", shape_of("_record"))
    marked = marked.withColumn("fingerprint", fingerprint(F.col("shape")))
    same = [f"when fingerprint = xxhash64({lit(s)}) then {_mapped(x, '_record')}" for s, x in layouts.items()]
    wider = sorted(layouts.items(), key=lambda item: (-_paths(item[1]), item[0]))
    more = [f"when {_fits(x, '_record')} then {_mapped(x, '_record')}" for _, x in wider]
    names = " ".join(f"when {lit(a)} then {lit(b)}" for a, b in ROLES.items())
    role = f"case lower(t.role) {names} else t.role end" if names else "t.role"
    placed = (
        f"transform(case {' '.join(same + more)} end, "
        f"(t, i) -> struct(cast(i as long) as pos, {role} as role, coalesce(t.text, '') as text))"
    )
    return marked.select(
        id, "shape", "fingerprint",
        F.expr(f"filter({placed}, t -> not (t.role <=> 'system' and t.text = ''))").alias("_turns"),
    )


def turns_of_records(
    records: DataFrame,
    id: str,
    record: str,
    layouts: Mapping[str, Fields | Messages] = LAYOUTS,
) -> DataFrame:
    """Canonical turns ``id, pos, role, text`` of VARIANT records, one row for each turn.

    A record's fingerprint selects its mapping. Where it is that of no layout, the layout with most paths
    whose paths the record all has is taken (equal ones: first by shape), so further fields do no harm.
    Null texts become empty, other names of roles are mapped, empty system texts are left out. Records
    without turns give no row here: ``records_without_turns`` returns them.
    """
    mapped = _records_mapped(records, id, record, layouts)
    return mapped.select(id, F.inline("_turns"), "fingerprint")


def records_without_turns(
    records: DataFrame,
    id: str,
    record: str,
    layouts: Mapping[str, Fields | Messages] = LAYOUTS,
) -> DataFrame:
    """The records that give no turn: ``id, shape, fingerprint, reason``.

    ``reason`` is ``null record``, ``unknown layout`` or ``no turns``; counts by ``shape`` tell what layouts to add.
    """
    mapped = _records_mapped(records, id, record, layouts)
    reason = (
        F.when(F.col("shape").isNull(), "null record").when(F.col("_turns").isNull(), "unknown layout").otherwise("no turns")
    )
    return mapped.where("_turns is null or size(_turns) = 0").select(id, "shape", "fingerprint", reason.alias("reason"))


def turns_of_rows(rows: DataFrame) -> DataFrame:
    """Canonical turns ``id, pos, role, text`` of a table with one turn in a row.

    The table's fingerprint selects the mapping; where it is unknown, the layout whose columns the table
    all has among others. The fingerprint is the layout's.
    """
    prints = {_hashed(shape): shape for shape in ROW_LAYOUTS}
    shape = prints.get(_hashed(shape_of_type(rows.schema)))
    if shape is None:
        shape = next((s for s, names in sorted(ROW_LAYOUTS.items()) if set(names) <= set(rows.columns)), None)
    if shape is None:
        raise ValueError(f"no mapping for records of the shape {shape_of_type(rows.schema)}")
    key, pos, role, text = ROW_LAYOUTS[shape]
    return rows.select(
        F.col(key).alias("id"), F.col(pos).cast("long").alias("pos"), F.col(role).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(_hashed(shape)).cast("long").alias("fingerprint"),
    )


@dataclass(frozen=True)
class Template:
    """How turns are written: ``start role middle text end``.

    ``controls`` are all strings that must not occur inside roles and texts. Each has to begin with
    ``<`` or ``[`` and to hold neither again.
    """

    start: str = "<|turn|>"
    middle: str = "<|text|>"
    end: str = "<|end|>"
    others: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<SYS>", "</SYS>", "<|endoftext|>")

    def _rests(self) -> str:
        every = (self.start, self.middle, self.end, *self.others)
        return "|".join(_quoted(c[1:]) for c in every)

    def escaped(self, text: Column) -> Column:
        """A backslash goes after the first character of each control string.

        If backslashes already stand there one more is added, so that nothing is ambiguous.
        """
        return F.regexp_replace(text, rf"([<\[])(?=\\*(?:{self._rests()}))", r"$1\\")

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[])\\(?=\\*(?:{self._rests()}))", "$1")


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in "|[]()/.*+?^${}\\" else c for c in text)


def formatted(
    turns: DataFrame, template: Template = Template(), *, id: str = "id", learn: Sequence[str] = ("assistant",)
) -> DataFrame:
    """One row ``id, formatted, loss_spans`` for each conversation.

    ``loss_spans`` are start and length, in UTF-8 bytes from 0, of the texts whose role is in ``learn``;
    bytes, so that a span is cut out of a long conversation without counting its characters.
    Turns are ordered by ``pos``, then role and text (null first); null roles count as empty, repeated
    turns are all kept, rows with a null ``pos`` stand first. Null ids are one conversation.
    A conversation is one value by its nature, so its turns meet in one task; offsets
    are running sums in the same shuffle.
    """
    rows = without(turns, "_piece", "_len", "_head").select(
        F.col(id).alias("id"), "pos", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    head = F.concat(F.lit(template.start), template.escaped(F.col("role")), F.lit(template.middle))
    body = template.escaped(F.col("text"))
    pieces = rows.select(
        "id", "pos", "role", "text", F.inline(F.array(F.struct(head.alias("_head"), body.alias("_body"))))
    ).withColumn("_len", F.octet_length("_head") + F.octet_length("_body") + len(template.end.encode()))
    order = Window.partitionBy("id").orderBy("pos", "role", "text")
    placed = pieces.withColumn("_n", F.row_number().over(order)).withColumn(
        "_end", F.sum("_len").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    learnt = F.col("role").isin(list(learn))
    length = F.octet_length("_body").cast("long")
    start = F.col("_end") - length - len(template.end.encode())
    span = F.struct(start.alias("start"), length.alias("length"))
    whole = placed.groupBy("id").agg(
        F.sort_array(
            F.collect_list(
                F.struct("_n", F.concat("_head", "_body", F.lit(template.end)).alias("t"), F.when(learnt, span).alias("s"))
            )
        ).alias("_turns")
    )
    return whole.select(
        F.col("id").alias(id),
        F.array_join(F.col("_turns.t"), "").alias("formatted"),
        F.filter(F.col("_turns.s"), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(text: str, template: Template = Template()) -> Column:
    """Turns ``array<struct<role, text>>`` of a formatted conversation."""
    parts = F.split(F.col(text), _quoted(template.end), -1)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(part: Column) -> Column:
        sides = F.split(F.substr(part, F.lit(len(template.start) + 1)), _quoted(template.middle), 2)
        return F.struct(
            template.unescaped(sides[0]).alias("role"), template.unescaped(sides[1]).alias("text")
        )

    return F.transform(turns, turn)


def under_mask(text: str, spans: str, template: Template = Template()) -> Column:
    """The texts under the loss mask, unescaped, one after the other."""

    def cut(whole: Column) -> Column:
        piece = lambda s: F.substring(whole, (s["start"] + 1).cast("int"), s["length"].cast("int"))
        return F.transform(F.col(spans), lambda s: template.unescaped(piece(s).cast("string")))

    # the bytes of the conversation are made once, then bound to a name
    return F.array_join(F.transform(F.array(F.col(text).cast("binary")), cut)[0], "")
