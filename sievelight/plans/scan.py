"""The scan: corpus rows in, one scored report per document out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.sql import NO_STRINGS, array, each, each_at, lit, struct
from ..functions.sql import keep as keep_where
from ..functions.text import suggestion_for
from ..functions.values import value_hash
from ..operators.builtin import EMPTY_HITS, with_builtin_hits, with_file_signals
from ..operators.contextual import EntitySetting, with_contextual_hits
from ..operators.findings import has_signal, with_risk
from ..operators.merge import merge_hits, merge_matches
from ..operators.rules import Rule, with_rule_hits
from ..operators.store import file_id_of
from ..sources.archives import docx_text, expand_zip, is_text_entry
from ..sources.files import (
    decode_text,
    existing_paths,
    file_size_gate,
    missing_files,
    read_files,
    read_paths,
    text_if_not_binary,
)
from .session import lookup_join, pin

def _name_rules(rules: Sequence[Rule]) -> list[Rule]:
    return [
        replace(r, field_name_regex=None, value_regex=None) for r in rules if r.filename_regex
    ]


def _text_rules(rules: Sequence[Rule], compat: bool) -> list[Rule]:
    """Rules for text passes; file names are matched once per file, or once more per text with
    ``compat``."""
    out = rules if compat else [replace(r, filename_regex=None) for r in rules]
    return [r for r in out if r.filename_regex or r.field_name_regex or r.value_regex]


def _with_text_matches(
    df: DataFrame,
    rules: Sequence[Rule],
    entities: Sequence[EntitySetting],
    *,
    secrets: bool | str,
    phone_locale: str,
    unicode: bool,
    compat: bool,
    entities_allowed: Column | None = None,
    **options,
) -> DataFrame:
    """Add ``hits`` and ``custom_hits`` of the whole ``text`` column."""
    df = with_builtin_hits(
        df, "text", secrets=secrets, phone_locale=phone_locale, unicode=unicode, **options
    )
    name_col = "path" if compat and "path" in df.columns else None
    df = with_rule_hits(
        df, _text_rules(rules, compat and name_col is not None), "text", name_col, unicode=unicode
    )
    if compat and name_col:
        df = df.withColumn(
            "custom_hits", F.expr(f"case when text is not null then custom_hits else {EMPTY_HITS} end")
        )
    if not any(e.enabled for e in entities):
        return df
    source = "text"
    if entities_allowed is not None:
        df = df.withColumn("_ctx_text", F.when(entities_allowed, F.col("text")))
        source = "_ctx_text"
    df = with_contextual_hits(df, entities, source, unicode=unicode)
    return df.withColumn(
        "custom_hits", F.expr(merge_hits("custom_hits", "entity_hits", custom=True))
    ).drop("entity_hits", "_ctx_text")


def _with_file_level(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Merge what the file itself shows (name, weak archive) into ``hits``/``custom_hits``."""
    df = with_file_signals(df, "path")
    entry = lambda c, v: f"array({struct(category=lit(c), vals=v)})"
    name_entry = entry("file_name_signal", "file_signals")
    weak_entry = entry("weak_archive_encryption", "array('ZipCrypto')")
    own = (
        f"concat(hits, case when size(file_signals) > 0 then {name_entry} else {EMPTY_HITS} end, "
        f"case when weak_zip_encryption then {weak_entry} else {EMPTY_HITS} end)"
    )
    df = df.withColumn("hits", F.expr(own))
    named = _name_rules(rules)
    if named:
        df = with_rule_hits(df, named, None, "path", "_name_hits")
        df = df.withColumn(
            "custom_hits", F.expr(merge_hits("_name_hits", "custom_hits", custom=True))
        ).drop("_name_hits")
    return df


def drop_ignored(
    df: DataFrame, ignored: DataFrame, salt: str, id_col: str, bypass: str | None = None
) -> DataFrame:
    """Remove ignored values from ``hits``.

    Matches are exploded and anti-joined; each document also sends one row with its other
    columns, which cannot match, so documents without any value left survive. One shuffle by
    ``id_col`` puts the rows together again; texts do not take part in it. ``bypass`` names a
    flag of documents whose text values are exempt.
    """
    others = ", ".join(f"`{c}`" for c in df.columns if c not in ("hits", id_col))
    exempt = f"({bypass} and {{c}} <> 'file_name_signal')" if bypass else "false"
    null = "cast(null as string)"
    head = struct(
        category=null, pos="cast(null as bigint)", value=null, meta=f"struct({others})",
        free="true",
    )
    rows = each(
        "hits",
        lambda h: each_at(
            f"{h}.vals",
            lambda v, i: struct(
                category=f"{h}.category",
                pos=f"cast({i} as bigint)",
                value=v,
                meta=f"case when false then struct({others}) end",
                free=f"({h}.category = 'weak_archive_encryption' or "
                f"{exempt.format(c=f'{h}.category')})",
            ),
        ),
    )
    long = df.selectExpr(id_col, f"inline_outer(concat(array({head}), flatten({rows})))")
    hashed = long.withColumn(
        "value_hash",
        F.expr(f"case when not free then {value_hash(salt, 'category', 'value')} end"),
    )
    keys = ignored.select("category", "value_hash").distinct()
    kept = lookup_join(hashed, keys, ["category", "value_hash"], "left_anti")
    listed = F.array_sort(
        F.collect_list(F.when(F.col("value").isNotNull(), F.struct("category", "pos", "value")))
    )
    grouped = kept.groupBy(id_col).agg(
        F.first("meta", ignorenulls=True).alias("_meta"), listed.alias("_m")
    )

    def values(c: str) -> str:
        return each(keep_where("_m", lambda m: f"{m}.category = {c}"), lambda m: f"{m}.value")

    found = each("_m", lambda m: f"{m}.category")
    hits = each(
        f"array_intersect({array(fixed.CATEGORIES)}, {found})",
        lambda c: struct(category=c, vals=values(c)),
    )
    return grouped.selectExpr(id_col, "_meta.*", f"{hits} as hits")


def scan(
    corpus: DataFrame,
    *,
    rules: Sequence[Rule] = (),
    entities: Sequence[EntitySetting] = (),
    ignored: DataFrame | None = None,
    salt: str = "",
    max_file_bytes: int | None = None,
    phone_locale: str = "other",
    unicode: bool = True,
    compat: bool = False,
    keep: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Score every document of a corpus (``doc_id, path, size, text, secrets_enabled``).

    Texts above ``max_file_bytes`` are not read, if it is given. Without an ignore list this is one
    narrow projection: no shuffle. Returns ``doc_id, path``,
    the ``keep`` columns and ``findings, custom_findings, reasons, risk_score, risk_level,
    weak_zip_encryption, suggestion`` for all documents, also those without findings.
    """
    too_large = file_size_gate(F.col("size"), max_file_bytes)
    df = corpus.withColumn("text", F.when(~too_large, F.col("text"))).withColumn(
        "too_large", F.coalesce(too_large, F.lit(False))
    )
    if "weak_zip_encryption" not in df.columns:
        df = df.withColumn("weak_zip_encryption", F.lit(False))
    df = _with_text_matches(
        df, rules, entities, secrets="secrets_enabled", phone_locale=phone_locale,
        unicode=unicode, compat=compat, **options,
    ).drop("text")
    return _report(df, "doc_id", rules, ignored, salt, keep)


def _report(
    df: DataFrame, id_col: str, rules: Sequence[Rule], ignored: DataFrame | None, salt: str,
    keep: Sequence[str], bypass: str | None = None,
) -> DataFrame:
    df = _with_file_level(df, rules)
    if ignored is not None:
        df = drop_ignored(df, ignored, salt, id_col, bypass)
    df = with_risk(
        df, rules, custom_hits="custom_hits", bonus="file_bonus", weak_zip="weak_zip_encryption",
        signals="file_signals", too_large="too_large",
    )
    return df.select(
        *dict.fromkeys([id_col, "path"]),
        *keep,
        "findings",
        "custom_findings",
        "reasons",
        "risk_score",
        "risk_level",
        "weak_zip_encryption",
        F.expr(suggestion_for("risk_level")).alias("suggestion"),
    )


def signals_only(reports: DataFrame) -> DataFrame:
    """Reports worth an alert."""
    costly = ["findings", "custom_findings", "reasons", "risk_score", "risk_level"]
    return pin(reports, *[c for c in costly if c in reports.columns]).filter(
        has_signal(
            F.col("findings"),
            F.col("custom_findings"),
            F.col("weak_zip_encryption"),
            F.col("risk_score"),
        )
    )


def as_scans(reports: DataFrame, scanned_at: Column) -> DataFrame:
    """Reports of files in the stored form of the scans table."""
    return reports.select(
        F.sha2(F.concat_ws("|", "path", scanned_at.cast("string")), 256).alias("scan_id"),
        file_id_of(F.col("path")).alias("file_id"),
        "path",
        scanned_at.cast("bigint").alias("scanned_at"),
        "risk_level",
        "risk_score",
        "weak_zip_encryption",
        "reasons",
        "findings",
        "custom_findings",
        "suggestion",
    )


def file_parts(texts: DataFrame, docx: DataFrame, zips: DataFrame) -> DataFrame:
    """Texts found in files: ``path, part, kind, secrets_enabled, text, weak_zip_encryption, error``.

    Text files and unknown files without NUL bytes are one part, DOCX files too, archives one
    per text entry, with one part without text that carries the result of the audit. What could not be
    read is a part with an ``error``.
    """
    none, plain_part = F.lit(None).cast("string"), F.array(F.lit(0))
    plain = texts.select(
        "path",
        plain_part.alias("part"),
        F.col("content_kind").alias("kind"),
        "secrets_enabled",
        F.when(F.col("content_kind") == "text", decode_text(F.col("content")))
        .otherwise(text_if_not_binary(F.col("content")))
        .alias("text"),
        F.lit(False).alias("weak_zip_encryption"),
        none.alias("error"),
    )
    written = docx_text(docx).select(
        "path", plain_part.alias("part"), F.lit("docx").alias("kind"),
        F.lit(True).alias("secrets_enabled"), "text", F.lit(False).alias("weak_zip_encryption"),
        none.alias("error"),
    )
    wanted = F.col("entry").isNull() | F.col("error").isNotNull() | is_text_entry("entry")
    zipped = expand_zip(zips, audit=True).filter(wanted).select(
        "path", "part", F.lit("zip").alias("kind"), F.lit(True).alias("secrets_enabled"),
        text_if_not_binary(F.col("content")).alias("text"),
        (F.coalesce("zip_encryption", F.lit("")) == "zipcrypto").alias("weak_zip_encryption"),
        F.when(F.col("error").isNotNull(), F.concat_ws(": ", "entry", "error")).alias("error"),
    )
    return plain.unionByName(written).unionByName(zipped)


def scan_files(
    spark: SparkSession,
    roots: Sequence[str],
    *,
    extracted: DataFrame | None = None,
    max_file_bytes: int | None = None,
    **options,
) -> DataFrame:
    """Score every visible file below the roots, one row per file; options as for :func:`scan`.

    Parts are scanned where their bytes are; only matches are shuffled, by path. Each branch opens
    only files of its extensions, so the bytes of PDF files, images and workbooks are never loaded; files of
    unknown extensions are opened by name, from the list that the file index holds anyway.
    ``extracted(path, part, text)`` adds texts from elsewhere (PDF text, image text, sheets)
    under the kind of their file. ``errors`` lists what could not be read.
    """
    small = ~file_size_gate(F.col("size"), max_file_bytes)
    listed = read_files(spark, roots).drop("content")
    unknown = listed.filter((F.col("content_kind") == "other") & small).select("path")
    others = read_paths(spark, [r["path"] for r in unknown.toLocalIterator()])
    texts = read_files(spark, roots, fixed.TEXT_EXTENSIONS).unionByName(others)
    parts = file_parts(
        texts.filter(small),
        read_files(spark, roots, ["docx"]).filter(small),
        read_files(spark, roots, ["zip"]).filter(small),
    )
    return _scan_parts(listed, parts, small, extracted, **options)


def scan_paths(
    spark: SparkSession, paths: Sequence[str], *, max_file_bytes: int | None = None, **options
) -> DataFrame:
    """Score single files, routed like those of :func:`scan_files`; a live scan calls it for its changes.

    Paths that are no files give a row with the reason ``reason.notAFile``.
    """
    there = existing_paths(spark, paths)
    small = ~file_size_gate(F.col("size"), max_file_bytes)
    files = read_paths(spark, there)
    kind = F.col("content_kind")
    opened = [p for p in there if extension_of(p) not in _UNOPENED]
    readable = read_paths(spark, [p for p in opened if extension_of(p) not in ("zip", "docx")])
    parts = file_parts(
        readable.filter(small & kind.isin("text", "other")),
        read_paths(spark, [p for p in opened if extension_of(p) == "docx"]).filter(small),
        read_paths(spark, [p for p in opened if extension_of(p) == "zip"]).filter(small),
    )
    reports = _scan_parts(files.drop("content"), parts, small, None, **options)
    gone = sorted(set(paths).difference(there))
    if not gone:
        return reports
    missing = missing_files(spark.createDataFrame([(p,) for p in gone], "path string"), files.select("path"))
    return reports.unionByName(missing, allowMissingColumns=True)


_UNOPENED = frozenset(["pdf", "xls", "xlsx", *fixed.IMAGE_EXTENSIONS])


def extension_of(path: str) -> str:
    """Lower-case extension of a path's file name, as :func:`file_extension` of a column."""
    name = path.rsplit("/", 1)[-1]
    stem, dot, ext = name.rpartition(".")
    return ext.lower() if dot and stem else ""


def _scan_parts(
    files: DataFrame,
    parts: DataFrame,
    small: Column,
    extracted: DataFrame | None,
    *,
    rules: Sequence[Rule] = (),
    entities: Sequence[EntitySetting] = (),
    ignored: DataFrame | None = None,
    salt: str = "",
    phone_locale: str = "other",
    unicode: bool = True,
    compat: bool = False,
    **options,
) -> DataFrame:
    if extracted is not None:
        kinds = files.select("path", F.col("content_kind").alias("kind"))
        parts = parts.unionByName(
            extracted.join(kinds, "path").select(
                "path", "part", "kind", F.lit(True).alias("secrets_enabled"), "text",
                F.lit(False).alias("weak_zip_encryption"), F.lit(None).cast("string").alias("error"),
            )
        )
    found = _with_text_matches(
        parts, rules, entities, secrets="secrets_enabled",
        phone_locale=phone_locale, unicode=unicode, compat=compat,
        entities_allowed=~F.col("kind").isin("zip", "sheet"), **options,
    )
    merged = merge_matches(found, "path", "part", "weak_zip_encryption", errors="error")
    df = (
        files.select("path", "size", "mtime", "content_kind")
        .join(merged, "path", "left")
        .withColumns(
            {
                "hits": F.coalesce("hits", F.expr(EMPTY_HITS)),
                "custom_hits": F.coalesce("custom_hits", F.expr(EMPTY_HITS)),
                "weak_zip_encryption": F.coalesce("weak_zip_encryption", F.lit(False)),
                "errors": F.coalesce("errors", F.expr(NO_STRINGS)),
                "too_large": ~small,
                "bypass": F.col("content_kind").isin("zip", "sheet"),
            }
        )
    )
    return _report(df, "path", rules, ignored, salt, ["size", "mtime", "errors"], "bypass")
