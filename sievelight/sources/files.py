"""File inventory, path predicates, text decoding and routing by extension."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.sql import any_of, lit
from ..functions.text import file_extension, file_name


def is_hidden_path(path: str) -> Column:
    """Any component starts with a dot ('.' and '..' themselves do not count)."""
    return F.col(path).rlike(r"(?:^|/)\.(?!\.?(?:/|$))")


def is_ignored_extension(path: str, suffixes: Sequence[str] = tuple(fixed.IGNORED_SUFFIXES)) -> Column:
    """File name ends in one of the suffixes of unfinished downloads. ``path`` is a column name."""
    return F.expr(any_of(f"endswith({file_name(path)}, {lit(s)})" for s in suffixes))


def is_in_watched_dirs(path: str, roots: Sequence[str]) -> Column:
    """Component-wise prefix test against a few roots. ``path`` is a column name."""
    clean = [r.rstrip("/") for r in roots]
    return F.expr(
        any_of(f"({path} = {lit(r)} or startswith({path}, {lit(r + '/')}))" for r in clean)
    )


def read_file_inventory(
    spark: SparkSession,
    roots: Sequence[str],
    *,
    ignored_suffixes: Sequence[str] = tuple(fixed.IGNORED_SUFFIXES),
    max_entries_per_root: int | None = None,
) -> DataFrame:
    """``path, size, mtime`` of the visible, finished files below the roots.

    Only names and metadata are read, not contents. Roots that do not exist are skipped.
    ``max_entries_per_root`` is off unless the caller wants a bounded walk; then the most recent
    files of each root are kept.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    out = None
    for root in roots:
        path = hadoop.Path(root)
        if not path.getFileSystem(conf).exists(path):
            continue
        found = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .load(root)
            .select(_plain_path(), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
        )
        if max_entries_per_root is not None:
            found = recent_first(found, max_entries_per_root)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "path string, size bigint, mtime timestamp")
    return out.filter(
        ~is_hidden_path("path") & ~is_ignored_extension("path", ignored_suffixes)
    )


def recent_first(inventory: DataFrame, limit: int | None = None) -> DataFrame:
    """Most recent files first; ``limit`` is the size of one bulk scan, if it is bounded."""
    ordered = inventory.orderBy(F.col("mtime").desc(), "path")
    return ordered if limit is None else ordered.limit(limit)


def decode_text(content: Column, max_bytes: int | None = None) -> Column:
    """Bytes as text, invalid UTF-8 replaced. Whole content unless ``max_bytes`` is given."""
    data = content if max_bytes is None else F.substring(content, 1, max_bytes)
    return F.make_valid_utf8(data.cast("string"))


def text_if_not_binary(content: Column, max_bytes: int | None = None) -> Column:
    """As :func:`decode_text`, null when the content holds a NUL byte."""
    text = decode_text(content, max_bytes)
    return F.when(~F.contains(text, F.lit("\0")), text)


def content_kind(ext: Column) -> Column:
    """pdf, sheet, docx, zip, image, text or other."""
    return (
        F.when(ext == "pdf", "pdf")
        .when(ext.isin("xlsx", "xls"), "sheet")
        .when(ext == "docx", "docx")
        .when(ext == "zip", "zip")
        .when(ext.isin(*fixed.IMAGE_EXTENSIONS), "image")
        .when(ext.isin(*fixed.TEXT_EXTENSIONS), "text")
        .otherwise("other")
    )


def route_by_extension(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Add ``ext, content_kind, secrets_enabled``."""
    return (
        df.withColumn("ext", F.expr(file_extension(path_col)))
        .withColumn("content_kind", content_kind(F.col("ext")))
        .withColumn("secrets_enabled", ~F.col("ext").isin(*fixed.TECHNICAL_EXTENSIONS))
    )


def file_size_gate(size: Column, max_file_bytes: int | None) -> Column:
    """True for files too large to be opened; without a bound none is."""
    return F.lit(False) if max_file_bytes is None else size > max_file_bytes


def extension_glob(extensions: Sequence[str]) -> str:
    """Glob for files with one of the extensions in any case."""
    each = ["*." + "".join(f"[{c.lower()}{c.upper()}]" for c in e) for e in extensions]
    return each[0] if len(each) == 1 else "{" + ",".join(each) + "}"


def _plain_path(column: str = "path") -> Column:
    return F.regexp_replace(column, r"^file:/+", "/").alias("path")


def _binary_files(spark: SparkSession, paths: Sequence[str], **options: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .options(**options)
        .load(list(paths))
        .select(
            _plain_path(), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content"
        )
    )


def read_files(
    spark: SparkSession, roots: Sequence[str], extensions: Sequence[str] | None = None
) -> DataFrame:
    """Visible files with their bytes: ``path, size, mtime, content, ext, content_kind, ...``.

    With ``extensions`` only files with one of them are listed and opened. Filters on ``size`` reach the
    reader; without ``content`` in the query only names and metadata are read.
    """
    if not roots:
        raise ValueError("no root given")
    options = {"recursiveFileLookup": "true"}
    if extensions:
        options["pathGlobFilter"] = extension_glob(extensions)
    out = None
    for root in roots:  # one reader for each: a file below two roots belongs to both
        found = _binary_files(spark, [root], **options)
        out = found if out is None else out.unionByName(found)
    shown = out.filter(~is_hidden_path("path") & ~is_ignored_extension("path"))
    return route_by_extension(shown)


def read_paths(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """As :func:`read_files` for single files that exist, hidden or not; characters with a meaning in globs are taken as they are."""
    if not paths:
        empty = "path string, size bigint, mtime timestamp, content binary"
        return route_by_extension(spark.createDataFrame([], empty))
    quoted = [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in paths]
    return route_by_extension(_binary_files(spark, quoted))


def existing_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Those of some paths that are files. One call of the file system for each, from the driver."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        at = hadoop.Path(path)
        system = at.getFileSystem(conf)
        return system.exists(at) and system.getFileStatus(at).isFile()

    return [p for p in paths if there(p)]


def missing_files(requested: DataFrame, inventory: DataFrame) -> DataFrame:
    """Result rows for requested paths that are not files: score 0, level low, one reason."""
    reason = F.array(
        F.struct(
            F.lit("reason.notAFile").alias("key"),
            F.map_from_arrays(
                F.array().cast("array<string>"), F.array().cast("array<string>")
            ).alias("vars"),
        )
    )
    return (
        requested.select("path")
        .join(inventory.select("path"), "path", "left_anti")
        .select(
            "path",
            F.lit("low").alias("risk_level"),
            F.lit(0).cast("bigint").alias("risk_score"),
            reason.alias("reasons"),
        )
    )
