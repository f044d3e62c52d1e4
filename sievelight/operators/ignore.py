"""The list of values a user chose to ignore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.values import value_hash
from ..plans.session import lookup_join


def mark_ignored(ignored: DataFrame | None, values: DataFrame, salt: str, now: int) -> DataFrame:
    """Add ``values(category, value)`` to the list; entries already there are kept as they are."""
    new = values.select(
        "category",
        F.expr(value_hash(salt, "category", "value")).alias("value_hash"),
        F.lit(now).cast("bigint").alias("created_at"),
    )
    every = new if ignored is None else ignored.select(*new.columns).unionByName(new)
    return every.groupBy("category", "value_hash").agg(F.min("created_at").alias("created_at"))


def unmark_ignored(ignored: DataFrame, values: DataFrame, salt: str) -> DataFrame:
    gone = values.select(
        "category", F.expr(value_hash(salt, "category", "value")).alias("value_hash")
    ).distinct()
    return lookup_join(ignored, gone, ["category", "value_hash"], "left_anti")


def is_builtin(matches: DataFrame) -> Column:
    """Is a match one of a built-in detector? By its scope, since rules may be named like a category;
    without that column by the name."""
    if "scope" in matches.columns:
        return F.col("scope") == "builtin"
    return F.col("category").isin(*fixed.CATEGORIES)


def apply_ignored_values(
    matches: DataFrame, ignored: DataFrame, salt: str, *, hint: str | None = None
) -> DataFrame:
    """Drop built-in matches whose salted hash is on the list; rule matches always stay."""
    builtin = is_builtin(matches)
    hashed = matches.withColumn(
        "value_hash",
        F.when(builtin, F.expr(value_hash(salt, "category", "value"))),
    )
    keys = ignored.select("category", "value_hash").distinct()
    kept = lookup_join(hashed, keys, ["category", "value_hash"], "left_anti", hint=hint)
    return kept.select(*matches.columns)


def flag_ignored_values(pairs: DataFrame, ignored: DataFrame, salt: str, value_col: str = "clear") -> DataFrame:
    """Add ``is_ignored`` to ``(category, value)`` rows of built-in categories."""
    hashed = pairs.withColumn(
        "value_hash",
        F.when(
            is_builtin(pairs),
            F.expr(value_hash(salt, "category", value_col)),
        ),
    )
    keys = ignored.select("category", "value_hash").distinct().withColumn("_hit", F.lit(True))
    flagged = lookup_join(hashed, keys, ["category", "value_hash"], "left")
    return flagged.withColumn("is_ignored", F.coalesce("_hit", F.lit(False))).select(
        *pairs.columns, "is_ignored"
    )
