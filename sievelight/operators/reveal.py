"""Pairs of redacted and clear values for the session that is allowed to see them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.redaction import redact, redact_last
from ..functions.sql import each, fold, keep, let, struct, zipped
from ..plans.session import lookup_join
from .builtin import detect_builtin
from .ignore import flag_ignored_values, is_builtin
from .running import running_totals


_ALL = (1 << 31) - 1


def reveal_pairs(matches: DataFrame) -> DataFrame:
    """``redacted, clear`` for each match, in place of its value. Never written by this library."""
    builtin, custom = F.expr(redact("category", "value")), F.expr(redact_last("value"))
    masked = F.when(is_builtin(matches), builtin).otherwise(custom)
    return matches.withColumn("redacted", masked).withColumnRenamed("value", "clear")


def trim_reveal_hits(
    hits: str,
    per_category: int | None = None,
    per_file: int | None = None,
) -> str:
    """Bounded copy of a document's hits, computed inside the row; without bounds all of them.

    At most ``per_category`` values of each category stay. What a file then has above
    ``per_file`` is taken from the ends of its categories, in name order.
    """
    per_category, per_file = per_category or _ALL, per_file or _ALL
    total = lambda sizes: fold(sizes, "0", lambda a, s: f"{a} + {s}.n")

    def cut(sizes: str) -> str:
        def left_over(h: str, s: str) -> str:
            before = total(keep(sizes, lambda o: f"{o}.category < {s}.category"))
            excess = f"greatest(0, least({s}.n, {total(sizes)} - {per_file} - {before}))"
            return struct(category=f"{h}.category", vals=f"slice({h}.vals, 1, {s}.n - {excess})")

        return zipped(hits, sizes, left_over)

    sizes = each(
        hits,
        lambda h: struct(category=f"{h}.category", n=f"least(size({h}.vals), {per_category})"),
    )
    return let(sizes, cut)


def trim_reveal_pairs(
    pairs: DataFrame,
    id_col: str,
    per_category: int | None = None,
    per_file: int | None = None,
) -> DataFrame:
    """As :func:`trim_reveal_hits` for long-form rows with ``category, pos``."""
    if per_category is None and per_file is None:
        return pairs
    # a document may hold most of all pairs: places are counted over many tasks
    kept = pairs
    if per_category:
        kept = running_totals(kept, [id_col, "category"], ["pos"], _n=F.lit(1)).filter(F.col("_n") <= per_category)
    if per_file:
        # what is cut lies at the ends of the categories in name order, so what stays comes first from behind
        kept = running_totals(kept, [id_col], [F.col("category").desc(), "pos"], _n=F.lit(1)).filter(F.col("_n") <= per_file)
    return kept.select(*pairs.columns)


def reveal_lookup(
    requests: DataFrame, pairs: DataFrame, ignored: DataFrame, salt: str, id_col: str
) -> DataFrame:
    """First clear value, not ignored, for each requested ``(id, category, redacted)``."""
    keys = [id_col, "category", "redacted"]
    wanted = lookup_join(pairs, requests.select(*keys).distinct(), keys, "left_semi")
    open_pairs = flag_ignored_values(wanted, ignored, salt).filter(~F.col("is_ignored"))
    return open_pairs.groupBy(*keys).agg(F.min_by("clear", "pos").alias("clear"))


def reveal_requested(
    requests: DataFrame,
    docs: DataFrame,
    ignored: DataFrame,
    salt: str,
    id_col: str,
    text_col: str = "text",
    categories: Sequence[str] | None = None,
    **options,
) -> DataFrame:
    """:func:`reveal_lookup` from texts: only documents that a request names are searched.

    ``requests`` has ``id, category, redacted``; ``categories`` are those that may be asked for.
    """
    named = lookup_join(docs, requests.select(id_col).distinct(), [id_col], "left_semi")
    found = detect_builtin(named, text_col, id_col, categories=categories, **options)
    return reveal_lookup(requests, reveal_pairs(found), ignored, salt, id_col)


def revealed_report(pairs: DataFrame, ignored: DataFrame, salt: str) -> DataFrame:
    """Every pair of a built-in category with its ``is_ignored`` flag."""
    return flag_ignored_values(pairs.filter(is_builtin(pairs)), ignored, salt)
