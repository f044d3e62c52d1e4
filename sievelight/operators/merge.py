"""Putting the matches of several sources of one document together."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.redaction import redact, redact_last
from ..functions.sql import array, each, keep, let, struct
from ..plans.session import checkpoint_dir
from .builtin import HITS_TYPE
from .findings import EMPTY_SUMMARIES, SUMMARIES_TYPE, hash_count


def merge_hits(*lists: str, custom: bool = False) -> str:
    """Concatenate hit lists per category, keeping the order of the lists.

    Built-in categories come out in their fixed order, rule names alphabetically.
    """

    def regroup(entries: str) -> str:
        found = each(entries, lambda h: f"{h}.category")
        names = (
            f"array_sort(array_distinct({found}))"
            if custom
            else f"array_intersect({array(fixed.CATEGORIES)}, {found})"
        )

        def values(c: str) -> str:
            mine = keep(entries, lambda h: f"{h}.category = {c}")
            return f"flatten({each(mine, lambda h: f'{h}.vals')})"

        return each(names, lambda c: struct(category=c, vals=values(c)))

    every = f"concat({', '.join(lists)})" if len(lists) > 1 else lists[0]
    return f"cast({let(every, regroup)} as {HITS_TYPE})"


def merge_matches(
    parts: DataFrame, key: str, order: str, *flags: str, hits: str = "hits",
    custom_hits: str = "custom_hits", errors: str | None = None,
) -> DataFrame:
    """One row per ``key`` from the hits of its parts (archive entries, sheets) in ``order``.

    ``flags`` are boolean columns, true when they are for any part; ``errors`` names a text column whose
    values are listed. Only matches are shuffled. A cap of the caller's applies per part, not to the
    merged list.
    """
    listed = [F.array_sort(F.collect_set(errors)).alias("errors")] if errors else []
    collected = F.array_sort(F.collect_list(F.struct(order, hits, custom_hits)))
    flat = lambda name: f"flatten({each('_parts', lambda p: f'{p}.{name}')})"
    return (
        parts.groupBy(key)
        .agg(collected.alias("_parts"), *[F.bool_or(f).alias(f) for f in flags], *listed)
        .selectExpr(
            key,
            *flags,
            *(["errors"] if errors else []),
            f"{merge_hits(flat(hits))} as {hits}",
            f"{merge_hits(flat(custom_hits), custom=True)} as {custom_hits}",
        )
    )


def _summaries(hits: str, custom: bool, examples: int) -> str:
    """``array<struct<scope, category, cnt, hashes, red>>`` of the hits of one part."""
    mask = (lambda h, v: redact_last(v)) if custom else (lambda h, v: redact(f"{h}.category", v))
    return each(
        hits,
        lambda h: struct(
            custom="true" if custom else "false",
            category=f"{h}.category",
            cnt=f"cast(size({h}.vals) as bigint)",
            hashes=hash_count(h),
            red=each(f"slice({h}.vals, 1, {examples})", lambda v: mask(h, v)),
        ),
    )


def merge_findings(
    parts: DataFrame, key: str, order: str, *flags: str, hits: str = "hits", custom_hits: str = "custom_hits",
    examples: int = 5,
) -> DataFrame:
    """One row per ``key`` with the summaries ``hits`` and ``custom_hits`` of its parts, for ``with_risk(summarized=True)``.

    Each part is summed up in its own row: counts, hash-like counts and its first redacted examples. Counts are added up
    before and after the shuffle, and of each category only the ``examples`` first parts by ``order`` (ties: by their examples, then
    counts) leave a task, so no task holds the values or parts of a large archive. The summaries are written once to the shared
    folder and read twice. ``flags`` are true when they are for any part; a part with null or no hits keeps its key. Null keys
    are one key. Values are not kept: where ignored or revealed values are asked for, use ``merge_matches``.
    """
    spark = parts.sparkSession
    path = f"{checkpoint_dir(spark)}/findings-{uuid.uuid4().hex}"
    both = f"concat({', '.join(f'coalesce({_summaries(c, own, examples)}, array())' for c, own in ((hits, False), (custom_hits, True)))})"
    named = [f"`{f}` as _f{i}" for i, f in enumerate(flags)]
    parts.selectExpr(f"`{key}` as _key", f"`{order}` as _order", *named, f"inline_outer({both})").write.parquet(path)
    entries = spark.read.parquet(path)
    found = entries.where("category is not null")
    group = ["_key", "custom", "category"]
    counts = found.groupBy(*group).agg(F.sum("cnt").alias("count"), F.sum("hashes").alias("hashes"))
    # a filter on the row number keeps that many rows of a group in each task, before the shuffle
    first = Window.partitionBy(*group).orderBy("_order", "red", "cnt")
    shown = (
        found.select(*group, "_order", "red", "cnt", F.row_number().over(first).alias("_n"))
        .where(F.col("_n") <= examples)
        .groupBy(*group)
        .agg(F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_n", "red"))), lambda r: r.red)), 1, examples).alias("red"))
        .select(F.col("_key").alias("_k"), F.col("custom").alias("_c"), F.col("category").alias("_g"), "red")
    )
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("custom") == F.col("_c")) & (F.col("category") == F.col("_g"))
    # the number of categories and rules bounds what is collected for a key
    place = f"case when custom then 0 else array_position({array(fixed.CATEGORIES)}, category) end"
    entry = struct(place=place, category="category", count="count", hashes="hashes", redacted_examples="red")
    listed = lambda test: f"array_sort(collect_list(case when {test} then {entry} end))"
    plain = lambda e: struct(**{n: f"{e}.{n}" for n in ("category", "count", "hashes", "redacted_examples")})
    merged = (
        counts.join(shown, same)
        .groupBy("_key")
        .agg(F.expr(listed("not custom")).alias("_builtin"), F.expr(listed("custom")).alias("_custom"))
        .selectExpr("_key", f"{each('_builtin', plain)} as `{hits}`", f"{each('_custom', plain)} as `{custom_hits}`")
    )
    keys = entries.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), *[F.bool_or(f"_f{i}").alias(f) for i, f in enumerate(flags)])
    whole = keys.withColumnRenamed("_key", "_all").join(merged, F.col("_all").eqNullSafe(F.col("_key")), "left")
    return whole.select(
        F.col("_all").alias(key), *flags, *[F.coalesce(F.col(c).cast(SUMMARIES_TYPE), F.expr(EMPTY_SUMMARIES)).alias(c) for c in (hits, custom_hits)]
    )
