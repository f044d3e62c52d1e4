"""Mix sources to target weights by systematic sampling.

Within a source all expected copies are prefix-summed in an order that is fixed by the rows (size,
then a hash of the id), one random offset is added, and a document is emitted once for each integer
that its interval passes. Ordering by size spreads the choice over all lengths, so the words taken
from a source come within about one long document of its target.

No task holds a source: ranks are made of three counts, of smaller sizes in the source, of earlier
hash buckets of the same size, and inside one bucket, so a source with a third of all rows and a
thousand copies of one size are both spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, without

_OUT = ("size", "source_size", "target", "copies")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeats: int = 3
) -> DataFrame:
    """Targets of sources: rows ``source, source_size`` get ``weight`` and ``target``.

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all
    sizes. A target stops at ``max_repeats`` times its source's size; what is over goes to the
    others by weight until no target is above. Sources are taken in the order of size by weight:
    while a source's bound lies under its share of what is left, it is capped, and the share of
    the first that is not capped holds for all others. One row per source; an empty table gives
    an empty one, and a total of 0 gives targets of 0.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighted = sizes.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    )
    every = Window.partitionBy()
    before = Window.orderBy("_ratio", F.col("source").isNull(), "source").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bound = F.lit(float(max_repeats)) * F.col("source_size")
    shared = (
        weighted.withColumn("_ratio", bound / F.col("weight"))
        .withColumn("_all", F.sum("source_size").over(every))
        .withColumn("_weights", F.sum("weight").over(every))
        .withColumn("_used", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("_taken", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn(
            "_share",
            (F.col("_all") - F.lit(float(max_repeats)) * F.col("_used"))
            / (F.col("_weights") - F.col("_taken")),
        )
        .withColumn("_capped", F.col("_ratio") <= F.col("_share"))
        .withColumn("_level", F.max(F.when(~F.col("_capped"), F.col("_share"))).over(every))
    )
    target = F.when(F.col("_capped"), bound).otherwise(F.col("weight") * F.col("_level"))
    return shared.select("source", "source_size", "weight", target.cast("double").alias("target"))


def mix(
    docs: DataFrame,
    size: Column,
    *,
    id: str = "doc_id",
    source: str = "source",
    weights: Sequence[float] = (1, 2, 3),
    max_repeats: int = 3,
    seed: int = 17,
) -> DataFrame:
    """Every row of ``docs`` with ``size, source_size, target`` and ``copies``, the times it is taken.

    Null sizes count as 0, null sources form a source of their own, null ids are an id like any
    other. Rows that repeat are counted one by one; rows of equal size and id are ordered by a hash
    of the row. A source without words has target 0 and none of its rows is taken. Input columns named
    like a result column are replaced by it. The same rows and seed give the same copies.
    """
    sized = docs.withColumn("_mix_size", F.coalesce(size, F.lit(0)).cast("long"))
    plain = without(sized, *(n for n in _OUT if n not in (id, source)))
    salt = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id).cast("string"), F.lit("null")))
    atoms = [c for c, t in plain.dtypes if "map<" not in t and "variant" not in t]
    rows = plain.select(
        *[F.col(f"`{c}`") for c in plain.columns if c != "_mix_size"],
        F.col("_mix_size").alias("size"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("_mix_s"),
        F.md5(salt).alias("_mix_tie"),
        F.xxhash64(*atoms).alias("_mix_row"),
    ).withColumn("_mix_b", F.substring("_mix_tie", 1, 3))
    # one reading of the texts; the rest works on a few numbers of each row
    counts = staged(
        rows.groupBy("_mix_s", F.col(source).alias("source"), "size", "_mix_b").agg(
            F.count(F.lit(1)).alias("_mix_n")
        ),
        "mix-counts",
        narrow=True,
    )
    sizes = counts.groupBy("_mix_s", "source", "size").agg(F.sum("_mix_n").alias("_mix_n"))
    totals = sizes.groupBy("_mix_s", "source").agg(
        F.sum(F.col("size") * F.col("_mix_n")).alias("source_size")
    )
    goals = staged(source_targets(totals.drop("_mix_s"), weights, max_repeats), "mix-targets")
    goals = goals.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_mix_s"),
        "source_size",
        "target",
        offset(F.col("source").cast("string"), seed).alias("_mix_u"),
    )
    smaller = Window.partitionBy("_mix_s").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_mix_s", "size", F.coalesce(F.sum("_mix_n").over(smaller), F.lit(0)).alias("_mix_before")
    ).join(goals, "_mix_s")
    earlier = (
        Window.partitionBy("_mix_s", "size")
        .orderBy("_mix_b")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    within = counts.select(
        "_mix_s", "size", "_mix_b", F.coalesce(F.sum("_mix_n").over(earlier), F.lit(0)).alias("_mix_in")
    )
    placed = within.join(starts, ["_mix_s", "size"]).withColumn(
        "_mix_before", F.col("_mix_before") + F.col("_mix_in")
    )
    inside = Window.partitionBy("_mix_s", "size", "_mix_b").orderBy("_mix_tie", F.col(id), "_mix_row")
    rank = (F.col("_mix_before") + F.row_number().over(inside)).cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    passed = F.floor(F.col("_mix_u") + F.col("_mix_rank") * F.col("_mix_rate")) - F.floor(
        F.col("_mix_u") + (F.col("_mix_rank") - 1) * F.col("_mix_rate")
    )
    keep = [F.col(f"`{c}`") for c in plain.columns if c != "_mix_size"]
    return (
        rows.join(placed.drop("_mix_in"), ["_mix_s", "size", "_mix_b"])
        .withColumn("_mix_rank", rank)
        .withColumn("_mix_rate", rate)
        .select(
            *keep,
            "size",
            "source_size",
            "target",
            F.least(passed, F.lit(max_repeats)).cast("long").alias("copies"),
        )
    )


def offset(source: Column, seed: int) -> Column:
    """The random offset in [0, 1) of a source."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(source, F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def drawn(
    docs: DataFrame, size: Column, *, id: str = "doc_id", source: str = "source", **options
) -> DataFrame:
    """The rows of ``docs`` as often as :func:`mix` takes them, with their own columns only."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_mix_doc")
    packed = docs.select(row, F.col(id).alias("id"), F.col(source).alias("source"), size.alias("_mix_words"))
    mixed = mix(packed, F.col("_mix_words"), id="id", source="source", **options)
    return emitted(mixed, ["_mix_doc"]).select("_mix_doc.*")


def emitted(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix itself: each row as often as it is taken."""
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    taken = mixed.where("copies > 0").select(*[F.col(f"`{c}`") for c in columns], times.alias("_copy"))
    return taken.drop("_copy")
