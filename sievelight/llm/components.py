"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def components(links: DataFrame) -> DataFrame:
    """Smallest node ``root`` reachable from each ``node`` of the links ``a, b``.

    Alternates large-star and small-star steps: each node ties its larger neighbours, then its smaller
    ones, to the smallest it knows. That needs few rounds even for long chains. A round is two
    aggregations (combined before their shuffle) and two joins, written to the shared folder; only a
    count and a checksum reach the driver, and the files of a round go once the next one is written. Loops and repeated links are allowed.
    """
    edges = links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges, seen = staged(edges.distinct(), "links", narrow=True), None
    while True:
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == seen or state[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last, seen = edges, state
        edges = staged(_small_star(_large_star(last)), "links", narrow=True)
        discard(last)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.selectExpr("inline(array(struct(a as u, b as v), struct(b as u, a as v)))")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").selectExpr(
        "inline(array(struct(b as a, m as b), struct(a as a, m as b)))"
    )
    return tied.where("a <> b").distinct()
