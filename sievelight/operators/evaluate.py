"""Detection quality on labelled cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .builtin import with_builtin_hits
from .rules import Rule, with_rule_hits


def detected_types(cases: DataFrame, rules: Sequence[Rule], **options) -> DataFrame:
    """Cases with ``detected``: all built-in categories and rule names found in the text."""
    found = with_rule_hits(with_builtin_hits(cases, "text", **options), rules, "text")
    names = lambda c: F.transform(c, lambda h: h.category)
    return found.withColumn("detected", F.concat(names("hits"), names("custom_hits"))).drop(
        "hits", "custom_hits"
    )


def evaluate_cases(cases: DataFrame, rules: Sequence[Rule], **options) -> DataFrame:
    """Cases with ``outcome``: HIT, MISS, FALSE_POS or CLEAN for their target type.

    The outcome comes from the detectors and rules of the case's own type, so a case costs one of them and not all. ``detected``
    still lists all types found; it is worked out where a caller reads it.
    """
    listed = detected_types(cases, rules, **options)
    own = with_builtin_hits(listed, "text", "_own", target="target_type", **options)
    judged = with_rule_hits(own, rules, "text", out="_own_rules", target="target_type")
    has = F.expr("case when target_type is not null then size(_own) + size(_own_rules) > 0 end")
    outcome = (
        F.when(F.col("should_detect") & has, "HIT")
        .when(F.col("should_detect"), "MISS")
        .when(has, "FALSE_POS")
        .otherwise("CLEAN")
    )
    return judged.withColumn("outcome", outcome).drop("_own", "_own_rules")


def confusion(judged: DataFrame) -> DataFrame:
    """Number of cases per target type and outcome."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o.lower())
    return judged.groupBy("target_type").agg(
        count("HIT"), count("MISS"), count("FALSE_POS"), count("CLEAN")
    )


def case_counts(cases: DataFrame) -> DataFrame:
    return cases.groupBy("target_type").agg(
        F.count_if(F.col("should_detect")).alias("positives"),
        F.count_if(~F.col("should_detect")).alias("negatives"),
    )


def dedup_cases(cases: DataFrame, order: str) -> DataFrame:
    """First case by ``order`` for each target type, expectation and text; sorted by type,
    positives first, id."""
    keys = ["target_type", "should_detect", "text"]
    first = cases.groupBy(*keys).agg(F.min_by(F.struct(*cases.columns), order).alias("r"))
    return first.select("r.*").orderBy("target_type", F.col("should_detect").desc(), "id")
