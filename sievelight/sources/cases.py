"""Labelled detection cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas


def read_labelled_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases from JSON lines; blank lines are skipped, a malformed line fails the read."""
    return spark.read.schema(schemas.LABELLED_CASES).option("mode", "FAILFAST").json(path)
