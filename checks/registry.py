"""Registration of a query with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelight.sources.tables import spread

from . import corpora

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` its rows are checked by a test on a small fixture."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


# columns that tell rows apart, to spread the larger tables over the cores
_ROW_KEYS = {
    "lineitem": ["l_orderkey", "l_linenumber"],
    "orders": ["o_orderkey"],
    "events": ["event_id"],
}


# an order line becomes a stored scan, some ten times as wide in memory as in its file; scans are sorted for the latest one
_PART_BYTES = {"lineitem": 8 << 20}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # event times of the tables are UTC
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df, *_ROW_KEYS[name], part_bytes=_PART_BYTES.get(name)) if name in _ROW_KEYS else df


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Customer notes ``doc_id, path, text``."""
    source = spread(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey")
    return source.selectExpr(*[f"{e} as {n}" for n, e in corpora.profile_columns().items()])


def order_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Order notes ``doc_id, text``."""
    source = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return source.selectExpr(*[f"{e} as {n}" for n, e in corpora.order_note_columns().items()])


def ranked(ordered: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of an ordered frame with their place, to compare the order."""
    place = F.monotonically_increasing_id()  # rises in the order of the rows of one partition
    first = ordered.limit(n).withColumn("_at", place)
    return first.withColumn("rank", F.row_number().over(Window.orderBy("_at"))).drop("_at")


def joined(values, sep: str = "|"):
    """Array as text, for comparing results across engines."""
    return F.array_join(values, sep)


DOCS = "docs as (select doc_id, text from documents)"
PROFILES = f"profiles as materialized ({corpora.profiles()})"
ORDER_NOTES = f"notes as materialized ({corpora.order_notes()})"
