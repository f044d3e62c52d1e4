"""Places of rows in an order of a whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import checkpoint_dir

_IN_PARTITION = 33  # bits that number the rows of a partition


def with_places(ordered: DataFrame, place: str = "rank") -> DataFrame:
    """Add the place of each row, from 1, to a frame that ends with its order.

    The order is the range partitions of Spark's sort, written once to the shared folder with the number of each row in its
    partition. Rows are counted by partition, and a row's place is the number of rows in the partitions before its own plus its own
    number: no task sees the whole order, and the driver sees one count for each partition. A column named ``place`` is replaced.
    """
    spark = ordered.sparkSession
    at = "_at"
    while any(c.lower().startswith(at) for c in ordered.columns):
        at += "_"
    part, first = f"{at}p", f"{at}f"
    kept = [c for c in ordered.columns if c.lower() != place.lower()]
    path = f"{checkpoint_dir(spark)}/places-{uuid.uuid4().hex}"
    numbered = ordered.withColumn(at, F.monotonically_increasing_id())  # rises along the order
    numbered.select(*[f"`{c}`" for c in kept], at).write.parquet(path)
    rows = spark.read.parquet(path).withColumn(part, F.shiftright(at, _IN_PARTITION))
    before, offsets = 0, []
    for r in sorted(rows.groupBy(part).count().collect()):
        offsets.append((r[part], before))
        before += r["count"]
    starts = spark.createDataFrame(offsets, f"{part} long, {first} long")  # one row for each partition of the sort
    here = F.col(at).bitwiseAND(F.lit((1 << _IN_PARTITION) - 1))
    placed = rows.join(F.broadcast(starts), part).withColumn(place, F.col(first) + here + 1)
    return placed.select(*[f"`{c}`" for c in kept], place)


def page(placed: DataFrame, number: int, size: int, place: str = "rank") -> DataFrame:
    """Rows of one page, from page 1, of a frame with places."""
    return placed.where((F.col(place) > (number - 1) * size) & (F.col(place) <= number * size))
