"""Running totals inside keys of any size."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.session import checkpoint_dir, stored

_IN_PARTITION = 33  # bits that number the rows of a partition


def running_totals(rows: DataFrame, keys: list[str], order: list[str | Column], **totals: Column) -> DataFrame:
    """Add, for each of ``totals``, its sum over the rows of the same key up to and with the row, in ``order``.

    A scan in two levels. The rows are sorted by key and order into range partitions and written once to the shared folder, so a key
    that holds half of all rows lies in many partitions. Sums run inside each partition; a key that goes on in the next partition
    takes along what it had before, which concerns the first and the last key of a partition only. No task sees more of a key
    than a partition, and the offsets are two rows for each partition at most, whatever the number of rows.

    Rows with equal place come in one fixed order. A null counts 0; null keys are one key. Columns of ``rows`` named like a total are replaced.
    """
    spark = rows.sparkSession
    at = "_at"
    while any(c.lower().startswith(at) for c in rows.columns):
        at += "_"
    part, top = f"{at}p", f"{at}top"
    kept = [c for c in rows.columns if c.lower() not in {t.lower() for t in totals}]
    given = {f"{at}v{n}": expr for n, expr in enumerate(totals.values())}
    path = f"{checkpoint_dir(spark)}/running-{uuid.uuid4().hex}"
    by = [F.col(f"`{k}`") for k in keys]
    columns = [F.col(f"`{c}`") for c in kept]
    valued = rows.withColumns({n: F.coalesce(expr, F.lit(0)) for n, expr in given.items()})
    # keys and order are sorted by their columns before any is replaced
    # a sort reads its input twice, once for the bounds of its ranges, so what the rows cost is paid before it
    stored(valued, "running").orderBy(*by, *order).select(*columns, *given, F.monotonically_increasing_id().alias(at)).write.parquet(path)
    laid = spark.read.parquet(path).withColumn(part, F.shiftright(at, _IN_PARTITION))

    # what the keys at the ends of the partitions hold there
    sums = laid.groupBy(part, *by).agg(
        *[F.sum(n).alias(f"{n}s") for n in given], F.min(at).alias(f"{at}lo"), F.max(at).alias(f"{at}hi")
    )
    ends = laid.groupBy(part).agg(F.max(at).alias(top))
    first = F.col(f"{at}lo") == F.shiftleft(part, _IN_PARTITION)
    edges = sums.join(F.broadcast(ends), part).filter(first | (F.col(f"{at}hi") == F.col(top)))
    earlier = W.partitionBy(*by).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    offsets = edges.select(
        F.col(part).alias(f"{at}q"), *[c.alias(f"{at}k{n}") for n, c in enumerate(by)],
        *[F.sum(f"{n}s").over(earlier).alias(f"{n}o") for n in given],
    )
    same = [F.col(part) == F.col(f"{at}q"), *[c.eqNullSafe(F.col(f"{at}k{n}")) for n, c in enumerate(by)]]

    here = W.partitionBy(part, *by).orderBy(at).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = laid.select("*", *[F.sum(n).over(here).alias(f"{n}r") for n in given])
    moved = summed.join(F.broadcast(offsets), reduce(Column.__and__, same), "left")
    return moved.select(
        *columns,
        *[(F.col(f"{n}r") + F.coalesce(f"{n}o", F.lit(0))).alias(name) for n, name in zip(given, totals, strict=True)],
    )
