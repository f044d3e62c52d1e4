"""The newest rows of a table, without sorting it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import with_places

_DIGIT = 16  # bits that are counted in one pass


def _as_long(rows: DataFrame, column: str) -> Column | None:
    kind = rows.select(f"`{column}`").schema[0].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.col(f"`{column}`").cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(f"`{column}`"))
    return None


def cut_off(rows: DataFrame, value: Column, keep: int) -> tuple[int | None, int]:
    """The ``keep``-th largest value, and how many rows with exactly that value are still wanted.

    Values are counted by digits of 16 bits, from the range they really have: two passes for seconds of a century. The
    driver sees 65,536 counts of a pass at most. The value is null if fewer rows have one; then the number is that of rows
    without a value.
    """
    found = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).first()
    if found["n"] < keep:
        return None, keep - found["n"]
    # exact for all longs: the distance to the smallest one is taken as 64 bits without a sign
    distance = F.try_subtract(value, F.lit(found["lo"])) if found["hi"] - found["lo"] < 1 << 63 else value.bitwiseXOR(F.lit(-(1 << 63)))
    span = found["hi"] - found["lo"] if found["hi"] - found["lo"] < 1 << 63 else (1 << 64) - 1
    shift = max(0, (max(span.bit_length(), 1) - 1) // _DIGIT * _DIGIT)
    prefix, left, here = 0, keep, rows
    while True:
        digit = F.shiftrightunsigned(distance, shift).bitwiseAND(F.lit((1 << _DIGIT) - 1)).alias("d")
        counts = here.where(value.isNotNull()).groupBy(digit).count().collect()
        for d, n in sorted(((r["d"], r["count"]) for r in counts), reverse=True):
            if n >= left:
                prefix = prefix << _DIGIT | d
                break
            left -= n
        if shift == 0:
            break
        signed = prefix - (1 << 64) if prefix >= 1 << 63 else prefix
        here = rows.where(F.shiftrightunsigned(distance, shift) == F.lit(signed))
        shift -= _DIGIT
    least = prefix + found["lo"] if span < 1 << 63 else prefix - (1 << 63)
    return least, left


def newest_rows(rows: DataFrame, keep: int, arrival: str, *ties: str) -> DataFrame:
    """The last ``keep`` rows by ``arrival``, then by ``ties``, all of them largest first; nulls come last.

    The arrival of the last row is found by counting, and rows are filtered by it: no sort, and no task sees them all, however many
    are kept. Only the rows that share that arrival are put in order, over many tasks. Arrivals that are no whole numbers or
    times are sorted. Rows that are equal in everything named are interchangeable.
    """
    if keep <= 0:
        return rows.limit(0)
    value = _as_long(rows, arrival)
    if value is None:
        ordered = rows.orderBy(*[F.col(f"`{c}`").desc() for c in (arrival, *ties)])
        return _first(ordered, keep).select(*rows.columns)
    least, left = cut_off(rows, value, keep)
    if least is None:
        above, level = rows.where(value.isNotNull()), rows.where(value.isNull())
    else:
        above, level = rows.where(value > least), rows.where(value == least)
    if level.count() <= left:
        return above.unionByName(level)
    if not ties:
        return above.unionByName(_first(level, left))
    return above.unionByName(_first(level.orderBy(*[F.col(f"`{c}`").desc() for c in ties]), left))


def _first(ordered: DataFrame, n: int) -> DataFrame:
    place = "_place"
    while place in {c.lower() for c in ordered.columns}:
        place += "_"
    return with_places(ordered, place).where(F.col(place) <= n).drop(place)
