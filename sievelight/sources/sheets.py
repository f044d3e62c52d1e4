"""Text of spreadsheets from decoded cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.running import running_totals


def sheet_cells_to_text(
    cells: DataFrame,
    *,
    max_rows: int | None = None,
    max_cols: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """One text per sheet: a ``sheet:<name>`` line, then one non-empty cell per line.

    ``cells`` has ``path, sheet_no, sheet, row, col, value`` (``row`` and ``col`` from 0; a sheet
    without cells has one row with a null value). All cells are read unless ``max_rows`` or
    ``max_cols`` bound a sheet. ``max_bytes`` is a budget over a file's sheets: reading stops at the
    first cell that does not fit.
    """
    inside = F.lit(True)
    if max_rows is not None:
        inside = inside & (F.col("row") < max_rows)
    if max_cols is not None:
        inside = inside & (F.col("col") < max_cols)
    wanted = cells.filter(F.col("value").isNull() | (inside & (F.col("value") != "")))
    header = F.concat(F.lit("sheet:"), F.col("sheet"), F.lit("\n"))
    line = F.concat(F.col("value"), F.lit("\n"))
    kept = wanted.withColumn("_line", line)
    if max_bytes is not None:
        # a file's sheets, and a sheet, may hold most of all cells: sums run over many tasks
        kept = running_totals(kept, ["path", "sheet_no"], ["row", "col"], _no=F.lit(1))
        size = F.coalesce(F.octet_length("_line"), F.lit(0)) + F.when(F.col("_no") == 1, F.octet_length(header)).otherwise(0)
        kept = running_totals(
            kept.withColumn("_size", size.cast("long")), ["path"], ["sheet_no", "row", "col", "_no"], _sum=F.col("_size")
        )
        before = F.col("_sum") - F.col("_size")
        fits = F.col("_sum") <= max_bytes
        # a sheet is opened only while the cells before it left some budget
        opened = (F.col("_no") == 1) & (before < max_bytes)
        # sums never fall, so all cells before fit where the last of them did
        kept = kept.filter((before <= max_bytes) & (fits | opened)).withColumn("_line", F.when(fits, F.col("_line")))
    lines = F.array_sort(
        F.collect_list(F.when(F.col("_line").isNotNull(), F.struct("row", "col", "_line")))
    )
    return kept.groupBy("path", "sheet_no", "sheet").agg(
        F.array_join(F.transform(lines, lambda x: x["_line"]), "").alias("_body")
    ).select(
        "path", "sheet_no", "sheet", F.concat(header, F.col("_body")).alias("text")
    )
