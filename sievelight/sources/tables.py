"""Tables with a text column as scan input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_extension

def spread(
    df: DataFrame, *keys: str, split_bytes: int = 128 << 20, max_bytes: int = 4 << 30, part_bytes: int | None = None
) -> DataFrame:
    """Split a small input over all cores; leave a large one as its file splits.

    A file with a single row group is read by one task however many cores are free. Inputs that
    Spark's statistics put below one split per core, and below ``max_bytes``, are therefore
    hashed by ``keys`` over the cores. Larger inputs have splits enough and are not shuffled.

    With ``part_bytes`` the parts are about so large, however large the input: for tables whose compressed bytes become wide rows that
    tasks sort, so that memory of a task does not grow with the table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if part_bytes is not None:
        return df.repartition(max(cores, -(-size // part_bytes)), *keys)
    if size >= min(cores * split_bytes, max_bytes):
        return df
    return df.repartition(cores, *keys)


def scan_table_text(
    df: DataFrame,
    id_col: str,
    text_col: str,
    *,
    path_col: str | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Any table as corpus rows ``doc_id, path, ext, size, text, secrets_enabled``.

    Only the named columns are read. ``size`` is the text's bytes, ``path`` defaults to null.
    """
    path = F.col(path_col) if path_col else F.lit(None).cast("string")
    return df.select(
        F.col(id_col).alias("doc_id"),
        path.alias("path"),
        F.expr(f"coalesce({file_extension(path_col)}, '')" if path_col else "''").alias("ext"),
        F.octet_length(text_col).cast("bigint").alias("size"),
        F.col(text_col).alias("text"),
        F.lit(True).alias("secrets_enabled"),
        *keep,
    )
