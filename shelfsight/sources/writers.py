"""Sinks.

Outputs are written by all tasks in parallel (no ``coalesce(1)`` and no
``toPandas``). List columns are rendered as text for CSV, flags as
``'True'/'False'/''`` only at export.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from shelfsight.functions.columns import flag_text


def for_csv(df: DataFrame) -> DataFrame:
    """Make a frame CSV-safe: arrays -> comma text, booleans -> 'True'/'False'/''."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        elif isinstance(f.dataType, BooleanType):
            c = flag_text(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, *, partition_by=None, mode: str = "overwrite") -> None:
    w = for_csv(df).write.mode(mode).option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_parquet(df: DataFrame, path: str, *, partition_by=None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_buckets(df: DataFrame, path: str, bucket_col: str = "bucket", fmt: str = "csv") -> None:
    """One folder per bucket value (replaces a workbook with one sheet per bucket)."""
    if fmt == "csv":
        write_csv(df, path, partition_by=[bucket_col])
    else:
        write_parquet(df, path, partition_by=[bucket_col])


def write_partitions(df: DataFrame, path: str, partition_by: list[str], rows_per_file: int = 5_000_000) -> None:
    """Parquet folders by ``partition_by``, of which only those that ``df``
    has rows for are replaced; the others stay as they are. Rows are rebalanced
    by the partition columns, so a folder gets few files, a large one several
    of at most ``rows_per_file`` rows, and no task a whole large folder."""
    (df.hint("rebalance", *partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .option("maxRecordsPerFile", rows_per_file).partitionBy(*partition_by).parquet(path))
