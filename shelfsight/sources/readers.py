"""Readers for the exported CSV files and for columnar copies of them.

Every CSV read uses an explicit schema (no inference pass, stable types) and
finds its columns by header name. Paths may be any Hadoop URI
(``s3a://``, ``abfss://``, ``hdfs://``); credentials come from the cluster's
own configuration, never from this code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shelfsight.sources import schemas as S


def read_csv(spark: SparkSession, path: str, schema, *, columns=None) -> DataFrame:
    """Header CSV: the columns of ``schema`` (or the subset ``columns``) are
    taken by header name, whatever their order and whatever other columns the
    file has. A missing column is an error, and so is a file of the path whose
    header differs from the first one's (``enforceSchema`` off)."""
    def reader():
        return (spark.read.option("header", True).option("encoding", "UTF-8")
                .option("mode", "PERMISSIVE"))
    header = reader().csv(path).columns
    place = {h.strip("\ufeff ").strip(): h for h in reversed(header)}
    wanted = [schema[c] for c in columns or schema.names]
    missing = [f.name for f in wanted if f.name not in place]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} in the header {header}")
    text = StructType([StructField(h, StringType()) for h in header])
    df = reader().schema(text).option("enforceSchema", False).csv(path)
    return df.select(*[F.col(f"`{place[f.name]}`").cast(f.dataType).alias(f.name) for f in wanted])


def read_stock_daily(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, S.STOCK_DAILY_SCHEMA)


def read_closed_stores(spark: SparkSession, path: str) -> DataFrame:
    """Closed-store list: one column ``Store``, unique, no NULLs.

    The export starts with a UTF-8 byte-order mark and uses CRLF; the BOM is
    stripped from the values so it cannot glue onto the first store id."""
    df = read_csv(spark, path, S.CLOSED_STORES_SCHEMA, columns=["Store"])
    store = F.trim(F.regexp_replace(F.col("Store"), "\ufeff", ""))
    return df.select(store.alias("Store")).where(F.col("Store").isNotNull()).distinct()


def read_rank_weekly(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, S.RANK_WEEKLY_SCHEMA)


def read_sales_monthly(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, S.SALES_MONTHLY_SCHEMA)


def read_dist_report(spark: SparkSession, path: str, columns=None) -> DataFrame:
    """Distribution (planogram) report; ``columns`` selects a subset."""
    return read_csv(spark, path, S.DIST_REPORT_SCHEMA, columns=columns)


def read_subcategory(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, S.SUBCATEGORY_SCHEMA)


def read_vendor(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, S.VENDOR_SCHEMA)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """Re-read an earlier output (parquet by default; CSV needs a schema)."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV table needs a schema: without one its months would be text")
        return r.option("header", True).option("enforceSchema", False).csv(path)
    return r.format(fmt).load(path)
