"""Tables kept partitioned by a key, for several joins and aggregates on it.

A bucketed table is shuffled and sorted once, when it is written. Reading it,
Spark knows that rows of one key are in one bucket, so aggregates and windows
on the key (or on more columns beside it) and joins between tables with the
same buckets need no exchange.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.plans.execution import table_path


def bucket_count(df: DataFrame, buckets: int | None = None) -> int:
    return buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _save(df: DataFrame, keys: list[str], n: int, sort: bool) -> DataFrame:
    spark = df.sparkSession
    name, path = f"shelfsight_{uuid.uuid4().hex}", table_path(spark)
    writer = df.write.format("parquet").mode("overwrite").option("path", path).bucketBy(n, *keys)
    (writer.sortBy(*keys) if sort else writer).saveAsTable(name)
    return spark.table(name)


def bucketed(df: DataFrame, keys: list[str], buckets: int | None = None) -> DataFrame:
    """``df`` as a written table in ``buckets`` buckets of ``keys``, one file
    each, sorted by them. Give tables that are to be joined the same count.
    NULL keys share a bucket. The table is external, in the shared checkpoint
    folder, and owned by the running job like any ``materialize``d one."""
    n = bucket_count(df, buckets)
    return _save(df.repartition(n, *[F.col(k) for k in keys]), keys, n, True)


def sliced(df: DataFrame, order: list, out: str = "_slice", buckets: int | None = None) -> DataFrame:
    """``df`` range-partitioned by ``order`` and written with the number of
    its slice in ``out``, bucketed by it: later windows inside (group, slice)
    need no exchange."""
    n = bucket_count(df, buckets)
    return _save(df.repartitionByRange(n, *order).withColumn(out, F.spark_partition_id()), [out], n, False)
