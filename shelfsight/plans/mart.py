"""The monthly mart as a table partitioned by month.

The folder of a month is named by ``period`` (its first day). A filter on it
opens only the folders of the wanted months (``PartitionFilters``), and a join
with a table of months prunes them at run time (dynamic partition pruning), so
early and late reads, and re-runs of one month, cost what their months hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.operators import inventory as inv
from shelfsight.sources import writers as wr

MONTH = "period"


def write_mart(mart: DataFrame, path: str) -> None:
    """Write the months that ``mart`` has; others under ``path`` stay."""
    wr.write_partitions(mart, path, [MONTH])


def read_mart(spark: SparkSession, path: str, begin: str | None = None, end: str | None = None) -> DataFrame:
    """The months in [begin, end), both first days of months."""
    df = spark.read.parquet(path).withColumn(MONTH, F.col(MONTH).cast("date"))
    if begin is not None:
        df = df.where(F.col(MONTH) >= F.to_date(F.lit(begin)))
    if end is not None:
        df = df.where(F.col(MONTH) < F.to_date(F.lit(end)))
    return df


def early_late(spark: SparkSession, path: str, split: str) -> tuple[DataFrame, DataFrame]:
    """The months before ``split`` and those from it on."""
    return inv.split_periods(read_mart(spark, path), split)


def of_season(mart: DataFrame, seasons: DataFrame, season: str) -> DataFrame:
    """Mart rows of the months that ``seasons`` (month, season) names."""
    months = seasons.where(F.col("season") == season).select("month").distinct()
    periods = mart.select(MONTH).distinct().where(F.col(MONTH).isNotNull())
    wanted = periods.join(months, F.month(MONTH) == F.col("month"), "left_semi")
    return mart.join(wanted, MONTH, "left_semi")
