"""The analyses as SQL over temporary views, with bound parameters.

``views`` names tables for the statements of one session; ``run`` binds
parameters (never pasted into the text), and the result is a DataFrame like any
other: the same optimizer sees SQL and DataFrame form.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


@contextmanager
def views(spark: SparkSession, **tables: DataFrame) -> Iterator[dict[str, str]]:
    """Temporary views of ``tables`` under names of their own, so that
    concurrent jobs of a session do not meet; dropped at the end (statements
    are resolved when they are made)."""
    names = {k: f"{k}_{uuid.uuid4().hex[:12]}" for k in tables}
    for k, df in tables.items():
        df.createOrReplaceTempView(names[k])
    try:
        yield names
    finally:
        for name in names.values():
            spark.catalog.dropTempView(name)


def run(spark: SparkSession, text: str, names: dict[str, str], **parameters) -> DataFrame:
    """``text`` with its views ({name} of ``names``) and ``parameters``
    (:name) bound."""
    return spark.sql(text.format(**names), args=parameters)


# Pairs that are out on every day of the window, with their share of the
# store's losses.
OOS_ALL_DAYS = """
SELECT SKU, Store, category, OOS_days, avg_loss_sale_quantity, avg_loss_net_sale, avg_loss_margin,
       total_loss_sale_quantity, total_loss_net_sale, total_loss_margin,
       try_divide(avg_loss_net_sale, sum(avg_loss_net_sale) OVER store) * 100 AS Avg_NS_Percentage,
       try_divide(avg_loss_margin, sum(avg_loss_margin) OVER store) * 100 AS Avg_Margin_Percentage
FROM {report} WHERE OOS_days = :days
WINDOW store AS (PARTITION BY Store)
"""

# Pairs of the newest week's top list that the week before did not list.
NEWCOMERS = """
WITH weeks AS (SELECT DISTINCT Date FROM {weekly} ORDER BY Date DESC LIMIT 2),
listed AS (
  SELECT SKU, Store, bool_or(Date = (SELECT max(Date) FROM weeks) AND rank BETWEEN 1 AND :top) AS now,
         bool_or(Date = (SELECT min(Date) FROM weeks) AND rank BETWEEN 1 AND :top) AS before
  FROM {weekly} WHERE Date IN (SELECT Date FROM weeks) GROUP BY SKU, Store)
SELECT w.*, coalesce(l.now AND NOT l.before, false) AS newcomer
FROM {weekly} w LEFT JOIN listed l ON w.SKU = l.SKU AND w.Store = l.Store
"""

# The lists that the analyses start from, one row per entry.
LISTS = """
SELECT DISTINCT 'pair' AS list, SKU, Store, CAST(NULL AS STRING) AS concept, CAST(NULL AS STRING) AS week FROM {weekly}
UNION ALL SELECT DISTINCT 'triple', SKU, Store, Concept_NEW, NULL FROM {weekly}
UNION ALL SELECT DISTINCT 'week', NULL, NULL, NULL, Date FROM {weekly}
UNION ALL SELECT DISTINCT 'concept', NULL, NULL, Concept_NEW, NULL FROM {weekly}
"""


def oos_all_days(report: DataFrame, days: int) -> DataFrame:
    """``oos.oos_7_days`` as SQL."""
    spark = report.sparkSession
    with views(spark, report=report) as names:
        return run(spark, OOS_ALL_DAYS, names, days=days)


def newcomers(weekly: DataFrame, top: int) -> DataFrame:
    """``rank.newcomer`` as SQL."""
    spark = weekly.sparkSession
    with views(spark, weekly=weekly) as names:
        return run(spark, NEWCOMERS, names, top=top)


def lists(weekly: DataFrame) -> DataFrame:
    """(list, SKU, Store, concept, week): the distinct pairs, triples, weeks
    and concepts of a weekly table."""
    spark = weekly.sparkSession
    with views(spark, weekly=weekly) as names:
        return run(spark, LISTS, names)
