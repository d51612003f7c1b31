"""Comparison of two distribution reports and of two analysis periods.

* ``report_diff``       materials on both reports with changed capacity or
                        facings (NULL-safe comparison), and the direction of
                        the capacity change;
* ``capacity_vs_full``  how many capacity-changed materials were over-spaced
                        in every month of the first period / of both periods;
* ``persistent_items``  materials over-spaced in every month of both periods:
                        their monthly rows of both periods, with each period's
                        demand-variability ratio;
* ``observation_check`` rows per persistent material (expected: 2 x 3 months);
* ``only_one_period``   materials over-spaced in every month of one period only.

Materials are matched on (MatID, SKU). Set operations are joins on those
keys (``left_semi`` / ``left_anti`` / ``intersect``), so no list reaches the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["MatID", "SKU"]


def report_diff(first: DataFrame, later: DataFrame, changed_only: bool = True) -> DataFrame:
    a = first.select(*KEYS, *[F.col(c).alias(f"{c}_first") for c in ("POGS", "Facings", "Capacity")])
    b = later.select(*KEYS, *[F.col(c).alias(f"{c}_later") for c in ("POGS", "Facings", "Capacity")])
    j = a.join(b, KEYS, "inner")
    ca, cb = F.col("Capacity_first"), F.col("Capacity_later")
    fa, fb = F.col("Facings_first"), F.col("Facings_later")
    j = (j.withColumn("changed", ~ca.eqNullSafe(cb) | ~fa.eqNullSafe(fb))
          .withColumn("capacity_decreased", F.coalesce(ca > cb, F.lit(False)))
          .withColumn("capacity_increased", F.coalesce(ca < cb, F.lit(False))))
    return j.where(F.col("changed")) if changed_only else j


def capacity_vs_full(diff: DataFrame, full_first: DataFrame, full_later: DataFrame) -> DataFrame:
    """Per direction of capacity change: changed materials, and how many of
    them were full-month over-spaced in the first period / in both."""
    present = _presence(full_first, full_later)
    direction = (F.when(F.col("capacity_decreased"), F.lit("decreased"))
                  .when(F.col("capacity_increased"), F.lit("increased")))
    d = (diff.withColumn("direction", direction).where(F.col("direction").isNotNull())
             .join(present, KEYS, "left"))
    return (d.groupBy("direction")
             .agg(F.count(F.lit(1)).alias("n_items"),
                  F.count_distinct(F.when(F.col("_in_first"), F.col("MatID"))).alias("n_full_month_first"),
                  F.count_distinct(F.when(F.col("_in_first") & F.col("_in_later"), F.col("MatID"))).alias("n_full_month_both")))


def persistent_items(full_first: DataFrame, full_later: DataFrame,
                     risk_first: DataFrame, risk_later: DataFrame,
                     label_first: str = "first", label_later: str = "later") -> DataFrame:
    """Rows of both periods for materials full-month in both, with
    ``StdQty_to_AvgQty`` of each period (risk tables: one row per MatID)."""
    both = (full_first.withColumn("period_label", F.lit(label_first))
            .unionByName(full_later.withColumn("period_label", F.lit(label_later))))
    common = _presence(full_first, full_later).where("_in_first AND _in_later").select(*KEYS)
    both = both.join(common, KEYS, "left_semi")
    return (both.join(_one_ratio(risk_first, "StdQty_to_AvgQty_first"), "MatID", "left")
                .join(_one_ratio(risk_later, "StdQty_to_AvgQty_later"), "MatID", "left"))


def _presence(first: DataFrame, later: DataFrame) -> DataFrame:
    """One row per material with the periods it is in (one aggregate)."""
    rows = first.select(*KEYS, F.lit(True).alias("_in_first"), F.lit(False).alias("_in_later")).unionByName(
        later.select(*KEYS, F.lit(False).alias("_in_first"), F.lit(True).alias("_in_later")))
    return rows.groupBy(*KEYS).agg(F.max("_in_first").alias("_in_first"), F.max("_in_later").alias("_in_later"))


def _one_ratio(risk: DataFrame, name: str) -> DataFrame:
    """MatID and its ratio; a material with two different ratios (a frame
    that is keyed by store) is an error, not an arbitrary choice."""
    x = F.col("StdQty_to_AvgQty")
    return risk.groupBy("MatID").agg(
        F.when(F.min(x).eqNullSafe(F.max(x)), F.max(x))
         .otherwise(F.raise_error(F.lit("several ratios for one MatID"))).alias(name))


def observation_check(persistent: DataFrame, expected: int = 6) -> DataFrame:
    """Rows per persistent material and whether it is the expected count."""
    return (persistent.groupBy(*KEYS)
                      .agg(F.count(F.lit(1)).alias("n_obs"))
                      .withColumn("ok", F.col("n_obs") == expected))


def only_one_period(full_first: DataFrame, full_later: DataFrame,
                    label_first: str = "first", label_later: str = "later") -> DataFrame:
    a = full_first.select(*KEYS).distinct()
    b = full_later.select(*KEYS).distinct()
    return (a.join(b, KEYS, "left_anti").withColumn("only_in", F.lit(label_first))
             .unionByName(b.join(a, KEYS, "left_anti").withColumn("only_in", F.lit(label_later))))
