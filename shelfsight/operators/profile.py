"""Descriptive statistics of the monthly analysis table (the data behind the
original analysis' tables and charts).

Every statistic is a grouped or global aggregate with partial aggregation on
the map side; global totals enter other expressions as scalar subqueries
(one row). Quartiles are exact (counts of distinct values and prefix sums);
no statistic collects a column into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.plans.execution import rows_before

SUMMARY_COLUMNS = ["Facings", "Capacity", "totalMonthlyQtySold", "SellMargin"]
CLASS_COLUMNS = ["Price", "SellMargin"]


def _c(n: str) -> Column:
    return F.col(n)


def _long(one: DataFrame, columns: list[str], stats: list[str], keys: list[str]) -> DataFrame:
    structs = [F.struct(*[_c(k) for k in keys], F.lit(c).alias("column"),
                        *[_c(f"{c}__{s}").alias(s) for s in stats]) for c in columns]
    return one.select(F.inline(F.array(*structs)))


def describe(df: DataFrame, columns=None, by: list[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, max per column (and per group ``by``),
    one row per (group, column)."""
    columns = columns or SUMMARY_COLUMNS
    by = by or []
    aggs = []
    for c in columns:
        x = _c(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"),
                 F.max(x).alias(f"{c}__max")]
    one = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return _long(one, columns, ["count", "mean", "std", "min", "max"], by)


QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def quartiles(df: DataFrame, columns=None, by: list[str] | None = None) -> DataFrame:
    """25th, 50th and 75th percentiles per column (and group), exact and
    linearly interpolated between neighbouring values.

    One aggregate counts each distinct (group, column, value); prefix sums
    over range-partitioned values give the place of every value, and the two
    neighbours of each quantile are picked by one more aggregate. Group size
    plays no part in the method or the result."""
    columns = columns or CLASS_COLUMNS
    by = by or []
    key = [*by, "column"]
    long = df.select(*by, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), _c(c).cast("double").alias("_v")) for c in columns])))
    counts = long.where("_v IS NOT NULL").groupBy(*key, "_v").agg(F.count(F.lit(1)).alias("_n"))
    placed = rows_before(counts, key, F.col("_v").asc(), "_n", "_before")
    total = placed.groupBy(*[_c(k).alias(f"_t_{k}") for k in key]).agg(F.sum("_n").alias("_total"))
    placed = placed.join(total, [_c(k).eqNullSafe(_c(f"_t_{k}")) for k in key])
    aggs = []
    for name, q in QUARTILES.items():
        at = F.lit(q) * (F.col("_total") - 1)
        for side, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("_before") <= index) & (index < F.col("_before") + F.col("_n"))
            aggs.append(F.max(F.when(here, F.col("_v"))).alias(f"{name}_{side}"))
    aggs.append(F.max("_total").alias("_total"))
    picked = placed.groupBy(*key).agg(*aggs)
    out = [_c(k) for k in key]
    for name, q in QUARTILES.items():
        at = F.lit(q) * (F.col("_total") - 1)
        out.append((F.col(f"{name}_lo") + (at - F.floor(at)) * (F.col(f"{name}_hi") - F.col(f"{name}_lo"))).alias(name))
    exact = picked.select(*out)
    # a group without a value keeps its row, with NULL quartiles
    groups = df.select(*by).distinct() if by else None
    if groups is None:
        return exact
    every = groups.select(*[_c(b).alias(f"_b_{b}") for b in by], F.explode(F.array(*map(F.lit, columns))).alias("_c"))
    match = [_c(b).eqNullSafe(_c(f"_b_{b}")) for b in by] + [_c("column") == _c("_c")]
    return every.join(exact, match, "left").select(
        *[_c(f"_b_{b}").alias(b) for b in by], _c("_c").alias("column"), *QUARTILES)


def eight_number_summary(df: DataFrame, columns=None, by: list[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles (see ``quartiles``) and max
    per column and group."""
    columns = columns or CLASS_COLUMNS
    by = by or []
    basic = describe(df, columns, by)
    q = quartiles(df, columns, by).select(*[_c(b).alias(f"_q_{b}") for b in by], _c("column").alias("_q_column"),
                                          *QUARTILES)
    match = [_c(b).eqNullSafe(_c(f"_q_{b}")) for b in [*by]] + [_c("column") == _c("_q_column")]
    return basic.join(q, match, "left").select(*by, "column", "count", "mean", "std", "min", *QUARTILES, "max")


def correlations(df: DataFrame) -> DataFrame:
    """Pearson correlation of net vs gross sales and of facings vs quantity."""
    return df.agg(
        F.corr("totalMonthlyNetSale", "totalMonthlyGrossSale").alias("corr_net_gross"),
        F.corr("Facings", "totalMonthlyQtySold").alias("corr_facings_qty"),
        F.count(F.lit(1)).alias("n_rows"))


def class_share(df: DataFrame, column: str, by: str = "Classification") -> DataFrame:
    """Per class: total and mean of ``column``, the class's share (%) of the
    overall total and its mean relative to the overall mean (%)."""
    overall = df.select(F.struct(F.sum(column).alias("t"), F.avg(column).alias("m"))).scalar()
    total, mean = overall["t"], overall["m"]
    g = df.groupBy(by).agg(F.sum(column).alias("total"), F.avg(column).alias("mean"))
    return g.select(by, "total", "mean",
                    (F.try_divide(_c("total"), total) * 100).alias("share_pct"),
                    (F.try_divide(_c("mean"), mean) * 100).alias("mean_pct"))


def margin_rate(df: DataFrame, by: str = "Classification") -> DataFrame:
    """Per class: summed sell margin over summed net sales."""
    return (df.groupBy(by)
              .agg(F.sum("SellMargin").alias("sell_margin"),
                   F.sum("totalMonthlyNetSale").alias("net_sales"))
              .withColumn("margin_rate", F.try_divide(_c("sell_margin"), _c("net_sales"))))


def class_month(df: DataFrame, column: str, by: str = "Classification") -> DataFrame:
    """Per (class, month): sum and mean of ``column``."""
    return (df.groupBy(by, "year", "month")
              .agg(F.sum(column).alias("total"), F.avg(column).alias("mean"),
                   F.count(F.lit(1)).alias("n_rows")))


def geo_mean_summary(enriched: DataFrame) -> DataFrame:
    """Per (SubCategory, month): mean of the geometric-mean columns."""
    return (enriched.groupBy("SubCategory", "year", "month")
                    .agg(F.avg("Qty_GeoMean_by_month_Subcat").alias("qty_geo_mean"),
                         F.avg("NS_GeoMean_by_month_Subcat").alias("NS_geo_mean")))


def class_counts(df: DataFrame, by: str = "Classification") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"),
                              F.count_distinct("MatID").alias("n_items"))


def of_class(df: DataFrame, name: str, by: str = "Classification") -> DataFrame:
    """The rows of one class."""
    return df.where(_c(by) == F.lit(name))


def margin_bands(df: DataFrame, high: float = 0.8, low: float = 0.4) -> DataFrame:
    """Rows whose margin ratio (sell margin / net sales) is at least
    ``high`` ('high') or below ``low`` ('low')."""
    r = F.try_divide(_c("SellMargin"), _c("totalMonthlyNetSale"))
    band = F.when(r >= high, F.lit("high")).when(r < low, F.lit("low"))
    return (df.withColumn("margin_ratio", r).withColumn("margin_band", band)
              .where(_c("margin_band").isNotNull())
              .select("MatID", "SKU", "year", "month", "Classification", "SellMargin",
                      "totalMonthlyNetSale", "margin_ratio", "margin_band"))


def selected_share(df: DataFrame, selected: DataFrame, by: str = "Classification") -> DataFrame:
    """Per class: selected items' count, summed margin and net sales, and their
    share (%) of the class's summed margin over all items."""
    sel = selected.groupBy(by).agg(F.count_distinct("MatID").alias("n_items"),
                                   F.sum("SellMargin").alias("selected_margin"),
                                   F.sum("totalMonthlyNetSale").alias("selected_net_sales"))
    allm = df.groupBy(by).agg(F.sum("SellMargin").alias("class_margin"))
    return (sel.join(allm, by, "left")
               .withColumn("margin_share_pct",
                           F.try_divide(_c("selected_margin"), _c("class_margin")) * 100))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram of ``column`` between its min and max (the max
    falls in the last bin); both bounds come from one scalar subquery."""
    bounds = df.select(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
    lo, hi = bounds["lo"], bounds["hi"]
    x = _c(column)
    b = F.least(F.lit(bins).cast("long"),
                F.floor(F.try_divide(x - lo, hi - lo) * bins) + 1)
    b = F.when(hi == lo, F.lit(1).cast("long")).otherwise(b)
    return (df.where(x.isNotNull())
              .groupBy(b.alias("bin"))
              .agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("bin_min"),
                   F.max(column).alias("bin_max")))


# Fences of a box plot: this many interquartile ranges beyond the quartiles.
WHISKER_REACH = 1.5


def _fenced(df: DataFrame, column: str, by: list[str], reach: float) -> DataFrame:
    """Rows with a value, beside their group's quartiles and fences.

    The quartiles come from prefix sums over range slices (``quartiles``), one
    row per group; they are joined back to the rows, so a group of any size is
    spread over tasks in both phases."""
    q = quartiles(df, [column], by)
    q = q.select(*[_c(b).alias(f"_b_{b}") for b in by], *[_c(n).alias(f"_{n}") for n in QUARTILES])
    rows = df.where(_c(column).isNotNull()).withColumn("_x", _c(column).cast("double"))
    rows = rows.join(q, [_c(b).eqNullSafe(_c(f"_b_{b}")) for b in by], "inner")
    spread = F.lit(reach) * (_c("_p75") - _c("_p25"))
    return rows.withColumn("_low", _c("_p25") - spread).withColumn("_high", _c("_p75") + spread)


def _inside():
    return (_c("_x") >= _c("_low")) & (_c("_x") <= _c("_high"))


def box_plot(df: DataFrame, column: str, by: list[str], reach: float = WHISKER_REACH) -> DataFrame:
    """What a box plot of ``column`` draws, one row per group with a value: n,
    quartiles, both whiskers (the extreme values within ``reach``
    interquartile ranges of the quartiles) and the number of outliers beyond
    them. NULL keys are a group of their own."""
    return _fenced(df, column, by, reach).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.first(f"_{n}").alias(n) for n in QUARTILES],
        F.min(F.when(_inside(), _c("_x"))).alias("whisker_low"), F.max(F.when(_inside(), _c("_x"))).alias("whisker_high"),
        F.count(F.when(_c("_x") < _c("_low"), 1)).alias("n_low"), F.count(F.when(_c("_x") > _c("_high"), 1)).alias("n_high"))


def box_outliers(df: DataFrame, column: str, by: list[str], columns: list[str], reach: float = WHISKER_REACH) -> DataFrame:
    """The rows beyond the whiskers: ``columns``, the value and its side."""
    side = F.when(_c("_x") < _c("_low"), "low").otherwise("high")
    return _fenced(df, column, by, reach).where(~_inside()).select(*columns, _c("_x").alias("value"), side.alias("side"))
