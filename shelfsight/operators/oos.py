"""Out-of-stock detection over daily (SKU, Store) stock and sales facts.

Rules (per SKU/Store pair):

1. pairs whose net sales over the period sum to 0 are dropped;
2. pairs whose stock over the period sums to 0 are dropped;
3. a day is out of stock when stock = 0 and quantity sold = 0, the pair has
   had non-zero stock on or before that day, and the day lies in the last
   ``window_days`` days of the calendar (global last day minus 6 .. last day);
4. days missing from the facts count as stock = 0, sales = 0 (calendar fill);
5. a pair is reported when it has at least one out-of-stock day and has had
   positive stock at some time in the period;
6. the loss estimate averages margin, net sales and quantity over the pair's
   days with non-zero stock, and multiplies by the number of out-of-stock days.

Plan shape: no row loop, no window, no grid for the report. One grouped
aggregate per pair over the whole period (partial aggregation on the map
side) gives the rules 1, 2, 5, 6 inputs and the first-stock day; it is
written once, and the global calendar bounds are a scalar subquery over
those pair rows; a second,
much smaller aggregate over the last ``window_days`` days lists each pair's
zero days, bounded by ``window_days`` entries per pair; missing days come
from ``array_except(sequence(start, last), present_days)``. The dense grid
(``clean_grid``) is produced only when it is itself the wanted output, with
``explode(sequence(...))`` rather than a cross join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsight.functions.columns import as_double, day_of, snap_to_zero
from shelfsight.plans.execution import materialize
from shelfsight.sources.schemas import DAY_FORMAT, STOCK_DAILY_RENAME

KEYS = ["SKU", "Store"]
MEASURES = ["NetSales", "QtySold", "Margin", "StockQty"]
WINDOW_DAYS = 7


def _col(n: str) -> Column:
    return F.col(n)


def clean_stock(raw: DataFrame, closed_stores: DataFrame | None = None,
                snap_small_stock: bool = False) -> DataFrame:
    """Rename business headers, cast measures to DOUBLE, parse the day,
    drop closed stores and rows without a store.

    ``closed_stores`` needs a ``Store`` column; it is anti-joined. No broadcast hint is set here: AQE broadcasts the list when
    its measured size is small and keeps a shuffle join otherwise (callers
    holding a small list file can pass ``broadcast_if_small(list)``).
    ``snap_small_stock`` (off by default, as in the reference) sets stock
    values strictly between -1 and 1 to 0."""
    ren = {k: v for k, v in STOCK_DAILY_RENAME.items() if k in raw.columns}
    df = raw.withColumnsRenamed(ren) if ren else raw
    df = df.select(
        "SKU", "Store", "Category",
        day_of(df, "Date", DAY_FORMAT).alias("Date"),
        *[as_double(df, m).alias(m) for m in MEASURES],
    ).where(_col("Store").isNotNull())
    if snap_small_stock:
        df = df.withColumn("StockQty", snap_to_zero(_col("StockQty")))
    if closed_stores is not None:
        # an anti join needs no de-duplicated right side; projection and
        # filter keep a caller's broadcast hint intact
        closed = closed_stores.select("Store").where(_col("Store").isNotNull())
        df = df.join(closed, "Store", "left_anti")
    return df.select("SKU", "Store", "Category", "Date", *MEASURES)


def pair_summary(facts: DataFrame) -> DataFrame:
    """One row per (SKU, Store) that passes rules 1 and 2, with the period
    statistics the later rules need.

    Two steps: a hash aggregate per (SKU, Store, Category) does all the
    numeric work with map-side partial aggregation; the per-pair step then
    runs over about one row per pair and picks the category of the latest
    dated row. (A string-valued ``max_by`` over the raw rows would force a
    sort-based aggregate over every fact row.)"""
    valid = _col("Date").isNotNull()
    stock = F.coalesce(_col("StockQty"), F.lit(0.0))
    on_stock = valid & (stock != 0)

    def on_stock_sum(m: str) -> Column:
        return F.sum(F.when(on_stock, F.coalesce(_col(m), F.lit(0.0))))

    per_cat = (facts.groupBy(*KEYS, "Category")
                    .agg(F.sum("NetSales").alias("sum_net_sales"),
                         F.sum("StockQty").alias("sum_stock"),
                         F.min(F.when(valid, _col("Date"))).alias("first_day"),
                         F.max(F.when(valid, _col("Date"))).alias("last_day"),
                         F.min(F.when(on_stock, _col("Date"))).alias("first_stock_day"),
                         F.max(F.when(valid, stock > 0)).alias("ever_positive"),
                         F.count(F.when(on_stock, 1)).alias("stock_days"),
                         on_stock_sum("QtySold").alias("qty_on_stock"),
                         on_stock_sum("NetSales").alias("net_on_stock"),
                         on_stock_sum("Margin").alias("margin_on_stock")))
    sums = ["sum_net_sales", "sum_stock", "stock_days", "qty_on_stock", "net_on_stock",
            "margin_on_stock"]
    return (per_cat.groupBy(*KEYS)
                   .agg(*[F.sum(c).alias(c) for c in sums],
                        F.min("first_day").alias("first_day"),
                        F.max("last_day").alias("last_day"),
                        F.min("first_stock_day").alias("first_stock_day"),
                        F.max("ever_positive").alias("ever_positive"),
                        F.max_by("Category", F.when(_col("Category").isNotNull(),
                                                    _col("last_day"))).alias("category"))
                   .where((_col("sum_net_sales") != 0) & (_col("sum_stock") != 0)))


def period_bounds(pairs: DataFrame) -> DataFrame:
    """Calendar of the kept pairs: one row (first_day, last_day, n_days)."""
    return pairs.agg(F.min("first_day").alias("first_day"),
                     F.max("last_day").alias("last_day")) \
                .withColumn("n_days", F.datediff("last_day", "first_day") + 1)


def clean_grid(facts: DataFrame) -> DataFrame:
    """Calendar-complete facts of the kept pairs: every pair has one row per
    day of the period (days without facts get 0 measures, NULL category);
    duplicate input days stay duplicated."""
    summary = materialize(pair_summary(facts))
    pairs = summary.select(*KEYS)
    b = period_bounds(summary)
    d0 = b.select("first_day").scalar()
    d1 = b.select("last_day").scalar()
    grid = pairs.select(*KEYS, F.explode(F.sequence(d0, d1)).alias("Date"))
    kept = facts.where(_col("Date").isNotNull())
    out = grid.join(kept, KEYS + ["Date"], "left")
    return out.select("SKU", "Store", "Date", "Category",
                      *[F.coalesce(_col(m), F.lit(0.0)).alias(m) for m in MEASURES])


def detect_oos(facts: DataFrame, window_days: int = WINDOW_DAYS,
               keep: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """Out-of-stock report, one row per reported (SKU, Store).

    The pair summary (about one row per pair) is written once by ``keep``: the
    period bounds and the report both read it, so the facts are aggregated
    once. With facts and ``keep`` bucketed by the pair, nothing here is
    shuffled by it."""
    pairs = keep(pair_summary(facts))
    last = period_bounds(pairs).select("last_day").scalar()
    since = F.date_sub(last, window_days - 1)

    zero = (F.coalesce(_col("StockQty"), F.lit(0.0)) == 0) & \
           (F.coalesce(_col("QtySold"), F.lit(0.0)) == 0)
    recent_days = (facts.where((_col("Date") >= since) & (_col("Date") <= last))
                        .groupBy(*KEYS, "Date")
                        .agg(F.count(F.when(zero, 1)).cast("int").alias("n_zero")))
    recent = (recent_days.groupBy(*KEYS)
                         .agg(F.collect_list("Date").alias("present"),
                              F.collect_list(F.when(_col("n_zero") > 0,
                                                    F.struct("Date", "n_zero"))).alias("zero_days")))

    # The calendar end enters as a column: the array functions below may not
    # hold a subquery themselves.
    p = pairs.join(recent, KEYS, "left").withColumn("_last", last)
    last = _col("_last")
    since = F.date_sub(last, window_days - 1)
    first_stock = _col("first_stock_day")
    start = F.greatest(first_stock, since)
    calendar_days = F.when(start <= last, F.sequence(start, last)).otherwise(F.array().cast("array<date>"))
    missing = F.array_except(calendar_days, F.coalesce(_col("present"), F.array().cast("array<date>")))
    counted = F.flatten(F.transform(
        F.filter(F.coalesce(_col("zero_days"), F.array()), lambda e: e["Date"] >= first_stock),
        lambda e: F.array_repeat(e["Date"], e["n_zero"])))
    date_list = F.array_sort(F.concat(missing, counted))

    p = p.withColumn("date_list", date_list) \
         .withColumn("OOS_days", F.size("date_list")) \
         .where((_col("OOS_days") > 0) & _col("ever_positive"))

    def avg(total: str) -> Column:
        return F.try_divide(_col(total), _col("stock_days"))

    return p.select(
        "SKU", "Store", "category", "OOS_days", "date_list",
        F.array_contains("date_list", last).cast("int").alias("OOS_lastDay"),
        avg("qty_on_stock").alias("avg_loss_sale_quantity"),
        avg("net_on_stock").alias("avg_loss_net_sale"),
        avg("margin_on_stock").alias("avg_loss_margin"),
        (avg("qty_on_stock") * _col("OOS_days")).alias("total_loss_sale_quantity"),
        (avg("net_on_stock") * _col("OOS_days")).alias("total_loss_net_sale"),
        (avg("margin_on_stock") * _col("OOS_days")).alias("total_loss_margin"),
    )


def oos_7_days(report: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Pairs out of stock on every day of the window, with each pair's share
    (in %) of its store's summed average net-sales and margin loss over these
    pairs. The share is this library's own definition (the original
    analysis step is not available)."""
    full = report.where(_col("OOS_days") == window_days)
    per_store = full.groupBy("Store").agg(
        F.sum("avg_loss_net_sale").alias("_store_ns"),
        F.sum("avg_loss_margin").alias("_store_margin"))
    out = full.join(per_store, "Store", "left")
    return out.select(
        "SKU", "Store", "category", "OOS_days",
        "avg_loss_sale_quantity", "avg_loss_net_sale", "avg_loss_margin",
        "total_loss_sale_quantity", "total_loss_net_sale", "total_loss_margin",
        (F.try_divide(_col("avg_loss_net_sale"), _col("_store_ns")) * 100).alias("Avg_NS_Percentage"),
        (F.try_divide(_col("avg_loss_margin"), _col("_store_margin")) * 100).alias("Avg_Margin_Percentage"),
    )


def store_summary(report: DataFrame) -> DataFrame:
    """Stores ranked by estimated out-of-stock loss."""
    return (report.groupBy("Store")
                  .agg(F.count(F.lit(1)).alias("oos_items"),
                       F.sum("OOS_days").cast("long").alias("oos_days"),
                       F.sum("total_loss_sale_quantity").alias("total_loss_sale_quantity"),
                       F.sum("total_loss_net_sale").alias("total_loss_net_sale"),
                       F.sum("total_loss_margin").alias("total_loss_margin"))
                  .orderBy(F.desc("total_loss_net_sale"), "Store"))


def product_summary(report: DataFrame, min_stores: int = 2) -> DataFrame:
    """Products out of stock in at least ``min_stores`` stores (report rows
    are unique per (SKU, Store), so a row count is the store count)."""
    return (report.groupBy("SKU")
                  .agg(F.count(F.lit(1)).alias("n_stores"),
                       F.sum("OOS_days").cast("long").alias("oos_days"),
                       F.sum("total_loss_net_sale").alias("total_loss_net_sale"),
                       F.sum("total_loss_margin").alias("total_loss_margin"))
                  .where(_col("n_stores") >= min_stores))


# Days of one range of the calendar in ``daily_state``.
STATE_DAYS = 32


def daily_state(facts: DataFrame, range_days: int = STATE_DAYS) -> DataFrame:
    """Day-level evidence behind the report: for every day of the period and
    every kept pair whether it had stock so far, its last day with stock, and
    how many days in a row up to this one passed without stock and sales (0 on
    a day with either).

    The running state is carried in two steps. The calendar is cut into ranges
    of ``range_days``; per (pair, range) one aggregate keeps the last day with
    stock and the last active day, and a window over these few rows carries
    them from range to range. Inside a range a framed window fills the days
    in. So one pair's calendar, however long, spans many tasks, and only facts
    (not the grid) are aggregated."""
    summary = materialize(pair_summary(facts))
    b = period_bounds(summary)
    d0, d1 = b.select("first_day").scalar(), b.select("last_day").scalar()
    stocked = F.coalesce(_col("StockQty"), F.lit(0.0)) != 0
    active = stocked | (F.coalesce(_col("QtySold"), F.lit(0.0)) != 0)
    days = materialize(
        facts.where(_col("Date").isNotNull()).join(summary.select(*KEYS), KEYS, "left_semi")
             .groupBy(*KEYS, "Date").agg(F.max(stocked).alias("stocked"), F.max(active).alias("active")))
    at = F.floor(F.datediff("Date", "_first") / range_days).cast("int").alias("_range")
    stock_day, active_day = F.when(_col("stocked"), _col("Date")), F.when(_col("active"), _col("Date"))

    ends = (days.withColumn("_first", d0).groupBy(*KEYS, at)
                .agg(F.max(stock_day).alias("_stock"), F.max(active_day).alias("_active")))
    # every range of every pair, so that the state also passes ranges without facts
    ranges = summary.select(*KEYS, F.explode(F.sequence(
        F.lit(0), F.floor(F.datediff(d1, d0) / range_days).cast("int"))).alias("_range"))
    earlier = Window.partitionBy(*KEYS).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = (ranges.join(ends, [*KEYS, "_range"], "left")
               .select(*KEYS, "_range", F.max("_stock").over(earlier).alias("_stock"),
                       F.max("_active").over(earlier).alias("_active")))

    first = F.date_add(d0, _col("_range") * range_days)
    grid = carried.withColumn("_first", d0).withColumn("_last", F.least(F.date_add(first, range_days - 1), d1))
    grid = grid.select("*", F.explode(F.sequence(F.date_add(_col("_first"), _col("_range") * range_days), _col("_last"))).alias("Date"))
    inside = Window.partitionBy(*KEYS, "_range").orderBy("Date").rowsBetween(Window.unboundedPreceding, 0)
    out = grid.join(days, [*KEYS, "Date"], "left").select(
        *KEYS, "Date", "_first",
        F.greatest("_stock", F.max(stock_day).over(inside)).alias("last_stock_day"),
        F.greatest("_active", F.max(active_day).over(inside)).alias("_active"))
    return out.select(
        "SKU", "Store", "Date", _col("last_stock_day").isNotNull().alias("had_stock"), "last_stock_day",
        F.datediff("Date", F.coalesce("_active", F.date_sub("_first", 1))).cast("int").alias("idle_run"))
