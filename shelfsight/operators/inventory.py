"""Shelf-space analysis: monthly sales against the distribution (planogram)
report's facings and capacity.

Pipeline: clean report (``clean_report``) and sales (``clean_sales``, with
SubCategory/Vendor lookups) -> monthly mart (``monthly_mart``, one grouped
aggregate) -> early/late split at a month -> issue lists (check / removed /
new items, suspicious capacity records, depth below 2) -> report joined with
the late months (``analysis_base``) -> statistics per (month, SubCategory)
and depth proposals (``enrich``) -> over-spaced items in at least one month
(``at_least_one_month``) and in every month (``full_month``), demand bands
(``demand_bands``).

Months are keyed by (year, month) plus ``period`` = first day of the month,
so a window may cross a year end. All ratios use ``try_divide`` (NULL on a
zero divisor). Every statistic is one grouped aggregate joined back once;
lookups are de-duplicated to one row per material before they are joined,
so no join fans out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.functions.columns import as_double, as_int, day_of, mat_id, name_of, ratio
from shelfsight.plans.execution import materialize, rows_before
from shelfsight.sources.schemas import DIST_REPORT_RENAME, MONTH_FORMAT, SALES_MONTHLY_RENAME

MART_MEASURES = {
    "totalMonthlyNetSale": "NetSales",
    "totalMonthlyGrossSale": "GrossSales",
    "avgCOGS": "COGS",
    "totalMonthlyQtySold": "QtySold",
    "Price": "Price",
    "SellMargin": "SellMargin",
    "avgFrontMargin": "FrontMargin",
}

# fixed values: output column lists of the issue files
ISSUE_COLUMNS = ["SKU", "MatID", "year", "month", "Price", "POGS", "Facings", "Capacity",
                 "Classification", "SubCategory", "totalMonthlyNetSale", "totalMonthlyQtySold",
                 "SellMargin"]
RECORD_COLUMNS = ["MatID", "SKU", "Facings", "Capacity", "POGS", "Depth", "DaysSupply",
                  "Classification", "year", "month", "SubCategory", "Vendor",
                  "totalMonthlyNetSale", "totalMonthlyGrossSale", "avgCOGS",
                  "totalMonthlyQtySold", "Price", "SellMargin", "avgFrontMargin"]
FULL_MONTH_COLUMNS = ["MatID", "SKU", "year", "month", "Vendor", "SubCategory", "Classification",
                      "POGS", "Facings", "Depth", "Capacity", "ProposedDepth", "VarianceDepth",
                      "Capacity_to_qty", "totalMonthlyNetSale", "totalMonthlyGrossSale",
                      "totalMonthlyQtySold", "Price", "SellMargin",
                      "Qty_GeoMean_by_month_Subcat", "NS_GeoMean_by_month_Subcat",
                      "Qty_mean_by_month_Subcat", "NS_mean_by_month_Subcat",
                      "Qty_std_by_month_Subcat", "NS_std_by_month_Subcat"]
AT_LEAST_ONE_COLUMNS = ["MatID", "SKU", "Vendor", "SubCategory", "Classification", "POGS",
                        "Facings", "Depth", "ProposedDepth", "VarianceDepth", "Capacity",
                        "Capacity_to_avg_qty", "Facing_to_avg_qty", "AvgQtySold",
                        "Qty_std_by_SKU", "StdQty_to_AvgQty"]
BAND_COLUMNS = ["MatID", "SKU", "year", "month", "Vendor", "SubCategory", "Classification",
                "Facings", "Depth", "Capacity", "Capacity_to_qty", "totalMonthlyNetSale",
                "totalMonthlyGrossSale", "totalMonthlyQtySold", "Price", "SellMargin",
                "Qty_GeoMean_by_month_Subcat", "NS_GeoMean_by_month_Subcat",
                "Qty_mean_by_month_Subcat", "NS_mean_by_month_Subcat",
                "Qty_std_by_month_Subcat", "NS_std_by_month_Subcat", "Capacity_to_sales"]

QTY = "totalMonthlyQtySold"


def _c(n: str) -> Column:
    return F.col(n)


# ------------------------------------------------------------- cleaning
def clean_report(raw: DataFrame) -> DataFrame:
    """Distribution report: short names, DOUBLE facings/capacity/days,
    INT material id and planogram count."""
    ren = {k: v for k, v in DIST_REPORT_RENAME.items() if k in raw.columns}
    df = raw.withColumnsRenamed(ren) if ren else raw
    return df.select(
        as_int(df, "MatID").alias("MatID"),
        _c("SKU"),
        as_double(df, "Facings").alias("Facings"),
        as_double(df, "Capacity").alias("Capacity"),
        as_double(df, "DaysSupply").alias("DaysSupply"),
        _c("Classification"),
        as_int(df, "POGS").alias("POGS"),
    )


def clean_lookup(raw: DataFrame, value: str) -> DataFrame:
    """``id-name`` lookup (SubCategory or Vendor) -> one row per MatID.

    The material id comes from the item text, the value keeps its name
    part. Materials listed more than once keep the smallest name, so the
    later join cannot multiply sales rows."""
    return (raw.select(mat_id(_c("SKU")).alias("MatID"), name_of(_c(value)).alias(value))
               .where(_c("MatID").isNotNull())
               .groupBy("MatID").agg(F.min(value).alias(value)))


def clean_sales(raw: DataFrame, subcategory: DataFrame | None, vendor: DataFrame | None,
                store: str | None = None, begin: str | None = None,
                end: str | None = None) -> DataFrame:
    """Monthly sales rows of one store (``None``: all stores) in the
    half-open window [begin, end), with material id, item name, DOUBLE
    measures (thousands separators removed), price and margins, and the
    SubCategory/Vendor of the material.

    ``subcategory``/``vendor`` are cleaned lookups (``clean_lookup``)."""
    ren = {k: v for k, v in SALES_MONTHLY_RENAME.items() if k in raw.columns}
    df = raw.withColumnsRenamed(ren) if ren else raw
    if store is not None:
        df = df.where(_c("Store") == F.lit(store))
    day = day_of(df, "Date", MONTH_FORMAT)
    df = df.select(
        day.alias("Date"), "Store",
        mat_id(_c("item")).alias("MatID"),
        name_of(_c("item")).alias("SKU"),
        *[as_double(df, m).alias(m) for m in
          ("GrossSales", "NetSales", "TotalDiscount", "QtySold", "COGS")])
    if begin is not None:
        df = df.where(_c("Date") >= F.to_date(F.lit(begin)))
    if end is not None:
        df = df.where(_c("Date") < F.to_date(F.lit(end)))
    df = df.select(
        "*",
        ratio(_c("GrossSales"), _c("QtySold")).alias("Price"),
        (_c("GrossSales") + _c("COGS")).alias("FrontMargin"),
        (_c("NetSales") + _c("COGS")).alias("SellMargin"))
    if subcategory is not None:
        df = df.join(subcategory, "MatID", "left")
    if vendor is not None:
        df = df.join(vendor, "MatID", "left")
    return df


def monthly_mart(sales: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per (year, month, MatID, SubCategory, Vendor): the average of each
    measure over the month's sales rows. Rows with a NULL key are left out
    (an equi-join on them would never match).

    ``by`` adds grouping keys, e.g. ``("Store",)`` to analyse every store in
    one job instead of one job per store; the later steps take the same
    ``by``."""
    keys = [*by, "MatID", "SubCategory", "Vendor"]
    df = sales.where(_c("Date").isNotNull())
    for k in keys:
        df = df.where(_c(k).isNotNull())
    return (df.groupBy(F.year("Date").alias("year"), F.month("Date").alias("month"),
                       F.trunc("Date", "month").alias("period"), *keys)
              .agg(*[F.avg(src).alias(dst) for dst, src in MART_MEASURES.items()]))


def split_periods(mart: DataFrame, split: str) -> tuple[DataFrame, DataFrame]:
    """(early, late): months before ``split`` (``yyyy-MM-dd``, first of a
    month) and from it on."""
    s = F.to_date(F.lit(split))
    return mart.where(_c("period") < s), mart.where(_c("period") >= s)


# ------------------------------------------------------------ issue lists
def check_items(mart: DataFrame, report: DataFrame, by: tuple[str, ...] = (),
                every_store: bool = False) -> DataFrame:
    """Report rows with no gross sales: no mart row at all, or a month whose
    average gross sales are 0.

    With ``by`` (the mart's own keys beside the material) an item is looked
    for within its key. The report must carry these keys; with ``every_store``
    a report without them stands for each key of the mart (the list of keys is
    the store list: one row per store), which gives one report per store."""
    missing = [k for k in by if k not in report.columns]
    if missing:
        if not every_store:
            raise ValueError(f"the report has no {', '.join(missing)}: which stores does it apply to?")
        keys = mart.select(F.array_sort(F.collect_set(F.struct(*missing)))).scalar()
        report = report.withColumn("_key", F.explode(keys)).select("*", "_key.*").drop("_key")
    j = report.join(mart, [*by, "MatID"], "left")
    return (j.where(F.coalesce(_c("totalMonthlyGrossSale"), F.lit(0.0)) == 0)
             .select(*by, *ISSUE_COLUMNS))


def _report_keys(report: DataFrame, by: tuple[str, ...]) -> list[str]:
    """Join keys with the report: the material, plus those ``by`` keys the
    report carries (a report without a store column applies to every store)."""
    return [k for k in by if k in report.columns] + ["MatID"]


def item_activity(mart: DataFrame, split: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per material: sold (non-zero gross) before / from the split."""
    s = F.to_date(F.lit(split))
    sold = _c("totalMonthlyGrossSale") != 0
    return (mart.groupBy(*by, "MatID")
                .agg(F.max(sold & (_c("period") < s)).alias("sold_early"),
                     F.max(sold & (_c("period") >= s)).alias("sold_late")))


def removed_items(early: DataFrame, late: DataFrame, report: DataFrame, split: str,
                  by: tuple[str, ...] = ()) -> DataFrame:
    """Report items sold in the early months and not sold in the late ones;
    their early monthly rows."""
    act = item_activity(early.unionByName(late), split, by)
    gone = (act.where(_c("sold_early") & ~F.coalesce(_c("sold_late"), F.lit(False)))
               .select(*by, "MatID"))
    return (report.join(early, _report_keys(report, by), "inner")
                  .join(gone, [*by, "MatID"], "left_semi")
                  .select(*by, *ISSUE_COLUMNS))


def new_items(late: DataFrame, report: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Late monthly rows with gross sales of materials not on the report."""
    sold = late.where(F.coalesce(_c("totalMonthlyGrossSale"), F.lit(0.0)) != 0)
    keys = _report_keys(report, by)
    out = sold.join(report.select(*keys).where(_c("MatID").isNotNull()), keys, "left_anti")
    return out.select(*by, "MatID", "year", "month", "SubCategory", "Vendor", "Price",
                      "totalMonthlyNetSale", "totalMonthlyGrossSale", "totalMonthlyQtySold",
                      "SellMargin")


def analysis_base(late: DataFrame, report: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Report joined with the late monthly rows (materials in both)."""
    return report.join(late, _report_keys(report, by), "inner")


def with_depth(df: DataFrame) -> DataFrame:
    """Depth = Capacity / Facings; ProposedDepth = 3 where Depth >= 4 (NULL
    otherwise); VarianceDepth = ProposedDepth - Depth."""
    depth = ratio(_c("Capacity"), _c("Facings"))
    deep = depth >= 4
    return (df.withColumn("Depth", depth)
              .withColumn("ProposedDepth", F.when(deep, F.lit(3.0)))
              .withColumn("VarianceDepth", F.when(deep, F.lit(3.0) - depth)))


def bad_records(base: DataFrame, threshold: float = 6.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Suspicious capacity records: Capacity / Facings above ``threshold``."""
    d = with_depth(base)
    return d.where(_c("Depth") > threshold).select(*by, *RECORD_COLUMNS)


def shallow_items(base: DataFrame, threshold: float = 2.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Depth below ``threshold`` (capacity under twice the facings)."""
    d = with_depth(base)
    return d.where(_c("Depth") < threshold).select(*by, *RECORD_COLUMNS)


def issue_counts(lists: dict[str, DataFrame]) -> DataFrame:
    """Rows and distinct materials per issue list, one row per list."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows"),
                    F.count_distinct("MatID").alias("n_items"))
               .select(F.lit(name).alias("issue"), "n_rows", "n_items")
             for name, df in lists.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------ statistics
def enrich(base: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Add per (month, SubCategory) geometric means, means and sample
    standard deviations of quantity and net sales; capacity ratios; depths.

    The geometric mean is exp(avg(ln x)) over x > 0 (other values drop out).
    All six statistics come from one aggregate, joined back once."""
    qty, ns = _c(QTY), _c("totalMonthlyNetSale")
    keys = [*by, "year", "month", "SubCategory"]
    stats = base.groupBy(*keys).agg(
        F.exp(F.avg(F.when(qty > 0, F.ln(qty)))).alias("Qty_GeoMean_by_month_Subcat"),
        F.exp(F.avg(F.when(ns > 0, F.ln(ns)))).alias("NS_GeoMean_by_month_Subcat"),
        F.avg(qty).alias("Qty_mean_by_month_Subcat"),
        F.avg(ns).alias("NS_mean_by_month_Subcat"),
        F.stddev_samp(qty).alias("Qty_std_by_month_Subcat"),
        F.stddev_samp(ns).alias("NS_std_by_month_Subcat"))
    out = base.join(stats, keys, "left")
    out = (out.withColumn("Capacity_to_qty", ratio(_c("Capacity"), qty))
              .withColumn("Capacity_to_sales", ratio(_c("Capacity"), ns)))
    return with_depth(out)


def at_least_one_month(enriched: DataFrame, by: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Materials whose monthly quantity is below capacity in at least one
    month, with their mean and sample std of monthly quantity over months
    with sales, and the capacity/facings-to-demand ratios.

    Returns ``rows`` (the flagged monthly rows), ``items`` (16 columns,
    distinct), ``unadjusted`` (Depth < 4) and ``adjusted`` (ProposedDepth 3).
    """
    qty = _c(QTY)
    rows = enriched.where(qty < _c("Capacity"))
    item = [*by, "MatID", "SubCategory", "Vendor"]
    per_item = (enriched.where(_c("totalMonthlyNetSale") != 0)
                        .groupBy(*item)
                        .agg(F.avg(qty).alias("AvgQtySold"),
                             F.stddev_samp(qty).alias("Qty_std_by_SKU")))
    j = rows.join(per_item, item, "left")
    j = (j.withColumn("Capacity_to_avg_qty", ratio(_c("Capacity"), _c("AvgQtySold")))
          .withColumn("Facing_to_avg_qty", ratio(_c("Facings"), _c("AvgQtySold")))
          .withColumn("StdQty_to_AvgQty", ratio(_c("Qty_std_by_SKU"), _c("AvgQtySold"))))
    items = j.select(*by, *AT_LEAST_ONE_COLUMNS).dropDuplicates()
    return {
        "rows": rows,
        "items": items,
        "unadjusted": items.where(_c("Depth") < 4),
        "adjusted": items.where(_c("ProposedDepth") == 3),
    }


def depth_buckets(unadjusted: DataFrame) -> DataFrame:
    """Bucket label on Capacity_to_avg_qty: <3, [3, 9), >=9 (NULL ratios
    belong to no bucket and are left out)."""
    r = _c("Capacity_to_avg_qty")
    b = (F.when(r < 3, "lessThan3").when(r < 9, "between3And9").when(r >= 9, "moreThan9"))
    return unadjusted.withColumn("bucket", b).where(_c("bucket").isNotNull())


def months_from(split: str, n: int = 3) -> list[Column]:
    s = F.to_date(F.lit(split))
    return [F.add_months(s, i) for i in range(n)]


def full_month_ids(rows: DataFrame, split: str, n: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """Materials present in each of the ``n`` months from ``split``."""
    months = months_from(split, n)
    return (rows.where(_c("period").isin(*months))
                .groupBy(*by, "MatID")
                .agg(F.count_distinct("period").alias("_n"))
                .where(_c("_n") == n)
                .select(*by, "MatID"))


def full_month(rows: DataFrame, split: str, columns=None, n: int = 3,
               by: tuple[str, ...] = ()) -> DataFrame:
    """Flagged monthly rows of materials flagged in every one of the ``n``
    months from ``split`` (distinct)."""
    ids = full_month_ids(rows, split, n, by)
    cols = [*by, *(columns or FULL_MONTH_COLUMNS)]
    return rows.join(ids, [*by, "MatID"], "left_semi").select(*cols).dropDuplicates()


def over_spaced(df: DataFrame, column: str = "Capacity", times: float = 1.0) -> DataFrame:
    """Monthly rows whose quantity times ``times`` is below ``column``."""
    return df.where(_c(QTY) * F.lit(float(times)) < _c(column))


def demand_bands(enriched: DataFrame, column: str = "Capacity",
                 by: tuple[str, ...] = ()) -> DataFrame:
    """Band of ``column`` against monthly quantity q:
    0: q >= column; 1: q < column <= 2q; 2: 2q < column <= 3q;
    3: 3q < column <= 4q; 4: column > 4q. Rows where either is NULL get no
    band and are left out; duplicates are removed."""
    q, c = _c(QTY), _c(column)
    band = (F.when(q >= c, 0)
             .when((q < c) & (q * 2 >= c), 1)
             .when((q * 2 < c) & (q * 3 >= c), 2)
             .when((q * 3 < c) & (q * 4 >= c), 3)
             .when(q * 4 < c, 4))
    return (enriched.withColumn("band", band.cast("int"))
                    .where(_c("band").isNotNull())
                    .select(*by, *BAND_COLUMNS, "band")
                    .dropDuplicates())


def check_items_by_store(mart: DataFrame, report: DataFrame, store: str = "Store") -> DataFrame:
    """Per report item, the stores of the mart that did not sell it: ``n_absent``
    stores without a mart row, ``n_unsold`` stores with a month of zero gross
    sales, and the absent ones as ranges of their place in the sorted store
    list (``absent``: "0-3,7" names the places 0 to 3 and 7; see
    ``store_places``).

    It is a complement of sets and not a product: the present places of an
    item are gathered as one bitmap per 32,768 stores, and the gaps between
    them are the absent ones. Work and result grow with the sales pairs, not
    with stores times items."""
    places = materialize(store_places(mart, store))
    n_stores = places.agg(F.count(F.lit(1))).scalar()
    zero = F.coalesce(_c("totalMonthlyGrossSale"), F.lit(0.0)) == 0
    pairs = (mart.join(report.select("MatID").distinct(), "MatID", "left_semi")
                 .groupBy("MatID", store).agg(F.max(zero).alias("unsold")).join(places, store))
    pieces = pairs.groupBy("MatID", F.bitmap_bucket_number("place").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("_bits"),
        F.count(F.when(_c("unsold"), 1)).alias("n_unsold"), F.array_sort(F.collect_list("place")).alias("_places"))
    items = pieces.groupBy("MatID").agg(
        F.sum(F.bitmap_count("_bits")).alias("_present"), F.sum("n_unsold").alias("n_unsold"),
        F.array_sort(F.collect_list(F.struct("_bucket", "_places"))).alias("_pieces"))
    present = F.flatten(F.transform(F.coalesce("_pieces", F.array()), lambda p: p["_places"]))
    none = F.lit(0).cast("long")
    out = report.join(items, "MatID", "left").withColumn("_n", n_stores).withColumn(
        "_edges", F.concat(F.array(F.lit(-1).cast("long")), present, F.array(_c("_n"))))
    gaps = F.filter(F.arrays_zip(F.slice("_edges", F.lit(1), F.size("_edges") - 1).alias("a"),
                                 F.slice("_edges", F.lit(2), F.size("_edges") - 1).alias("b")),
                    lambda g: g["b"] - g["a"] > 1)

    def text(g: Column) -> Column:
        lo, hi = g["a"] + 1, g["b"] - 1
        return F.when(lo == hi, lo.cast("string")).otherwise(F.concat(lo.cast("string"), F.lit("-"), hi.cast("string")))
    return out.select(
        "MatID", "SKU", "Classification", (_c("_n") - F.coalesce("_present", none)).alias("n_absent"),
        F.coalesce("n_unsold", none).alias("n_unsold"), F.array_join(F.transform(gaps, text), ",").alias("absent")
    ).where((_c("n_absent") > 0) | (_c("n_unsold") > 0))


def store_places(mart: DataFrame, store: str = "Store") -> DataFrame:
    """(store, place): the place of every store in their sorted list, from 0."""
    stores = mart.where(_c(store).isNotNull()).groupBy(store).agg(F.count(F.lit(1)).alias("_n"))
    return rows_before(stores.select(store, F.lit(1).alias("_one")), [], _c(store).asc(), "_one", "place").select(
        store, _c("place").cast("long").alias("place"))
