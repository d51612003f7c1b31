"""Adapters: the driver's generated tables -> the logical retail tables.

The reference reads warehouse exports that are not shipped with it. These
adapters derive tables with the same layout (raw headers of
``sources.schemas``) from the generated parquet tables, over the whole
tables, so that every operator's work grows with the data. Each adapter is a
plain DataFrame plan (scan -> project -> aggregate/join); column pruning and
filters reach the parquet scan.

Mappings (fixed values of the fixture design):

* daily stock: SKU = ``events.event_type``, Store = ``events.user_id``,
  Date = day of ``ts``; QtySold = events that day, NetSales = sum(value),
  Margin = sum(value * (event_id mod 7) / 10), StockQty = events that day
  whose event_id is not a multiple of 3.
* closed stores: stores whose user id is a multiple of 10 form the
  closed-store list (a list table, joined away by the operator).
* weekly ranked sales: ISO week of ``l_shipdate``; SKU = ten neighbouring
  parts (``partkey div 10``: the table grows with the data); Store = nation
  name of the supplier; Concept_NEW = region name; NetSales = sum of
  ``l_extendedprice`` with line number 7 counted as 0 (gives zero-sales rows);
  ranks computed by ``operators.rank.add_ranks``.
* monthly sales: one row per line item dated by its ship day; item text
  ``NZDF<id>-Part <id>``,
  Store = ``S<l_suppkey>``; Gross = extended price, Net = price after
  discount, COGS = -0.6 * price.
* catalogue ``"part"`` uses ``l_partkey`` as material id; catalogue
  ``"group"`` folds ten neighbouring parts into one material (``partkey div
  10``; their number grows with the data) so that items sell in every month,
  which the full-month and period-comparison operators need; every eleventh
  of them has more facings than a month's quantity (the facings rule).
* distribution report: one row per material; ``promo=False`` leaves
  promotional part types off the planogram (they surface as new items).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.functions.columns import iso_week
from shelfsight.plans.execution import materialize

# fixed values of the fixture design
GROUP_SIZE = 10
WIDE_EVERY, WIDE_AT, WIDE_FACINGS = 11, 3, 500
ZERO_LINE = 7
CLOSED_EVERY = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------- OOS
def stock_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    out = (ev.groupBy(F.col("event_type").alias("SKU"),
                      F.col("user_id").cast("string").alias("Store"),
                      F.to_date("ts").alias("Date"))
             .agg(F.sum("value").alias("POS Net Sales"),
                  F.count(F.lit(1)).cast("double").alias("POS Qty Sold"),
                  F.sum(F.col("value") * (eid % 7) / F.lit(10.0)).alias("POS Margin on Net Sales"),
                  F.count(F.when(eid % 3 != 0, 1)).cast("double").alias("Stock Balance Qty")))
    return out.select("SKU", "Store", F.upper("SKU").alias("Category"), "Date",
                      "POS Net Sales", "POS Qty Sold", "POS Margin on Net Sales",
                      "Stock Balance Qty")


def closed_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return (ev.where(F.col("user_id") % CLOSED_EVERY == 0)
              .select(F.col("user_id").cast("string").alias("Store"))
              .distinct()
              .withColumn("Status", F.lit("Closed")))


# -------------------------------------------------------------------- Rank
def weekly_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(Date, SKU, Store, Concept_NEW, NetSales) of every ISO week."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = (supp.join(nation, supp.s_nationkey == nation.n_nationkey)
               .join(region, nation.n_regionkey == region.r_regionkey)
               .select("s_suppkey", "n_name", "r_name"))
    # rows are grouped by short keys: week begin, item number, number of the place
    names = [geo.n_name, geo.r_name]
    places = materialize(geo.select(*names).distinct().select(
        F.monotonically_increasing_id().alias("place"), F.col("n_name").alias("Store"), F.col("r_name").alias("Concept_NEW")))
    place = F.col("n_name").eqNullSafe(F.col("Store")) & F.col("r_name").eqNullSafe(F.col("Concept_NEW"))
    geo = geo.join(F.broadcast(places), place).select("s_suppkey", "place")
    sales = F.when(F.col("l_linenumber") == ZERO_LINE, F.lit(0.0)).otherwise(F.col("l_extendedprice"))
    weeks = (li.join(geo, li.l_suppkey == geo.s_suppkey)
               .groupBy(F.trunc(F.to_date("l_shipdate"), "week").alias("week"),
                        F.expr(f"l_partkey div {GROUP_SIZE}").alias("item"), "place")
               .agg(F.sum(sales).alias("NetSales")))
    return weeks.join(F.broadcast(places), "place").select(
        iso_week(F.col("week")).alias("Date"), F.concat(F.lit("G"), F.col("item").cast("string")).alias("SKU"),
        "Store", "Concept_NEW", "NetSales")


def rank_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfsight.operators.rank import add_ranks

    # written once: the sampling of the range cut and the rows both read it
    ranked = add_ranks(materialize(weekly_sales(spark, sf_dir)), store_rank=False)
    return ranked.select(
        F.concat_ws("/", "Date", "Store", "SKU").alias("Index"),
        F.col("Date").alias("Date Detail"),
        F.lit("RETAIL").alias("Company"),
        F.col("Concept_NEW").alias("Business Unit"),
        "Concept_NEW",
        F.lit("General").alias("Product Category"),
        F.col("Store").alias("Company and Cost Centre"),
        "SKU",
        F.col("NetSales").alias("POS Net Sales"),
        F.col("rank").cast("double").alias("Rank Total"),
    )


# --------------------------------------------------------------- Inventory
def _material(col: str, catalogue: str):
    c = F.col(col)
    return F.expr(f"{col} div {GROUP_SIZE}") if catalogue == "group" else c


def sales_monthly(spark: SparkSession, sf_dir: str, catalogue: str = "part") -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_quantity", "l_shipdate")
    mid = _material("l_partkey", catalogue).cast("string")
    price = F.col("l_extendedprice")
    return li.select(
        # the sale day: a window filter on it reaches the parquet scan (a
        # month-truncated value would not); the mart groups by month
        F.to_date("l_shipdate").alias("Date"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("Store"),
        F.concat(F.lit("NZDF"), mid, F.lit("-Part "), mid).alias("item"),
        price.alias("POS Gross Sales"),
        (price * (F.lit(1.0) - F.col("l_discount"))).alias("POS Net Sales"),
        (price * F.col("l_discount")).alias("POS Total Discount"),
        F.col("l_quantity").alias("POS Qty Sold"),
        (F.lit(-0.6) * price).alias("POS COGS (INV)"),
    )


def _part_groups(spark: SparkSession, sf_dir: str, catalogue: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    if catalogue == "group":
        return (part.groupBy(F.expr(f"p_partkey div {GROUP_SIZE}").alias("mid"))
                    .agg(F.min("p_type").alias("p_type"), F.min("p_brand").alias("p_brand"))
                    .withColumn("p_name", F.concat(F.lit("Part "), F.col("mid").cast("string"))))
    return part.withColumnRenamed("p_partkey", "mid")


def subcategory_info(spark: SparkSession, sf_dir: str, catalogue: str = "part") -> DataFrame:
    p = _part_groups(spark, sf_dir, catalogue)
    return p.select(
        F.concat(F.lit("NZDF"), F.col("mid").cast("string"), F.lit("-"), F.col("p_name")).alias("SKU"),
        F.concat(F.lit("SC-"), F.col("p_type")).alias("SubCategory"))


def vendor_info(spark: SparkSession, sf_dir: str, catalogue: str = "part") -> DataFrame:
    p = _part_groups(spark, sf_dir, catalogue)
    return p.select(
        F.concat(F.lit("NZDF"), F.col("mid").cast("string"), F.lit("-"), F.col("p_name")).alias("SKU"),
        F.concat(F.lit("V-"), F.col("p_brand")).alias("Vendor"))


def _classification(cap):
    return (F.when(cap > 40, "A+").when(cap > 30, "A").when(cap > 20, "B")
             .when(cap > 10, "C").otherwise("D"))


def dist_report(spark: SparkSession, sf_dir: str, catalogue: str = "part",
                later: bool = False, promo: bool = True) -> DataFrame:
    """Distribution report. ``later=True`` gives the next report, in which
    some materials got a new capacity or an extra facing; ``promo=False`` one
    without the promotional parts."""
    if catalogue == "group":
        p = _part_groups(spark, sf_dir, catalogue)
        mid = F.col("mid")
        wide = F.when(mid % WIDE_EVERY == WIDE_AT, WIDE_FACINGS).otherwise(0)
        facings = (F.lit(1) + mid % 5 + wide).cast("double")
        capacity = (F.lit(1) + mid % 50).cast("double")
        name = F.concat(mid.cast("string"), F.lit(" "), F.col("p_name"))
    else:
        p = _part_groups(spark, sf_dir, catalogue)
        if not promo:
            p = p.where(~F.col("p_type").startswith("PROMO"))
        mid = F.col("mid")
        facings = (F.lit(1) + mid % 5).cast("double")
        capacity = F.col("p_size").cast("double")
        name = F.concat(mid.cast("string"), F.lit(" "), F.col("p_name"))
    if later:
        k = mid % 7
        capacity = F.greatest(F.lit(1.0), capacity + F.when(k == 0, 3.0).when(k == 1, -1.0).otherwise(0.0))
        facings = facings + F.when(k == 2, 1.0).otherwise(0.0)
    return p.select(
        name.alias("Name"),
        facings.alias("Facings"),
        capacity.alias("Capacity"),
        (capacity / F.lit(2.0)).alias("Days Supply"),
        _classification(capacity).alias("Classification"),
        mid.cast("int").alias("Mat ID"),
        (F.lit(1) + mid % 3).cast("int").alias("# POGs"),
    )


# ------------------------------------------------------------- text export
# fixed values of the fixture design: rows of these order keys have a cell that
# cannot be read, a cell with quotes and a line break, or a cell too few or too
# many.
NO_QUANTITY, NO_DATE, NO_GROSS, ODD_NAME, SHORT_ROW, LONG_ROW = 97, 89, 83, 79, 101, 103


def sales_export(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(cells, lines): the line items as cells of the monthly-sales export, all
    text, and as raw lines those whose number of cells is wrong."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_quantity", "l_shipdate")
    price, part = F.col("l_extendedprice"), F.col("l_partkey").cast("string")

    def every(n: int):
        return F.col("l_orderkey") % n == 0
    name = F.when(every(ODD_NAME), F.concat(F.lit('Part "'), part, F.lit('"\nnew pack'))).otherwise(F.concat(F.lit("Part "), part))
    cells = {
        "Date": F.when(every(NO_DATE), "2000-13").otherwise(F.date_format("l_shipdate", "yyyyMM")),
        "Store": F.concat(F.lit("S"), F.col("l_suppkey").cast("string")),
        "item": F.concat(F.lit("NZDF"), part, F.lit("-"), name),
        "POS Gross Sales": F.when(~every(NO_GROSS), F.format_number(price, 2)),
        "POS Net Sales": F.format_number(price * (F.lit(1.0) - F.col("l_discount")), 4),
        "POS Total Discount": F.format_number(price * F.col("l_discount"), 4),
        "POS Qty Sold": F.when(every(NO_QUANTITY), "n/a").otherwise(F.format_number("l_quantity", 0)),
        "POS COGS (INV)": F.format_number(F.lit(-0.6) * price, 3),
    }
    broken = every(SHORT_ROW) | every(LONG_ROW)
    rows = li.select(*(c.alias(n) for n, c in cells.items()), broken.alias("broken"), every(SHORT_ROW).alias("short"))
    names = list(cells)

    def line(*columns):
        return F.to_csv(F.struct(*columns), {"escape": '"'})
    short = line(*(F.col(f"`{n}`") for n in names[:-1]))
    long = line(*(F.col(f"`{n}`") for n in names), F.lit("x").alias("more"))
    return (rows.where(~F.col("broken")).select(*names),
            rows.where("broken").select(F.when(F.col("short"), short).otherwise(long).alias("line")))
