"""Registered queries over tables that they write first: text exports, the
month-partitioned mart, bucket sinks, co-partitioned facts, published runs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from shelfsight.functions.columns import mat_id, name_of
from shelfsight.operators import compare as cmp
from shelfsight.operators import inventory as inv
from shelfsight.operators import oos
from shelfsight.plans import mart, publish
from shelfsight.plans.checked import finalize
from shelfsight.plans.copartition import bucketed
from shelfsight.plans.execution import materialize, table_path
from shelfsight.plans.jobs import inventory_outputs, run_inventory_job, run_oos_job, run_rank_job
from shelfsight.plans.params import InventoryParams, store_for_report
from shelfsight.sources import exports as ex
from shelfsight.sources import readers as rd
from shelfsight.sources import testdata as td
from shelfsight.sources import writers as wr
from shelfsight.sources.schemas import DAY_FORMAT, MONTH_FORMAT, SALES_MONTHLY_RENAME, SALES_MONTHLY_SCHEMA

# --------------------------------------------------------------- text input
# Rows of a file with line breaks inside cells, which one task reads.
EXPORT_ROWS = 100_000
SALES_CELLS = {
    "Date": ex.Cell("date", MONTH_FORMAT, required=True),
    "Store": ex.Cell("text", required=True),
    "item": ex.Cell("text", required=True),
    "POS Gross Sales": ex.Cell("number", required=True),
    "POS Net Sales": ex.Cell("number"),
    "POS Total Discount": ex.Cell("number"),
    "POS Qty Sold": ex.Cell("number"),
    "POS COGS (INV)": ex.Cell("number"),
}


def sales_parsed(spark, sf_dir):
    """The line items written as an export and read back, cell by cell."""
    cells, lines = td.sales_export(spark, sf_dir)
    good, raw = table_path(spark), table_path(spark)
    ex.write_export(cells, good, EXPORT_ROWS)
    lines.write.mode("overwrite").option("maxRecordsPerFile", EXPORT_ROWS).text(raw)
    both = ex.read_export(spark, good, SALES_MONTHLY_SCHEMA).unionByName(
        ex.read_export(spark, raw, SALES_MONTHLY_SCHEMA, header=False))
    return ex.parse(both, SALES_CELLS)


def q_text_sales_rows(spark, sf_dir):
    rows = ex.good_rows(sales_parsed(spark, sf_dir)).withColumnsRenamed(SALES_MONTHLY_RENAME)
    return finalize(rows.select("Date", "Store", mat_id(F.col("item")).alias("MatID"), name_of(F.col("item")).alias("SKU"),
                                "GrossSales", "NetSales", "TotalDiscount", "QtySold", "COGS"))


def q_text_rejects(spark, sf_dir):
    return ex.rejects(sales_parsed(spark, sf_dir)).select("column", "reason", "n_cells")



# ------------------------------------------------------- partitioned mart
PERIOD = {"begin": "2000-04-01", "end": "2000-10-01", "split": "2000-07-01"}


def written_mart(spark, sf_dir, period=PERIOD):
    """The monthly mart of the window, one folder a month."""
    sub = inv.clean_lookup(td.subcategory_info(spark, sf_dir), "SubCategory")
    ven = inv.clean_lookup(td.vendor_info(spark, sf_dir), "Vendor")
    sales = inv.clean_sales(td.sales_monthly(spark, sf_dir), sub, ven, begin=period["begin"], end=period["end"])
    path = table_path(spark)
    mart.write_mart(inv.monthly_mart(sales), path)
    return path


def q_mart_removed(spark, sf_dir):
    """Removed items from the partitioned mart: either side opens its own
    months only."""
    early, late = mart.early_late(spark, written_mart(spark, sf_dir), PERIOD["split"])
    report = inv.clean_report(td.dist_report(spark, sf_dir))
    return finalize(inv.removed_items(early, late, report, PERIOD["split"]))


def q_mart_season(spark, sf_dir):
    """Sales of the months that a season table names, picked at run time."""
    seasons = spark.range(12).select((F.col("id") + 1).cast("int").alias("month"),
                                     F.when(F.col("id").between(5, 7), "summer").otherwise("rest").alias("season"))
    return finalize(mart.of_season(mart.read_mart(spark, written_mart(spark, sf_dir)), seasons, "summer").groupBy(
        "year", "month", "SubCategory").agg(F.count(F.lit(1)).alias("n_items"), F.sum("totalMonthlyNetSale").alias("net_sales")))


# ------------------------------------------------------------ bucket sinks
def q_sink_buckets(spark, sf_dir):
    """The depth buckets of the at-least-one-month items as folders; then one
    bucket is written again without its single-facing items, and all are read."""
    _, late = mart.early_late(spark, written_mart(spark, sf_dir), PERIOD["split"])
    report = inv.clean_report(td.dist_report(spark, sf_dir))
    enriched = materialize(inv.enrich(inv.analysis_base(late, report)))
    items = materialize(inv.depth_buckets(inv.at_least_one_month(enriched)["unadjusted"]))
    path = table_path(spark)
    wr.write_partitions(items, path, ["bucket"])
    wr.write_partitions(items.where("bucket = 'lessThan3' AND Facings > 1"), path, ["bucket"])
    return finalize(rd.read_table(spark, path, schema=items.schema))


# ---------------------------------------------------- co-partitioned facts
def bucketed_facts(spark, sf_dir):
    facts = oos.clean_stock(td.stock_daily(spark, sf_dir), td.closed_stores(spark, sf_dir))
    return bucketed(facts, oos.KEYS)


def q_oos_copartitioned(spark, sf_dir):
    """The out-of-stock report on facts kept by (SKU, Store): one shuffle when
    they are written, none for the aggregates and joins on the pair."""
    return finalize(oos.detect_oos(bucketed_facts(spark, sf_dir), keep=lambda df: bucketed(df, oos.KEYS)))


# ---------------------------------------------------------- published run
def q_inv_published(spark, sf_dir):
    """The whole inventory job, published as one run and read back."""
    whole = mart.read_mart(spark, written_mart(spark, sf_dir))
    early, late = inv.split_periods(whole, PERIOD["split"])
    report = inv.clean_report(td.dist_report(spark, sf_dir))
    outputs = inventory_outputs({"mart": whole, "early": early, "late": late, "report": report}, PERIOD["split"])
    out_dir = table_path(spark)
    publish.publish(spark, out_dir, outputs, partition_by={"at_least_one_month/unadjusted": ["bucket"]})
    return publish.contents(spark, out_dir)


# -------------------------------------------------- jobs over text exports
def exported(df) -> str:
    """``df`` as a text export; its path."""
    path = table_path(df.sparkSession)
    ex.write_export(df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns)), path, EXPORT_ROWS)
    return path


def q_job_oos(spark, sf_dir):
    """The out-of-stock job from its exports to its CSV output, read back."""
    stock = td.stock_daily(spark, sf_dir).withColumn("Date", F.date_format("Date", DAY_FORMAT))
    out = table_path(spark)
    report = run_oos_job(spark, exported(stock), exported(td.closed_stores(spark, sf_dir)), out)["oos_items"]
    schema = StructType([StructField(f.name, StringType() if f.name == "date_list" else f.dataType) for f in report.schema])
    return finalize(rd.read_table(spark, f"{out}/oos_items", "csv", schema))


def q_job_rank(spark, sf_dir):
    """The rank job from its export to its CSV output, read back."""
    out = table_path(spark)
    report = run_rank_job(spark, exported(td.rank_weekly(spark, sf_dir)), out)
    schema = StructType([StructField(f.name, StringType() if f.dataType == BooleanType() else f.dataType) for f in report.schema])
    flags = [f.name for f in report.schema if f.dataType == BooleanType()]
    return finalize(rd.read_table(spark, out, "csv", schema).fillna("", flags))


def q_job_inventory(spark, sf_dir):
    """The inventory job of one store over its four exports: even suppliers
    are the store of the departures report, odd ones that of the arrivals."""
    store = F.when(F.substring("Store", 2, 20).cast("long") % 2 == 0, "NZDF.AKL108").otherwise("NZDF.AKL109")
    sales = td.sales_monthly(spark, sf_dir).withColumn("Store", store).withColumn("Date", F.date_format("Date", MONTH_FORMAT))
    params = InventoryParams(store_for_report("dist-Departures.csv"), **PERIOD)
    out = table_path(spark)
    frames = run_inventory_job(spark, exported(sales), exported(td.dist_report(spark, sf_dir)),
                               exported(td.subcategory_info(spark, sf_dir)), exported(td.vendor_info(spark, sf_dir)), params, out,
                               fmt="parquet")
    name = "at_least_one_month/all"
    return finalize(rd.read_table(spark, f"{out}/{name}", schema=frames[name].schema))


def q_text_report_diff(spark, sf_dir):
    """Two distribution reports read from text, the compared columns only."""
    columns = ["Mat ID", "Name", "Facings", "Capacity", "Days Supply", "Classification", "# POGs"]
    one, two = (inv.clean_report(rd.read_dist_report(spark, exported(td.dist_report(spark, sf_dir, "group", later=later)), columns))
                for later in (False, True))
    return finalize(cmp.report_diff(one, two))


def q_text_short_names(spark, sf_dir):
    """Item names without their ids, and the facts' small stock snapped to 0."""
    raw = td.stock_daily(spark, sf_dir).withColumn("SKU", F.concat(F.lit("NZDF1-"), "SKU")).withColumn(
        "Stock Balance Qty", F.col("Stock Balance Qty") - 0.5)
    facts = oos.clean_stock(raw, td.closed_stores(spark, sf_dir), snap_small_stock=True)
    return finalize(facts.groupBy(name_of(F.col("SKU")).alias("name")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("StockQty") == 0, 1)).alias("n_zero"),
        F.sum("StockQty").alias("stock")))


QUERIES = {
    "text_sales_rows": q_text_sales_rows,
    "text_rejects": q_text_rejects,
    "mart_removed": q_mart_removed,
    "mart_season": q_mart_season,
    "sink_buckets": q_sink_buckets,
    "oos_copartitioned": q_oos_copartitioned,
    "inv_published": q_inv_published,
    "job_oos": q_job_oos,
    "job_rank": q_job_rank,
    "job_inventory": q_job_inventory,
    "text_report_diff": q_text_report_diff,
    "text_short_names": q_text_short_names,
}
