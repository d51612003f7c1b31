"""End-to-end jobs: read the exports, run the operators, write every output.

Each job returns its outputs as DataFrames as well (for tests and for
callers that chain further work). Intermediates read by several outputs are
written once to the checkpoint directory (``materialize``), so each source
is scanned once and a lost executor does not restart the job from the raw
files. Once the outputs are written, the job deletes those intermediates
(``cleanup``); the returned frames read them, so they stay usable only with
``cleanup=False`` or without an output directory.
Writers run on all tasks; nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfsight.operators import inventory as inv
from shelfsight.operators import oos, rank
from shelfsight.plans.execution import materialize, owned_tables
from shelfsight.plans.params import InventoryParams
from shelfsight.sources import readers as rd
from shelfsight.sources import writers as wr


def _write(df: DataFrame, path: str | None, fmt: str, partition_by=None) -> None:
    if path is None:
        return
    if fmt == "csv":
        wr.write_csv(df, path, partition_by=partition_by)
    else:
        wr.write_parquet(df, path, partition_by=partition_by)


def run_oos_job(spark: SparkSession, stock_path: str, closed_path: str | None,
                out_dir: str | None = None, fmt: str = "csv",
                window_days: int = oos.WINDOW_DAYS, cleanup: bool = True) -> dict[str, DataFrame]:
    with owned_tables(spark, keep=not (out_dir and cleanup)):
        raw = rd.read_stock_daily(spark, stock_path)
        closed = rd.read_closed_stores(spark, closed_path) if closed_path else None
        facts = materialize(oos.clean_stock(raw, closed))
        report = materialize(oos.detect_oos(facts, window_days))
        out = {
            "oos_items": report,
            "oos_7_days": oos.oos_7_days(report, window_days),
            "store_summary": oos.store_summary(report),
            "product_summary": oos.product_summary(report),
        }
        for name, df in out.items():
            _write(df, f"{out_dir}/{name}" if out_dir else None, fmt)
        return out


def run_rank_job(spark: SparkSession, rank_path: str, out_path: str | None = None,
                 fmt: str = "csv", cleanup: bool = True) -> DataFrame:
    with owned_tables(spark, keep=not (out_path and cleanup)):
        table = materialize(rank.clean_rank(rd.read_rank_weekly(spark, rank_path)))
        report = rank.rank_report(table)
        _write(report, out_path, fmt)
        return report


def load_inventory(spark: SparkSession, sales_path: str, report_path: str,
                   subcategory_path: str, vendor_path: str,
                   params: InventoryParams, all_stores: bool = False) -> dict[str, DataFrame]:
    """Read and clean the four exports; return the monthly mart (written
    once), its early and late parts, and the cleaned report. With
    ``all_stores`` the store filter is dropped and the mart is keyed by
    store."""
    by = ("Store",) if all_stores else ()
    report = inv.clean_report(rd.read_dist_report(spark, report_path))
    sub = inv.clean_lookup(rd.read_subcategory(spark, subcategory_path), "SubCategory")
    ven = inv.clean_lookup(rd.read_vendor(spark, vendor_path), "Vendor")
    sales = inv.clean_sales(rd.read_sales_monthly(spark, sales_path), sub, ven,
                            store=None if all_stores else params.store,
                            begin=params.begin, end=params.end)
    mart = materialize(inv.monthly_mart(sales, by))
    early, late = inv.split_periods(mart, params.split)
    return {"mart": mart, "early": early, "late": late, "report": report}


def run_inventory_job(spark: SparkSession, sales_path: str, report_path: str,
                      subcategory_path: str, vendor_path: str, params: InventoryParams,
                      out_dir: str | None = None, fmt: str = "csv",
                      cleanup: bool = True, all_stores: bool = False) -> dict[str, DataFrame]:
    """Issue lists, analysis table, at-least-one-month and full-month
    over-spaced items for one store and window, or with ``all_stores`` for
    every store in one job (outputs keyed by store; a report without a store
    column is checked against every store of the mart)."""
    with owned_tables(spark, keep=not (out_dir and cleanup)):
        by = ("Store",) if all_stores else ()
        data = load_inventory(spark, sales_path, report_path, subcategory_path, vendor_path, params,
                              all_stores)
        out = inventory_outputs(data, params.split, by)
        for name, df in out.items():
            part = ["bucket"] if name.endswith("unadjusted") else None
            _write(df, f"{out_dir}/{name}" if out_dir else None, fmt, part)
        return out


def inventory_outputs(data: dict[str, DataFrame], split: str, by: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Every output of the inventory analysis from the mart, its early and late
    months and the report, by output name."""
    mart, early, late, report = data["mart"], data["early"], data["late"], data["report"]
    base = inv.analysis_base(late, report, by)
    enriched = materialize(inv.enrich(base, by))
    res = inv.at_least_one_month(enriched, by)
    return {
        "issued/checked": inv.check_items(mart, report, by, every_store=bool(by)),
        "issued/removed": inv.removed_items(early, late, report, split, by),
        "issued/new": inv.new_items(late, report, by),
        "issued/incorrect_record": inv.bad_records(base, by=by),
        "issued/depth_lt2": inv.shallow_items(base, by=by),
        "analysis_table": enriched,
        "at_least_one_month/all": res["items"],
        "at_least_one_month/adjusted": res["adjusted"],
        "at_least_one_month/unadjusted": inv.depth_buckets(res["unadjusted"]),
        "full_month": inv.full_month(res["rows"], split, by=by),
    }
