"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver's generated tables through the adapters in
``sources.testdata`` (whole tables), runs the library operators, and ends in
``finalize`` (rounding/rendering only) so that it can be compared with the
SQL in ``plans.oracle``.

The derived tables that an operator reads more than once (the daily facts,
the weekly ranked table, the monthly mart, the analysis table) are written
once to the checkpoint directory (``materialize``): later branches read the
written table instead of re-deriving it, and the lineage is cut, so a lost
executor does not send the job back to the raw scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.operators import inventory as inv
from shelfsight.operators import compare as cmp
from shelfsight.operators import oos, profile, rank
from shelfsight.plans import sql_surface, storage_queries
from shelfsight.plans.checked import finalize
from shelfsight.plans.execution import materialize
from shelfsight.sources import testdata as td

Query = Callable[[SparkSession, str], DataFrame]


# ------------------------------------------------------------------ OOS
def oos_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(oos.clean_stock(td.stock_daily(spark, sf_dir), td.closed_stores(spark, sf_dir)))


def oos_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oos.detect_oos(oos_facts(spark, sf_dir))


def q_oos_clean_grid(spark, sf_dir):
    return finalize(oos.clean_grid(oos_facts(spark, sf_dir)))


def q_oos_items(spark, sf_dir):
    return finalize(oos_report(spark, sf_dir))


def q_oos_7_days(spark, sf_dir):
    return finalize(oos.oos_7_days(oos_report(spark, sf_dir)))


def q_oos_store_summary(spark, sf_dir):
    return finalize(oos.store_summary(oos_report(spark, sf_dir)))


def q_oos_product_summary(spark, sf_dir):
    return finalize(oos.product_summary(oos_report(spark, sf_dir)))


def q_oos_daily_state(spark, sf_dir):
    return finalize(oos.daily_state(oos_facts(spark, sf_dir)))


# ----------------------------------------------------------------- Rank
def rank_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(rank.clean_rank(td.rank_weekly(spark, sf_dir)))


def q_rank_overall(spark, sf_dir):
    return finalize(rank_table(spark, sf_dir))


def q_rank_store(spark, sf_dir):
    df = rank_table(spark, sf_dir)
    return finalize(rank.add_ranks(df.drop("rank"), store_rank=True))


def q_rank_concept_avg(spark, sf_dir):
    df = rank_table(spark, sf_dir)
    _, w2 = rank.last_two_weeks(df)
    return finalize(rank.concept_average(df, w2))


def q_rank_top50(spark, sf_dir):
    """The weekly sales are ranked in the two weeks only, and there only as far
    as the lists go."""
    return finalize(rank.top_lists(materialize(td.weekly_sales(spark, sf_dir))))


def q_rank_top_weeks(spark, sf_dir):
    """The 50 best pairs of every week, and all that tie with the last one."""
    weekly = td.weekly_sales(spark, sf_dir).where(F.col("NetSales") > 0)
    return finalize(rank.top_k(weekly, ["Date"], "NetSales", rank.TOP_N).select("Date", "SKU", "Store", "NetSales", "rank"))


def q_rank_preview(spark, sf_dir):
    """Preview: the three best-selling rows of the whole table."""
    weekly = td.weekly_sales(spark, sf_dir)
    return finalize(rank.preview(weekly, 3, [F.desc("NetSales"), "Date", "SKU", "Store"]))


def q_rank_range_expansion(spark, sf_dir):
    return finalize(rank.range_expansion(rank_table(spark, sf_dir)))


def q_rank_lost(spark, sf_dir):
    return finalize(rank.in_w1_not_w2(rank_table(spark, sf_dir)))


def q_rank_material_change(spark, sf_dir):
    return finalize(rank.material_change(rank_table(spark, sf_dir)))


def q_rank_unaddressed_gap(spark, sf_dir):
    return finalize(rank.unaddressed_gap(rank_table(spark, sf_dir)))


def q_rank_newcomer(spark, sf_dir):
    return finalize(rank.newcomer(rank_table(spark, sf_dir)))


def q_rank_report(spark, sf_dir):
    return finalize(rank.rank_report(rank_table(spark, sf_dir)))


# ------------------------------------------------------------ Inventory
# Analysis windows (job parameters): six months, split after three.
PERIOD_A = {"begin": "2000-04-01", "end": "2000-10-01", "split": "2000-07-01"}
PERIOD_B = {"begin": "2000-06-01", "end": "2000-12-01", "split": "2000-09-01"}


def inv_inputs(spark: SparkSession, sf_dir: str, catalogue: str = "part",
               period: dict = PERIOD_A, later_report: bool = False, keep_mart: bool = True, promo: bool = True):
    """(sales, mart, report) for one analysis window; ``promo=False`` leaves
    promotional parts off the planogram.

    ``keep_mart`` writes the mart once when several branches read it (the
    branches prune it differently, so Spark could not share one exchange and
    would aggregate the sales twice)."""
    sub = inv.clean_lookup(td.subcategory_info(spark, sf_dir, catalogue), "SubCategory")
    ven = inv.clean_lookup(td.vendor_info(spark, sf_dir, catalogue), "Vendor")
    sales = inv.clean_sales(td.sales_monthly(spark, sf_dir, catalogue), sub, ven,
                            store=None, begin=period["begin"], end=period["end"])
    mart = inv.monthly_mart(sales)
    if keep_mart:
        mart = materialize(mart)
    report = inv.clean_report(td.dist_report(spark, sf_dir, catalogue, later=later_report, promo=promo))
    return sales, mart, report


def inv_enriched(spark, sf_dir, catalogue="part", period=PERIOD_A, later_report=False,
                 keep: bool = False):
    """The analysis table; ``keep`` writes it once for multi-branch readers."""
    _, mart, report = inv_inputs(spark, sf_dir, catalogue, period, later_report)
    _, late = inv.split_periods(mart, period["split"])
    enriched = inv.enrich(inv.analysis_base(late, report))
    return materialize(enriched) if keep else enriched


def q_inv_sales_clean(spark, sf_dir):
    return finalize(inv_inputs(spark, sf_dir, keep_mart=False)[0])


def q_inv_monthly(spark, sf_dir):
    return finalize(inv_inputs(spark, sf_dir, keep_mart=False)[1])


def q_inv_check(spark, sf_dir):
    _, mart, report = inv_inputs(spark, sf_dir, keep_mart=False)
    out = inv.check_items(mart, report)
    # year/month are NULL for items without any sales row; as DOUBLE the
    # NULLs read the same way in both engines' pandas form
    return finalize(out.withColumn("year", F.col("year").cast("double"))
                       .withColumn("month", F.col("month").cast("double")))


def store_mart(spark, sf_dir):
    """The monthly mart of period A keyed by store."""
    sub = inv.clean_lookup(td.subcategory_info(spark, sf_dir), "SubCategory")
    ven = inv.clean_lookup(td.vendor_info(spark, sf_dir), "Vendor")
    sales = inv.clean_sales(td.sales_monthly(spark, sf_dir), sub, ven, begin=PERIOD_A["begin"], end=PERIOD_A["end"])
    return materialize(inv.monthly_mart(sales, ("Store",)))


def q_inv_check_by_store(spark, sf_dir):
    return finalize(inv.check_items_by_store(store_mart(spark, sf_dir), inv.clean_report(td.dist_report(spark, sf_dir))))


def q_inv_removed(spark, sf_dir):
    _, mart, report = inv_inputs(spark, sf_dir)
    early, late = inv.split_periods(mart, PERIOD_A["split"])
    return finalize(inv.removed_items(early, late, report, PERIOD_A["split"]))


def q_inv_new(spark, sf_dir):
    _, mart, report = inv_inputs(spark, sf_dir, keep_mart=False, promo=False)
    _, late = inv.split_periods(mart, PERIOD_A["split"])
    return finalize(inv.new_items(late, report))


def q_inv_bad_record(spark, sf_dir):
    _, mart, report = inv_inputs(spark, sf_dir, keep_mart=False)
    _, late = inv.split_periods(mart, PERIOD_A["split"])
    return finalize(inv.bad_records(inv.analysis_base(late, report)))


def q_inv_depth_lt2(spark, sf_dir):
    _, mart, report = inv_inputs(spark, sf_dir, keep_mart=False)
    _, late = inv.split_periods(mart, PERIOD_A["split"])
    return finalize(inv.shallow_items(inv.analysis_base(late, report)))


def q_inv_issue_counts(spark, sf_dir):
    _, mart, report = inv_inputs(spark, sf_dir)
    split = PERIOD_A["split"]
    early, late = inv.split_periods(mart, split)
    base = inv.analysis_base(late, report)
    return finalize(inv.issue_counts({
        "check": inv.check_items(mart, report),
        "removed": inv.removed_items(early, late, report, split),
        "new": inv.new_items(late, inv.clean_report(td.dist_report(spark, sf_dir, promo=False))),
        "bad_record": inv.bad_records(base),
        "depth_lt2": inv.shallow_items(base),
    }))


def q_inv_enriched(spark, sf_dir):
    return finalize(inv_enriched(spark, sf_dir))


def q_inv_at_least_one(spark, sf_dir):
    return finalize(inv.at_least_one_month(inv_enriched(spark, sf_dir, keep=True))["items"])


def q_inv_unadjusted_buckets(spark, sf_dir):
    res = inv.at_least_one_month(inv_enriched(spark, sf_dir, keep=True))
    return finalize(inv.depth_buckets(res["unadjusted"]))


def q_inv_adjusted(spark, sf_dir):
    return finalize(inv.at_least_one_month(inv_enriched(spark, sf_dir, keep=True))["adjusted"])


def q_inv_store_at_least_one(spark, sf_dir):
    """At-least-one-month over-spaced items of every store in one job
    (stores keyed through mart, statistics and item averages)."""
    by = ("Store",)
    mart = store_mart(spark, sf_dir)
    report = inv.clean_report(td.dist_report(spark, sf_dir))
    _, late = inv.split_periods(mart, PERIOD_A["split"])
    enriched = materialize(inv.enrich(inv.analysis_base(late, report, by), by))
    return finalize(inv.at_least_one_month(enriched, by)["items"])


def q_inv_full_month(spark, sf_dir):
    res = inv.at_least_one_month(inv_enriched(spark, sf_dir, catalogue="group", keep=True))
    return finalize(inv.full_month(res["rows"], PERIOD_A["split"]))


OVER_SPACED_COLUMNS = ["MatID", "SKU", "year", "month", "SubCategory", "Vendor", "Classification",
                       "Facings", "Capacity", "totalMonthlyQtySold", "totalMonthlyNetSale"]


def q_inv_over_spaced_x2(spark, sf_dir):
    _, mart, report = inv_inputs(spark, sf_dir, catalogue="group")
    _, late = inv.split_periods(mart, PERIOD_A["split"])
    flagged = inv.over_spaced(inv.analysis_base(late, report), "Capacity", 2)
    ids = inv.full_month_ids(flagged, PERIOD_A["split"])
    return finalize(flagged.join(ids, "MatID", "left_semi").select(*OVER_SPACED_COLUMNS))


def q_inv_over_spaced_facings(spark, sf_dir):
    """Rule 1: facings above the monthly quantity, in every late month."""
    _, mart, report = inv_inputs(spark, sf_dir, catalogue="group")
    _, late = inv.split_periods(mart, PERIOD_A["split"])
    flagged = inv.over_spaced(inv.analysis_base(late, report), "Facings", 1)
    ids = inv.full_month_ids(flagged, PERIOD_A["split"])
    return finalize(flagged.join(ids, "MatID", "left_semi").select(*OVER_SPACED_COLUMNS))


def q_inv_bands(spark, sf_dir):
    return finalize(inv.demand_bands(inv_enriched(spark, sf_dir)))


# -------------------------------------------------------------- Compare
LABEL_A, LABEL_B = "2000-07", "2000-09"


def cmp_inputs(spark: SparkSession, sf_dir: str, with_items: bool = True):
    """Full-month over-spaced rows and at-least-one-month items of the two
    periods; each period is analysed with its own report.

    One monthly mart over the union of the two windows serves both periods
    (a monthly aggregate restricted to a period's months equals the
    aggregate of that period's rows), so the sales are read and aggregated
    once. The analysis table is written once only when the items (a second
    reader) are wanted."""
    begin = min(PERIOD_A["begin"], PERIOD_B["begin"])
    end = max(PERIOD_A["end"], PERIOD_B["end"])
    _, mart_all, _ = inv_inputs(spark, sf_dir, "group", {"begin": begin, "end": end, "split": end})
    out = []
    for period, later in ((PERIOD_A, False), (PERIOD_B, True)):
        mart = mart_all.where((F.col("period") >= F.to_date(F.lit(period["begin"])))
                              & (F.col("period") < F.to_date(F.lit(period["end"]))))
        report = inv.clean_report(td.dist_report(spark, sf_dir, "group", later=later))
        _, late = inv.split_periods(mart, period["split"])
        enr = inv.enrich(inv.analysis_base(late, report))
        res = inv.at_least_one_month(materialize(enr) if with_items else enr)
        out.append((inv.full_month(res["rows"], period["split"]), res["items"]))
    (full_a, items_a), (full_b, items_b) = out
    return full_a, full_b, items_a, items_b


def cmp_reports(spark: SparkSession, sf_dir: str):
    first = inv.clean_report(td.dist_report(spark, sf_dir, "group", later=False))
    later = inv.clean_report(td.dist_report(spark, sf_dir, "group", later=True))
    return first, later


def q_cmp_report_diff(spark, sf_dir):
    return finalize(cmp.report_diff(*cmp_reports(spark, sf_dir)))


def q_cmp_capacity_vs_full(spark, sf_dir):
    full_a, full_b, _, _ = cmp_inputs(spark, sf_dir, with_items=False)
    return finalize(cmp.capacity_vs_full(cmp.report_diff(*cmp_reports(spark, sf_dir)), full_a, full_b))


def q_cmp_persistent(spark, sf_dir):
    full_a, full_b, items_a, items_b = cmp_inputs(spark, sf_dir)
    return finalize(cmp.persistent_items(full_a, full_b, items_a, items_b, LABEL_A, LABEL_B))


def q_cmp_obs_check(spark, sf_dir):
    full_a, full_b, items_a, items_b = cmp_inputs(spark, sf_dir)
    return finalize(cmp.observation_check(
        cmp.persistent_items(full_a, full_b, items_a, items_b, LABEL_A, LABEL_B)))


def q_cmp_only_one_period(spark, sf_dir):
    full_a, full_b, _, _ = cmp_inputs(spark, sf_dir, with_items=False)
    return finalize(cmp.only_one_period(full_a, full_b, LABEL_A, LABEL_B))


# -------------------------------------------------------------- Profile
def q_profile_summary(spark, sf_dir):
    return finalize(profile.describe(inv_enriched(spark, sf_dir)))


def q_profile_by_class(spark, sf_dir):
    return finalize(profile.describe(inv_enriched(spark, sf_dir), profile.CLASS_COLUMNS,
                                     by=["Classification"]))


def q_profile_one_class(spark, sf_dir):
    return finalize(profile.describe(profile.of_class(inv_enriched(spark, sf_dir), "A"), profile.CLASS_COLUMNS))


def q_profile_quartiles(spark, sf_dir):
    return finalize(profile.quartiles(inv_enriched(spark, sf_dir), by=["Classification"]))


def q_profile_eight_number(spark, sf_dir):
    return finalize(profile.eight_number_summary(inv_enriched(spark, sf_dir), by=["Classification"]))


def q_profile_corr(spark, sf_dir):
    return finalize(profile.correlations(inv_enriched(spark, sf_dir)))


def q_profile_share(spark, sf_dir):
    return finalize(profile.class_share(inv_enriched(spark, sf_dir), "totalMonthlyQtySold",
                                        by="SubCategory"))


def q_profile_margin_rate(spark, sf_dir):
    return finalize(profile.margin_rate(inv_enriched(spark, sf_dir)))


def q_profile_class_month(spark, sf_dir):
    return finalize(profile.class_month(inv_enriched(spark, sf_dir), "SellMargin"))


def q_profile_geo_means(spark, sf_dir):
    return finalize(profile.geo_mean_summary(inv_enriched(spark, sf_dir)))


def q_profile_class_counts(spark, sf_dir):
    return finalize(profile.class_counts(inv_enriched(spark, sf_dir)))


def q_profile_margin_bands(spark, sf_dir):
    return finalize(profile.margin_bands(inv_enriched(spark, sf_dir)))


def q_profile_selected_share(spark, sf_dir):
    enr = inv_enriched(spark, sf_dir, "group", keep=True)
    full = inv.full_month(inv.at_least_one_month(enr)["rows"], PERIOD_A["split"])
    return finalize(profile.selected_share(enr, full))


def q_profile_histogram(spark, sf_dir):
    return finalize(profile.histogram(inv_enriched(spark, sf_dir), "Price", 10))


BOX_KEYS = ["Classification", "year", "month"]


def q_profile_box_plot(spark, sf_dir):
    return finalize(profile.box_plot(inv_enriched(spark, sf_dir, keep=True), "Price", BOX_KEYS))


def q_profile_box_outliers(spark, sf_dir):
    enriched = inv_enriched(spark, sf_dir, keep=True)
    return finalize(profile.box_outliers(enriched, "Price", BOX_KEYS, [*BOX_KEYS, "MatID"]))


# ------------------------------------------------------------------ SQL
def q_sql_oos_7_days(spark, sf_dir):
    return finalize(sql_surface.oos_all_days(materialize(oos_report(spark, sf_dir)), oos.WINDOW_DAYS))


def q_sql_rank_newcomer(spark, sf_dir):
    return finalize(sql_surface.newcomers(rank_table(spark, sf_dir), rank.TOP_N))


def q_sql_lists(spark, sf_dir):
    return sql_surface.lists(materialize(td.weekly_sales(spark, sf_dir)))


QUERIES: dict[str, Query] = {
    "oos_clean_grid": q_oos_clean_grid,
    "oos_items": q_oos_items,
    "oos_7_days": q_oos_7_days,
    "oos_store_summary": q_oos_store_summary,
    "oos_product_summary": q_oos_product_summary,
    "oos_daily_state": q_oos_daily_state,
    "rank_overall": q_rank_overall,
    "rank_store": q_rank_store,
    "rank_concept_avg": q_rank_concept_avg,
    "rank_top50": q_rank_top50,
    "rank_top_weeks": q_rank_top_weeks,
    "rank_preview": q_rank_preview,
    "rank_range_expansion": q_rank_range_expansion,
    "rank_lost": q_rank_lost,
    "rank_material_change": q_rank_material_change,
    "rank_unaddressed_gap": q_rank_unaddressed_gap,
    "rank_newcomer": q_rank_newcomer,
    "rank_report": q_rank_report,
    "inv_sales_clean": q_inv_sales_clean,
    "inv_monthly": q_inv_monthly,
    "inv_check": q_inv_check,
    "inv_check_by_store": q_inv_check_by_store,
    "inv_removed": q_inv_removed,
    "inv_new": q_inv_new,
    "inv_bad_record": q_inv_bad_record,
    "inv_depth_lt2": q_inv_depth_lt2,
    "inv_issue_counts": q_inv_issue_counts,
    "inv_enriched": q_inv_enriched,
    "inv_at_least_one": q_inv_at_least_one,
    "inv_unadjusted_buckets": q_inv_unadjusted_buckets,
    "inv_adjusted": q_inv_adjusted,
    "inv_store_at_least_one": q_inv_store_at_least_one,
    "inv_full_month": q_inv_full_month,
    "inv_over_spaced_x2": q_inv_over_spaced_x2,
    "inv_over_spaced_facings": q_inv_over_spaced_facings,
    "inv_bands": q_inv_bands,
    "cmp_report_diff": q_cmp_report_diff,
    "cmp_capacity_vs_full": q_cmp_capacity_vs_full,
    "cmp_persistent": q_cmp_persistent,
    "cmp_obs_check": q_cmp_obs_check,
    "cmp_only_one_period": q_cmp_only_one_period,
    "profile_summary": q_profile_summary,
    "profile_by_class": q_profile_by_class,
    "profile_one_class": q_profile_one_class,
    "profile_quartiles": q_profile_quartiles,
    "profile_eight_number": q_profile_eight_number,
    "profile_corr": q_profile_corr,
    "profile_share": q_profile_share,
    "profile_margin_rate": q_profile_margin_rate,
    "profile_class_month": q_profile_class_month,
    "profile_geo_means": q_profile_geo_means,
    "profile_class_counts": q_profile_class_counts,
    "profile_margin_bands": q_profile_margin_bands,
    "profile_selected_share": q_profile_selected_share,
    "profile_histogram": q_profile_histogram,
    "profile_box_plot": q_profile_box_plot,
    "profile_box_outliers": q_profile_box_outliers,
    "sql_oos_7_days": q_sql_oos_7_days,
    "sql_rank_newcomer": q_sql_rank_newcomer,
    "sql_lists": q_sql_lists,
    **storage_queries.QUERIES,
}
