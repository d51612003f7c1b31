"""DuckDB SQL of the queries in ``plans.storage_queries``."""

from __future__ import annotations

from shelfsight.plans import oracle
from shelfsight.plans.oracle import PERIOD_A, R, inv_ctes

SQL: dict[str, str] = {}

SQL["text_sales_rows"] = f"""
SELECT CASE WHEN l_orderkey % 89 <> 0 THEN strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') END AS Date,
       'S' || CAST(l_suppkey AS VARCHAR) AS Store, CAST(l_partkey AS INTEGER) AS MatID,
       CASE WHEN l_orderkey % 79 = 0 THEN 'Part "' || CAST(l_partkey AS VARCHAR) || '"' || chr(10) || 'new pack'
            ELSE 'Part ' || CAST(l_partkey AS VARCHAR) END AS SKU,
       CASE WHEN l_orderkey % 83 <> 0 THEN {R('l_extendedprice')} END AS GrossSales,
       {R('round(l_extendedprice * (1.0 - l_discount), 4)')} AS NetSales,
       {R('round(l_extendedprice * l_discount, 4)')} AS TotalDiscount,
       CASE WHEN l_orderkey % 97 <> 0 THEN {R('l_quantity')} END AS QtySold,
       {R('round(-0.6 * l_extendedprice, 3)')} AS COGS
FROM lineitem WHERE l_orderkey % 101 <> 0 AND l_orderkey % 103 <> 0
"""

SQL["text_rejects"] = """
WITH wide AS (SELECT * FROM lineitem WHERE l_orderkey % 101 <> 0 AND l_orderkey % 103 <> 0),
cells AS (
  SELECT 'Date' AS "column", 'not a date' AS reason FROM wide WHERE l_orderkey % 89 = 0
  UNION ALL SELECT 'POS Gross Sales', 'missing' FROM wide WHERE l_orderkey % 83 = 0
  UNION ALL SELECT 'POS Qty Sold', 'not a number' FROM wide WHERE l_orderkey % 97 = 0
  UNION ALL SELECT NULL, 'row width' FROM lineitem WHERE l_orderkey % 101 = 0 OR l_orderkey % 103 = 0)
SELECT "column", reason, count(*) AS n_cells FROM cells GROUP BY 1, 2
"""

SQL["mart_removed"] = oracle.SQL["inv_removed"]

SQL["mart_season"] = f"""WITH {inv_ctes("part", PERIOD_A)}
SELECT year, month, SubCategory, count(*) AS n_items, {R('sum(totalMonthlyNetSale)')} AS net_sales
FROM mart WHERE month BETWEEN 6 AND 8 GROUP BY year, month, SubCategory"""

SQL["sink_buckets"] = f"""
SELECT * FROM ({oracle.SQL["inv_unadjusted_buckets"]}) WHERE bucket <> 'lessThan3' OR Facings > 1"""

SQL["oos_copartitioned"] = oracle.SQL["oos_items"]

_OUTPUTS = {
    "issued/checked": "inv_check", "issued/removed": "inv_removed", "issued/incorrect_record": "inv_bad_record",
    "issued/depth_lt2": "inv_depth_lt2", "analysis_table": "inv_enriched", "at_least_one_month/all": "inv_at_least_one",
    "at_least_one_month/adjusted": "inv_adjusted", "at_least_one_month/unadjusted": "inv_unadjusted_buckets",
}
_FULL = f"""WITH {inv_ctes("part", PERIOD_A)} SELECT r.* FROM (SELECT DISTINCT MatID, year, month FROM rows) r
WHERE MatID IN (SELECT MatID FROM full_ids)"""
_NEW = f"""WITH {inv_ctes("part", PERIOD_A)} SELECT * FROM late WHERE coalesce(totalMonthlyGrossSale, 0) <> 0
AND MatID NOT IN (SELECT MatID FROM report)"""

SQL["inv_published"] = "\nUNION ALL\n".join(
    f"""SELECT '{name}' AS list, count(*) AS n_rows, count(DISTINCT MatID) AS n_items FROM ({sql})"""
    for name, sql in [*((k, oracle.SQL[v]) for k, v in _OUTPUTS.items()), ("full_month", _FULL), ("issued/new", _NEW)])

SQL["job_oos"] = oracle.SQL["oos_items"]
SQL["job_rank"] = oracle.SQL["rank_report"]
_EVEN = inv_ctes("part", PERIOD_A, only="l_suppkey % 2 = 0")
SQL["job_inventory"] = f"WITH {_EVEN} SELECT DISTINCT {oracle.cols(oracle.ATL_COLS, oracle.DOUBLES)} FROM atl"
SQL["text_report_diff"] = oracle.SQL["cmp_report_diff"]
SQL["text_short_names"] = "WITH " + oracle.STOCK_FACTS + f"""
SELECT SKU AS name, count(*) AS n_rows, count(*) FILTER (WHERE StockQty - 0.5 < 1) AS n_zero,
       {R('sum(CASE WHEN abs(StockQty - 0.5) < 1 THEN 0.0 ELSE StockQty - 0.5 END)')} AS stock
FROM facts GROUP BY SKU"""
