"""Equivalent SQL (DuckDB dialect) for each registered query.

The SQL is written independently of the Spark plans: it densifies with a
calendar and uses window functions where the Spark side uses grouped
aggregates and array functions, so agreement is evidence, not tautology.
``R(x)`` marks the 4-decimal rounding applied at the result boundary.
"""

from __future__ import annotations


def R(x: str) -> str:
    return f"(round(({x}) * 10000.0 + 0.001) / 10000.0 + 0.0)"


def B(x: str) -> str:
    """Flag rendered as exported: 'True' / 'False' / '' for NULL."""
    return f"(CASE WHEN ({x}) THEN 'True' WHEN NOT ({x}) THEN 'False' ELSE '' END)"


# ------------------------------------------------------------------ OOS
STOCK_FACTS = """
facts AS (
  SELECT event_type AS SKU, CAST(user_id AS VARCHAR) AS Store, CAST(ts AS DATE) AS Date,
         upper(event_type) AS Category,
         sum(value) AS NetSales,
         CAST(count(*) AS DOUBLE) AS QtySold,
         sum(value * (event_id % 7) / 10.0) AS Margin,
         CAST(count(*) FILTER (WHERE event_id % 3 <> 0) AS DOUBLE) AS StockQty
  FROM events
  WHERE user_id NOT IN (SELECT DISTINCT user_id FROM events WHERE user_id % 10 = 0)
  GROUP BY event_type, user_id, CAST(ts AS DATE)),
pairs AS (
  SELECT SKU, Store FROM facts GROUP BY SKU, Store
  HAVING sum(NetSales) <> 0 AND sum(StockQty) <> 0),
kept AS (SELECT f.* FROM facts f JOIN pairs p ON f.SKU = p.SKU AND f.Store = p.Store),
bounds AS (SELECT min(Date) AS d0, max(Date) AS d1 FROM kept),
grid AS (
  SELECT p.SKU, p.Store, CAST(unnest(generate_series(b.d0, b.d1, INTERVAL 1 DAY)) AS DATE) AS Date
  FROM pairs p CROSS JOIN bounds b),
dense AS (
  SELECT g.SKU, g.Store, g.Date, k.Category,
         coalesce(k.NetSales, 0) AS NetSales, coalesce(k.QtySold, 0) AS QtySold,
         coalesce(k.Margin, 0) AS Margin, coalesce(k.StockQty, 0) AS StockQty
  FROM grid g LEFT JOIN kept k ON g.SKU = k.SKU AND g.Store = k.Store AND g.Date = k.Date)
"""

OOS_REPORT = STOCK_FACTS + """,
marked AS (
  SELECT d.*, b.d1,
         max(CASE WHEN StockQty <> 0 THEN 1 ELSE 0 END) OVER (
           PARTITION BY SKU, Store ORDER BY Date
           RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen
  FROM dense d CROSS JOIN bounds b),
flagged AS (
  SELECT *, (StockQty = 0 AND QtySold = 0 AND seen = 1 AND Date >= d1 - 6) AS is_oos FROM marked),
report AS (
  SELECT SKU, Store,
         arg_max(Category, Date) FILTER (WHERE Category IS NOT NULL) AS category,
         CAST(count(*) FILTER (WHERE is_oos) AS INTEGER) AS OOS_days,
         string_agg(strftime(Date, '%Y-%m-%d'), ',' ORDER BY Date) FILTER (WHERE is_oos) AS date_list,
         CAST(max(CASE WHEN is_oos AND Date = d1 THEN 1 ELSE 0 END) AS INTEGER) AS OOS_lastDay,
         avg(QtySold) FILTER (WHERE StockQty <> 0) AS avg_loss_sale_quantity,
         avg(NetSales) FILTER (WHERE StockQty <> 0) AS avg_loss_net_sale,
         avg(Margin) FILTER (WHERE StockQty <> 0) AS avg_loss_margin
  FROM flagged GROUP BY SKU, Store
  HAVING count(*) FILTER (WHERE is_oos) > 0 AND max(StockQty) > 0),
report_full AS (
  SELECT *, avg_loss_sale_quantity * OOS_days AS total_loss_sale_quantity,
            avg_loss_net_sale * OOS_days AS total_loss_net_sale,
            avg_loss_margin * OOS_days AS total_loss_margin
  FROM report)
"""

SQL: dict[str, str] = {}

SQL["oos_clean_grid"] = "WITH " + STOCK_FACTS + f"""
SELECT SKU, Store, strftime(Date, '%Y-%m-%d') AS Date, Category,
       {R('NetSales')} AS NetSales, {R('QtySold')} AS QtySold,
       {R('Margin')} AS Margin, {R('StockQty')} AS StockQty
FROM dense
"""

SQL["oos_items"] = "WITH " + OOS_REPORT + f"""
SELECT SKU, Store, category, OOS_days, date_list, OOS_lastDay,
       {R('avg_loss_sale_quantity')} AS avg_loss_sale_quantity,
       {R('avg_loss_net_sale')} AS avg_loss_net_sale,
       {R('avg_loss_margin')} AS avg_loss_margin,
       {R('total_loss_sale_quantity')} AS total_loss_sale_quantity,
       {R('total_loss_net_sale')} AS total_loss_net_sale,
       {R('total_loss_margin')} AS total_loss_margin
FROM report_full
"""

SQL["oos_7_days"] = "WITH " + OOS_REPORT + f""",
seven AS (SELECT * FROM report_full WHERE OOS_days = 7)
SELECT SKU, Store, category, OOS_days,
       {R('avg_loss_sale_quantity')} AS avg_loss_sale_quantity,
       {R('avg_loss_net_sale')} AS avg_loss_net_sale,
       {R('avg_loss_margin')} AS avg_loss_margin,
       {R('total_loss_sale_quantity')} AS total_loss_sale_quantity,
       {R('total_loss_net_sale')} AS total_loss_net_sale,
       {R('total_loss_margin')} AS total_loss_margin,
       {R("avg_loss_net_sale / nullif(sum(avg_loss_net_sale) OVER (PARTITION BY Store), 0) * 100")}
         AS Avg_NS_Percentage,
       {R("avg_loss_margin / nullif(sum(avg_loss_margin) OVER (PARTITION BY Store), 0) * 100")}
         AS Avg_Margin_Percentage
FROM seven
"""

SQL["oos_store_summary"] = "WITH " + OOS_REPORT + f"""
SELECT Store, count(*) AS oos_items, CAST(sum(OOS_days) AS BIGINT) AS oos_days,
       {R('sum(total_loss_sale_quantity)')} AS total_loss_sale_quantity,
       {R('sum(total_loss_net_sale)')} AS total_loss_net_sale,
       {R('sum(total_loss_margin)')} AS total_loss_margin
FROM report_full GROUP BY Store
"""

SQL["oos_product_summary"] = "WITH " + OOS_REPORT + f"""
SELECT SKU, count(DISTINCT Store) AS n_stores, CAST(sum(OOS_days) AS BIGINT) AS oos_days,
       {R('sum(total_loss_net_sale)')} AS total_loss_net_sale,
       {R('sum(total_loss_margin)')} AS total_loss_margin
FROM report_full GROUP BY SKU HAVING count(DISTINCT Store) >= 2
"""


# ----------------------------------------------------------------- Rank
RANK_BASE = """
weekly AS (
  SELECT strftime(l_shipdate, '%G') || 'W' || strftime(l_shipdate, '%V') AS Date,
         'G' || CAST(l_partkey // 10 AS VARCHAR) AS SKU, n_name AS Store, r_name AS Concept_NEW,
         sum(CASE WHEN l_linenumber = 7 THEN 0.0 ELSE l_extendedprice END) AS NetSales
  FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2, 3, 4),
rw AS (
  SELECT Date || '/' || Store || '/' || SKU AS "Index", Date, 'RETAIL' AS Company,
         Concept_NEW AS BusinessUnit, Concept_NEW, 'General' AS Category, Store, SKU, NetSales,
         CAST(rank() OVER (PARTITION BY Date ORDER BY NetSales DESC) AS DOUBLE) AS rank
  FROM weekly),
wk AS (
  SELECT max(Date) AS w2,
         (SELECT max(Date) FROM rw WHERE Date < (SELECT max(Date) FROM rw)) AS w1
  FROM rw),
flags AS (
  SELECT r.*,
    CASE WHEN r.Date = wk.w2 AND NOT EXISTS (
           SELECT 1 FROM rw x WHERE x.SKU = r.SKU AND x.Store = r.Store AND x.Date = wk.w1)
         THEN TRUE END AS range_expansion,
    CASE WHEN r.Date = wk.w1 AND r.NetSales <> 0 AND NOT EXISTS (
           SELECT 1 FROM rw x WHERE x.SKU = r.SKU AND x.Store = r.Store AND x.Date = wk.w2)
         THEN TRUE END AS in_W1_not_W2,
    coalesce((SELECT sum(x.NetSales) FROM rw x
              WHERE x.SKU = r.SKU AND x.Store = r.Store AND x.Date = wk.w1), 0.0) AS sumSales_oldWeek,
    coalesce((SELECT avg(x.NetSales) FROM rw x
              WHERE x.SKU = r.SKU AND x.Concept_NEW = r.Concept_NEW AND x.Date = wk.w2), 0.0)
      AS avgSales_lastWeek,
    (EXISTS (SELECT 1 FROM rw x WHERE x.SKU = r.SKU AND x.Store = r.Store AND x.Date = wk.w2
                                  AND x.rank BETWEEN 1 AND 50)
     AND NOT EXISTS (SELECT 1 FROM rw x WHERE x.SKU = r.SKU AND x.Store = r.Store
                                         AND x.Date = wk.w1 AND x.rank BETWEEN 1 AND 50)) AS newcomer
  FROM rw r CROSS JOIN wk),
flags2 AS (
  SELECT *,
    CASE WHEN sumSales_oldWeek = 0 THEN NULL
         WHEN sumSales_oldWeek > avgSales_lastWeek AND coalesce(in_W1_not_W2, FALSE) THEN TRUE
         ELSE FALSE END AS material_change,
    (NOT coalesce(range_expansion, FALSE) AND NOT coalesce(in_W1_not_W2, FALSE)
     AND NetSales = 0) AS unaddressed_gap
  FROM flags)
"""

RANK_COLS = f""""Index", Date, Company, BusinessUnit, Concept_NEW, Category, Store, SKU,
       {R('NetSales')} AS NetSales, {R('rank')} AS rank"""

SQL["rank_overall"] = "WITH " + RANK_BASE + f"SELECT {RANK_COLS} FROM rw"

SQL["rank_store"] = "WITH " + RANK_BASE + f"""
SELECT "Index", Date, Company, BusinessUnit, Concept_NEW, Category, Store, SKU,
       {R('NetSales')} AS NetSales,
       CAST(rank() OVER (PARTITION BY Date ORDER BY NetSales DESC) AS INTEGER) AS rank,
       CAST(rank() OVER (PARTITION BY Date, Store ORDER BY NetSales DESC) AS INTEGER) AS store_rank
FROM rw
"""

SQL["rank_concept_avg"] = "WITH " + RANK_BASE + f"""
SELECT SKU, Concept_NEW, {R('avg(NetSales)')} AS avgSales_lastWeek
FROM rw WHERE Date = (SELECT w2 FROM wk) GROUP BY SKU, Concept_NEW
"""

SQL["rank_top50"] = "WITH " + RANK_BASE + f"""
SELECT SKU, Store, Date, {R('NetSales')} AS NetSales, {R('rank')} AS rank
FROM rw, wk WHERE Date IN (wk.w1, wk.w2) AND rank BETWEEN 1 AND 50
"""

SQL["rank_range_expansion"] = "WITH " + RANK_BASE + f"SELECT {RANK_COLS}, {B('range_expansion')} AS range_expansion FROM flags2"
SQL["rank_lost"] = "WITH " + RANK_BASE + f"SELECT {RANK_COLS}, {B('in_W1_not_W2')} AS in_W1_not_W2 FROM flags2"
SQL["rank_material_change"] = "WITH " + RANK_BASE + f"""
SELECT {RANK_COLS}, {B('in_W1_not_W2')} AS in_W1_not_W2, {R('sumSales_oldWeek')} AS sumSales_oldWeek,
       {R('avgSales_lastWeek')} AS avgSales_lastWeek, {B('material_change')} AS material_change
FROM flags2"""
SQL["rank_unaddressed_gap"] = "WITH " + RANK_BASE + f"""
SELECT {RANK_COLS}, {B('range_expansion')} AS range_expansion, {B('in_W1_not_W2')} AS in_W1_not_W2,
       {B('unaddressed_gap')} AS unaddressed_gap FROM flags2"""
SQL["rank_newcomer"] = "WITH " + RANK_BASE + f"SELECT {RANK_COLS}, {B('newcomer')} AS newcomer FROM flags2"
SQL["rank_report"] = "WITH " + RANK_BASE + f"""
SELECT DISTINCT {RANK_COLS}, {B('range_expansion')} AS range_expansion,
       {B('material_change')} AS material_change, {B('unaddressed_gap')} AS unaddressed_gap,
       {B('newcomer')} AS newcomer
FROM flags2"""


# ------------------------------------------------------------ Inventory
PERIOD_A = ("2000-04-01", "2000-10-01", "2000-07-01")
PERIOD_B = ("2000-06-01", "2000-12-01", "2000-09-01")


def _cls(cap: str) -> str:
    return (f"CASE WHEN {cap} > 40 THEN 'A+' WHEN {cap} > 30 THEN 'A' WHEN {cap} > 20 THEN 'B' "
            f"WHEN {cap} > 10 THEN 'C' ELSE 'D' END")


def _div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN NULL ELSE ({a}) / ({b}) END)"


def inv_ctes(catalogue: str = "part", period=PERIOD_A, later: bool = False, tag: str = "",
             promo: bool = True, only: str = "TRUE") -> str:
    """``only`` filters the line items. CTEs sales{tag}, mart{tag}, report{tag}, late{tag}, base{tag}, enriched{tag}."""
    begin, end, split = period
    if catalogue == "group":
        mid = "CAST(l_partkey // 10 AS INTEGER)"
        groups = f"""
groups{tag} AS (
  SELECT CAST(p_partkey // 10 AS INTEGER) AS mid, min(p_type) AS p_type, min(p_brand) AS p_brand,
         'Part ' || CAST(p_partkey // 10 AS VARCHAR) AS p_name
  FROM part GROUP BY p_partkey // 10),"""
        rep_from = f"groups{tag}"
        facings = "CAST(1 + mid % 5 + CASE WHEN mid % 11 = 3 THEN 500 ELSE 0 END AS DOUBLE)"
        capacity = "CAST(1 + mid % 50 AS DOUBLE)"
        rep_where = "TRUE"
    else:
        mid = "CAST(l_partkey AS INTEGER)"
        groups = f"""
groups{tag} AS (
  SELECT CAST(p_partkey AS INTEGER) AS mid, p_type, p_brand, p_name, p_size FROM part),"""
        rep_from = f"groups{tag}"
        facings = "CAST(1 + mid % 5 AS DOUBLE)"
        capacity = "CAST(p_size AS DOUBLE)"
        rep_where = "TRUE" if promo else "NOT starts_with(p_type, 'PROMO')"
    if later:
        capacity = (f"greatest(1.0, {capacity} + CASE WHEN mid % 7 = 0 THEN 3.0 "
                    f"WHEN mid % 7 = 1 THEN -1.0 ELSE 0.0 END)")
        facings = f"({facings} + CASE WHEN mid % 7 = 2 THEN 1.0 ELSE 0.0 END)"
    return groups + f"""
sales{tag} AS (
  SELECT CAST(l_shipdate AS DATE) AS Date,
         'S' || CAST(l_suppkey AS VARCHAR) AS Store,
         {mid} AS MatID, 'Part ' || CAST({mid} AS VARCHAR) AS SKU,
         l_extendedprice AS GrossSales,
         l_extendedprice * (1.0 - l_discount) AS NetSales,
         l_extendedprice * l_discount AS TotalDiscount,
         l_quantity AS QtySold,
         -0.6 * l_extendedprice AS COGS,
         {_div('l_extendedprice', 'l_quantity')} AS Price,
         l_extendedprice + (-0.6 * l_extendedprice) AS FrontMargin,
         l_extendedprice * (1.0 - l_discount) + (-0.6 * l_extendedprice) AS SellMargin,
         g.p_type AS SubCategory, g.p_brand AS Vendor
  FROM lineitem LEFT JOIN groups{tag} g ON g.mid = {mid}
  WHERE l_shipdate >= TIMESTAMP '{begin}' AND l_shipdate < TIMESTAMP '{end}' AND {only}),
mart{tag} AS (
  SELECT CAST(year(Date) AS INTEGER) AS year, CAST(month(Date) AS INTEGER) AS month,
         CAST(date_trunc('month', Date) AS DATE) AS period,
         MatID, SubCategory, Vendor,
         avg(NetSales) AS totalMonthlyNetSale, avg(GrossSales) AS totalMonthlyGrossSale,
         avg(COGS) AS avgCOGS, avg(QtySold) AS totalMonthlyQtySold, avg(Price) AS Price,
         avg(SellMargin) AS SellMargin, avg(FrontMargin) AS avgFrontMargin
  FROM sales{tag}
  WHERE MatID IS NOT NULL AND SubCategory IS NOT NULL AND Vendor IS NOT NULL
  GROUP BY 1, 2, 3, 4, 5, 6),
report{tag} AS (
  SELECT mid AS MatID, CAST(mid AS VARCHAR) || ' ' || p_name AS SKU,
         {facings} AS Facings, {capacity} AS Capacity, {capacity} / 2.0 AS DaysSupply,
         {_cls(capacity)} AS Classification, CAST(1 + mid % 3 AS INTEGER) AS POGS
  FROM {rep_from} WHERE {rep_where}),
early{tag} AS (SELECT * FROM mart{tag} WHERE period < DATE '{split}'),
late{tag} AS (SELECT * FROM mart{tag} WHERE period >= DATE '{split}'),
base{tag} AS (
  SELECT r.*, l.year, l.month, l.period, l.SubCategory, l.Vendor, l.totalMonthlyNetSale,
         l.totalMonthlyGrossSale, l.avgCOGS, l.totalMonthlyQtySold, l.Price, l.SellMargin,
         l.avgFrontMargin,
         {_div('r.Capacity', 'r.Facings')} AS Depth
  FROM report{tag} r JOIN late{tag} l ON r.MatID = l.MatID),
stats{tag} AS (
  SELECT year, month, SubCategory,
         exp(avg(CASE WHEN totalMonthlyQtySold > 0 THEN ln(totalMonthlyQtySold) END))
           AS Qty_GeoMean_by_month_Subcat,
         exp(avg(CASE WHEN totalMonthlyNetSale > 0 THEN ln(totalMonthlyNetSale) END))
           AS NS_GeoMean_by_month_Subcat,
         avg(totalMonthlyQtySold) AS Qty_mean_by_month_Subcat,
         avg(totalMonthlyNetSale) AS NS_mean_by_month_Subcat,
         stddev_samp(totalMonthlyQtySold) AS Qty_std_by_month_Subcat,
         stddev_samp(totalMonthlyNetSale) AS NS_std_by_month_Subcat
  FROM base{tag} GROUP BY year, month, SubCategory),
enriched{tag} AS (
  SELECT b.*, s.Qty_GeoMean_by_month_Subcat, s.NS_GeoMean_by_month_Subcat,
         s.Qty_mean_by_month_Subcat, s.NS_mean_by_month_Subcat,
         s.Qty_std_by_month_Subcat, s.NS_std_by_month_Subcat,
         {_div('b.Capacity', 'b.totalMonthlyQtySold')} AS Capacity_to_qty,
         {_div('b.Capacity', 'b.totalMonthlyNetSale')} AS Capacity_to_sales,
         CASE WHEN b.Depth >= 4 THEN 3.0 END AS ProposedDepth,
         CASE WHEN b.Depth >= 4 THEN 3.0 - b.Depth END AS VarianceDepth
  FROM base{tag} b LEFT JOIN stats{tag} s
    ON b.year = s.year AND b.month = s.month AND b.SubCategory = s.SubCategory),
rows{tag} AS (SELECT * FROM enriched{tag} WHERE totalMonthlyQtySold < Capacity),
per_item{tag} AS (
  SELECT MatID, SubCategory, Vendor, avg(totalMonthlyQtySold) AS AvgQtySold,
         stddev_samp(totalMonthlyQtySold) AS Qty_std_by_SKU
  FROM enriched{tag} WHERE totalMonthlyNetSale <> 0 GROUP BY MatID, SubCategory, Vendor),
atl{tag} AS (
  SELECT r.*, p.AvgQtySold, p.Qty_std_by_SKU,
         {_div('r.Capacity', 'p.AvgQtySold')} AS Capacity_to_avg_qty,
         {_div('r.Facings', 'p.AvgQtySold')} AS Facing_to_avg_qty,
         {_div('p.Qty_std_by_SKU', 'p.AvgQtySold')} AS StdQty_to_AvgQty
  FROM rows{tag} r LEFT JOIN per_item{tag} p
    ON r.MatID = p.MatID AND r.SubCategory = p.SubCategory AND r.Vendor = p.Vendor),
full_ids{tag} AS (
  SELECT MatID FROM rows{tag}
  WHERE period IN (DATE '{split}', DATE '{split}' + INTERVAL 1 MONTH, DATE '{split}' + INTERVAL 2 MONTH)
  GROUP BY MatID HAVING count(DISTINCT period) = 3)
"""


def cols(names: list[str], doubles: set[str], prefix: str = "") -> str:
    out = []
    for n in names:
        ref = f"{prefix}{n}"
        if n in doubles:
            out.append(f"{R(ref)} AS {n}")
        elif n == "period" or n == "Date":
            out.append(f"strftime({ref}, '%Y-%m-%d') AS {n}")
        else:
            out.append(f"{ref} AS {n}")
    return ", ".join(out)


DOUBLES = {"GrossSales", "NetSales", "TotalDiscount", "QtySold", "COGS", "Price", "FrontMargin",
           "SellMargin", "totalMonthlyNetSale", "totalMonthlyGrossSale", "avgCOGS",
           "totalMonthlyQtySold", "avgFrontMargin", "Facings", "Capacity", "DaysSupply", "Depth",
           "ProposedDepth", "VarianceDepth", "Capacity_to_qty", "Capacity_to_sales",
           "Qty_GeoMean_by_month_Subcat", "NS_GeoMean_by_month_Subcat", "Qty_mean_by_month_Subcat",
           "NS_mean_by_month_Subcat", "Qty_std_by_month_Subcat", "NS_std_by_month_Subcat",
           "AvgQtySold", "Qty_std_by_SKU", "Capacity_to_avg_qty", "Facing_to_avg_qty",
           "StdQty_to_AvgQty"}

SALES_COLS = ["Date", "Store", "MatID", "SKU", "GrossSales", "NetSales", "TotalDiscount", "QtySold",
              "COGS", "Price", "FrontMargin", "SellMargin", "SubCategory", "Vendor"]
MART_COLS = ["year", "month", "period", "MatID", "SubCategory", "Vendor", "totalMonthlyNetSale",
             "totalMonthlyGrossSale", "avgCOGS", "totalMonthlyQtySold", "Price", "SellMargin",
             "avgFrontMargin"]
ISSUE_COLS = ["SKU", "MatID", "year", "month", "Price", "POGS", "Facings", "Capacity",
              "Classification", "SubCategory", "totalMonthlyNetSale", "totalMonthlyQtySold",
              "SellMargin"]
RECORD_COLS = ["MatID", "SKU", "Facings", "Capacity", "POGS", "Depth", "DaysSupply",
               "Classification", "year", "month", "SubCategory", "Vendor",
               "totalMonthlyNetSale", "totalMonthlyGrossSale", "avgCOGS",
               "totalMonthlyQtySold", "Price", "SellMargin", "avgFrontMargin"]
REPORT_COLS = ["MatID", "SKU", "Facings", "Capacity", "DaysSupply", "Classification", "POGS"]
ENRICHED_COLS = (REPORT_COLS + MART_COLS[:3] + MART_COLS[4:] +
                 ["Qty_GeoMean_by_month_Subcat", "NS_GeoMean_by_month_Subcat",
                  "Qty_mean_by_month_Subcat", "NS_mean_by_month_Subcat",
                  "Qty_std_by_month_Subcat", "NS_std_by_month_Subcat",
                  "Capacity_to_qty", "Capacity_to_sales", "Depth", "ProposedDepth", "VarianceDepth"])
ATL_COLS = ["MatID", "SKU", "Vendor", "SubCategory", "Classification", "POGS", "Facings", "Depth",
            "ProposedDepth", "VarianceDepth", "Capacity", "Capacity_to_avg_qty",
            "Facing_to_avg_qty", "AvgQtySold", "Qty_std_by_SKU", "StdQty_to_AvgQty"]
FULL_COLS = ["MatID", "SKU", "year", "month", "Vendor", "SubCategory", "Classification", "POGS",
             "Facings", "Depth", "Capacity", "ProposedDepth", "VarianceDepth", "Capacity_to_qty",
             "totalMonthlyNetSale", "totalMonthlyGrossSale", "totalMonthlyQtySold", "Price",
             "SellMargin", "Qty_GeoMean_by_month_Subcat", "NS_GeoMean_by_month_Subcat",
             "Qty_mean_by_month_Subcat", "NS_mean_by_month_Subcat", "Qty_std_by_month_Subcat",
             "NS_std_by_month_Subcat"]
BAND_COLS = ["MatID", "SKU", "year", "month", "Vendor", "SubCategory", "Classification",
             "Facings", "Depth", "Capacity", "Capacity_to_qty", "totalMonthlyNetSale",
             "totalMonthlyGrossSale", "totalMonthlyQtySold", "Price", "SellMargin",
             "Qty_GeoMean_by_month_Subcat", "NS_GeoMean_by_month_Subcat",
             "Qty_mean_by_month_Subcat", "NS_mean_by_month_Subcat",
             "Qty_std_by_month_Subcat", "NS_std_by_month_Subcat", "Capacity_to_sales"]
OVER_COLS = ["MatID", "SKU", "year", "month", "SubCategory", "Vendor", "Classification",
             "Facings", "Capacity", "totalMonthlyQtySold", "totalMonthlyNetSale"]

_A = inv_ctes("part", PERIOD_A)
_A_OFF = inv_ctes("part", PERIOD_A, promo=False)
_G = inv_ctes("group", PERIOD_A)
_SPLIT_A = PERIOD_A[2]

SQL["inv_sales_clean"] = f"WITH {_A} SELECT {cols(SALES_COLS, DOUBLES)} FROM sales"
SQL["inv_monthly"] = f"WITH {_A} SELECT {cols(MART_COLS, DOUBLES)} FROM mart"
SQL["inv_check"] = f"""WITH {_A},
chk AS (SELECT r.SKU, r.MatID, CAST(m.year AS DOUBLE) AS year, CAST(m.month AS DOUBLE) AS month,
               m.Price, r.POGS, r.Facings, r.Capacity,
               r.Classification, m.SubCategory, m.totalMonthlyNetSale, m.totalMonthlyQtySold,
               m.SellMargin
        FROM report r LEFT JOIN mart m ON r.MatID = m.MatID
        WHERE coalesce(m.totalMonthlyGrossSale, 0) = 0)
SELECT {cols(ISSUE_COLS, DOUBLES | {"year", "month"})} FROM chk"""
SQL["inv_removed"] = f"""WITH {_A},
act AS (SELECT MatID,
               bool_or(totalMonthlyGrossSale <> 0 AND period < DATE '{_SPLIT_A}') AS se,
               bool_or(totalMonthlyGrossSale <> 0 AND period >= DATE '{_SPLIT_A}') AS sl
        FROM mart GROUP BY MatID),
rem AS (SELECT r.SKU, r.MatID, m.year, m.month, m.Price, r.POGS, r.Facings, r.Capacity,
               r.Classification, m.SubCategory, m.totalMonthlyNetSale, m.totalMonthlyQtySold,
               m.SellMargin
        FROM report r JOIN early m ON r.MatID = m.MatID
        WHERE r.MatID IN (SELECT MatID FROM act WHERE se AND NOT coalesce(sl, FALSE)))
SELECT {cols(ISSUE_COLS, DOUBLES)} FROM rem"""
SQL["inv_new"] = f"""WITH {_A_OFF}
SELECT {cols(["MatID", "year", "month", "SubCategory", "Vendor", "Price", "totalMonthlyNetSale",
              "totalMonthlyGrossSale", "totalMonthlyQtySold", "SellMargin"], DOUBLES)}
FROM late
WHERE coalesce(totalMonthlyGrossSale, 0) <> 0
  AND MatID NOT IN (SELECT MatID FROM report WHERE MatID IS NOT NULL)"""
SQL["inv_bad_record"] = f"WITH {_A} SELECT {cols(RECORD_COLS, DOUBLES)} FROM base WHERE Depth > 6"
SQL["inv_depth_lt2"] = f"WITH {_A} SELECT {cols(RECORD_COLS, DOUBLES)} FROM base WHERE Depth < 2"
SQL["inv_issue_counts"] = f"""WITH {_A},
act AS (SELECT MatID,
               bool_or(totalMonthlyGrossSale <> 0 AND period < DATE '{_SPLIT_A}') AS se,
               bool_or(totalMonthlyGrossSale <> 0 AND period >= DATE '{_SPLIT_A}') AS sl
        FROM mart GROUP BY MatID),
chk AS (SELECT r.MatID FROM report r LEFT JOIN mart m ON r.MatID = m.MatID
        WHERE coalesce(m.totalMonthlyGrossSale, 0) = 0),
rem AS (SELECT r.MatID FROM report r JOIN early m ON r.MatID = m.MatID
        WHERE r.MatID IN (SELECT MatID FROM act WHERE se AND NOT coalesce(sl, FALSE))),
nw AS (SELECT MatID FROM late WHERE coalesce(totalMonthlyGrossSale, 0) <> 0
         AND MatID NOT IN (SELECT mid FROM groups WHERE NOT starts_with(p_type, 'PROMO')))
SELECT 'check' AS issue, count(*) AS n_rows, count(DISTINCT MatID) AS n_items FROM chk
UNION ALL SELECT 'removed', count(*), count(DISTINCT MatID) FROM rem
UNION ALL SELECT 'new', count(*), count(DISTINCT MatID) FROM nw
UNION ALL SELECT 'bad_record', count(*), count(DISTINCT MatID) FROM base WHERE Depth > 6
UNION ALL SELECT 'depth_lt2', count(*), count(DISTINCT MatID) FROM base WHERE Depth < 2"""
SQL["inv_enriched"] = f"WITH {_A} SELECT {cols(ENRICHED_COLS, DOUBLES)} FROM enriched"
SQL["inv_at_least_one"] = f"WITH {_A} SELECT DISTINCT {cols(ATL_COLS, DOUBLES)} FROM atl"
SQL["inv_unadjusted_buckets"] = f"""WITH {_A},
items AS (SELECT DISTINCT {', '.join(ATL_COLS)} FROM atl),
b AS (SELECT *, CASE WHEN Capacity_to_avg_qty < 3 THEN 'lessThan3'
                     WHEN Capacity_to_avg_qty < 9 THEN 'between3And9'
                     WHEN Capacity_to_avg_qty >= 9 THEN 'moreThan9' END AS bucket
      FROM items WHERE Depth < 4)
SELECT {cols(ATL_COLS, DOUBLES)}, bucket FROM b WHERE bucket IS NOT NULL"""
SQL["inv_full_month"] = f"""WITH {_G}
SELECT DISTINCT {cols(FULL_COLS, DOUBLES)} FROM rows WHERE MatID IN (SELECT MatID FROM full_ids)"""
SQL["inv_over_spaced_x2"] = f"""WITH {_G},
flag AS (SELECT * FROM base WHERE totalMonthlyQtySold * 2.0 < Capacity),
ids AS (SELECT MatID FROM flag
        WHERE period IN (DATE '{_SPLIT_A}', DATE '{_SPLIT_A}' + INTERVAL 1 MONTH,
                         DATE '{_SPLIT_A}' + INTERVAL 2 MONTH)
        GROUP BY MatID HAVING count(DISTINCT period) = 3)
SELECT {cols(OVER_COLS, DOUBLES)} FROM flag WHERE MatID IN (SELECT MatID FROM ids)"""
SQL["inv_bands"] = f"""WITH {_A},
bd AS (SELECT *, CASE WHEN totalMonthlyQtySold >= Capacity THEN 0
                      WHEN totalMonthlyQtySold * 2 >= Capacity THEN 1
                      WHEN totalMonthlyQtySold * 3 >= Capacity THEN 2
                      WHEN totalMonthlyQtySold * 4 >= Capacity THEN 3
                      WHEN totalMonthlyQtySold * 4 < Capacity THEN 4 END AS band
       FROM enriched)
SELECT DISTINCT {cols(BAND_COLS, DOUBLES)}, band FROM bd WHERE band IS NOT NULL"""


# -------------------------------------------------------------- Compare
_CA = inv_ctes("group", PERIOD_A, later=False, tag="_a")
_CB = inv_ctes("group", PERIOD_B, later=True, tag="_b")
_FULL_SEL = ", ".join(FULL_COLS)
CMP_BASE = f"""{_CA}, {_CB},
full_a AS (SELECT DISTINCT {_FULL_SEL} FROM rows_a WHERE MatID IN (SELECT MatID FROM full_ids_a)),
full_b AS (SELECT DISTINCT {_FULL_SEL} FROM rows_b WHERE MatID IN (SELECT MatID FROM full_ids_b)),
diff AS (
  SELECT a.MatID, a.SKU, a.POGS AS POGS_first, a.Facings AS Facings_first,
         a.Capacity AS Capacity_first, b.POGS AS POGS_later, b.Facings AS Facings_later,
         b.Capacity AS Capacity_later,
         (a.Capacity IS DISTINCT FROM b.Capacity OR a.Facings IS DISTINCT FROM b.Facings) AS changed,
         coalesce(a.Capacity > b.Capacity, FALSE) AS capacity_decreased,
         coalesce(a.Capacity < b.Capacity, FALSE) AS capacity_increased
  FROM report_a a JOIN report_b b ON a.MatID = b.MatID AND a.SKU = b.SKU),
ids_a AS (SELECT DISTINCT MatID, SKU FROM full_a),
ids_b AS (SELECT DISTINCT MatID, SKU FROM full_b),
common AS (SELECT MatID, SKU FROM ids_a INTERSECT SELECT MatID, SKU FROM ids_b),
persist AS (
  SELECT u.*, ra.StdQty_to_AvgQty AS StdQty_to_AvgQty_first, rb.StdQty_to_AvgQty AS StdQty_to_AvgQty_later
  FROM (SELECT *, '2000-07' AS period_label FROM full_a
        UNION ALL SELECT *, '2000-09' AS period_label FROM full_b) u
  LEFT JOIN (SELECT DISTINCT MatID, StdQty_to_AvgQty FROM atl_a) ra ON u.MatID = ra.MatID
  LEFT JOIN (SELECT DISTINCT MatID, StdQty_to_AvgQty FROM atl_b) rb ON u.MatID = rb.MatID
  WHERE (u.MatID, u.SKU) IN (SELECT (MatID, SKU) FROM common))
"""

SQL["cmp_report_diff"] = f"""WITH {CMP_BASE}
SELECT MatID, SKU, POGS_first, {R('Facings_first')} AS Facings_first,
       {R('Capacity_first')} AS Capacity_first, POGS_later, {R('Facings_later')} AS Facings_later,
       {R('Capacity_later')} AS Capacity_later, {B('changed')} AS changed,
       {B('capacity_decreased')} AS capacity_decreased, {B('capacity_increased')} AS capacity_increased
FROM diff WHERE changed"""

SQL["cmp_capacity_vs_full"] = f"""WITH {CMP_BASE},
d AS (SELECT diff.MatID, diff.SKU,
             CASE WHEN capacity_decreased THEN 'decreased' WHEN capacity_increased THEN 'increased' END
               AS direction,
             ids_a.MatID IS NOT NULL AS in_first, common.MatID IS NOT NULL AS in_both
      FROM diff
      LEFT JOIN ids_a ON diff.MatID = ids_a.MatID AND diff.SKU = ids_a.SKU
      LEFT JOIN common ON diff.MatID = common.MatID AND diff.SKU = common.SKU
      WHERE changed)
SELECT direction, count(*) AS n_items,
       count(DISTINCT CASE WHEN in_first THEN MatID END) AS n_full_month_first,
       count(DISTINCT CASE WHEN in_both THEN MatID END) AS n_full_month_both
FROM d WHERE direction IS NOT NULL GROUP BY direction"""

SQL["cmp_persistent"] = f"""WITH {CMP_BASE}
SELECT {cols(FULL_COLS, DOUBLES)}, period_label,
       {R('StdQty_to_AvgQty_first')} AS StdQty_to_AvgQty_first,
       {R('StdQty_to_AvgQty_later')} AS StdQty_to_AvgQty_later
FROM persist"""

SQL["cmp_obs_check"] = f"""WITH {CMP_BASE}
SELECT MatID, SKU, count(*) AS n_obs, {B('count(*) = 6')} AS ok FROM persist GROUP BY MatID, SKU"""

SQL["cmp_only_one_period"] = f"""WITH {CMP_BASE}
SELECT MatID, SKU, '2000-07' AS only_in FROM (SELECT * FROM ids_a EXCEPT SELECT * FROM ids_b)
UNION ALL
SELECT MatID, SKU, '2000-09' AS only_in FROM (SELECT * FROM ids_b EXCEPT SELECT * FROM ids_a)"""


# -------------------------------------------------------------- Profile
def _describe(columns, by=None):
    key = f"{by}, " if by else ""
    parts = []
    for c in columns:
        parts.append(f"""SELECT {key}'{c}' AS "column", count({c}) AS "count", {R(f'avg({c})')} AS mean,
       {R(f'stddev_samp({c})')} AS std, {R(f'min({c})')} AS "min", {R(f'max({c})')} AS "max"
FROM enriched{' GROUP BY ' + by if by else ''}""")
    return "\nUNION ALL\n".join(parts)


SQL["profile_summary"] = f"WITH {_A}\n" + _describe(
    ["Facings", "Capacity", "totalMonthlyQtySold", "SellMargin"])
SQL["profile_by_class"] = f"WITH {_A}\n" + _describe(["Price", "SellMargin"], "Classification")
SQL["profile_corr"] = f"""WITH {_A}
SELECT {R('corr(totalMonthlyNetSale, totalMonthlyGrossSale)')} AS corr_net_gross,
       {R('corr(Facings, totalMonthlyQtySold)')} AS corr_facings_qty, count(*) AS n_rows
FROM enriched"""
SQL["profile_share"] = f"""WITH {_A}
SELECT SubCategory, {R('sum(totalMonthlyQtySold)')} AS total, {R('avg(totalMonthlyQtySold)')} AS mean,
       {R('sum(totalMonthlyQtySold) / (SELECT sum(totalMonthlyQtySold) FROM enriched) * 100')} AS share_pct,
       {R('avg(totalMonthlyQtySold) / (SELECT avg(totalMonthlyQtySold) FROM enriched) * 100')} AS mean_pct
FROM enriched GROUP BY SubCategory"""
SQL["profile_margin_rate"] = f"""WITH {_A}
SELECT Classification, {R('sum(SellMargin)')} AS sell_margin, {R('sum(totalMonthlyNetSale)')} AS net_sales,
       {R(_div('sum(SellMargin)', 'sum(totalMonthlyNetSale)'))} AS margin_rate
FROM enriched GROUP BY Classification"""
SQL["profile_class_month"] = f"""WITH {_A}
SELECT Classification, year, month, {R('sum(SellMargin)')} AS total, {R('avg(SellMargin)')} AS mean,
       count(*) AS n_rows
FROM enriched GROUP BY Classification, year, month"""
SQL["profile_geo_means"] = f"""WITH {_A}
SELECT SubCategory, year, month, {R('avg(Qty_GeoMean_by_month_Subcat)')} AS qty_geo_mean,
       {R('avg(NS_GeoMean_by_month_Subcat)')} AS NS_geo_mean
FROM enriched GROUP BY SubCategory, year, month"""
SQL["profile_class_counts"] = f"""WITH {_A}
SELECT Classification, count(*) AS n_rows, count(DISTINCT MatID) AS n_items
FROM enriched GROUP BY Classification"""
SQL["profile_margin_bands"] = f"""WITH {_A},
m AS (SELECT *, {_div('SellMargin', 'totalMonthlyNetSale')} AS margin_ratio FROM enriched),
b AS (SELECT *, CASE WHEN margin_ratio >= 0.8 THEN 'high' WHEN margin_ratio < 0.4 THEN 'low' END
              AS margin_band FROM m)
SELECT MatID, SKU, year, month, Classification, {R('SellMargin')} AS SellMargin,
       {R('totalMonthlyNetSale')} AS totalMonthlyNetSale, {R('margin_ratio')} AS margin_ratio,
       margin_band
FROM b WHERE margin_band IS NOT NULL"""
SQL["profile_selected_share"] = f"""WITH {_G},
fm AS (SELECT DISTINCT {_FULL_SEL} FROM rows WHERE MatID IN (SELECT MatID FROM full_ids)),
sel AS (SELECT Classification, count(DISTINCT MatID) AS n_items, sum(SellMargin) AS selected_margin,
               sum(totalMonthlyNetSale) AS selected_net_sales FROM fm GROUP BY Classification),
allm AS (SELECT Classification, sum(SellMargin) AS class_margin FROM enriched GROUP BY Classification)
SELECT s.Classification, s.n_items, {R('s.selected_margin')} AS selected_margin,
       {R('s.selected_net_sales')} AS selected_net_sales, {R('a.class_margin')} AS class_margin,
       {R(_div('s.selected_margin', 'a.class_margin') + ' * 100')} AS margin_share_pct
FROM sel s LEFT JOIN allm a ON s.Classification = a.Classification"""
SQL["profile_histogram"] = f"""WITH {_A},
bnd AS (SELECT min(Price) AS lo, max(Price) AS hi FROM enriched),
h AS (SELECT Price, CASE WHEN hi = lo THEN 1
                         ELSE least(10, CAST(floor({_div('Price - lo', 'hi - lo')} * 10) AS BIGINT) + 1) END AS bin
      FROM enriched, bnd WHERE Price IS NOT NULL)
SELECT bin, count(*) AS n, {R('min(Price)')} AS bin_min, {R('max(Price)')} AS bin_max FROM h GROUP BY bin"""
SQL["profile_quartiles"] = f"WITH {_A}\n" + "\nUNION ALL\n".join(
    f"""SELECT Classification, '{c}' AS "column", {R(f'quantile_cont({c}, 0.25)')} AS p25,
       {R(f'quantile_cont({c}, 0.5)')} AS p50, {R(f'quantile_cont({c}, 0.75)')} AS p75
FROM enriched GROUP BY Classification""" for c in ("Price", "SellMargin"))

SQL["inv_adjusted"] = f"""WITH {_A},
items AS (SELECT DISTINCT {', '.join(ATL_COLS)} FROM atl)
SELECT {cols(ATL_COLS, DOUBLES)} FROM items WHERE ProposedDepth = 3"""

SQL["inv_over_spaced_facings"] = f"""WITH {_G},
flag AS (SELECT * FROM base WHERE totalMonthlyQtySold * 1.0 < Facings),
ids AS (SELECT MatID FROM flag
        WHERE period IN (DATE '{_SPLIT_A}', DATE '{_SPLIT_A}' + INTERVAL 1 MONTH,
                         DATE '{_SPLIT_A}' + INTERVAL 2 MONTH)
        GROUP BY MatID HAVING count(DISTINCT period) = 3)
SELECT {cols(OVER_COLS, DOUBLES)} FROM flag WHERE MatID IN (SELECT MatID FROM ids)"""

SQL["profile_eight_number"] = f"WITH {_A}\n" + "\nUNION ALL\n".join(
    f"""SELECT Classification, '{c}' AS "column", count({c}) AS "count", {R(f'avg({c})')} AS mean,
       {R(f'stddev_samp({c})')} AS std, {R(f'min({c})')} AS "min",
       {R(f'quantile_cont({c}, 0.25)')} AS p25, {R(f'quantile_cont({c}, 0.5)')} AS p50,
       {R(f'quantile_cont({c}, 0.75)')} AS p75, {R(f'max({c})')} AS "max"
FROM enriched GROUP BY Classification""" for c in ("Price", "SellMargin"))

# every supplier is a store; the report applies to all stores
SQL["inv_store_at_least_one"] = f"""WITH
parts AS (SELECT CAST(p_partkey AS INTEGER) AS mid, p_type, p_brand, p_name, p_size FROM part),
sales AS (
  SELECT CAST(l_shipdate AS DATE) AS Date, 'S' || CAST(l_suppkey AS VARCHAR) AS Store,
         CAST(l_partkey AS INTEGER) AS MatID,
         l_extendedprice AS GrossSales, l_extendedprice * (1.0 - l_discount) AS NetSales,
         -0.6 * l_extendedprice AS COGS, l_quantity AS QtySold,
         {_div('l_extendedprice', 'l_quantity')} AS Price,
         l_extendedprice + (-0.6 * l_extendedprice) AS FrontMargin,
         l_extendedprice * (1.0 - l_discount) + (-0.6 * l_extendedprice) AS SellMargin,
         g.p_type AS SubCategory, g.p_brand AS Vendor
  FROM lineitem LEFT JOIN parts g ON g.mid = CAST(l_partkey AS INTEGER)
  WHERE l_shipdate >= TIMESTAMP '{PERIOD_A[0]}' AND l_shipdate < TIMESTAMP '{PERIOD_A[1]}'),
mart AS (
  SELECT Store, CAST(year(Date) AS INTEGER) AS year, CAST(month(Date) AS INTEGER) AS month,
         CAST(date_trunc('month', Date) AS DATE) AS period, MatID, SubCategory, Vendor,
         avg(NetSales) AS totalMonthlyNetSale, avg(QtySold) AS totalMonthlyQtySold
  FROM sales WHERE MatID IS NOT NULL AND SubCategory IS NOT NULL AND Vendor IS NOT NULL
  GROUP BY 1, 2, 3, 4, 5, 6, 7),
report AS (
  SELECT mid AS MatID, CAST(mid AS VARCHAR) || ' ' || p_name AS SKU,
         CAST(1 + mid % 5 AS DOUBLE) AS Facings, CAST(p_size AS DOUBLE) AS Capacity,
         {_cls('CAST(p_size AS DOUBLE)')} AS Classification, CAST(1 + mid % 3 AS INTEGER) AS POGS
  FROM parts),
base AS (
  SELECT r.*, m.Store, m.year, m.month, m.SubCategory, m.Vendor, m.totalMonthlyNetSale,
         m.totalMonthlyQtySold, {_div('r.Capacity', 'r.Facings')} AS Depth
  FROM report r JOIN mart m ON r.MatID = m.MatID WHERE m.period >= DATE '{PERIOD_A[2]}'),
rows AS (SELECT * FROM base WHERE totalMonthlyQtySold < Capacity),
per_item AS (
  SELECT Store, MatID, SubCategory, Vendor, avg(totalMonthlyQtySold) AS AvgQtySold,
         stddev_samp(totalMonthlyQtySold) AS Qty_std_by_SKU
  FROM base WHERE totalMonthlyNetSale <> 0 GROUP BY Store, MatID, SubCategory, Vendor),
atl AS (
  SELECT r.*, CASE WHEN r.Depth >= 4 THEN 3.0 END AS ProposedDepth,
         CASE WHEN r.Depth >= 4 THEN 3.0 - r.Depth END AS VarianceDepth,
         p.AvgQtySold, p.Qty_std_by_SKU,
         {_div('r.Capacity', 'p.AvgQtySold')} AS Capacity_to_avg_qty,
         {_div('r.Facings', 'p.AvgQtySold')} AS Facing_to_avg_qty,
         {_div('p.Qty_std_by_SKU', 'p.AvgQtySold')} AS StdQty_to_AvgQty
  FROM rows r LEFT JOIN per_item p
    ON r.Store = p.Store AND r.MatID = p.MatID AND r.SubCategory = p.SubCategory AND r.Vendor = p.Vendor)
SELECT DISTINCT Store, {cols(ATL_COLS, DOUBLES)} FROM atl"""

_BOX = f"""WITH {_A},
quart AS (
  SELECT Classification, year, month, quantile_cont(Price, 0.25) AS p25, quantile_cont(Price, 0.5) AS p50,
         quantile_cont(Price, 0.75) AS p75
  FROM enriched WHERE Price IS NOT NULL GROUP BY ALL),
fenced AS (
  SELECT e.Classification, e.year, e.month, e.MatID, e.Price, q.p25, q.p50, q.p75,
         q.p25 - 1.5 * (q.p75 - q.p25) AS low, q.p75 + 1.5 * (q.p75 - q.p25) AS high
  FROM enriched e JOIN quart q ON e.Classification = q.Classification AND e.year = q.year AND e.month = q.month
  WHERE e.Price IS NOT NULL)
"""

SQL["profile_box_plot"] = _BOX + f"""
SELECT Classification, year, month, count(*) AS n, {R('any_value(p25)')} AS p25, {R('any_value(p50)')} AS p50,
       {R('any_value(p75)')} AS p75,
       {R('min(Price) FILTER (WHERE Price BETWEEN low AND high)')} AS whisker_low,
       {R('max(Price) FILTER (WHERE Price BETWEEN low AND high)')} AS whisker_high,
       count(*) FILTER (WHERE Price < low) AS n_low, count(*) FILTER (WHERE Price > high) AS n_high
FROM fenced GROUP BY Classification, year, month"""

SQL["profile_box_outliers"] = _BOX + f"""
SELECT Classification, year, month, MatID, {R('Price')} AS value,
       CASE WHEN Price < low THEN 'low' ELSE 'high' END AS side
FROM fenced WHERE Price < low OR Price > high"""

# every day of every pair, by windows over the whole calendar
SQL["oos_daily_state"] = "WITH " + STOCK_FACTS + f""",
days AS (
  SELECT SKU, Store, Date, bool_or(StockQty <> 0) AS stocked, bool_and(StockQty = 0 AND QtySold = 0) AS idle
  FROM dense GROUP BY SKU, Store, Date),
state AS (
  SELECT *, max(CASE WHEN stocked THEN Date END) OVER o AS last_stock_day,
         max(CASE WHEN NOT idle THEN Date END) OVER o AS last_active_day
  FROM days WINDOW o AS (PARTITION BY SKU, Store ORDER BY Date))
SELECT SKU, Store, strftime(Date, '%Y-%m-%d') AS Date, {B('last_stock_day IS NOT NULL')} AS had_stock,
       strftime(last_stock_day, '%Y-%m-%d') AS last_stock_day,
       CAST(Date - coalesce(last_active_day, d0 - 1) AS INTEGER) AS idle_run
FROM state CROSS JOIN bounds"""

# stores per item the long way: the gaps of the sorted places of its stores
SQL["inv_check_by_store"] = f"""WITH {_A},
pairs AS (
  SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS Store, CAST(l_partkey AS INTEGER) AS MatID,
         date_trunc('month', l_shipdate) AS m, avg(l_extendedprice) AS gross
  FROM lineitem WHERE l_shipdate >= TIMESTAMP '{PERIOD_A[0]}' AND l_shipdate < TIMESTAMP '{PERIOD_A[1]}'
    AND l_partkey IN (SELECT p_partkey FROM part WHERE p_type IS NOT NULL AND p_brand IS NOT NULL)
  GROUP BY 1, 2, 3),
stores AS (SELECT Store, row_number() OVER (ORDER BY Store) - 1 AS place FROM (SELECT DISTINCT Store FROM pairs)),
present AS (
  SELECT MatID, place, max(CASE WHEN gross = 0 THEN 1 ELSE 0 END) AS unsold
  FROM pairs JOIN stores USING (Store) GROUP BY 1, 2),
edges AS (
  SELECT MatID, place FROM present
  UNION ALL SELECT MatID, -1 FROM report UNION ALL SELECT MatID, (SELECT count(*) FROM stores) FROM report),
gaps AS (SELECT MatID, place + 1 AS lo, lead(place) OVER (PARTITION BY MatID ORDER BY place) - 1 AS hi FROM edges),
absent AS (
  SELECT MatID, sum(hi - lo + 1) AS n,
         string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '-' || hi END, ',' ORDER BY lo) AS absent
  FROM gaps WHERE hi >= lo GROUP BY MatID),
unsold AS (SELECT MatID, sum(unsold) AS n FROM present GROUP BY MatID)
SELECT r.MatID, r.SKU, r.Classification, CAST(coalesce(a.n, 0) AS BIGINT) AS n_absent,
       CAST(coalesce(u.n, 0) AS BIGINT) AS n_unsold, coalesce(a.absent, '') AS absent
FROM report r LEFT JOIN absent a USING (MatID) LEFT JOIN unsold u USING (MatID)
WHERE coalesce(a.n, 0) > 0 OR coalesce(u.n, 0) > 0"""

SQL["rank_top_weeks"] = "WITH " + RANK_BASE + f"""
SELECT Date, SKU, Store, {R('NetSales')} AS NetSales, CAST(rank AS INTEGER) AS rank FROM rw
WHERE NetSales > 0 AND rank <= 50"""

SQL["rank_preview"] = "WITH " + RANK_BASE + f"""
SELECT Date, SKU, Store, Concept_NEW, {R('NetSales')} AS NetSales FROM rw
ORDER BY rw.NetSales DESC, Date, SKU, Store LIMIT 3"""

SQL["sql_oos_7_days"] = SQL["oos_7_days"]
SQL["sql_rank_newcomer"] = SQL["rank_newcomer"]
SQL["sql_lists"] = "WITH " + RANK_BASE + """
SELECT DISTINCT 'pair' AS list, SKU, Store, CAST(NULL AS VARCHAR) AS concept, CAST(NULL AS VARCHAR) AS week FROM rw
UNION ALL SELECT DISTINCT 'triple', SKU, Store, Concept_NEW, NULL FROM rw
UNION ALL SELECT DISTINCT 'week', NULL, NULL, NULL, Date FROM rw
UNION ALL SELECT DISTINCT 'concept', NULL, NULL, Concept_NEW, NULL FROM rw"""

SQL["profile_one_class"] = f"WITH {_A}\n" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", count({c}) AS "count", {R(f'avg({c})')} AS mean, {R(f'stddev_samp({c})')} AS std,
       {R(f'min({c})')} AS "min", {R(f'max({c})')} AS "max" FROM enriched WHERE Classification = 'A'""" for c in ("Price", "SellMargin"))
