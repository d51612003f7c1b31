"""Raw input layouts (as exported by the point-of-sale warehouse) and the
short names the operators use after cleaning.

Fixed values: the business column headers below must equal the exported
files' headers exactly, so they are stated here once, in natural order.
"""

from __future__ import annotations

from pyspark.sql.types import StringType, StructField, StructType


def _text(*names: str) -> StructType:
    """CSV exports are read as text with an explicit schema (no inference
    pass over the data); cleaning casts with ``try_cast``."""
    return StructType([StructField(n, StringType(), True) for n in names])


# --- fixed values: raw headers -------------------------------------------
STOCK_DAILY_RAW = ("SKU", "Store", "Category", "Date", "POS Net Sales",
                   "POS Qty Sold", "POS Margin on Net Sales", "Stock Balance Qty")
CLOSED_STORES_RAW = ("Store", "Status")
RANK_WEEKLY_RAW = ("Index", "Date Detail", "Company", "Business Unit", "Concept_NEW",
                   "Product Category", "Company and Cost Centre", "SKU",
                   "POS Net Sales", "Rank Total")
SALES_MONTHLY_RAW = ("Date", "Store", "item", "POS Gross Sales", "POS Net Sales",
                     "POS Total Discount", "POS Qty Sold", "POS COGS (INV)")
DIST_REPORT_RAW = ("Name", "Facings", "Capacity", "Days Supply", "Classification",
                   "Mat ID", "# POGs")
SUBCATEGORY_RAW = ("SKU", "SubCategory")
VENDOR_RAW = ("SKU", "Vendor")

# --- fixed values: raw header -> short name -------------------------------
STOCK_DAILY_RENAME = {
    "POS Margin on Net Sales": "Margin",
    "POS Net Sales": "NetSales",
    "Stock Balance Qty": "StockQty",
    "POS Qty Sold": "QtySold",
}
RANK_WEEKLY_RENAME = {
    "POS Net Sales": "NetSales",
    "Date Detail": "Date",
    "Product Category": "Category",
    "Company and Cost Centre": "Store",
    "Business Unit": "BusinessUnit",
    "Rank Total": "rank",
}
SALES_MONTHLY_RENAME = {
    "POS Gross Sales": "GrossSales",
    "POS Net Sales": "NetSales",
    "POS Total Discount": "TotalDiscount",
    "POS Qty Sold": "QtySold",
    "POS COGS (INV)": "COGS",
}
DIST_REPORT_RENAME = {
    "Name": "SKU",
    "Days Supply": "DaysSupply",
    "Mat ID": "MatID",
    "# POGs": "POGS",
}

# Date formats of the exports.
DAY_FORMAT = "yyyyMMdd"
MONTH_FORMAT = "yyyyMM"

STOCK_DAILY_SCHEMA = _text(*STOCK_DAILY_RAW)
CLOSED_STORES_SCHEMA = _text(*CLOSED_STORES_RAW)
RANK_WEEKLY_SCHEMA = _text(*RANK_WEEKLY_RAW)
SALES_MONTHLY_SCHEMA = _text(*SALES_MONTHLY_RAW)
DIST_REPORT_SCHEMA = _text(*DIST_REPORT_RAW)
SUBCATEGORY_SCHEMA = _text(*SUBCATEGORY_RAW)
VENDOR_SCHEMA = _text(*VENDOR_RAW)
