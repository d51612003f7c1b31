"""Inventory chain against pandas on random fixtures with zero quantities,
zero facings and zero sales (cases the generated tables never produce)."""

import datetime as dt
import math
import random

import pandas as pd
import pytest

from shelfsight.operators import inventory as inv

SPLIT = "2019-07-01"


@pytest.mark.parametrize("seed", range(3))
def test_chain_matches_pandas(spark, seed):
    rnd = random.Random(seed)
    sales = []
    for mid in range(1, 9):
        for m in range(4, 10):
            for _ in range(rnd.choice([0, 1, 2, 3])):
                qty = rnd.choice([0.0, 1.0, 2.0, 5.0, 9.0])
                gross = rnd.choice([0.0, 10.0, 25.0])
                sales.append((dt.date(2019, m, rnd.randint(1, 28)), "S", f"NZDF{mid}-X",
                              gross, gross * 0.9, 0.0, qty, -0.5 * gross))
    raw = spark.createDataFrame(sales, "Date date, Store string, item string, `POS Gross Sales` double, "
                                       "`POS Net Sales` double, `POS Total Discount` double, "
                                       "`POS Qty Sold` double, `POS COGS (INV)` double")
    look = spark.createDataFrame([(f"NZDF{m}-X", f"1-Sub{m % 2}") for m in range(1, 9)], "SKU string, SubCategory string")
    ven = spark.createDataFrame([(f"NZDF{m}-X", "1-V") for m in range(1, 9)], "SKU string, Vendor string")
    report = inv.clean_report(spark.createDataFrame(
        [(f"I{m}", float(rnd.choice([0, 1, 2])), float(rnd.choice([1, 3, 8, 12])), 1.0, "A", m, 1)
         for m in range(1, 9)],
        "Name string, Facings double, Capacity double, `Days Supply` double, Classification string, "
        "`Mat ID` int, `# POGs` int"))
    mart = inv.monthly_mart(inv.clean_sales(raw, inv.clean_lookup(look, "SubCategory"),
                                            inv.clean_lookup(ven, "Vendor")))
    _, late = inv.split_periods(mart, SPLIT)
    enr = inv.enrich(inv.analysis_base(late, report))
    res = inv.at_least_one_month(enr)

    # pandas, written from the definitions
    s = pd.DataFrame(sales, columns=["Date", "Store", "item", "g", "n", "d", "q", "c"])
    s["MatID"] = s["item"].str.slice(4, 5).astype(int)
    s["month"] = s["Date"].map(lambda d: d.month)
    s["price"] = s.apply(lambda r: r.g / r.q if r.q != 0 else math.nan, axis=1)
    m = s.groupby(["MatID", "month"]).agg(qty=("q", "mean"), ns=("n", "mean"), price=("price", "mean")).reset_index()
    rep = report.toPandas()
    b = m[m.month >= 7].merge(rep, on="MatID")
    b["sub"] = b.MatID.map(lambda x: f"Sub{x % 2}")
    got = {(r["MatID"], r["month"]): r for r in enr.collect()}
    assert set(got) == set(zip(b.MatID, b.month))
    for _, r in b.iterrows():
        g = got[(r.MatID, r.month)]
        grp = b[(b.month == r.month) & (b["sub"] == r["sub"])]
        pos = grp.qty[grp.qty > 0]
        geo = math.exp(pos.map(math.log).mean()) if len(pos) else None
        assert (g["Qty_GeoMean_by_month_Subcat"] is None) == (geo is None)
        if geo is not None:
            assert g["Qty_GeoMean_by_month_Subcat"] == pytest.approx(geo)
        assert g["Qty_mean_by_month_Subcat"] == pytest.approx(grp.qty.mean())
        std = grp.qty.std(ddof=1)
        assert (g["Qty_std_by_month_Subcat"] is None) == (len(grp) < 2)
        if len(grp) >= 2:
            assert g["Qty_std_by_month_Subcat"] == pytest.approx(std, abs=1e-9)
        depth = r.Capacity / r.Facings if r.Facings != 0 else None
        assert (g["Depth"] is None) == (depth is None)
        if depth is not None:
            assert g["Depth"] == pytest.approx(depth)
            assert g["ProposedDepth"] == (3.0 if depth >= 4 else None)
        if (g["Price"] is None) != bool(math.isnan(r.price)):
            raise AssertionError((g["Price"], r.price))
    # at least one month: rows with qty < capacity; per-item stats over months with sales
    flagged = b[b.qty < b.Capacity]
    items = {r["MatID"]: r for r in res["items"].collect()}
    assert set(items) == set(flagged.MatID)
    for mid in items:
        sold = b[(b.MatID == mid) & (b.ns != 0)]
        want = sold.qty.mean() if len(sold) else None
        assert (items[mid]["AvgQtySold"] is None) == (want is None)
        if want is not None:
            assert items[mid]["AvgQtySold"] == pytest.approx(want)
