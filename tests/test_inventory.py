"""Inventory operators on hand-made rows: cleaning, mart, issue lists, bands, depths."""

import pytest

from shelfsight.operators import inventory as inv

SPLIT = "2019-07-01"


def sales_raw(spark, rows):
    return spark.createDataFrame(rows, ["Date", "Store", "item", "POS Gross Sales", "POS Net Sales",
                                        "POS Total Discount", "POS Qty Sold", "POS COGS (INV)"])


def lookups(spark):
    sub = inv.clean_lookup(spark.createDataFrame(
        [("NZDF1-Tea", "10-Drinks"), ("NZDF2-Gum", "20-Sweets"), ("NZDF2-Gum", "21-Candy"),
         ("NZDF3-Pen", "30-Stationery")], ["SKU", "SubCategory"]), "SubCategory")
    ven = inv.clean_lookup(spark.createDataFrame(
        [("NZDF1-Tea", "7-Acme"), ("NZDF2-Gum", "8-Bolt")], ["SKU", "Vendor"]), "Vendor")
    return sub, ven


def report(spark, rows):
    return inv.clean_report(spark.createDataFrame(
        rows, ["Name", "Facings", "Capacity", "Days Supply", "Classification", "Mat ID", "# POGs"]))


def test_sales_cleaning_parses_text(spark):
    sub, ven = lookups(spark)
    raw = sales_raw(spark, [
        ("201907", "NZDF.AKL108", "NZDF1-Tea-Green", "1,200.50", "1,000", "0", "10", "-600"),
        ("201907", "NZDF.AKL109", "NZDF1-Tea", "5", "5", "0", "1", "-1"),
        ("201903", "NZDF.AKL108", "NZDF1-Tea", "5", "5", "0", "1", "-1"),
        ("201907", "NZDF.AKL108", "NZDF2-Gum", "bad", "5", "0", "0", "-1")])
    s = inv.clean_sales(raw, sub, ven, store="NZDF.AKL108", begin="2019-04-01", end="2019-10-01")
    rows = {r["MatID"]: r for r in s.collect()}
    assert set(rows) == {1, 2}
    tea = rows[1]
    assert tea["SKU"] == "Tea"                       # a name containing '-' is cut at it
    assert tea["GrossSales"] == pytest.approx(1200.5) and tea["NetSales"] == 1000.0
    assert tea["Price"] == pytest.approx(120.05)
    assert tea["SellMargin"] == pytest.approx(400.0) and tea["FrontMargin"] == pytest.approx(600.5)
    assert tea["SubCategory"] == "Drinks" and tea["Vendor"] == "Acme"
    gum = rows[2]
    assert gum["GrossSales"] is None and gum["Price"] is None     # bad text -> NULL; 0 qty -> NULL
    assert gum["SubCategory"] == "Candy"                         # one lookup row per material


def test_mart_averages_and_drops_null_keys(spark):
    sub, ven = lookups(spark)
    raw = sales_raw(spark, [
        ("201907", "S", "NZDF1-Tea", "10", "8", "0", "2", "-5"),
        ("201907", "S", "NZDF1-Tea", "20", "16", "0", "4", "-10"),
        ("201908", "S", "NZDF3-Pen", "20", "16", "0", "4", "-10")])   # no vendor -> left out
    mart = inv.monthly_mart(inv.clean_sales(raw, sub, ven))
    rows = mart.collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["year"], r["month"], r["MatID"]) == (2019, 7, 1)
    assert r["totalMonthlyGrossSale"] == 15.0 and r["totalMonthlyQtySold"] == 3.0
    assert r["SellMargin"] == pytest.approx(4.5) and r["avgCOGS"] == -7.5


def mart_rows(spark, rows):
    """rows: (MatID, 'yyyy-mm', gross, qty, net)"""
    import datetime as dt
    data = []
    for mid, ym, gross, qty, net in rows:
        y, m = map(int, ym.split("-"))
        data.append((y, m, dt.date(y, m, 1), mid, "Drinks", "Acme", float(net), float(gross), -1.0,
                     float(qty), 1.0, 1.0, 1.0))
    return spark.createDataFrame(data, ["year", "month", "period", "MatID", "SubCategory", "Vendor",
                                        "totalMonthlyNetSale", "totalMonthlyGrossSale", "avgCOGS",
                                        "totalMonthlyQtySold", "Price", "SellMargin", "avgFrontMargin"])


def test_issue_lists(spark):
    rep = report(spark, [("Tea", "1", "3", "1", "A", "1", "1"), ("Gum", "1", "8", "1", "B", "2", "1"),
                         ("Pen", "2", "3", "1", "C", "3", "1"), ("Cup", "0", "4", "1", "D", "4", "1")])
    mart = mart_rows(spark, [(1, "2019-05", 10, 1, 5), (1, "2019-07", 10, 1, 5),
                             (2, "2019-05", 10, 1, 5), (2, "2019-08", 0, 0, 0),
                             (4, "2019-07", 10, 1, 5), (9, "2019-08", 10, 1, 5)])
    early, late = inv.split_periods(mart, SPLIT)
    check = {(r["MatID"], r["month"]) for r in inv.check_items(mart, rep).collect()}
    assert check == {(2, 8), (3, None)}
    removed = {r["MatID"] for r in inv.removed_items(early, late, rep, SPLIT).collect()}
    assert removed == {2}
    assert [r["MatID"] for r in inv.new_items(late, rep).collect()] == [9]
    base = inv.analysis_base(late, rep)
    assert {r["MatID"] for r in inv.bad_records(base).collect()} == {2}          # 8 / 1 > 6
    assert {r["MatID"] for r in inv.shallow_items(base).collect()} == set()       # 0 facings: no depth
    counts = {r["issue"]: (r["n_rows"], r["n_items"]) for r in inv.issue_counts(
        {"check": inv.check_items(mart, rep)}).collect()}
    assert counts == {"check": (2, 2)}


def test_depths_and_bands(spark):
    rep = report(spark, [(f"I{i}", f, c, "1", "A", str(i), "1") for i, f, c in
                         [(1, "1", "4"), (2, "1", "3.5"), (3, "0", "4"), (4, "1", "8"), (5, "1", "9"),
                          (6, "1", "12"), (7, "1", "20")]])
    # quantity per material chosen to hit each band edge
    mart = mart_rows(spark, [(1, "2019-07", 1, 4, 1),   # q = cap  -> band 0
                             (2, "2019-07", 1, 1, 1),   # 3.5 in (q, 4q]: band 3
                             (3, "2019-07", 1, 0, 1),   # q = 0 < cap: band 4
                             (4, "2019-07", 1, 4, 1),   # 2q = cap -> band 1
                             (5, "2019-07", 1, 3, 1),   # 3q = cap -> band 2
                             (6, "2019-07", 1, 3, 1),   # 4q = cap -> band 3
                             (7, "2019-07", 1, 4, 1)])  # cap > 4q  -> band 4
    _, late = inv.split_periods(mart, SPLIT)
    enr = inv.enrich(inv.analysis_base(late, rep))
    bands = {r["MatID"]: r["band"] for r in inv.demand_bands(enr).collect()}
    assert bands == {1: 0, 2: 3, 3: 4, 4: 1, 5: 2, 6: 3, 7: 4}
    d = {r["MatID"]: r for r in enr.collect()}
    assert d[1]["ProposedDepth"] == 3.0 and d[1]["VarianceDepth"] == -1.0
    assert d[2]["Depth"] == 3.5 and d[2]["ProposedDepth"] is None
    assert d[3]["Depth"] is None and d[3]["Capacity_to_qty"] is None
    res = inv.at_least_one_month(enr)
    unadj = {r["MatID"] for r in res["unadjusted"].collect()}
    adj = {r["MatID"] for r in res["adjusted"].collect()}
    assert 2 in unadj and 2 not in adj               # depth in [3, 4) counts as unadjusted
    assert {4, 5, 6, 7} <= adj


def test_geometric_mean_skips_non_positive(spark):
    rep = report(spark, [("A", "1", "9", "1", "A", "1", "1"), ("B", "1", "9", "1", "A", "2", "1"),
                         ("C", "1", "9", "1", "A", "3", "1")])
    mart = mart_rows(spark, [(1, "2019-07", 1, 2, 1), (2, "2019-07", 1, 8, 1), (3, "2019-07", 1, 0, 1)])
    _, late = inv.split_periods(mart, SPLIT)
    r = inv.enrich(inv.analysis_base(late, rep)).collect()[0]
    assert r["Qty_GeoMean_by_month_Subcat"] == pytest.approx(4.0)
    assert r["Qty_mean_by_month_Subcat"] == pytest.approx(10 / 3)


def test_full_month_needs_every_month(spark):
    rep = report(spark, [("A", "1", "50", "1", "A", "1", "1"), ("B", "1", "50", "1", "A", "2", "1")])
    mart = mart_rows(spark, [(1, "2019-07", 1, 1, 1), (1, "2019-08", 1, 1, 1), (1, "2019-09", 1, 1, 1),
                             (2, "2019-07", 1, 1, 1), (2, "2019-09", 1, 1, 1)])
    _, late = inv.split_periods(mart, SPLIT)
    res = inv.at_least_one_month(inv.enrich(inv.analysis_base(late, rep)))
    full = inv.full_month(res["rows"], SPLIT)
    assert {r["MatID"] for r in full.collect()} == {1} and full.count() == 3
    items = res["items"].collect()
    one = {r["MatID"]: r for r in items}
    assert one[2]["AvgQtySold"] == 1.0 and one[2]["Qty_std_by_SKU"] == 0.0


def test_buckets(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 8.99), (4, 9.0), (5, None)],
                               "MatID int, Capacity_to_avg_qty double")
    got = {r["MatID"]: r["bucket"] for r in inv.depth_buckets(df).collect()}
    assert got == {1: "lessThan3", 2: "between3And9", 3: "between3And9", 4: "moreThan9"}


def test_fixture_anchors(spark):
    """The fixture design of the inventory analysis at sf0.001: one store
    (even suppliers, selected by the store filter), window Apr-Sep 2000 with
    split July, report without parts whose key is a multiple of 10."""
    from pyspark.sql import functions as F

    from shelfsight.sources import testdata as td
    d = "/root/testdata/sf0.001"
    li = td.table(spark, d, "lineitem")
    raw = li.select(
        F.to_date("l_shipdate").alias("Date"),
        F.when(F.col("l_suppkey") % 2 == 0, "EVEN").otherwise("ODD").alias("Store"),
        F.concat(F.lit("NZDF"), F.col("l_partkey").cast("string"), F.lit("-P")).alias("item"),
        F.col("l_extendedprice").alias("POS Gross Sales"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("POS Net Sales"),
        F.lit(0.0).alias("POS Total Discount"),
        F.col("l_quantity").alias("POS Qty Sold"),
        (F.lit(-0.6) * F.col("l_extendedprice")).alias("POS COGS (INV)"))
    part = td.table(spark, d, "part")
    key = F.concat(F.lit("NZDF"), F.col("p_partkey").cast("string"), F.lit("-x")).alias("SKU")
    sub = inv.clean_lookup(part.select(key, F.concat(F.lit("1-"), "p_type").alias("SubCategory")), "SubCategory")
    ven = inv.clean_lookup(part.select(key, F.concat(F.lit("1-"), "p_brand").alias("Vendor")), "Vendor")
    mart = inv.monthly_mart(inv.clean_sales(raw, sub, ven, store="EVEN", begin="2000-04-01", end="2000-10-01"))
    report = inv.clean_report(part.where(F.col("p_partkey") % 10 != 0).select(
        F.concat(F.col("p_partkey").cast("string"), F.lit(" "), "p_name").alias("Name"),
        (1 + F.col("p_partkey") % 5).cast("double").alias("Facings"),
        F.col("p_size").cast("double").alias("Capacity"), F.lit(1.0).alias("Days Supply"),
        F.lit("A").alias("Classification"), F.col("p_partkey").cast("int").alias("Mat ID"),
        F.lit(1).alias("# POGs")))
    split = "2000-07-01"
    early, late = inv.split_periods(mart, split)
    base = inv.analysis_base(late, report)
    enr = inv.enrich(base)
    rows = inv.at_least_one_month(enr)["rows"]
    bands = {r["band"]: r["n"] for r in
             inv.demand_bands(enr).groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert (mart.count(), mart.select("MatID").distinct().count(), late.count()) == (190, 130, 87)
    assert inv.check_items(mart, report).count() == 62
    assert inv.new_items(late, report).count() == 5
    assert inv.removed_items(early, late, report, split).select("MatID").distinct().count() == 49
    assert (inv.bad_records(base).count(), inv.shallow_items(base).count()) == (47, 15)
    assert (rows.count(), rows.select("MatID").distinct().count()) == (38, 32)
    assert [bands.get(b, 0) for b in (1, 2, 3, 4)] == [19, 8, 4, 7]
    assert enr.where("totalMonthlyQtySold = Capacity").count() == 1
    assert enr.where("Depth >= 3 AND Depth < 4").count() == 5


def test_all_stores_in_one_job_equals_one_job_per_store(spark):
    from pyspark.sql import functions as F

    from shelfsight.plans.checked import finalize
    from shelfsight.sources import testdata as td
    d = "/root/testdata/sf0.001"
    sub = inv.clean_lookup(td.subcategory_info(spark, d), "SubCategory")
    ven = inv.clean_lookup(td.vendor_info(spark, d), "Vendor")
    raw = td.sales_monthly(spark, d)
    report = inv.clean_report(td.dist_report(spark, d))
    split, begin, end = "2000-07-01", "2000-04-01", "2000-10-01"

    def chain(sales, by=()):
        _, late = inv.split_periods(inv.monthly_mart(sales, by), split)
        enr = inv.enrich(inv.analysis_base(late, report, by), by)
        res = inv.at_least_one_month(enr, by)
        return res["items"], inv.full_month(res["rows"], split, by=by), inv.demand_bands(enr, by=by)

    all_items, all_full, all_bands = chain(inv.clean_sales(raw, sub, ven, begin=begin, end=end), ("Store",))
    stores = [r["Store"] for r in all_items.groupBy("Store").count().orderBy(F.desc("count")).limit(3).collect()]
    for st in stores:
        one = chain(inv.clean_sales(raw, sub, ven, store=st, begin=begin, end=end))
        for whole, single in zip((all_items, all_full, all_bands), one):
            # compared rounded: the aggregates may sum in another order
            part = finalize(whole.where(F.col("Store") == st).drop("Store"))
            single = finalize(single)
            assert part.exceptAll(single).count() == 0 and single.exceptAll(part).count() == 0


def test_check_items_per_store(spark):
    """An item sold in one store and not in another is reported for the
    other; a report without stores is refused unless asked for."""
    import pytest
    mart = inv_mart_two_stores(spark)
    rep = spark.createDataFrame([("1 A", 1, 1, 1.0, 5.0, "A")],
                                "SKU string, MatID int, POGS int, Facings double, Capacity double, Classification string")
    with pytest.raises(ValueError):
        inv.check_items(mart, rep, ("Store",))
    got = inv.check_items(mart, rep, ("Store",), every_store=True).collect()
    assert [(r["Store"], r["MatID"], r["month"]) for r in got] == [("S2", 1, None)]


def inv_mart_two_stores(spark):
    return spark.createDataFrame(
        [("S1", 1, 2000, 7, 1.0, "T", 5.0, 5.0, 2.0, 1.0), ("S2", 2, 2000, 7, 1.0, "T", 5.0, 5.0, 2.0, 1.0)],
        "Store string, MatID int, year int, month int, Price double, SubCategory string, totalMonthlyNetSale double, "
        "totalMonthlyGrossSale double, totalMonthlyQtySold double, SellMargin double")
