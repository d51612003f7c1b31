"""Out-of-stock rules on hand-made daily facts."""

import datetime as dt

import pytest

from shelfsight.operators import oos

D = dt.date


def facts(spark, rows, closed=None):
    raw = spark.createDataFrame(
        [(s, st, "Drinks", d.strftime("%Y%m%d"), str(ns), str(q), str(m), str(k))
         for (s, st, d, ns, q, m, k) in rows],
        ["SKU", "Store", "Category", "Date", "POS Net Sales", "POS Qty Sold",
         "POS Margin on Net Sales", "Stock Balance Qty"])
    closed_df = spark.createDataFrame([(c,) for c in closed], ["Store"]) if closed else None
    return oos.clean_stock(raw, closed_df)


def days(start, n):
    return [start + dt.timedelta(days=i) for i in range(n)]


def report(spark, rows, closed=None):
    return {(r["SKU"], r["Store"]): r for r in oos.detect_oos(facts(spark, rows, closed)).collect()}


def test_gap_days_after_first_stock_are_out_of_stock(spark):
    # calendar 1..10 Jan (set by another pair); pair A sells days 1-3, then nothing
    rows = [("A", "S1", d, 10, 1, 2, 5) for d in days(D(2024, 1, 1), 3)]
    rows += [("B", "S1", d, 10, 1, 2, 5) for d in days(D(2024, 1, 1), 10)]
    r = report(spark, rows)
    a = r[("A", "S1")]
    assert a["OOS_days"] == 7                                 # 4..10 Jan: window is 4..10
    assert a["date_list"] == days(D(2024, 1, 4), 7)
    assert a["OOS_lastDay"] == 1
    assert a["avg_loss_net_sale"] == pytest.approx(10.0)
    assert a["total_loss_net_sale"] == pytest.approx(70.0)
    assert ("B", "S1") not in r


def test_window_is_last_seven_days_and_stock_must_come_first(spark):
    cal = [("Z", "S9", d, 1, 1, 1, 1) for d in days(D(2024, 1, 1), 14)]
    # stock appears only on 10 Jan; 8-9 Jan are zero days before the first stock
    rows = cal + [("A", "S1", D(2024, 1, 8), 1, 0, 0, 0), ("A", "S1", D(2024, 1, 9), 1, 0, 0, 0),
                  ("A", "S1", D(2024, 1, 10), 1, 0, 0, 3)]
    a = report(spark, rows)[("A", "S1")]
    assert a["date_list"] == days(D(2024, 1, 11), 4)          # 11..14 Jan
    assert a["OOS_days"] == 4


def test_day_max_minus_6_in_max_minus_7_out(spark):
    cal = [("Z", "S9", d, 1, 1, 1, 1) for d in days(D(2024, 1, 1), 14)]
    rows = cal + [("A", "S1", D(2024, 1, 1), 5, 1, 1, 2)]
    rows += [("A", "S1", d, 5, 1, 1, 2) for d in days(D(2024, 1, 2), 13) if d not in (D(2024, 1, 7), D(2024, 1, 8))]
    a = report(spark, rows)[("A", "S1")]
    assert a["date_list"] == [D(2024, 1, 8)]                  # 8 Jan = max - 6 counts, 7 Jan does not
    assert a["OOS_lastDay"] == 0


def test_sold_with_zero_stock_is_not_out_of_stock(spark):
    cal = [("Z", "S9", d, 1, 1, 1, 1) for d in days(D(2024, 1, 1), 7)]
    rows = cal + [("A", "S1", D(2024, 1, 1), 5, 1, 1, 3)]
    rows += [("A", "S1", d, 5, 1, 1, 0) for d in days(D(2024, 1, 2), 6)]
    assert ("A", "S1") not in report(spark, rows)


def test_only_negative_stock_is_never_reported(spark):
    cal = [("Z", "S9", d, 1, 1, 1, 1) for d in days(D(2024, 1, 1), 7)]
    rows = cal + [("A", "S1", D(2024, 1, 1), 5, 1, 1, -2)]
    assert ("A", "S1") not in report(spark, rows)


def test_no_sales_or_no_stock_pairs_are_dropped(spark):
    cal = [("Z", "S9", d, 1, 1, 1, 1) for d in days(D(2024, 1, 1), 7)]
    rows = cal + [("A", "S1", D(2024, 1, 1), 0, 0, 0, 3),        # no sales in the period
                  ("B", "S1", D(2024, 1, 1), 4, 1, 0, 0),        # no stock in the period
                  ("C", "S1", D(2024, 1, 1), 4, 1, 0, 2), ("C", "S1", D(2024, 1, 2), -4, 1, 0, -2)]
    r = report(spark, rows)
    assert ("A", "S1") not in r and ("B", "S1") not in r and ("C", "S1") not in r


def test_closed_and_null_stores_are_removed(spark):
    cal = [("Z", "S9", d, 1, 1, 1, 1) for d in days(D(2024, 1, 1), 7)]
    rows = cal + [("A", "S1", D(2024, 1, 1), 5, 1, 1, 3), ("A", None, D(2024, 1, 1), 5, 1, 1, 3)]
    f = facts(spark, rows, closed=["S1"])
    assert f.where("Store = 'S1' OR Store IS NULL").count() == 0


def test_duplicate_zero_days_count_twice(spark):
    cal = [("Z", "S9", d, 1, 1, 1, 1) for d in days(D(2024, 1, 1), 7)]
    rows = cal + [("A", "S1", D(2024, 1, 1), 5, 1, 1, 3),
                  ("A", "S1", D(2024, 1, 7), 0, 0, 0, 0), ("A", "S1", D(2024, 1, 7), 0, 0, 0, 0)]
    a = report(spark, rows)[("A", "S1")]
    # 2..6 Jan missing (5 days) + 7 Jan twice
    assert a["OOS_days"] == 7
    assert a["date_list"].count(D(2024, 1, 7)) == 2


def test_grid_is_calendar_complete(spark):
    rows = [("A", "S1", D(2024, 1, 1), 5, 1, 1, 3), ("A", "S1", D(2024, 1, 4), 5, 1, 1, 3),
            ("B", "S2", D(2024, 1, 2), 5, 1, 1, 3)]
    g = oos.clean_grid(facts(spark, rows))
    assert g.count() == 8                                     # 2 pairs x 4 days
    filled = g.where("SKU = 'A' AND Date = DATE'2024-01-02'").collect()[0]
    assert filled["StockQty"] == 0 and filled["Category"] is None


def test_seven_day_share_and_summaries(spark):
    cal = [("Z", "S9", d, 1, 1, 1, 1) for d in days(D(2024, 1, 1), 8)]
    rows = cal + [("A", "S1", D(2024, 1, 1), 10, 1, 1, 3), ("B", "S1", D(2024, 1, 1), 30, 1, 1, 3),
                  ("A", "S2", D(2024, 1, 1), 10, 1, 1, 3)]
    rep = oos.detect_oos(facts(spark, rows))
    seven = {(r["SKU"], r["Store"]): r for r in oos.oos_7_days(rep).collect()}
    assert seven[("A", "S1")]["Avg_NS_Percentage"] == pytest.approx(25.0)
    assert seven[("B", "S1")]["Avg_NS_Percentage"] == pytest.approx(75.0)
    stores = {r["Store"]: r for r in oos.store_summary(rep).collect()}
    assert stores["S1"]["oos_items"] == 2 and stores["S1"]["total_loss_net_sale"] == pytest.approx(280.0)
    prods = {r["SKU"]: r["n_stores"] for r in oos.product_summary(rep).collect()}
    assert prods == {"A": 2}


def test_invariants_of_report(spark):
    from shelfsight.plans import queries as Q
    rep = Q.oos_report(spark, "/root/testdata/sf0.001")
    rows = rep.collect()
    assert len(rows) == 65
    last = max(d for r in rows for d in r["date_list"])
    for r in rows:
        assert len(r["date_list"]) == r["OOS_days"]
        assert r["date_list"] == sorted(r["date_list"])
        assert r["OOS_lastDay"] == (1 if r["date_list"][-1] == last else 0)
        assert all((last - d).days <= 6 for d in r["date_list"])
        assert r["total_loss_net_sale"] == pytest.approx(r["avg_loss_net_sale"] * r["OOS_days"])
    assert len({(r["SKU"], r["Store"]) for r in rows}) == len(rows)


def test_fixture_anchors(spark):
    """Counts of the fixture design at sf0.001 (facts after the closed-store
    filter, grid rows, reported pairs, out on the last day, out all 7 days)."""
    from shelfsight.plans import queries as Q
    d = "/root/testdata/sf0.001"
    rep = Q.oos_report(spark, d)
    assert Q.oos_facts(spark, d).count() == 688
    assert Q.q_oos_clean_grid(spark, d).count() == 1950
    assert (rep.count(), rep.where("OOS_lastDay = 1").count(), rep.where("OOS_days = 7").count()) == (65, 36, 4)


def test_window_length_is_a_parameter(spark):
    cal = [("Z", "S9", d, 1, 1, 1, 1) for d in days(D(2024, 1, 1), 10)]
    rows = cal + [("A", "S1", D(2024, 1, 1), 5, 1, 1, 3)]
    out = {(r["SKU"], r["Store"]): r for r in oos.detect_oos(facts(spark, rows), window_days=3).collect()}
    assert out[("A", "S1")]["date_list"] == days(D(2024, 1, 8), 3)
    seven = {(r["SKU"], r["Store"]) for r in oos.oos_7_days(oos.detect_oos(facts(spark, rows), 3), 3).collect()}
    assert seven == {("A", "S1")}


def test_grid_rows_are_pairs_times_days(spark):
    from shelfsight.plans import queries as Q
    facts = Q.oos_facts(spark, "/root/testdata/sf0.001")
    summary = oos.pair_summary(facts)
    b = oos.period_bounds(summary).collect()[0]
    grid = oos.clean_grid(facts)
    assert grid.count() == summary.count() * b["n_days"]
    days_seen = grid.agg({"Date": "min"}).collect()[0][0], grid.agg({"Date": "max"}).collect()[0][0]
    assert days_seen == (b["first_day"], b["last_day"])
