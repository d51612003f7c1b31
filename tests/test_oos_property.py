"""detect_oos against a brute-force day-by-day walk on random fixtures."""

import datetime as dt
import random

import pytest

from shelfsight.operators import oos


def brute_force(rows, window=7):
    """rows: (sku, store, date, net, qty, margin, stock). Literal rules:
    calendar fill over the kept pairs' min..max day, walk each pair's days in
    order, duplicates walked as separate rows."""
    by_pair = {}
    for r in rows:
        by_pair.setdefault((r[0], r[1]), []).append(r)
    kept = {p: rs for p, rs in by_pair.items()
            if sum(r[3] for r in rs) != 0 and sum(r[6] for r in rs) != 0}
    if not kept:
        return {}
    days = [r[2] for rs in kept.values() for r in rs]
    d0, d1 = min(days), max(days)
    since = d1 - dt.timedelta(days=window - 1)
    out = {}
    for p, rs in kept.items():
        present = {r[2] for r in rs}
        dense = list(rs) + [(p[0], p[1], d0 + dt.timedelta(days=i), 0.0, 0.0, 0.0, 0.0)
                            for i in range((d1 - d0).days + 1)
                            if d0 + dt.timedelta(days=i) not in present]
        dense.sort(key=lambda r: (r[2], -abs(r[6])))   # same-day stock rows first
        seen = False
        ever_pos = False
        oos_days = []
        for r in dense:
            if r[6] != 0:
                seen = True
            if r[6] == 0 and r[4] == 0 and seen and r[2] >= since:
                oos_days.append(r[2])
            if r[6] > 0:
                ever_pos = True
        if oos_days and ever_pos:
            on = [r for r in dense if r[6] != 0]
            avg_net = sum(r[3] for r in on) / len(on)
            out[p] = (len(oos_days), sorted(oos_days), int(max(oos_days) == d1), avg_net)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    start = dt.date(2024, 3, 1)
    rows = []
    for sku in "ABC":
        for store in ("S1", "S2", "S3"):
            for i in range(20):
                if rnd.random() < 0.45:
                    continue                     # missing day -> filled with zeros
                for _ in range(2 if rnd.random() < 0.1 else 1):   # some duplicate days
                    stock = rnd.choice([0, 0, 0, 1, 2, -1, 3])
                    qty = rnd.choice([0, 0, 1, 2])
                    net = rnd.choice([0.0, 0.0, 2.5, 4.0, -1.0])
                    rows.append((sku, store, start + dt.timedelta(days=i), net, float(qty), 0.5, float(stock)))
    want = brute_force(rows)
    raw = spark.createDataFrame(
        [(r[0], r[1], "Cat", r[2], r[3], r[4], r[5], r[6]) for r in rows],
        "SKU string, Store string, Category string, Date date, NetSales double, QtySold double, "
        "Margin double, StockQty double")
    got = {(r["SKU"], r["Store"]): (r["OOS_days"], list(r["date_list"]), r["OOS_lastDay"],
                                    r["avg_loss_net_sale"])
           for r in oos.detect_oos(oos.clean_stock(raw)).collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k][:3] == want[k][:3], k
        assert got[k][3] == pytest.approx(want[k][3])
