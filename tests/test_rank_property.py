"""Week-over-week flags against a plain-Python evaluation on random data."""

import random

import pytest

from shelfsight.operators import rank

COLS = ["Index", "Date", "Company", "BusinessUnit", "Concept_NEW", "Category",
        "Store", "SKU", "NetSales", "rank"]


def brute(rows):
    weeks = sorted({r["Date"] for r in rows})
    w2, w1 = weeks[-1], weeks[-2]
    at = {}
    for r in rows:
        at.setdefault((r["SKU"], r["Store"], r["Date"]), []).append(r)
    conc = {}
    for r in rows:
        if r["Date"] == w2:
            conc.setdefault((r["SKU"], r["Concept_NEW"]), []).append(r["NetSales"])
    out = {}
    for r in rows:
        k = (r["SKU"], r["Store"])
        in1, in2 = (k + (w1,)) in at, (k + (w2,)) in at
        rng = True if (r["Date"] == w2 and not in1) else None
        lost = True if (r["Date"] == w1 and not in2 and r["NetSales"] != 0) else None
        s = sum(x["NetSales"] for x in at.get(k + (w1,), []))
        vals = conc.get((r["SKU"], r["Concept_NEW"]))
        a = sum(vals) / len(vals) if vals else 0.0
        mat = None if s == 0 else bool(s > a and lost)
        gap = (not rng) and (not lost) and r["NetSales"] == 0
        top2 = any(1 <= x["rank"] <= 50 for x in at.get(k + (w2,), []))
        top1 = any(1 <= x["rank"] <= 50 for x in at.get(k + (w1,), []))
        out[r["Index"]] = (rng, lost, mat, gap, top2 and not top1)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_flags_match_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = []
    i = 0
    for week in ("2019W50", "2019W51", "2019W52"):
        for sku in ("A", "B", "C", "D"):
            for store, concept in (("S1", "K1"), ("S2", "K1"), ("S3", "K2")):
                if rnd.random() < 0.35:
                    continue
                i += 1
                rows.append({"Index": str(i), "Date": week, "Company": "C", "BusinessUnit": "B",
                             "Concept_NEW": concept, "Category": "X", "Store": store, "SKU": sku,
                             "NetSales": rnd.choice([0.0, 0.0, 5.0, 10.0, 20.0]),
                             "rank": float(rnd.choice([0, 1, 10, 49, 50, 51, 80]))})
    df = rank.clean_rank(spark.createDataFrame([tuple(r[c] for c in COLS) for r in rows], COLS))
    got = {r["Index"]: (r["range_expansion"], r["in_W1_not_W2"], r["material_change"],
                        r["unaddressed_gap"], r["newcomer"])
           for r in rank.assortment_flags(df).collect()}
    assert got == brute(rows)
