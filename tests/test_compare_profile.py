import numpy as np
import pytest

from shelfsight.operators import compare as cmp
from shelfsight.operators import profile


def rep(spark, rows):
    return spark.createDataFrame(rows, "MatID int, SKU string, POGS int, Facings double, Capacity double")


def test_report_diff_is_null_safe(spark):
    a = rep(spark, [(1, "A", 1, 1.0, 5.0), (2, "B", 1, 1.0, None), (3, "C", 1, 1.0, 5.0), (4, "D", 1, 2.0, 5.0)])
    b = rep(spark, [(1, "A", 1, 1.0, 4.0), (2, "B", 1, 1.0, None), (3, "C", 1, 1.0, 6.0), (4, "D", 1, 3.0, 5.0)])
    d = {r["MatID"]: r for r in cmp.report_diff(a, b).collect()}
    assert set(d) == {1, 3, 4}
    assert d[1]["capacity_decreased"] and d[3]["capacity_increased"]
    assert not d[4]["capacity_decreased"] and not d[4]["capacity_increased"]


def full(spark, ids, months=(7, 8, 9)):
    return spark.createDataFrame([(i, f"I{i}", 2019, m) for i in ids for m in months],
                                 "MatID int, SKU string, year int, month int")


def test_persistence_and_only_one(spark):
    fa, fb = full(spark, [1, 2]), full(spark, [2, 3], (9, 10, 11))
    risk = spark.createDataFrame([(1, 0.5), (2, 0.2), (3, 0.1)], "MatID int, StdQty_to_AvgQty double")
    p = cmp.persistent_items(fa, fb, risk, risk)
    assert {r["MatID"] for r in p.collect()} == {2} and p.count() == 6
    chk = cmp.observation_check(p).collect()
    assert [(r["MatID"], r["n_obs"], r["ok"]) for r in chk] == [(2, 6, True)]
    only = {(r["MatID"], r["only_in"]) for r in cmp.only_one_period(fa, fb).collect()}
    assert only == {(1, "first"), (3, "later")}
    diff = cmp.report_diff(rep(spark, [(1, "I1", 1, 1.0, 5.0), (2, "I2", 1, 1.0, 5.0)]),
                           rep(spark, [(1, "I1", 1, 1.0, 4.0), (2, "I2", 1, 1.0, 4.0)]))
    c = cmp.capacity_vs_full(diff, fa, fb).collect()
    assert [(r["direction"], r["n_items"], r["n_full_month_first"], r["n_full_month_both"]) for r in c] == \
        [("decreased", 2, 2, 1)]


def test_profile_against_brute_force(spark):
    rng = np.random.default_rng(7)
    vals = rng.normal(10, 3, 500).round(2)
    cls = rng.choice(["A", "B", "C"], 500)
    df = spark.createDataFrame([(str(c), float(v)) for c, v in zip(cls, vals)], "Classification string, Price double")
    d = {r["Classification"]: r for r in profile.describe(df, ["Price"], by=["Classification"]).collect()}
    q = {r["Classification"]: r for r in profile.quartiles(df, ["Price"], by=["Classification"]).collect()}
    for c in "ABC":
        x = np.sort(vals[cls == c])
        assert d[c]["count"] == len(x)
        assert d[c]["mean"] == pytest.approx(x.mean())
        assert d[c]["std"] == pytest.approx(x.std(ddof=1))
        assert (d[c]["min"], d[c]["max"]) == (x.min(), x.max())
        for p, col in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")):
            assert q[c][col] == pytest.approx(np.quantile(x, p))
    h = profile.histogram(df, "Price", 10).collect()
    assert sum(r["n"] for r in h) == 500 and max(r["bin"] for r in h) == 10


def test_quartiles_of_a_group_beyond_any_sketch(spark):
    """40,000 distinct values and a group without values."""
    from pyspark.sql import functions as F
    df = spark.range(0, 40000).select(F.lit("big").alias("k"), (F.col("id") * 1.5).alias("Price")).unionByName(
        spark.createDataFrame([("none", None)], "k string, Price double"))
    q = {r["k"]: r for r in profile.quartiles(df, ["Price"], by=["k"]).collect()}
    x = np.arange(40000) * 1.5
    assert [q["big"][c] for c in ("p25", "p50", "p75")] == pytest.approx(list(np.quantile(x, [.25, .5, .75])))
    assert q["none"]["p50"] is None


def test_two_ratios_for_one_material_are_refused(spark):
    one = full(spark, [2])
    risk = spark.createDataFrame([(2, 0.5), (2, 0.7)], "MatID int, StdQty_to_AvgQty double")
    with pytest.raises(Exception, match="several ratios"):
        cmp.persistent_items(one, one, risk, risk).collect()
