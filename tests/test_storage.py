"""Tables that are written and read again: text exports, the partitioned mart,
bucket sinks, co-partitioned facts, published runs; and the SQL form."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shelfsight.operators import inventory as inv
from shelfsight.operators import oos, profile, rank
from shelfsight.plans import mart, publish, sql_surface, storage_queries
from shelfsight.plans.copartition import bucketed
from shelfsight.plans.params import inventory_params
from shelfsight.sources import exports as ex
from shelfsight.sources import testdata as td
from shelfsight.sources import writers as wr

SF = "/root/testdata/sf0.001"
SCHEMA = StructType([StructField(c, StringType()) for c in ("Date", "Store", "Qty")])
CELLS = {"Date": ex.Cell("date", "yyyyMMdd", required=True), "Store": ex.Cell("text"), "Qty": ex.Cell("number")}


def plan_of(df, capsys):
    df.explain("formatted")
    return capsys.readouterr().out


# ------------------------------------------------------------------ exports
def test_cells_of_a_hand_made_export(spark, tmp_path):
    (tmp_path / "e.csv").write_bytes(
        "\ufeffStore,Qty,Date\r\n"
        '"A, ""B""\nC","1,234.50",20190701\r\n'
        "S2,n/a,20190702\r\n"
        "S3,,2019-07\r\n"
        "S4,7,\r\n"
        "S5,7\r\n"
        "S6,7,20190703,extra\r\n".encode())
    parsed = ex.parse(ex.read_export(spark, str(tmp_path), SCHEMA), CELLS)
    rows = sorted(((str(r.Date), r.Store, r.Qty) for r in ex.good_rows(parsed).collect()), key=str)
    assert rows == sorted([("2019-07-01", 'A, "B"\nC', 1234.5), ("2019-07-02", "S2", None), ("None", "S3", None),
                           ("None", "S4", 7.0)], key=str)
    got = {(r["column"], r.reason): (r.n_cells, r.sample) for r in ex.rejects(parsed).collect()}
    assert got[("Qty", "not a number")] == (1, "n/a") and got[("Date", "not a date")] == (1, "2019-07")
    assert got[("Date", "missing")] == (1, None) and got[(None, "row width")][0] == 2 and len(got) == 4


def test_export_round_trip_and_bad_headers(spark, tmp_path):
    cells = [(f"{i}", f'x "{i}", y\nz', None if i % 3 else "1,000") for i in range(50)]
    ex.write_export(spark.createDataFrame(cells, SCHEMA).repartition(2), str(tmp_path / "a"), rows_per_file=10)
    files = [f for f in os.listdir(tmp_path / "a") if f.endswith(".csv")]
    assert len(files) >= 5
    assert all(open(tmp_path / "a" / f, "rb").read(3) == b"\xef\xbb\xbf" for f in files)
    back = ex.read_export(spark, str(tmp_path / "a"), SCHEMA)
    assert sorted((r.Date, r.Store, r.Qty) for r in back.collect() if r.Qty) == sorted(c for c in cells if c[2])
    assert len(back.collect()) == 50 and not any(r[ex.BAD_ROW] for r in back.collect())
    with pytest.raises(ValueError):
        ex.read_export(spark, str(tmp_path / "a"), StructType([StructField("Other", StringType())]))


# ---------------------------------------------------------------- box plots
def test_box_plot_whiskers_and_outliers(spark):
    rows = [("a", float(x)) for x in [1, 2, 3, 4, 5, 6, 7, 8, 100, -50]] + [("b", 1.0), ("c", None), (None, 2.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: r for r in profile.box_plot(df, "x", ["k"]).collect()}
    assert set(got) == {"a", "b", None}
    a = got["a"]
    assert (a.n, a.p25, a.p50, a.p75, a.whisker_low, a.whisker_high, a.n_low, a.n_high) == (10, 2.25, 4.5, 6.75, 1, 8, 1, 1)
    assert (got["b"].whisker_low, got["b"].whisker_high, got[None].n) == (1, 1, 2)
    out = {(r.k, r.value, r.side) for r in profile.box_outliers(df, "x", ["k"], ["k"]).collect()}
    assert out == {("a", 100.0, "high"), ("a", -50.0, "low")}


# ------------------------------------------------------------ daily evidence
@pytest.mark.parametrize("range_days", [1, 3, 32])
def test_daily_state_of_one_pair(spark, range_days):
    def day(n):
        return f"2019-01-{n:02d}"
    # (day, sold, stock); day 1 has neither, days 3-5 and 8-10 have no row
    facts = [("A", "S", day(d), float(q), float(s)) for d, q, s in ((1, 0, 0), (2, 1, 4), (6, 2, 0), (7, 0, 0), (7, 0, 0))]
    facts += [("A", "T", day(10), 1.0, 1.0)]
    df = spark.createDataFrame(facts, "SKU string, Store string, d string, QtySold double, StockQty double").select(
        "SKU", "Store", F.lit("c").alias("Category"), F.to_date("d").alias("Date"), F.lit(1.0).alias("NetSales"), "QtySold",
        F.lit(0.0).alias("Margin"), "StockQty")
    got = {(r.Store, r.Date.day): (r.had_stock, r.last_stock_day and r.last_stock_day.day, r.idle_run)
           for r in oos.daily_state(df, range_days).collect()}
    assert len(got) == 20
    assert [got["S", d] for d in range(1, 11)] == [
        (False, None, 1), (True, 2, 0), (True, 2, 1), (True, 2, 2), (True, 2, 3), (True, 2, 0), (True, 2, 1), (True, 2, 2),
        (True, 2, 3), (True, 2, 4)]
    assert got["T", 9] == (False, None, 9) and got["T", 10] == (True, 10, 0)


# -------------------------------------------------------------- absent stores
def test_absent_stores_as_ranges(spark, capsys):
    month = F.to_date(F.lit("2000-07-01"))
    df = spark.createDataFrame([(f"S{i}", i % 3, 0.0 if i == 4 else 1.0) for i in range(9)],
                               "Store string, MatID int, totalMonthlyGrossSale double").withColumn("period", month)
    report = spark.createDataFrame([(m, f"{m} x", "A") for m in (0, 1, 2, 9)], "MatID int, SKU string, Classification string")
    out = inv.check_items_by_store(df, report)
    got = {r.MatID: (r.n_absent, r.n_unsold, r.absent) for r in out.collect()}
    assert got == {0: (6, 0, "1-2,4-5,7-8"), 1: (6, 1, "0,2-3,5-6,8"), 2: (6, 0, "0-1,3-4,6-7"), 9: (9, 0, "0-8")}
    # no product of stores and items before the difference
    plan = plan_of(out, capsys)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Generate" not in plan


# ---------------------------------------------------------- partitioned mart
def test_mart_reads_open_their_months_only(spark, tmp_path, capsys):
    rows = spark.range(600).select(
        F.to_date(F.concat(F.lit("2000-0"), (F.col("id") % 6 + 4).cast("string"), F.lit("-01"))).alias("period"),
        F.col("id").cast("int").alias("MatID"), F.lit(1.0).alias("totalMonthlyGrossSale")).withColumn("month", F.month("period"))
    path = str(tmp_path / "mart")
    mart.write_mart(rows, path)
    early, late = mart.early_late(spark, path, "2000-07-01")
    assert (early.count(), late.count()) == (300, 300)
    plan = plan_of(late, capsys)
    assert "PartitionFilters: [isnotnull(period" in plan and "2000-07-01" in plan
    assert len({f.split("period=")[1][:7] for f in late.inputFiles()}) == 6  # listed, pruned when read
    seasons = spark.createDataFrame([(m, "summer" if m in (6, 7, 8) else "rest") for m in range(1, 13)], "month int, season string")
    summer = mart.of_season(mart.read_mart(spark, path), seasons, "summer")
    assert summer.count() == 300
    assert "dynamicpruning" in plan_of(summer, capsys)
    # one month again: the others stay
    mart.write_mart(rows.where("month = 5 AND MatID < 100"), path)
    counts = {r.month: r["count"] for r in mart.read_mart(spark, path).groupBy("month").count().collect()}
    assert counts == {4: 100, 5: 17, 6: 100, 7: 100, 8: 100, 9: 100}


def test_sink_files_are_bounded_and_one_bucket_is_replaced(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "big").otherwise("small").alias("bucket"))
    wr.write_partitions(df, path, ["bucket"], rows_per_file=200)
    assert len([f for f in os.listdir(f"{path}/bucket=big") if f.endswith(".parquet")]) >= 5
    before = set(os.listdir(f"{path}/bucket=big"))
    wr.write_partitions(df.where("id = 950"), path, ["bucket"])
    assert set(os.listdir(f"{path}/bucket=big")) == before
    assert spark.read.parquet(path).groupBy("bucket").count().orderBy("bucket").collect()[1]["count"] == 1


# ------------------------------------------------------- co-partitioned facts
def test_pair_operations_on_bucketed_facts_need_no_exchange(spark, capsys):
    facts = bucketed(oos.clean_stock(td.stock_daily(spark, SF), td.closed_stores(spark, SF)), oos.KEYS, 4)
    pairs = oos.pair_summary(facts)
    kept = bucketed(pairs, oos.KEYS, 4)
    joined = facts.join(kept.select(*oos.KEYS), oos.KEYS, "left_semi").groupBy(*oos.KEYS).agg(F.sum("NetSales").alias("s"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (pairs, joined):
            plan = plan_of(df, capsys)
            assert "Exchange" not in plan and "Bucketed: true" in plan
            df.count()
        report = oos.detect_oos(facts, keep=lambda d: bucketed(d, oos.KEYS, 4))
        plan = plan_of(report, capsys)
        assert "hashpartitioning(SKU" not in plan
        plain = oos.detect_oos(oos.clean_stock(td.stock_daily(spark, SF), td.closed_stores(spark, SF)))
        keys = ["SKU", "Store", "OOS_days"]
        assert sorted(map(tuple, report.select(*keys).collect())) == sorted(map(tuple, plain.select(*keys).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# ------------------------------------------------------------- published runs
def test_readers_see_a_whole_run_or_the_one_before(spark, tmp_path):
    out = str(tmp_path / "pub")
    with pytest.raises(publish.Unpublished):
        publish.published(spark, out)
    one = spark.createDataFrame([(1, "a"), (1, "b")], "MatID int, x string")
    publish.publish(spark, out, {"list/a": one, "b": one.where("x = 'a'")})
    assert {r["list"]: (r.n_rows, r.n_items) for r in publish.contents(spark, out).collect()} == {"list/a": (2, 1), "b": (1, 1)}
    opened = publish.published(spark, out)["b"]
    broken = one.withColumn("y", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        publish.publish(spark, out, {"list/a": one.limit(0), "b": broken})
    assert publish.published(spark, out)["list/a"].count() == 2
    empty = one.limit(0)
    publish.publish(spark, out, {"list/a": empty, "b": empty})
    assert {r["list"]: r.n_rows for r in publish.contents(spark, out).collect()} == {"list/a": 0, "b": 0}
    assert opened.count() == 1  # the run before stays for its readers
    publish.publish(spark, out, {"list/a": one})
    publish.publish(spark, out, {"list/a": one})
    assert len(os.listdir(f"{out}/runs")) <= 3 and set(publish.published(spark, out)) == {"list/a"}


def test_bad_run_parameters():
    for report, start in (("dist.csv", "2019-04-01"), ("dist-Arrivals.csv", "2019-05-01")):
        with pytest.raises(ValueError):
            inventory_params(report, start)


# ------------------------------------------------------------------ SQL form
def test_sql_form_equals_dataframe_form(spark):
    report = oos.detect_oos(oos.clean_stock(td.stock_daily(spark, SF), td.closed_stores(spark, SF))).cache()
    for days in (7, 3):
        a, b = sql_surface.oos_all_days(report, days), oos.oos_7_days(report, days)
        assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(b.columns)).collect()))
    report.unpersist()
    assert not [t for t in spark.catalog.listTables() if t.isTemporary]


def test_parameters_are_bound_not_pasted(spark):
    df = spark.createDataFrame([("a'; --",), ("b",)], "x string")
    with sql_surface.views(spark, t=df) as names:
        got = sql_surface.run(spark, "SELECT x FROM {t} WHERE x = :x", names, x="a'; --").collect()
    assert [r.x for r in got] == ["a'; --"]


# -------------------------------------------------------------------- top k
def test_top_k_keeps_ties_and_ranks_no_whole_group(spark, capsys):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") % 50).cast("double").alias("v"))
    out = rank.top_k(df, ["g"], "v", 2)
    got = {(r.g, r.v): r["count"] for r in out.groupBy("g", "v").count().collect()}
    want = df.groupBy("g", "v").count()
    assert got == {(r.g, r.v): r["count"] for r in want.where("v = 49").collect()}
    plan = plan_of(out, capsys)
    assert plan.count("WindowGroupLimit") >= 2 and "rangepartitioning" not in plan
    assert [r.v for r in rank.preview(df, 3, [F.desc("v"), "g"]).collect()] == [49.0] * 3
    assert "TakeOrderedAndProject" in plan_of(rank.preview(df, 3, [F.desc("v")]), capsys)


def test_rank_desc_equals_window_on_random_groups(spark):
    from pyspark.sql import Window
    df = spark.range(3000).select(
        F.when(F.col("id") % 7 != 0, (F.hash("id") % 3).cast("string")).alias("g"),
        F.when(F.hash(F.col("id") + 1) % 11 != 0, (F.abs(F.hash(F.col("id") * 3)) % 40).cast("double")).alias("v"))
    want = df.withColumn("r", F.rank().over(Window.partitionBy("g").orderBy(F.desc_nulls_last("v"))))
    for parts in (1, 5, 16):
        got = rank.rank_desc(df, ["g"], "v", "r", parts)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_every_storage_query_has_sql():
    from shelfsight.plans import storage_oracle
    assert set(storage_queries.QUERIES) == set(storage_oracle.SQL)
