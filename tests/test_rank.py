"""Week-over-week flags: the original hand-made cases plus one case per rule."""

import pytest

from shelfsight.operators import rank

COLS = ["Index", "Date", "Company", "BusinessUnit", "Concept_NEW", "Category",
        "Store", "SKU", "NetSales", "rank"]


def frame(spark, rows):
    return rank.clean_rank(spark.createDataFrame(
        [(r[0], r[1], r[2], r[3], r[4], r[5], r[6], r[7], float(r[8]), float(r[9])) for r in rows],
        COLS))


def pick(df, col, **where):
    out = df
    for k, v in where.items():
        out = out.where(out[k] == v)
    return [r[col] for r in out.collect()]


def test_range_expansion(spark):
    rows = [("3", "2019W01", "AUDF", "BNC", "Duty Free", "", "AUDF.CNS113", "AUDF100430711", 241.8, 1),
            ("4", "2019W02", "AUDF", "BNC", "Duty Free", "", "AUDF.CNS113", "AUDF100430711", 322.8, 1),
            ("1", "2019W02", "AUDF", "BNC", "Air N&R", "", "AULS.AVV102", "AULS126353", 76.89, 17),
            ("3", "2019W01", "AUDF", "BNC", "Air N&R", "", "AULS.AVV102", "AULS488089", 76.89, 17)]
    out = rank.range_expansion(frame(spark, rows))
    assert pick(out, "range_expansion", Store="AULS.AVV102", SKU="AULS126353") == [True]
    assert pick(out, "range_expansion", Store="AULS.AVV102", SKU="AULS488089") != [True]
    assert all(v is not True for v in pick(out, "range_expansion", Store="AUDF.CNS113"))


def test_in_w1_not_w2(spark):
    rows = [("1", "2019W01", "AUDF", "BNC", "Air N&R", "", "AULS.AVV102", "AULS488089", 76.89, 17),
            ("2", "2019W01", "AUDF", "BNC", "Air N&R", "", "AULS.AVV104", "AULS488082", 76.89, 17),
            ("3", "2019W02", "AUDF", "BNC", "Air N&R", "", "AULS.AVV104", "AULS488082", 76.89, 17)]
    out = rank.in_w1_not_w2(frame(spark, rows))
    assert pick(out, "in_W1_not_W2", SKU="AULS488089", Store="AULS.AVV102") == [True]
    assert all(v is not True for v in pick(out, "in_W1_not_W2", SKU="AULS488082"))


def test_material_change(spark):
    rows = [("1", "2019W01", "AUDF", "BNC", "Air N&R", "", "AULS.AVV102", "AULS488089", 76.89, 17),
            ("2", "2019W02", "AUDF", "BNC", "Air N&R", "", "AULS.AVV104", "AULS488089", 30.1, 1),
            ("3", "2019W01", "AUDF", "BNC", "Air N&R", "", "AULS.AVV104", "AULS488089", 76.89, 7)]
    out = rank.material_change(frame(spark, rows))
    assert pick(out, "material_change", Store="AULS.AVV102") == [True]
    assert all(v is not True for v in pick(out, "material_change", Store="AULS.AVV104"))
    # the averages behind it
    assert pick(out, "avgSales_lastWeek", Store="AULS.AVV102") == [pytest.approx(30.1)]
    assert pick(out, "sumSales_oldWeek", Store="AULS.AVV102") == [pytest.approx(76.89)]


def test_material_change_blank_when_no_previous_sales(spark):
    rows = [("1", "2019W02", "C", "B", "K", "", "S1", "A", 10.0, 1),
            ("2", "2019W01", "C", "B", "K", "", "S2", "A", 0.0, 2)]
    out = rank.material_change(frame(spark, rows))
    assert pick(out, "material_change", Store="S1") == [None]
    assert pick(out, "material_change", Store="S2") == [None]


def test_unaddressed_gap_treats_unset_flags_as_false(spark):
    rows = [("1", "2019W01", "C", "B", "K", "", "S1", "A", 0.0, 3),
            ("2", "2019W02", "C", "B", "K", "", "S1", "A", 0.0, 3),   # gap: no flag, no sales
            ("3", "2019W02", "C", "B", "K", "", "S2", "A", 0.0, 4),   # range expansion: no gap
            ("4", "2019W02", "C", "B", "K", "", "S3", "A", 5.0, 1)]   # sales: no gap
    out = rank.unaddressed_gap(frame(spark, rows))
    assert pick(out, "unaddressed_gap", Index="2") == [True]
    assert pick(out, "unaddressed_gap", Index="1") == [True]
    assert pick(out, "unaddressed_gap", Index="3") == [False]
    assert pick(out, "unaddressed_gap", Index="4") == [False]


def test_newcomer_flags_every_row_of_the_pair(spark):
    rows = [("1", "2019W01", "C", "B", "K", "", "S1", "A", 1.0, 60),
            ("2", "2019W02", "C", "B", "K", "", "S1", "A", 9.0, 5),
            ("3", "2018W52", "C", "B", "K", "", "S1", "A", 9.0, 1),
            ("4", "2019W01", "C", "B", "K", "", "S2", "A", 9.0, 3),
            ("5", "2019W02", "C", "B", "K", "", "S2", "A", 9.0, 4),
            ("6", "2019W02", "C", "B", "K", "", "S3", "A", 9.0, 0)]   # rank 0 = unranked
    out = rank.newcomer(frame(spark, rows))
    assert sorted(pick(out, "newcomer", Store="S1")) == [True, True, True]
    assert pick(out, "newcomer", Store="S2") == [False, False]
    assert pick(out, "newcomer", Store="S3") == [False]


def test_weeks_are_the_last_two_present(spark):
    rows = [("1", "2018W52", "C", "B", "K", "", "S1", "A", 1.0, 1),
            ("2", "2019W01", "C", "B", "K", "", "S1", "A", 1.0, 1),
            ("3", "2019W03", "C", "B", "K", "", "S2", "A", 1.0, 1)]
    out = rank.assortment_flags(frame(spark, rows))
    # W1 = 2019W01, W2 = 2019W03
    assert pick(out, "range_expansion", Index="3") == [True]
    assert pick(out, "in_W1_not_W2", Index="2") == [True]
    assert pick(out, "in_W1_not_W2", Index="1") == [None]


def test_ranks_share_ties(spark):
    rows = [("1", "2019W01", "C", "B", "K", "", "S1", "A", 5.0, 0),
            ("2", "2019W01", "C", "B", "K", "", "S2", "A", 5.0, 0),
            ("3", "2019W01", "C", "B", "K", "", "S1", "B", 1.0, 0)]
    out = rank.add_ranks(frame(spark, rows).drop("rank"))
    got = {r["Index"]: (r["rank"], r["store_rank"]) for r in out.collect()}
    assert got == {"1": (1, 1), "2": (1, 1), "3": (3, 2)}


def test_report_has_no_helper_columns_and_no_duplicates(spark):
    rows = [("1", "2019W01", "C", "B", "K", "", "S1", "A", 1.0, 1)] * 2 + \
           [("2", "2019W02", "C", "B", "K", "", "S1", "A", 1.0, 1)]
    out = rank.rank_report(frame(spark, rows))
    assert "in_W1_not_W2" not in out.columns and "sumSales_oldWeek" not in out.columns
    assert out.count() == 2


def test_distributed_rank_equals_window_rank(spark):
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F
    random.seed(3)
    rows = [(f"W{random.randint(1, 4)}", f"S{random.randint(1, 3)}", float(random.choice([0, 1, 2, 5, 5, 7, None or 3])) if random.random() > 0.05 else None)
            for _ in range(3000)]
    df = spark.createDataFrame(rows, "Date string, Store string, NetSales double")
    got = rank.rank_desc(df.withColumn("id", F.monotonically_increasing_id()), ["Date"], "NetSales", "r",
                         partitions=7)
    want = df.withColumn("id", F.monotonically_increasing_id()).withColumn(
        "r", F.rank().over(Window.partitionBy("Date").orderBy(F.col("NetSales").desc_nulls_last())))
    a = sorted((r["Date"], r["NetSales"] if r["NetSales"] is not None else -1, r["r"]) for r in got.collect())
    b = sorted((r["Date"], r["NetSales"] if r["NetSales"] is not None else -1, r["r"]) for r in want.collect())
    assert a == b


def test_hot_week_is_split_across_slices(spark):
    """One week holds 90% of the rows: it must span several range slices
    and still get exact ranks."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    df = spark.range(0, 20000).select(
        F.when(F.col("id") % 10 == 0, F.lit("2019W01")).otherwise(F.lit("2019W02")).alias("Date"),
        (F.col("id") % 997).cast("double").alias("NetSales"))
    tagged = rank.rank_desc(df, ["Date"], "NetSales", "r", partitions=8)
    want = df.withColumn("r", F.rank().over(Window.partitionBy("Date").orderBy(F.desc("NetSales"))))
    assert tagged.exceptAll(want).count() == 0 and want.exceptAll(tagged).count() == 0
    keyed = (df.repartitionByRange(8, F.col("Date"), F.col("NetSales").desc_nulls_last())
               .withColumn("_pid", F.spark_partition_id()))
    assert keyed.where("Date = '2019W02'").select("_pid").distinct().count() >= 4


def test_fixture_anchors(spark):
    """The fixture design's weekly table (first half of 2001) at sf0.001:
    zero-sales rows and unaddressed gaps of the zero-sales variant; rows in
    W2/W1, range expansion / lost / material change rows and newcomer pairs
    with plain sums."""
    from pyspark.sql import functions as F

    from shelfsight.functions.columns import iso_week
    d = "/root/testdata/sf0.001"

    def t(n):
        return spark.read.parquet(f"{d}/{n}.parquet")
    li = t("lineitem").where((F.col("l_shipdate") >= "2001-01-01") & (F.col("l_shipdate") < "2001-07-02"))
    geo = (t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
           .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")))

    def weekly(sales):
        w = (li.join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
               .join(geo, F.col("l_suppkey") == F.col("s_suppkey"))
               .groupBy(iso_week(F.to_date("l_shipdate")).alias("Date"), F.col("p_brand").alias("SKU"),
                        F.col("s_nationkey").cast("string").alias("Store"),
                        F.col("r_name").alias("Concept_NEW"))
               .agg(F.sum(sales).alias("NetSales")))
        return rank.add_ranks(w, store_rank=False).select(
            F.concat_ws("/", "Date", "Store", "SKU").alias("Index"), "Date", F.lit("C").alias("Company"),
            F.lit("B").alias("BusinessUnit"), "Concept_NEW", F.lit("X").alias("Category"), "Store", "SKU",
            "NetSales", F.col("rank").cast("double").alias("rank"))

    # zero-sales variant: line 7 counts as 0
    z = rank.assortment_flags(weekly(F.when(F.col("l_linenumber") == 7, 0.0)
                                      .otherwise(F.col("l_extendedprice"))))
    assert z.where("NetSales = 0").count() == 68
    assert z.where("unaddressed_gap").count() == 65
    assert z.where("unaddressed_gap AND Date IN ('2001W25', '2001W26')").count() == 4
    f = rank.assortment_flags(weekly(F.col("l_extendedprice"))).cache()
    assert f.where("Date = '2001W26'").count() == 14 and f.where("Date = '2001W25'").count() == 18
    assert f.where("range_expansion").count() == 14
    assert f.where("in_W1_not_W2").count() == 18
    assert f.where("material_change").count() == 18
    assert f.where("newcomer").select("SKU", "Store").distinct().count() == 14
    f.unpersist()


def test_duplicate_keys_check(spark):
    rows = [("1", "2019W01", "C", "B", "K", "", "S1", "A", 1.0, 1),
            ("2", "2019W01", "C", "B", "K", "", "S1", "A", 2.0, 2),
            ("3", "2019W02", "C", "B", "K", "", "S1", "A", 1.0, 1)]
    got = [(r["SKU"], r["Store"], r["Date"], r["n_rows"]) for r in rank.duplicate_keys(frame(spark, rows)).collect()]
    assert got == [("A", "S1", "2019W01", 2)]
    # the flags do not multiply rows: one output row per input row
    assert rank.assortment_flags(frame(spark, rows)).count() == 3


def test_rank_of_a_week_that_is_mostly_ties(spark):
    """80% of a week share one value: they meet as one counted value, and the
    ranks stay exact."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    df = spark.range(0, 20000).select(
        F.lit("2019W02").alias("Date"),
        F.when(F.col("id") % 5 == 0, (F.col("id") % 997).cast("double")).otherwise(F.lit(0.0)).alias("NetSales"))
    got = rank.rank_desc(df, ["Date"], "NetSales", "r", partitions=8)
    want = df.withColumn("r", F.rank().over(Window.partitionBy("Date").orderBy(F.desc("NetSales"))))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_both_ranks_come_from_one_range_partition(spark, monkeypatch):
    """The rows are cut by value once for both ranks, into more slices the
    more rows there are; values that go on over slices keep exact ranks."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    cuts, plain = [], rank.sliced
    monkeypatch.setattr(rank, "sliced", lambda df, order, out, n: cuts.append(n) or plain(df, order, out, n))
    monkeypatch.setattr(rank, "SLICE_ROWS", 300)
    df = spark.range(0, 6000).select(
        "id", F.when(F.col("id") % 7 > 0, "2019W02").alias("Date"),
        F.when(F.col("id") % 11 > 0, F.concat(F.lit("S"), F.col("id") % 3)).alias("Store"),
        F.when(F.col("id") % 13 == 0, None).when(F.col("id") % 3 == 0, 0.0).otherwise((F.col("id") % 97).cast("double")).alias("NetSales"))
    got = rank.add_ranks(df)

    def over(*group):
        return F.rank().over(Window.partitionBy(*group).orderBy(F.desc_nulls_last("NetSales")))
    want = df.withColumn("rank", over("Date")).withColumn("store_rank", over("Date", "Store"))
    assert cuts == [20] and got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_report_exchanges_whole_rows_only_where_they_repeat(spark, monkeypatch):
    from pyspark.sql import DataFrame
    whole, plain = [], type(spark.range(1)).dropDuplicates
    monkeypatch.setattr(type(spark.range(1)), "dropDuplicates", lambda df, *a: whole.append(df.count()) or plain(df, *a))
    rows = [(str(i), f"2019W0{i % 3}", "C", "B", "K", "", f"S{i % 5}", "A", float(i % 4), i) for i in range(40)]
    rows[7] = (*rows[7][:8], 0.0, 7)
    twice = [*rows, (*rows[7][:8], -0.0, 7), rows[9], rows[9]]
    once = rank.rank_report(frame(spark, rows))
    assert whole == [] and isinstance(once, DataFrame)
    out = rank.rank_report(frame(spark, twice))
    assert out.count() == 40 and whole == [5]
    monkeypatch.setattr(rank, "REPEATED", 1)
    assert rank.rank_report(frame(spark, twice)).count() == 40 and whole == [5, 43]


def test_weekly_sales_of_places_with_and_without_names(spark, tmp_path):
    """Grouped by short keys, the rows are those of the names: places of one
    name are one, nameless ones too, and repeated suppliers count again."""
    import datetime as dt

    from shelfsight.sources import testdata as td
    tables = {
        "lineitem": ("l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_shipdate timestamp",
                     [(p, s, n, 1.0, dt.datetime(2018, 12, d) if d else None)
                      for p in (3, 8, 12, None) for s in (1, 2, 3, 4) for n in (1, 7) for d in (30, 31, None)]),
        "supplier": ("s_suppkey long, s_nationkey int", [(1, 1), (2, 2), (3, 3), (3, 3), (4, 4)]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(1, "X", 1), (2, "X", 1), (3, None, 2), (4, "Y", 2)]),
        "region": ("r_regionkey int, r_name string", [(1, "R"), (2, None)])}
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    weekly = td.weekly_sales(spark, str(tmp_path))
    got = sorted((str(tuple(r)) for r in weekly.collect()))
    dates = {"2018W52": 1, "2019W01": 1, None: 1}
    places = {("X", "R"): 2, (None, None): 2, ("Y", None): 1}
    want = [(d, sku, n, r, float(k * m * c)) for d, k in dates.items() for sku, m in (("G0", 2), ("G1", 1), (None, 1))
            for (n, r), c in places.items()]
    assert got == sorted(map(str, want))
    assert "n_name" not in "".join(x for x in weekly._jdf.queryExecution().toString().splitlines() if "Exchange hashpartitioning" in x and "week" in x)
