import os

import pytest

from shelfsight.plans import params
from shelfsight.plans.jobs import run_inventory_job, run_oos_job, run_rank_job
from shelfsight.sources import readers, schemas, writers


def write(path, text):
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return str(path)


def test_closed_store_list_with_bom_and_crlf(spark, tmp_path):
    p = write(tmp_path / "closed.csv", "﻿Store,Status\r\nAULS.SYD201,Closed\r\nAULS.SYD202,Closed\r\n"
                                        "AULS.SYD201,Closed\r\n")
    got = sorted(r["Store"] for r in readers.read_closed_stores(spark, p).collect())
    assert got == ["AULS.SYD201", "AULS.SYD202"]


def test_params():
    p = params.inventory_params("reports/dist-Departures-2019-07.csv", "2019-04-01")
    assert (p.store, p.begin, p.end, p.split_month) == ("NZDF.AKL108", "2019-04-01", "2019-10-01", 7)
    p = params.inventory_params("reports/dist-Arrivals-2020-01.csv", "2019-06-01")
    assert (p.store, p.end, p.split) == ("NZDF.AKL109", "2019-12-01", "2019-09-01")
    with pytest.raises(ValueError):
        params.inventory_params("report.csv", "2019-04-01")
    with pytest.raises(ValueError):
        params.inventory_params("Arrivals.csv", "2019-05-01")


def test_csv_export_renders_lists_and_flags(spark, tmp_path):
    import datetime as dt
    df = spark.createDataFrame([("a", [dt.date(2024, 1, 2), dt.date(2024, 1, 3)], True, None)],
                               "k string, d array<date>, f boolean, g boolean")
    out = str(tmp_path / "o")
    writers.write_csv(df, out)
    back = spark.read.option("header", True).csv(out).collect()[0]
    assert back["d"] == "2024-01-02,2024-01-03" and back["f"] == "True" and back["g"] is None


def test_jobs_end_to_end(spark, tmp_path):
    stock = write(tmp_path / "stock.csv",
                  "SKU,Store,Category,Date,POS Net Sales,POS Qty Sold,POS Margin on Net Sales,Stock Balance Qty\n"
                  + "".join(f"A,S1,Drinks,202401{d:02d},5,1,1,3\n" for d in (1, 2))
                  + "".join(f"B,S1,Drinks,202401{d:02d},5,1,1,3\n" for d in range(1, 11))
                  + "A,S2,Drinks,20240101,5,1,1,3\n")
    closed = write(tmp_path / "closed.csv", "Store,Status\nS2,Closed\n")
    out = run_oos_job(spark, stock, closed, str(tmp_path / "oos"), cleanup=False)
    rows = out["oos_items"].collect()
    assert [(r["SKU"], r["Store"], r["OOS_days"]) for r in rows] == [("A", "S1", 7)]
    assert os.path.isdir(tmp_path / "oos" / "oos_items")

    rank_csv = write(tmp_path / "rank.csv",
                     "Index,Date Detail,Company,Business Unit,Concept_NEW,Product Category,"
                     "Company and Cost Centre,SKU,POS Net Sales,Rank Total\n"
                     "1,2019W01,C,B,K,X,S1,A,5,1\n2,2019W02,C,B,K,X,S2,A,5,1\n")
    rep = run_rank_job(spark, rank_csv, str(tmp_path / "rank_out"), cleanup=False)
    assert rep.where("range_expansion").count() == 1

    sales = write(tmp_path / "sales.csv",
                  "Date,Store,item,POS Gross Sales,POS Net Sales,POS Total Discount,POS Qty Sold,POS COGS (INV)\n"
                  + "".join(f"2019{m:02d},NZDF.AKL108,NZDF1-Tea,\"1,000\",900,0,2,-500\n" for m in range(4, 10))
                  + "201905,NZDF.AKL108,NZDF2-Gum,10,9,0,1,-5\n"
                  + "201908,NZDF.AKL109,NZDF2-Gum,10,9,0,1,-5\n")
    dist = write(tmp_path / "Departures.csv",
                 "Name,Facings,Capacity,Days Supply,Classification,Mat ID,# POGs\n"
                 "Tea,1,12,3,A,1,1\nGum,1,2,3,B,2,1\n")
    sub = write(tmp_path / "sub.csv", "SKU,SubCategory\nNZDF1-Tea,1-Drinks\nNZDF2-Gum,2-Sweets\n")
    ven = write(tmp_path / "ven.csv", "SKU,Vendor\nNZDF1-Tea,1-Acme\nNZDF2-Gum,2-Bolt\n")
    p = params.inventory_params(dist, "2019-04-01")
    res = run_inventory_job(spark, sales, dist, sub, ven, p, str(tmp_path / "inv"), cleanup=False)
    assert {r["MatID"] for r in res["issued/removed"].collect()} == {2}
    assert {r["MatID"] for r in res["full_month"].collect()} == {1}
    assert os.path.isdir(tmp_path / "inv" / "at_least_one_month" / "unadjusted")

    # every store in one job: the other store's sales are analysed too
    both = run_inventory_job(spark, sales, dist, sub, ven, p, None, all_stores=True)
    assert {(r["Store"], r["MatID"]) for r in both["issued/new"].collect()} == set()
    assert {r["Store"] for r in both["analysis_table"].collect()} == {"NZDF.AKL108", "NZDF.AKL109"}

    # with clean-up (the default) the job leaves no intermediate behind
    from shelfsight.plans import execution
    tables = os.path.join(execution.ensure_checkpoint_dir(spark).replace("file:", ""), "shelfsight-tables")
    before = set(os.listdir(tables))
    run_inventory_job(spark, sales, dist, sub, ven, p, str(tmp_path / "inv2"))
    assert set(os.listdir(tables)) == before
    back = spark.read.option("header", True).csv(str(tmp_path / "inv2" / "full_month")).collect()
    assert {r["MatID"] for r in back} == {"1"}


def test_column_helpers(spark):
    from pyspark.sql import functions as F

    from shelfsight.functions import columns as C
    df = spark.createDataFrame([("AULS498076-Shepherds Hut", "NZDF12345-Tea", "1,333.5", 0.5, "2018-12-31")],
                               "a string, b string, c string, d double, e string")
    r = df.select(C.name_of(F.col("a")).alias("short"), C.mat_id(F.col("b")).alias("mid"),
                  C.as_double(df, "c").alias("num"), C.snap_to_zero(F.col("d")).alias("snap"),
                  C.iso_week(F.to_date("e")).alias("wk"),
                  C.name_of(F.lit("nodash")).alias("none"),
                  C.ratio(F.lit(1.0), F.lit(0.0)).alias("div0")).collect()[0]
    assert r["short"] == "Shepherds Hut" and r["mid"] == 12345 and r["num"] == 1333.5
    assert r["snap"] == 0.0 and r["wk"] == "2019W01" and r["none"] is None and r["div0"] is None


def test_command_line_rank_job(spark, tmp_path):
    from shelfsight.__main__ import main
    src = write(tmp_path / "rank.csv",
                "Index,Date Detail,Company,Business Unit,Concept_NEW,Product Category,"
                "Company and Cost Centre,SKU,POS Net Sales,Rank Total\n"
                "1,2019W01,C,B,K,X,S1,A,5,1\n2,2019W02,C,B,K,X,S2,A,5,1\n")
    out = str(tmp_path / "out")
    assert main(["--local", "2", "rank", "--input", src, "--out", out]) == 0
    back = spark.read.option("header", True).csv(out).collect()
    assert sorted(str(r["range_expansion"]) for r in back) == ["None", "True"]


def test_malformed_cells_become_null(spark, tmp_path):
    from shelfsight.operators import oos
    p = write(tmp_path / "stock.csv",
              "SKU,Store,Category,Date,POS Net Sales,POS Qty Sold,POS Margin on Net Sales,Stock Balance Qty\n"
              "A,S1,Drinks,20240101,5,1,1,3\n"
              "A,S1,Drinks,2024-13-45,n/a,1,1,3\n"
              "A,S1,Drinks,20240102,\"1,250.5\",x,1,\n")
    rows = sorted(oos.clean_stock(readers.read_stock_daily(spark, p)).collect(),
                  key=lambda r: (r["Date"] is not None, str(r["Date"])))
    assert rows[0]["Date"] is None and rows[0]["NetSales"] is None
    assert rows[2]["NetSales"] == 1250.5 and rows[2]["QtySold"] is None and rows[2]["StockQty"] is None


def test_report_subset_and_reread(spark, tmp_path):
    p = write(tmp_path / "dist.csv", "Name,Facings,Capacity,Days Supply,Classification,Mat ID,# POGs\n"
                                     "Tea,1,12,3,A,1,1\n")
    sub = readers.read_dist_report(spark, p, columns=["Mat ID", "Name", "# POGs", "Facings", "Capacity"])
    assert sub.columns == ["Mat ID", "Name", "# POGs", "Facings", "Capacity"]
    out = str(tmp_path / "t")
    writers.write_parquet(sub.withColumnRenamed("Mat ID", "MatID").withColumnRenamed("# POGs", "POGS"), out)
    back = readers.read_table(spark, out).collect()[0]
    assert (back["MatID"], back["Name"], back["Capacity"]) == ("1", "Tea", "12")
    assert readers.read_table(spark, p, fmt="csv", schema=schemas.DIST_REPORT_SCHEMA).count() == 1


def test_command_line_inventory_all_stores(spark, tmp_path):
    from shelfsight.__main__ import main
    sales = write(tmp_path / "sales.csv",
                  "Date,Store,item,POS Gross Sales,POS Net Sales,POS Total Discount,POS Qty Sold,POS COGS (INV)\n"
                  + "".join(f"2019{m:02d},NZDF.AKL108,NZDF1-Tea,10,9,0,1,-5\n" for m in range(4, 10))
                  + "".join(f"2019{m:02d},NZDF.AKL109,NZDF1-Tea,10,9,0,1,-5\n" for m in range(7, 10)))
    dist = write(tmp_path / "dist-Departures.csv",
                 "Name,Facings,Capacity,Days Supply,Classification,Mat ID,# POGs\nTea,1,12,3,A,1,1\n")
    sub = write(tmp_path / "sub.csv", "SKU,SubCategory\nNZDF1-Tea,1-Drinks\n")
    ven = write(tmp_path / "ven.csv", "SKU,Vendor\nNZDF1-Tea,1-Acme\n")
    out = str(tmp_path / "out")
    assert main(["--local", "2", "inventory", "--sales", sales, "--report", dist, "--subcategory", sub,
                 "--vendor", ven, "--start", "2019-04-01", "--out", out, "--all-stores"]) == 0
    full = spark.read.option("header", True).csv(f"{out}/full_month").collect()
    assert sorted({r["Store"] for r in full}) == ["NZDF.AKL108", "NZDF.AKL109"]


def test_csv_columns_are_found_by_name(spark, tmp_path):
    """Extra and reordered columns do not shift values; a missing column and
    a second file with another header are errors."""
    from shelfsight.sources import readers
    p = tmp_path / "sub"
    p.mkdir()
    (p / "a.csv").write_text("\ufeffregion,SubCategory,SKU\nnorth,Tea,NZDF1-A\n")
    assert [tuple(r) for r in readers.read_subcategory(spark, str(p)).collect()] == [("NZDF1-A", "Tea")]
    with pytest.raises(ValueError, match="Vendor"):
        readers.read_vendor(spark, str(p))
    (p / "b.csv").write_text("SKU,SubCategory,region\nNZDF2-B,Tea,north\n")
    with pytest.raises(Exception):
        readers.read_subcategory(spark, str(p)).collect()


def test_csv_table_needs_a_schema(spark, tmp_path):
    from shelfsight.sources import readers
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path), "csv")
