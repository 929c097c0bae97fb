from pyspark.sql import functions as F

from ledgerloom.functions.joins import with_group
from ledgerloom.sources import notices, readers, statements, xlsx


def test_rows_of_a_large_group_are_dealt_out_and_none_is_lost(spark):
    rows = spark.range(3000).selectExpr("CASE WHEN id < 2000 THEN 'a' WHEN id < 2600 THEN 'none' WHEN id < 2990 THEN concat('k', id % 50) END AS k", "id % 7 AS v")
    groups = rows.where("k <> 'none'").groupBy("k").agg(F.max("v").alias("top"))
    for how in ("inner", "left"):
        out = with_group(rows, groups, ["k"], how, large=100)
        want = rows.join(groups, ["k"], how)
        assert sorted(map(str, out.select("k", "v", "top").collect())) == sorted(map(str, want.select("k", "v", "top").collect()))
        assert out.columns == ["k", "v", "top"]


def test_a_sheet_of_many_rows_meets_its_header_without_a_shuffle_by_sheet_alone(spark):
    cells = spark.range(50).selectExpr("'f' AS file", "'動画リワード_株式会社RIVERSE' AS sheet", "CAST(id + 1 AS INT) AS row_index", "array('2026-05-01', '', '', 'T', '', '', '5', '40%', '2') AS cells")
    table = readers.sheet_table(cells, readers.READERS["piccoma_ads"])
    assert table.count() == 49 and {r.pay for r in table.collect()} == {"2"}
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "_deal" in plan and "rightHint=(strategy=broadcast)" in plan


def test_the_first_month_of_a_files_name_counts(spark):
    names = {"請求書_2405_201205.pdf": "2024-05-01", "請求書_2405_1201205.pdf": "2024-05-01", "x202405_2301.pdf": "2024-05-01", "9999_12305_2026年5月_202301": "2026-05-01", "2405": "2024-05-01", "a20241.x": None, "24051": None}
    out = spark.createDataFrame([(n,) for n in names], "n string").select("n", statements.file_month(F.col("n")).alias("m"))
    assert {r.n: r.m for r in out.collect()} == names


def test_titles_of_reports_and_details_are_taken_apart_once(spark):
    details = spark.createDataFrame([("f", 1, "作品 第1巻", 100), ("f", 2, "作品【分冊版】(1話～9話)", 5)], "file string, place int, title string, royalty long")
    draws = spark.createDataFrame([("f", 1, "作品（1）", 9)], "file string, place int, title string, draw long")
    months = spark.createDataFrame([("f", "2026-05-01")], "file string, sales_month string").withColumn("sales_month", F.to_date("sales_month"))
    records, problems = notices.sb_net(details, draws, months)
    assert [(r.title, r.before_tax_income) for r in records.collect()] == [("作品（１）", 96)] and problems.count() == 0
    parsed, _ = notices.ichijinsha_details(spark.createDataFrame([("a", "国内電子 作品 (3) 集計期間：2026年4月 1,200 国内電子 作品 3（MG） 集計期間：2026年4月 -200")], "file string, text string"))
    assert [(r.title, r.after_tax_income) for r in parsed.collect()] == [("作品（３）", 1000)]
    plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in (records, problems, parsed)]
    assert not any("PythonUDF" in p or "集計期間" in p for p in plans)


def test_the_columns_of_a_weekly_file_are_found_once_a_file(spark):
    rows = [("f", "Daily", i, c, 0) for i, c in enumerate((["x"], ["Date", "Sales", "Channel", "Title(JP)"], ["2026-05-01", "7", "c", "T"], ["2026-05-02", "0", "c", "T"]), 1)]
    out = xlsx.weekly_rows(spark.createDataFrame(rows, xlsx.SCHEMA))
    assert [(r.title_jp, r.channel, str(r.sale_date), r.sales_amount) for r in out.collect()] == [("T", "c", "2026-05-01", 7)]
    above = out._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "날짜" not in above
