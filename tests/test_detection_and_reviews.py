import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import analytics as A
from ledgerloom.operators import ledger as L
from ledgerloom.sources import reports
from ledgerloom.sources.detection import detect_daily


def test_formats_of_daily_files(spark):
    rows = [
        ("[RVJP] Weekly Report.xlsx", None, True, "weekly_report", "", False, "high", "weekly_report"),
        ("누계매출.xlsx", None, True, "ruikei_metadata", "", False, "high", "ruikei_metadata"),
        ("mecha_PRODUCT_KPI.csv", None, False, "piccoma_kpi", "Mechacomic", True, "high", "sokuhochi_kpi"),
        ("product_kpi.csv", None, False, "piccoma_kpi", "Piccoma", True, "high", "sokuhochi_kpi"),
        ("app_kan_daily_sales_log.csv", None, False, "piccoma_sokuhochi", "", True, "medium", "sokuhochi_app_kan"),
        ("ピッコマ速報.csv", None, False, "piccoma_sokuhochi", "Piccoma", True, "high", "sokuhochi"),
        ("シーモア.xlsx", None, True, "cmoa_sokuhochi", "cmoa", True, "high", "sokuhochi_cmoa_excel"),
        ("cmoa.tsv", None, False, "cmoa_sokuhochi", "cmoa", True, "high", "sokuhochi_cmoa"),
        ("LINE_2026.csv", None, False, "linemanga_sokuhochi", "LINEマンガ", True, "high", "sokuhochi_line"),
        ("FANZA_商品.csv", None, False, "dmm_sokuhochi", "DMM", True, "high", "sokuhochi_dmm"),
        ("x.csv", "日付,ブック名,購入ポイント数", False, "piccoma_sokuhochi", "", True, "medium", "sokuhochi"),
        ("x.csv", "商品タイトル,売上金額,カテゴリ", False, "dmm_sokuhochi", "DMM", True, "high", "sokuhochi_dmm"),
        ("x.csv", "商品タイトル,売上金額", False, "unknown", "", False, "low", "sokuhochi"),
        ("u-next.xlsx", None, True, "weekly_report", "U-NEXT", False, "low", "weekly_report"),
        (None, None, None, "unknown", "", False, "low", "sokuhochi"),
    ]
    got = spark.createDataFrame([r[:3] for r in rows], "f string, h string, b boolean").select("f", "h", detect_daily(F.col("f"), F.col("h"), F.col("b")).alias("d")).collect()
    assert [(r.f, r.h, *r.d) for r in got] == [(r[0], r[1], *r[3:]) for r in rows]


def test_what_cells_mean(spark):
    rows = [("１,２３４", "n:1234.0"), ("-5.50", "n:-5.5"), (" ﾀｲﾄﾙ　Ａ ", "t:タイトル A"), ("", "t:"), ("1-2", "t:1-2"), (None, None)]
    assert [tuple(r) for r in spark.createDataFrame(rows, "x string, y string").select(T.semantic(F.col("x"), "string"), "y").collect()] == [(y, y) for _, y in rows]
    day = spark.createDataFrame([(dt.date(2026, 5, 1), 7, True)], "d date, n long, b boolean").select(T.semantic(F.col("d"), "date"), T.semantic(F.col("n"), "bigint"), T.semantic(F.col("b"), "boolean"))
    assert tuple(day.first()) == ("t:2026-05-01", "n:7", "t:true")


def test_sheets_are_compared_by_meaning(spark):
    ours = spark.createDataFrame([("k", "1,234", dt.date(2026, 5, 1), "ＡＢ"), ("k", "5", None, "x"), ("l", "1.00000001", None, "")], "i string, n string, d date, t string")
    theirs = spark.createDataFrame([("k", "5", "2026-01-01", "y"), ("k", "1234.0", "2026-05-01", "AB"), ("l", "1", None, None)], "i string, n string, d string, t string")
    assert [tuple(r) for r in L.compare_sheets(ours, theirs, ["i"], ["n", "d", "t"]).collect()] == [("k", "field", "t", "x", "y")]


def test_insertions_are_counted_in_order(spark):
    rows = [("abc", "axbyc", 2), ("abc", "acb", None), ("", "xy", 2), ("ab", "ab", 0), ("aab", "ab", None), (None, "a", None), ("a", None, None), ("再婚", "再口婚", 1), ("a.c", "abc", None)]
    assert [r[0] for r in spark.createDataFrame([r[:2] for r in rows], "s string, l string").select(T.inserted(F.col("s"), F.col("l"))).collect()] == [r[2] for r in rows]


def test_reviews_and_pages(spark):
    at = dt.datetime(2026, 5, 1)
    reviews = spark.createDataFrame([("r", 1, "resolved", None, at), ("r", 1, None, "why", at.replace(day=2)), ("r", 1, "pending", None, at.replace(month=1)), ("r", 2, "maybe", None, at), ("r", 3, None, None, at), ("r", 4, None, "x" * 2001, at)], "run_id string, diff_id int, status string, note string, reviewed_at timestamp")
    kept, odd = reports.checked_reviews(reviews)
    assert sorted((r.diff_id, r.problem) for r in odd.collect()) == [(2, "unknown status"), (3, "neither status nor note"), (4, "note too long")]
    rows = reports.reviewed(spark.createDataFrame([("r", i, ("field", "extra")[i % 2]) for i in range(1, 251)], "run_id string, diff_id int, category string"), kept)
    page, count = reports.diff_page(rows, "extra", "resolved")
    assert ([tuple(r) for r in page.collect()], count) == ([("r", 1, "extra", "resolved", "why")], 1)
    page, count = reports.diff_page(rows, offset=-5, limit=900)
    assert (page.count(), count) == (200, 250)
    assert [r.diff_id for r in reports.diff_page(rows, "field", offset=3, limit=0)[0].collect()] == [8]
    for odd in ({"category": "x"}, {"status": "x"}):
        with pytest.raises(ValueError, match="must be one of"):
            reports.diff_page(rows, **odd)


def test_titles_in_seven_orders(spark):
    day = dt.date(2026, 1, 1)
    sales = spark.createDataFrame([("い【完全版】", "x", day, 5), ("い", "y", day.replace(month=2), 1), ("ア", "x", day, 9), ("Z", "z", day.replace(year=2025), 2), ("Z", "x", day, 2)], "title_jp string, channel string, sale_date date, sales_amount long")
    titles = spark.createDataFrame([("い【完全版】", "い", "잘못", "g", "c"), ("い", "い", "나", "い", "b"), ("ア", "ア", "가", None, "a"), ("Z", "Z", None, "ア", "Ａ")], "title_jp string, base_title string, title_kr string, genre string, company string")
    rows = A.listed_titles(sales, titles, T.ORIGINAL)
    order = lambda key, down=False: "".join(r.base_title for r in A.in_list_order(rows, key, down).collect())
    assert (order("sales"), order("sales", True), order("?", True)) == ("Zいア", "アいZ", "アいZ")
    assert order("title_jp") == "Zアい" and order("title_kr") == "Zアい" and order("genre") == "アZい"
    assert order("company") in ("アZい", "Zアい") and order("platforms") == "アZい" and order("newest") == "Zアい"
    assert {r.base_title: (r.channel_count, r.title_kr) for r in rows.collect()}["い"] == (2, "나")
