import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.sources import workbooks as W

CELLS = "file string, sheet string, row_index int, cells array<string>"


def cells(spark, sheet, rows, first=1):
    return spark.createDataFrame([("f.xlsx", sheet, first + i, r) for i, r in enumerate(rows)], CELLS)


def at(values, width=24):
    return [values.get(i) for i in range(width)]


def test_days_of_any_form(spark):
    rows = spark.createDataFrame([("46113",), ("26.04.01",), ("98.04.01",), ("2026.04.01",), ("2026-04-01",), ("9999",), ("26.13.01",), (None,)], "t string")
    april = dt.date(2026, 4, 1)
    assert [r.d for r in rows.select(W.any_day(F.col("t")).alias("d")).collect()] == [april, april, dt.date(1998, 4, 1), april, april, None, None, None]


def test_cumulative_and_four_column_sales(spark):
    rows = [at({8: "x"}), at({8: "판매월"}), at({1: "k", 2: "A", 8: "2026-04-30", 14: "piccoma", 22: "¥1,000"}), at({2: "B", 8: "46143", 14: "cmoa", 22: "10.5"}), at({2: "#N/A", 8: "2026-04", 14: "c", 22: "5"}), at({2: "C", 8: "2026-04", 14: "c", 22: "0"})]
    got = W.cumulative_sales(cells(spark, "누계매출", rows).union(cells(spark, "other", rows))).collect()
    assert sorted(tuple(r) for r in got) == [("A", "k", "piccoma", dt.date(2026, 4, 1), 1000), ("B", "", "cmoa", dt.date(2026, 5, 1), 11)]
    rows = [["期間"], ["作品", "ch", "日", "円"], ["A", " piccoma ", "2026/4/3", "1,200"], ["A", None, "46113", "5"], ["", "c", "46113", "5"], ["B", "c", "bad", "5"], ["C", "c", "46113", "-1"]]
    assert sorted(tuple(r) for r in W.four_column_sales(cells(spark, "s", rows)).collect()) == [("A", "", dt.date(2026, 4, 1), 5), ("A", "piccoma", dt.date(2026, 4, 3), 1200)]
    assert W.four_column_sales(cells(spark, "s", [["head"], ["A", "c", "46113", "7"]])).count() == 1


def test_initial_sales_meet_in_a_full_join(spark):
    daily = [["h"], ["h"], ["A", "픽코마", "g", None, "46113", None, "3", "1", "2"], ["A", "픽코마", "g2", None, "26.04.01", "독점", "4", "5"], [None, "x"], ["Z", "x", "g", None, "soon"]]
    weekly = [["h"], ["h"], ["A", "픽코마", "w", None, "2026-04-01", None, "9", "70"], ["B", "Other", None, "p", "46113", "", "x", "80"]]
    got = {r.title_kr: r for r in W.initial_sales(cells(spark, "초동 일별", daily).union(cells(spark, "초동 주간", weekly))).collect()}
    a, b = got["A"], got["B"]
    assert set(got) == {"A", "B"} and (a.platform_code, a.genre_kr, a.launch_type, a.launch_episodes, a.d1, a.d2, a.w1, a.w12) == ("piccoma", "g2", "독점", 4.0, 5.0, 0.0, 70.0, 0.0)
    assert (b.platform_code, b.genre_kr, b.pf_genre, b.launch_type, b.launch_episodes, b.d1, b.w1) == ("other", None, "p", "비독점", 0.0, 0.0, 80.0)


def test_content_master_takes_the_first_column_of_a_field(spark):
    rows = [["title"], ["JP タイトル\n(仮)", "作品名(KR)", "制作会社", "制作会社", "備考"], ["A", "가", "one", "two", " - "], [None, " ", "x", None, None], ["-", "나", None, "two", "n"]]
    got = W.content_master(cells(spark, "日本(版面)準備作品", rows).union(cells(spark, "other", rows))).orderBy("source_row").collect()
    a, b = got
    assert (a.source_row, a.status, a.title_jp, a.title_kr, a.production_company, a.notes) == (3, "prep", "A", "가", "one", None)
    assert a.raw_data == {"JP タイトル (仮)": "A", "作品名(KR)": "가", "制作会社": "one", "制作会社 (3)": "two", "備考": " - "}
    assert (b.title_jp, b.title_kr, b.production_company, b.raw_data["制作会社"]) == (None, "나", None, "two")


def test_the_older_workbook_has_62_columns(spark):
    records = spark.createDataFrame([("", "u", "50%", 0.4, 12.0, dt.date(2026, 4, 1), None), ("i", "u", None, 0.4, None, None, 3.0)], "unique_identifier string, unique_id string, rs_label string, rs_rate double, total_amount_jpy double, sales_month date, fee_jpy double")
    out = W.old_workbook_rows(records)
    assert len(out.columns) == 62 and out.columns[30] == "col31" and out.columns[43] == "note2" and W.month_sheet("202604") == "일본_신INPUT_4월"
    a, b = out.collect()
    assert (a.unique_identifier, a.rs, a.total_amount_jpy, a.sales_month, a.fee_jpy, a.company, a.mg_end, a.extra_62) == ("u", "50%", 12.0, dt.date(2026, 4, 1), 0.0, "RJ", 0.0, None)
    assert (b.unique_identifier, b.rs, b.total_amount_jpy, b.fee_jpy, b.rate_krw_krw) == ("i", "0.4", None, 3.0, 1.0)
