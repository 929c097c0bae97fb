import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import statements
from ledgerloom.sources.readers import READERS, comico_lines, lines, piccoma_lines, sheet_table, text_table, with_detail

CELLS = "file string, sheet string, row_index int, cells array<string>"
APRIL = dt.date(2026, 4, 1)


def placed(values, width=31):
    row = [None] * width
    for at, v in values.items():
        row[at] = v
    return row


def cells(spark, file, sheet, rows):
    return spark.createDataFrame([(file, sheet, i + 1, r) for i, r in enumerate(rows)], CELLS)


def table(spark, reader, file, *rows):
    t = spark.createDataFrame(rows, [c for f, c in READERS[reader].columns.items()])
    return text_table(t, READERS[reader], F.lit(file))


def test_every_reader_has_amounts():
    assert {p.removesuffix("_volumes").removesuffix("_detail") for p in READERS} == set(statements.STATEMENTS)


def test_header_rows_are_found_in_each_sheet(spark):
    head = ["x", " シリーズ名 ", "書名", "売上金額", "率", "支払", "種別"]
    rows = [["めちゃコミック"], None, head, ["1", "作品 改訂版", "a", "1,000", "40", "400", "話"], ["2", "B", "b", "10", "30", "3", "巻"], ["3", None, "c", "7", "1", "1", "巻"]]
    both = cells(spark, "RIVERSE_202604.xlsx", "アプリ明細", rows).union(cells(spark, "RIVERSE_202604.xlsx", "スマートフォン明細", [head[1:], ["B", "b", "5", "50", "2", "巻"]])).union(cells(spark, "RIVERSE_202604.xlsx", "集計", [head, ["1", "Z", "a", "9", "9", "9", "話"]]))
    got = lines(sheet_table(both, READERS["mechacomic"]), "mechacomic")
    assert sorted((r.title, r.kind, r.sales, r.pay, r.rate, r.month) for r in got.collect()) == [("B", "EB", 5.0, 2.0, 0.5, APRIL), ("B", "EB", 10.0, 3.0, 0.3, APRIL), ("作品 改訂版", "WR", 1000.0, 400.0, 0.4, APRIL)]
    b = statements.settled(got, "mechacomic").where("title = 'B'").first()
    assert (b.after_tax, b.before_tax_income, b.after_tax_income, b.total, b.row_count) == (15, 5, 5, None, 2)
    assert sheet_table(cells(spark, "f", "アプリ明細", [["x"], ["y"]]), READERS["mechacomic"]).count() == 0


def test_renta_and_ebookjapan(spark):
    got = lines(table(spark, "renta", "PAS_202604.csv", ("作品A【タテコミ】", "100", "3", "2", "185"), ("作品A【分冊版】", "50", "1", "0", "20"), (" ", "1", "1", "1", "1")), "renta")
    assert sorted((r.kind, r.sales, r.pay, r.month) for r in got.collect()) == [("EP", 50.0, 20.0, APRIL), ("WT", 500.0, 185.0, APRIL)]
    out = statements.settled(got, "renta").where("kind = 'WT'").first()
    assert (out.total, out.after_tax, out.consumption_tax, out.before_tax_income, out.settlement_date) == (550, 500, 18, 203, dt.date(2026, 6, 30))
    rows = [("B【タテヨミ】", "LINEマンガ", "話", "s", "100", "40"), ("B【タテヨミ】", "ebookjapan", "話", "s", "10", "4"), ("C", "ebookjapan", "巻", "s", "7", "3"), ("D", "", "巻", "s", "7", "3")]
    got = lines(table(spark, "line_ebj", "ExportCSV_20260609132654817.csv", *rows), "line_ebj")
    assert sorted((r.title, r.channel, r.kind, r.month) for r in got.collect()) == [("B【タテヨミ】", "ebj_webtoon", "WT", dt.date(2026, 5, 1)), ("B【タテヨミ】", "line", "WT", APRIL), ("C", "ebj", "EB", dt.date(2026, 5, 1))]
    assert {r.settlement_date for r in statements.settled(got, "line_ebj").collect()} == {dt.date(2026, 6, 30)}


def test_cmoa_takes_sales_from_the_detail(spark):
    got = lines(table(spark, "cmoa", "CD1_N1100_202604_meisai_ALL.tsv", ("作品〜【タテヨミ】", "440.9"), ("別【連載版】", "40"), ("総合計", "480")), "cmoa")
    detail = spark.createDataFrame([("作品〜【タテヨミ】", "500", "2", "45.0"), ("作品〜【タテヨミ】", "50", "2", "0")], ["タイトル名", "単価", "件数", "料率"])
    both = with_detail(got, detail)
    assert sorted((r.title, r.kind, r.sales, r.rate) for r in both.collect()) == [("作品～【タテヨミ】", "WT", 1100.0, 0.45), ("別【連載版】", "EP", 0.0, 0.4)]
    out = {r.kind: r for r in statements.settled(both, "cmoa").collect()}
    assert (out["WT"].after_tax, out["WT"].total, out["WT"].before_tax_income, out["WT"].consumption_tax) == (1100, 1210, 440, 44)
    assert (out["EP"].after_tax, out["EP"].total) == (100, 110)


def test_piccoma_sets_the_summary_against_the_detail(spark):
    summary = sheet_table(cells(spark, "f", "227", [[None, "期間"], [], [None, "No.", "作品"], [None, "1", "A", "26"] + [None] * 4 + ["100", "20", None, None, "130", "10"], [None, None, "合計", "26"] + [None] * 4 + ["9"] * 6]), READERS["piccoma"])
    head = [["h"]]
    sold = lambda kind, sheet, place: lines(sheet_table(cells(spark, "出版社report_株式会社RIVERSE_20260401.xlsx", sheet, head + [placed({0: "1", 2: "A", place: "500", place + 1: "26", place + 2: "130"})]), READERS[kind]), kind)
    chapters = sold("piccoma_detail", "<話売>精算対象使用件数", 14)
    assert [(r.title, r.kind, r.sales, r.pay, r.rate, r.month) for r in chapters.collect()] == [("A", "WT", 500.0, 130.0, 0.26, APRIL)]
    got = piccoma_lines(summary, chapters, F.lit(APRIL))
    assert sorted((r.kind, round(r.sales, 6), r.pay) for r in got.collect()) == [("EB", round(20 / 0.26, 6), 20.0), ("WT", 500.0, 130.0)]


def test_comico_counts_paid_coins_of_magazines(spark):
    row = lambda title, content, rate: placed({0: "2026", 1: "4", 2: content, 5: title, 10: "110", 14: "220", 20: rate, 21: "30", 30: "50"})
    sheet = cells(spark, "202604.xlsx", "プラットフォーム売上現況", [["a"], ["b"], row("M", "magazine_comic", "0.5"), row("M", "x", "0.5"), row("W", "webtoon", "0.6"), row("W【完全版】", "webtoon", "0.6"), row("N", "webtoon", "0.55")])
    got = comico_lines(lines(sheet_table(sheet, READERS["comico"]), "comico"))
    assert sorted((r.title, r.kind, r.sales, r.pay, r.month) for r in got.collect()) == [("M", "EP", 220.0, 60.0, APRIL), ("N", "EP", 110.0, 30.0, APRIL), ("W", "WR", 220.0, 50.0, APRIL), ("W【完全版】", "WT", 220.0, 50.0, APRIL)]
    w = statements.settled(got, "comico").where("title = 'W'").first()
    assert (w.total, w.before_tax, w.after_tax, w.before_tax_income, w.consumption_tax, w.after_tax_income) == (220, 220, 200, 55, 5, 50)


def test_rows_that_are_records_by_themselves(spark):
    rows = [("2026年4月", "A", "ブックライブ", "WT", "1000", "380", "419", "39"), ("2026年4月", "A", "ブックライブ", "WT", "10", "3.8", "4", "0"), ("2026年4月", "A", "よその店", "WT", "1", "1", "1", "1"), ("2026年4月", "B", "ブッコミ", "版面", "0", "0", "0", "0")]
    out = statements.settled(lines(table(spark, "booklive", "f", *rows), "booklive"), "booklive").collect()
    assert sorted((r.channel, r.kind, r.total, r.before_tax, r.before_tax_income, r.after_tax_income, r.consumption_tax) for r in out) == [("bookcomi", "EP", 0, 0, 0, 0, 0), ("booklive", "WT", 11, 9, 4, 4, 0), ("booklive", "WT", 1100, 909, 419, 380, 39)]
    out = statements.settled(lines(table(spark, "kadokawa", "f", ("本", "1,100", "2026/05/31", "2026/04/01"), ("零", "0", "2026/05/31", None)), "kadokawa"), "kadokawa").collect()
    assert [(r.title, r.total, r.after_tax, r.consumption_tax, r.is_summary, r.sales_month, r.settlement_date) for r in out] == [("本", 1100, 1000, 100, True, APRIL, dt.date(2026, 5, 31))]
    months = lines(table(spark, "lezhin_beltoon", "beltoon_2026_Q2.xlsx", ("T", "9", "4", "50%", "Apr-26"), ("T分冊版", "9", "4", "50", None), ("U", "9", "4", None, "2026.4")), "lezhin_beltoon").collect()
    assert sorted((r.title, r.kind, r.channel, r.rate, r.month) for r in months) == [("T", "WT", "beltoon", 0.5, APRIL), ("T分冊版", "EP", "beltoon", 0.5, APRIL), ("U", "WT", "beltoon", None, APRIL)]


def test_positions_and_names_of_sheets(spark):
    ads = cells(spark, "f", "動画リワード_株式会社RIVERSE", [["h"] * 9, ["2026-04-01", None, None, "A", "iOS", None, "7711.99", "0.25", "1927.75"], ["2026-04-02", None, None, "A", "iOS", None, "0.01", "0.25", "0"]])
    out = statements.settled(lines(sheet_table(ads, READERS["piccoma_ads"]), "piccoma_ads"), "piccoma_ads").first()
    assert (out.after_tax, out.total, out.after_tax_income, out.consumption_tax, out.before_tax_income) == (7011, 7712, 1753, 175, 1928)
    sheet = lambda name: cells(spark, "9_支払通知書_202604.xlsx", name, [["h"] * 10, placed({0: "1", 4: "作品 3話", 8: "2", 9: "100"}, 10), placed({0: "1", 4: "作品 4話", 8: "2", 9: "11"}, 10)])
    got = lines(sheet_table(sheet("ﾌﾞｯｸｽ(ｱﾀﾞﾙﾄ)").union(sheet("他")), READERS["dmm"]), "dmm")
    assert {(r.title, r.kind, r.channel, r.month) for r in got.collect()} == {("作品", "EP", "dmm_fanza", APRIL)}
    out = statements.settled(got, "dmm").first()
    assert (out.after_tax, out.after_tax_income, out.total) == (111, 50, None)
    month = cells(spark, "beaglee.xlsx", "202604", [["x"], ["コミック名称", "課金額（税抜）", "ロイヤリティ(税抜)", "ロイヤリティ率"], ["待ちコミA", "1000", "455", "45.5%"], ["合計", "1000", "455", None]])
    got = lines(sheet_table(month, READERS["beaglee"]), "beaglee").collect()
    assert [(r.title, r.kind, r.month, r.rate) for r in got] == [("待ちコミA", "WT", APRIL, 0.455)]
    bill = cells(spark, "【請求書】_2026年4月.xlsx", "請求書", [["件名：x"], ["№", "内容", "単価", "印税率", "数量", "金額"], ["1", "ロイヤリティ", "5", "-", "1", "1,005"], ["", "振込手数料は", None, None, None, "3"]])
    out = statements.settled(lines(sheet_table(bill, READERS["invoice"]), "invoice"), "invoice").collect()
    assert [(r.total, r.after_tax, r.after_tax_income, r.consumption_tax) for r in out] == [(1106, 1005, 1005, 101)]


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="支払額"):
        text_table(spark.createDataFrame([("x",)], ["タイトル名"]), READERS["cmoa"])
