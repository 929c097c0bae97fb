import datetime as dt

from ledgerloom.sources import invoices as I
from ledgerloom.sources import notices

CELLS = "file string, sheet string, row_index int, cells array<string>"


def sheet(file, *rows):
    return [(file, "請求書", i, list(r)) for i, r in enumerate(rows, 1)]


HEAD = ["№", "内容", "単価", "印税率", "数量", "金額"]


def test_sheets_are_set_against_their_totals(spark):
    good = sheet(
        "【請求書】一迅社様.xlsx", ["件名：2026年4月 電子"], ["発行日", "2026-05-10"], ["お支払期限", "", "2026年6月30日"], ["御請求金額", "", "¥1,210"], HEAD,
        ["1", "電子「作品」第1～2巻", "500", "-", "2", "1000"], ["2", "「別」原稿料", "100", "10%", "1", "100"], ["小計", "", "1,100"], ["消費税額(10%)", "110"], ["", "振込手数料はご負担ください"], ["9", "後", "1", "", "1", "5"],
    )
    bad = sheet("b_202603.xlsx", HEAD, ["1", "A", "1", "", "1", "7"], ["小計", "8"])
    alone = sheet("c.xlsx", ["件名：まとめ"], ["発行日", "2026/05/01"], ["御請求金額", "2,200"])
    nothing = sheet("d.xlsx", ["x"])
    records, problems = I.invoice_records(spark.createDataFrame(good + bad + alone + nothing, CELLS))
    got = sorted((r.file[:2], r.title, r.amount, r.unit_price, r.quantity, str(r.sales_month), str(r.settlement_month), r.before_tax_income, r.is_summary) for r in records.collect())
    assert got == [
        ("b_", "A", 7, 1, 1, "2026-03-01", "None", 8, False), ("c.", "まとめ", 2000, None, None, "2026-05-01", "None", 2200, True),
        ("【請", "「別」原稿料", 100, 100, 1, "2026-04-01", "2026-06-01", 110, False), ("【請", "電子「作品」第1～2巻", 1000, 500, 2, "2026-04-01", "2026-06-01", 1100, False),
    ]
    assert sorted((r.file, r.problem) for r in problems.collect()) == [("b_202603.xlsx", "lines differ from the subtotal"), ("d.xlsx", "no lines and no totals")]
    lines = records.where("file like '【%'").selectExpr("file", "1 as place", "title", "quantity", "unit_price", "amount", "cast(sales_month as string)", "cast(settlement_month as string)")
    spread = sorted((r.title, r.after_tax_income, r.sales_month) for r in notices.ichijinsha_invoice(lines).collect())
    assert spread == [("作品（１）", 500, "2026-06-01"), ("作品（２）", 500, "2026-06-01"), ("別", 100, "2026-04-01")]


def test_printed_twins_give_their_total(spark):
    rows = [("【請求書】X様.pdf", "株式会社 件名：MG 2026年4月分  御請求金額 2026年5月末日¥11,000,000 お支払期限：2026年6月30日"), ("x_202605.pdf", "御請求金額 ¥109"), ("y.pdf", " "), ("z.pdf", "御請求金額 なし")]
    records, problems = I.printed_invoices(spark.createDataFrame(rows, "file string, text string"))
    got = sorted((r.title, r.sales_month, r.settlement_month, r.total, r.net, r.tax) for r in records.collect())
    assert got == [("MG 2026年4月分", dt.date(2026, 4, 1), dt.date(2026, 6, 1), 11_000_000, 10_000_000, 1_000_000), ("x_202605", dt.date(2026, 5, 1), None, 109, 99, 10)]
    assert sorted((r.file, r.problem) for r in problems.collect()) == [("y.pdf", "no text"), ("z.pdf", "no total")]


def test_what_several_steps_read_is_written_once(spark):
    cells = spark.createDataFrame(sheet("b_202603.xlsx", HEAD, ["1", " A\n", "1", "", "1", "7"], ["小計", "8"]), CELLS)
    records, _ = I.invoice_records(cells)
    assert [(r.title, r.amount) for r in records.collect()] == [("A", 7)]
    assert {kind for kind in ("invoice-lines", "invoice-totals") if any(kind in f for f in records.inputFiles())} == {"invoice-lines", "invoice-totals"}
