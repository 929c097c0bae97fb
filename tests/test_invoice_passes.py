"""Invoices' sheets: looked through for header and footer at once, and for labels only where there is one."""

from ledgerloom.sources import invoices, readers

CELLS = "file string, sheet string, row_index int, cells array<string>"
HEAD = ["№", "内容", "単価", "印税率", "数量", "金額"]


def _sheets(spark):
    line = lambda i, title, amount: (i, ["1", title, "5", "-", "1", amount])
    files = {
        "a": [line(1, "above", "7"), (2, HEAD), line(3, "A", "100"), line(4, "B", "50"), (5, ["", " 振込手数料は"]), line(6, "below", "9"), (7, ["小計", "", "150"])],
        "b": [(1, ["振込先"]), (2, HEAD), line(3, "C", "10")],  # the footer above the header: no lines
        "c": [(1, HEAD), line(2, "D", "20"), (3, ["小計", "21"])],
        "d": [(1, ["x", None])],
        "e": [(1, ["御請求金額", "¥1,100"]), (2, ["消費税額", "100"]), (3, None)],
    }
    return spark.createDataFrame([(f, s, i, c) for f, rows in files.items() for s in ["請求書"] for i, c in rows] + [("f", "other", 1, ["小計", "3"])], CELLS)


def test_lines_between_header_and_footer(spark):
    records, problems = invoices.invoice_records(_sheets(spark))
    assert sorted((r.file, r.title, r.after_tax_income) for r in records.collect()) == [("a", "A", 100), ("a", "B", 50), ("c", "D", 20), ("e", "e", 1000)]
    assert sorted((p.file, p.problem) for p in problems.collect()) == [("b", "no lines and no totals"), ("c", "lines differ from the subtotal"), ("d", "no lines and no totals")]


def test_a_sheet_ends_in_its_own_pass(spark):
    cells = _sheets(spark)
    table = readers.sheet_table(cells, readers.READERS["invoice"], until=cells["row_index"] == 4)
    assert sorted((r.file, r.title) for r in table.where("title is not null").collect()) == [("a", "A"), ("b", "C"), ("c", "21"), ("c", "D")]
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # with the header alone, whose row says where the sheet ends: of large sheets, of others


def test_rows_without_a_label_are_not_sorted_for_totals(spark):
    totals = invoices.invoice_totals(_sheets(spark))
    assert sorted(r.file for r in totals.collect()) == ["a", "b", "c", "d", "e"]
    plan = totals._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("max_by") :]
    labels = below.index(f"{invoices.SUBJECT}|{invoices.ISSUED}")
    assert "Filter" in below[labels - 200 : labels]
