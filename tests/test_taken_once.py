"""Steps that must compute a row's cells once: filters do not take them down to the rows they are made of."""

from pyspark.sql import functions as F

from ledgerloom.functions import titles as N
from ledgerloom.functions.joins import with_group
from ledgerloom.sources import daily, readers, workbooks


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _filters(df, word):
    return [x for x in _plan(df).splitlines() if "Filter" in x and word in x]


def _sheet(spark):
    rows = [("f", "請求書", 1, ["x"]), ("f", "請求書", 2, ["単価", "内容 ", "金\n額"]), ("f", "請求書", 3, ["5", "a", "7"]), ("f", "請求書", 4, ["内容", "金額", "単価"]), ("g", "請求書", 1, ["a", "1"])]
    return spark.createDataFrame(rows, "file string, sheet string, row_index int, cells array<string>")


def test_sheet_rows_are_counted_with_their_header(spark):
    table = readers.sheet_table(_sheet(spark), readers.READERS["invoice"])
    assert sorted(map(tuple, table.select("row_index", "title", "price", "sales", "rate").collect())) == [(3, "a", "5", "7", None), (4, "金額", "内容", "単価", None)]
    # the rows are read for the header and their number together, not for each
    assert _plan(table).count("count(1)") <= 2 and "min(struct" not in _plan(table)


def test_groups_that_know_their_size_do_not_read_the_rows_for_it(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "k string, v int")
    groups = spark.createDataFrame([("a", "x", 2), ("b", "y", 1)], "k string, w string, n long")
    met = with_group(rows, groups, ["k"], large=1, counted="n")
    assert sorted(map(tuple, met.collect())) == [("a", 1, "x"), ("a", 2, "x"), ("b", 3, "y")]
    assert "count(1)" not in _plan(met)


def test_amounts_of_invoices_are_taken_before_they_are_asked_for(spark):
    own = readers.lines(readers.sheet_table(_sheet(spark), readers.READERS["invoice"]), "invoice")
    assert [tuple(r) for r in own.select("title", "sales").collect()] == [("a", 7.0)]
    assert not _filters(own, "array_position") and not _filters(own, "trim(coalesce(cells")


def test_months_of_cumulative_workbooks_are_taken_once(spark):
    head = [None] * 8 + ["판매월"]
    body = lambda month, n: [None, "k", "t"] + [None] * 5 + [month] + [None] * 5 + ["c"] + [None] * 7 + [n]
    rows = [("f", "누계", 5, head), ("f", "누계", 6, body("2024-05", "7")), ("f", "누계", 7, body("24.06.30", "8")), ("f", "누계", 8, body("2024-13", "9")), ("f", "누계", 9, body("#N/A", "9"))]
    out = workbooks.cumulative_sales(spark.createDataFrame(rows, "file string, sheet string, row_index int, cells array<string>"))
    assert sorted((str(r.sale_date), r.sales_amount) for r in out.collect()) == [("2024-05-01", 7), ("2024-06-01", 8)]
    assert not _filters(out, "trunc(")


def test_days_of_files_are_taken_once(spark):
    texts = ["2024-05-03", "2024/5/3", "20240503", "2024-05-03～2024-05-09", "2024-13-01", "2024-05", "", None, "2024-5-3 "]
    table = spark.createDataFrame([(x, "t", "1") for x in texts], "`販売日` string, `タイトル名` string, `販売額計` string")
    assert [str(r[0]) for r in table.select(daily.day_of(F.col("販売日"))).collect()] == ["2024-05-03"] * 4 + ["None"] * 4 + ["2024-05-03"]
    out = daily.daily_rows(table, daily.FORMATS["line_manga"])
    assert [tuple(map(str, r)) for r in out.select("sale_date", "sales_amount").collect()] == [("2024-05-03", "5")]
    assert not _filters(out, "regexp")


def test_patterns_of_series_are_tried_where_their_sign_is(spark):
    titles = {"a 12巻": ("a", "EB"), "a 3話 外伝2": ("a", "EP"), "a巻 5話": ("a巻", "EP"), "a 7": ("a", "WT"), "a": ("a", "WT"), "1 2": ("1", "WT"), "［ａ］～ 4": ("［ａ］～", "WT")}
    rows = spark.createDataFrame([(t,) for t in titles], "t string").withColumn("s", N.dmm_series(F.col("t")))
    assert {r.t: (r.s.series, r.s.kind) for r in rows.collect()} == titles
    assert [r[0] for r in spark.createDataFrame([("［a］～１ b　♥",), ("a b",), (None,)], "t string").select(N.dmm_title(F.col("t"))).collect()] == ["[a]〜1b", "ab", None]
    assert "Contains(" in _plan(rows.select("s.kind"))
