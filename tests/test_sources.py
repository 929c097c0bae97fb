import datetime as dt
import io
import itertools
import zipfile

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money
from ledgerloom.functions import text as T
from ledgerloom.operators import ledger as L
from ledgerloom.sources import daily, statements, xlsx
from ledgerloom.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_scalars(spark):
    lit = F.lit
    assert one(spark, money.half_up(lit(-2.5))) == -2 and one(spark, money.half_away(lit(-2.5))) == -3.0
    assert one(spark, money.half_up(lit(2.5))) == 3 and one(spark, money.cents_half_up(lit(220), 1, 110)) == 2
    assert one(spark, T.amount(lit("¥1,2３4 円"))) == 1234.0 and one(spark, T.amount(lit("x"))) == 0.0 and one(spark, T.amount(lit("−5"))) == -5.0
    assert one(spark, T.rate(lit("50/60%"))) == 0.6 and one(spark, T.rate(lit("0.37"))) == 0.37
    assert one(spark, T.base_title(lit("タイトルA【完全版】"))) == "タイトルA" and one(spark, T.product_type(lit("A【分冊版】"))) == "分冊版" and one(spark, T.product_type(lit("A 分冊版"))) == T.ORIGINAL and one(spark, T.product_type(lit("A"))) == T.ORIGINAL
    assert one(spark, T.title_key(lit("ＡＢ Ｃ"))) == "abc" and one(spark, T.inserted(lit("abc"), lit("axbc"))) == 1 and one(spark, T.inserted(lit("abc"), lit("ac"))) is None
    assert one(spark, T.carry_key(lit("a"), lit(""), lit("t"))) is None and one(spark, T.channel_name(lit("Line "), {"line": "LINE"})) == "LINE"
    day = lit("2026-01-31").cast("date")
    assert one(spark, dates.shifted(day)) == dt.date(2026, 2, 28) and one(spark, dates.iso_month(lit("2024年5月"))) == dt.date(2024, 5, 1) and one(spark, dates.excel_serial(lit(45000))) == dt.date(2023, 3, 15)


def test_daily_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text('作品名,日付,ポイント\n"A, B",2024/5/3,"1,100"\n"A, B",2024/5/3,110\n,2024/5/3,5\nC,bad,7\n')
    got = daily.daily_rows(daily.read_table(spark, str(tmp_path / "a.csv")), daily.FORMATS["sokuhochi"]).collect()
    assert [tuple(r) for r in got] == [("A, B", "piccoma", dt.date(2024, 5, 3), 1100, 1210)]
    wide = spark.createDataFrame([("A", "110", "0", "9"), ("B", None, "220", "9")], ["作品", "05-01 Total売上", "05-02 Total売上", "05月"])
    got = {tuple(r)[:4] for r in daily.unpivoted(wide, "作品", "kpi", 2024).collect()}
    assert got == {("A", "kpi", dt.date(2024, 5, 1), 100), ("B", "kpi", dt.date(2024, 5, 2), 200)}
    assert spark.createDataFrame([("シーモア_5月.tsv", "x")], ["f", "h"]).select(daily.detect(F.col("f"), F.col("h")).alias("d")).first().d.format == "cmoa"


def test_statements(spark):
    month = dt.date(2026, 4, 1)
    lines = spark.createDataFrame([("A", "WT", "c", 1000.0, 400.0, month), ("A", "WT", "c", 5.0, 1.0, month), ("B", "EP", "c", None, 10.0, month)], "title string, kind string, channel string, sales double, pay double, month date")
    for name in statements.STATEMENTS:
        assert statements.settled(lines, name).count() >= 2
    got = {r.title: r for r in statements.settled(lines, "piccoma").collect()}
    assert (got["A"].total, got["A"].before_tax_income, got["A"].after_tax_income, got["A"].consumption_tax) == (1106, 441, 401, 40)
    assert got["A"].settlement_date == dt.date(2026, 5, 31) and statements.settled(lines, "dmm").first().total is None
    files = spark.createDataFrame([("renta_202604.csv", "書名,アップグレード冊数"), ("zzz.csv", "q")], ["file", "header"])
    assert {r.file: r.platform for r in statements.detected(files).collect()} == {"renta_202604.csv": "renta", "zzz.csv": None}


def test_xlsx(spark, tmp_path):
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>タイトル</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>12.5</v></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(out.getvalue())
    r = xlsx.read_xlsx(spark, str(tmp_path)).first()
    assert (r.sheet, r.row_index, r.cells) == ("S1", 1, ["タイトル", None, "12.5"])


def test_assignment_is_optimal():
    r = np.random.default_rng(3)
    for n, m in ((1, 1), (2, 2), (3, 3), (3, 5), (5, 6)):
        for _ in range(30):
            cost = r.integers(0, 9, (n, m)).astype(float)
            got = L.assign(cost)
            best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
            assert len(set(got)) == n and sum(cost[i, j] for i, j in enumerate(got)) == best


def test_comparison(spark):
    ours = spark.createDataFrame([("c", "t", "600", "1,000"), ("c", "t", "600", "5"), ("d", "u", None, "1")], ["channel", "title", "income", "total"])
    key = spark.createDataFrame([("c", "t", "600.0", "5"), ("c", "t", "600", "1000"), ("d", "u", "7", "2"), ("e", "v", "1", "1")], ["channel", "title", "income", "total"])
    got = {tuple(r) for r in L.compare_sheets(ours, key, ["channel", "title"], ["income", "total"]).collect()}
    assert got == {("d", "u", "field", "total", "1", "2"), ("e", "v", "missing", None, None, None)}


def test_strict_key_and_multiset_difference(spark):
    rows = spark.createDataFrame([("1", "1,0", 1), ("1.0", None, 2), ("1", "", 3), ("", "", 4), ("", "", 5)], "a string, b string, id int")
    keyed = rows.withColumn("k", L.strict_key("a", "b"))
    k = {r.id: r.k for r in keyed.collect()}
    assert k[2] == k[3] and k[1] != k[2]
    left = L.suppress_existing(keyed, keyed.where("id in (2, 4, 5)"), ["k"], ["id"], ["a", "b"])
    assert sorted(r.id for r in left.collect()) == [1, 3, 4, 5]


def test_streaming_ingest(spark, tmp_path):
    src = tmp_path / "in"
    day = dt.date(2024, 1, 1)
    spark.createDataFrame([("A", "c", day, 1, 2), ("A", "c", day, 3, None)], "title_jp string, channel string, sale_date date, sales_amount long, sales_amount_gross long").write.parquet(str(src))
    rows = spark.readStream.schema("title_jp string, channel string, sale_date date, sales_amount long, sales_amount_gross long").parquet(str(src))
    ingest.append_batches(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert [(r.title_jp, r.sales_amount, r.sales_amount_gross) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("A", 4, 2)]
