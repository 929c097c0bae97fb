"""Daily files of each format, the sales as they would stand in them, and queries over keys, numbers and stored comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import ledger as L
from ledgerloom.operators import settlement as S
from ledgerloom.plans import views as V
from ledgerloom.plans.registry import HALF, on_ledger, query
from ledgerloom.sources import daily, reports, workbooks, xlsx
from ledgerloom.sources.versioned import shared_folder

_NET = f"CAST(floor(CAST({{0}} AS DOUBLE) / CAST(1.1 AS DOUBLE) + {HALF}) AS BIGINT)"
_SUM = "CAST(sum({0}) AS BIGINT)"
_NO = "CAST(NULL AS BIGINT)"
_MONTH = "CAST(date_trunc('month', sale_date) AS DATE)"
_LETTERS = "translate(substr(title_jp, 2), '0123456789', 'abcdefghij')"


def _file(columns: dict[str, str], kind: str):
    """The sales under a format's columns, read as that format."""

    def run(s: SparkSession, d: str) -> DataFrame:
        table = V.daily_sales(s, d).select(*(F.expr(f"CAST({e} AS STRING)").alias(c) for c, e in columns.items()))
        return daily.daily_rows(table, daily.FORMATS[kind])

    return run


def _sales(name: str, title: str, channel: str, date: str, net: str, gross: str, run) -> None:
    query(name, f"SELECT {title} AS title_jp, {channel} AS channel, {date} AS sale_date, {net} AS sales_amount, {gross} AS sales_amount_gross FROM sales GROUP BY 1, 2, 3", "sales")(run)


_sales("d02_weekly_file", "title_jp", "channel", "sale_date", _SUM.format("sales_amount"), _NO, _file({"title_jp": "title_jp", "channel": "channel", "sale_date": "sale_date", "sales_amount": "sales_amount"}, "weekly_report"))
_EARLY = {"作品名": "title_jp", "日付": "replace(CAST(sale_date AS STRING), '-', '/')", "ポイント": "sales_amount"}
_sales("d04_early_file", "title_jp", "'piccoma'", "sale_date", _NET.format("sum(sales_amount)"), _SUM.format("sales_amount"), _file(_EARLY, "sokuhochi"))
_sales("d04_early_volumes_file", "title_jp || '(巻)'", "'piccoma'", "sale_date", _NET.format("sum(sales_amount)"), _SUM.format("sales_amount"), _file(_EARLY, "sokuhochi_kan"))
_CMOA = {"タイトル名": "title_jp", "販売年月": "date_format(sale_date, 'yyyyMM')", "消費PT": "CASE WHEN line % 2 = 0 THEN CAST(sales_amount AS STRING) ELSE '' END", "支払額": "sales_amount + 1"}
_sales("d05_cmoa_file", "title_jp", "'cmoa'", _MONTH, _SUM.format("sales_amount + line % 2"), _NO, _file(_CMOA, "cmoa"))
_sales("d11_ebookjapan_file", "title_jp", "'ebookjapan'", "sale_date", _SUM.format("sales_amount"), _NO, _file({"タイトル名": "title_jp", "販売日": "date_format(sale_date, 'yyyy年MM月dd日')", "販売額計": "'¥' || sales_amount"}, "ebookjapan"))
_sales("d13_line_file", "title_jp", "'line'", "sale_date", _SUM.format("CASE WHEN line % 2 = 0 THEN sales_amount ELSE sales_amount * 2 END"), _NO, _file({"タイトル名": "title_jp", "販売日": "sale_date", "販売額（税抜）": "CASE WHEN line % 2 = 0 THEN CAST(sales_amount AS STRING) ELSE ' ' END", "販売額計": "sales_amount * 2"}, "line_manga"))


def _dmm(s: SparkSession, d: str) -> DataFrame:
    day = "date_format(sale_date, 'yyyy/MM/dd')"
    columns = {"商品タイトル": f"'作品' || {_LETTERS} || CASE line % 3 WHEN 0 THEN ' 第3話【フルカラー】' WHEN 1 THEN ' 12巻' ELSE '' END", "配信サイト": "CASE line % 2 WHEN 0 THEN 'fanza' ELSE 'x' END", "集計期間": f"CASE upload_id % 2 WHEN 0 THEN {day} ELSE {day} || '～' || {day} END", "売上金額": "'¥' || sales_amount"}
    return daily.dmm_rows(V.daily_sales(s, d).select(*(F.expr(f"CAST({e} AS STRING)").alias(c) for c, e in columns.items())))


_sales("d12_dmm_file", f"'作品' || {_LETTERS}", "CASE line % 2 WHEN 0 THEN 'DMM(FANZA)' ELSE 'DMM' END", f"CASE upload_id % 2 WHEN 0 THEN sale_date ELSE {_MONTH} END", _SUM.format("sales_amount"), _NO, _dmm)


# ---------------------------------------------------------------- wide files
def _wide(columns: dict[str, str], read):
    return lambda s, d: read(V.daily_sales(s, d).select(*(F.expr(f"CAST({e} AS STRING)").alias(c) for c, e in columns.items())))


def _wide_sql(title: str, channel: str, days: dict[str, str], gross: bool) -> str:
    each = " UNION ALL ".join(f"SELECT {title} AS title_jp, DATE '{day}' AS sale_date, {e} AS v FROM sales" for day, e in days.items())
    net, whole = (_NET.format("sum(v)"), _SUM.format("v")) if gross else (_SUM.format("v"), _NO)
    return f"SELECT title_jp, '{channel}' AS channel, sale_date, {net} AS sales_amount, {whole} AS sales_amount_gross FROM ({each}) WHERE v <> 0 GROUP BY 1, 3"


query("d06_kpi_file", _wide_sql("title_jp", "piccoma", {"2026-05-01": "sales_amount", "2026-12-31": "CASE WHEN line = 1 THEN line ELSE 0 END"}, True), "sales")(
    _wide({"作品名": "title_jp", "05-01 Total売上": "sales_amount", "12-31 Total売上": "CASE WHEN line = 1 THEN CAST(line AS STRING) ELSE '' END", "05月": "7"}, lambda t: daily.unpivoted(t, "作品名", "piccoma", 2026))
)
query("d06_kpi_file_by_month", _wide_sql("title_jp", "piccoma", {"2026-05-01": "sales_amount", "2026-06-01": "line"}, True), "sales")(
    _wide({"作品名": "title_jp", "05月": "sales_amount", "6月": "line"}, lambda t: daily.unpivoted(t, "作品名", "piccoma", 2026))
)
query("d07_cmoa_workbook", _wide_sql("title_jp", "cmoa", {"2026-02-01": "sales_amount", "2026-02-28": "line"}, False), "sales")(
    _wide({"タイトル": "title_jp", "1日": "sales_amount", "28日": "line", "29日": "7"}, lambda t: daily.month_of_days(t, "タイトル", "cmoa", 2026, 2))
)
query("d10_renta_file", _wide_sql(f"'作品' || {_LETTERS}", "renta", {"2026-05-01": "line * (sales_amount % 500)", "2026-05-02": "2 * (sales_amount % 500)"}, False), "sales")(
    _wide(
        {"商品名": f"'作品' || {_LETTERS} || CASE line % 3 WHEN 0 THEN ' 第3話【フルカラー】' WHEN 1 THEN ' 12' ELSE '' END", "価格": "sales_amount % 500", "2026/05/01": "line", "2026/05/02": "2"},
        lambda t: daily.unpivoted(t, "商品名", "renta", 2026, r"^\d{4}/(\d{1,2})/(\d{1,2})$", "価格", False, daily.RENTA_TAILS * 3),
    )
)


# ---------------------------------------------------------------- workbooks
def _cells(s: SparkSession, d: str, sheet: str, head: int, header: list[str | None], cells: list[str]) -> DataFrame:
    """A file a channel, with the header in row ``head``."""
    rows = V.daily_sales(s, d).select(F.concat("channel", F.lit(".xlsx")).alias("file"), F.lit(sheet).alias("sheet"), (F.lit(head) + F.col("line")).cast("int").alias("row_index"), F.array(*(F.expr(f"CAST({c} AS STRING)") for c in cells)).alias("cells"))
    top = rows.select("file", "sheet").distinct().select("file", "sheet", F.lit(head).alias("row_index"), F.array(*(F.lit(h).cast("string") for h in header)).alias("cells"))
    return rows.union(top).withColumn("place", F.lit(0))


#: The header has no Korean title, so that its usual place counts.
query("d03_weekly_workbook", "SELECT title_jp, 'c' || line AS title_kr, 'c' || line AS channel_title_jp, channel, sale_date, sales_amount FROM sales WHERE sales_amount > 0", "sales")(
    lambda s, d: xlsx.weekly_rows(_cells(s, d, "Daily_Raw", 4, ["Date", "Channel Title(JP)", "Sales", "Channel", "Title(JP)"], ["CASE WHEN line % 2 = 0 THEN CAST(sale_date AS STRING) ELSE CAST(datediff(sale_date, DATE'1899-12-30') AS STRING) END", "concat('c', line)", "sales_amount", "channel", "title_jp"]))
)
_CUMULATIVE = [{1: "concat('k', line)", 2: "title_jp", 8: "date_format(sale_date, 'yyyy-MM')", 14: "channel", 22: "sales_amount"}.get(i, "''") for i in range(23)]
query("d08_cumulative_workbook", f"SELECT title_jp, 'k' || line AS title_kr, channel, {_MONTH} AS sale_date, sales_amount FROM sales WHERE sales_amount > 0", "sales")(
    lambda s, d: workbooks.cumulative_sales(_cells(s, d, "누계매출메타데이터(2020~)", 5, ["h"] * 8 + ["판매월"] + ["h"] * 14, _CUMULATIVE))
)
query("d09_four_columns", "SELECT title_jp, channel, sale_date, sales_amount FROM sales WHERE sales_amount > 0", "sales")(
    lambda s, d: workbooks.four_column_sales(_cells(s, d, "x", 1, ["タイトル", "c", "d", "売上"], ["title_jp", "channel", "date_format(sale_date, 'yyyy/M/d')", "sales_amount"]))
)


def _content(s: SparkSession, d: str) -> DataFrame:
    rows = V.table(s, d, "part").select(F.lit("f").alias("file"), F.expr("CASE p_partkey % 2 WHEN 0 THEN '日本(タテヨミ)' ELSE '日本(版面)準備作品' END").alias("sheet"), (F.col("p_partkey") + 3).cast("int").alias("row_index"), F.expr("array('x', p_name, CASE p_partkey % 3 WHEN 0 THEN '-' ELSE upper(p_name) END, p_brand, concat(' ', p_type))").alias("cells"))
    top = rows.select("file", "sheet").distinct().select("file", "sheet", F.lit(2).alias("row_index"), F.array(*map(F.lit, ("No", "作品名\n(JP)", "作品名(KR)", "制作会社", "形式"))).alias("cells"))
    return workbooks.content_master(rows.union(top)).select("source_sheet", "source_row", "status", "title_jp", "title_kr", "production_company", "format", F.element_at("raw_data", "制作会社").alias("stated_company"))


query(
    "d17_content_list",
    "SELECT CASE p_partkey % 2 WHEN 0 THEN '日本(タテヨミ)' ELSE '日本(版面)準備作品' END AS source_sheet, CAST(p_partkey + 3 AS INTEGER) AS source_row, CASE p_partkey % 2 WHEN 0 THEN 'service' ELSE 'prep' END AS status, p_name AS title_jp, CASE WHEN p_partkey % 3 > 0 THEN upper(p_name) END AS title_kr, p_brand AS production_company, p_type AS format, p_brand AS stated_company FROM part",
)(_content)

# ---------------------------------------------------------------- keys, numbers, scanned titles
def _strict(rows: DataFrame) -> DataFrame:
    own = rows.selectExpr("upload_id", "line", "gross", "concat(' 0', upload_id) AS upload", "concat(title_jp, ' ') AS title", "fee", "' 7.00' AS seven")
    return own.select("upload_id", "line", L.strict_key("upload", "title", "fee", "seven").alias("key"), "gross")


on_ledger(
    "e04_strict_keys",
    "SELECT upload_id, line, CAST(upload_id AS DOUBLE) || '␟' || title_jp || '␟' || coalesce(CAST(CAST(fee AS DOUBLE) AS VARCHAR), '') || '␟' || '7.0' AS key, gross FROM ledger",
    _strict,
)
_WIDE = "translate(p_name, 'abcdefghij', 'ａｂｃｄｅｆｇｈｉｊ') || '〜'"


def _keys(s: SparkSession, d: str) -> DataFrame:
    rows = V.table(s, d, "part").select("p_partkey", F.expr(_WIDE).alias("t"), F.expr("CASE WHEN p_partkey % 5 > 0 THEN concat(' ', p_brand) ELSE ' ' END").alias("c"))
    key = F.replace(T.carry_key(F.col("c"), F.lit("WT"), F.col("t")), F.lit("\u0000"), F.lit("|"))
    return rows.select("p_partkey", T.title_key(F.col("t")).alias("title_key"), T.fold_wave_dash(F.col("t")).alias("folded"), key.alias("carry_key"))


query(
    "c09_carry_keys",
    f"SELECT p_partkey, lower(replace(p_name, ' ', '')) || '〜' AS title_key, replace({_WIDE}, '〜', '~') AS folded, CASE WHEN p_partkey % 5 > 0 THEN p_brand || '|WT|' || lower(replace(p_name, ' ', '')) || '~' END AS carry_key FROM part",
)(_keys)
_LONG = "CASE p_partkey % 5 WHEN 0 THEN concat('口', p_name) WHEN 1 THEN concat(substr(p_name, 1, 2), '口口', substr(p_name, 3)) WHEN 2 THEN substr(p_name, 2) WHEN 3 THEN p_name ELSE concat(p_name, '!!!') END"
query("c18_insertions", "SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 0 WHEN 4 THEN 3 END AS INTEGER) AS inserted FROM part")(lambda s, d: V.table(s, d, "part").select("p_partkey", T.inserted(F.col("p_name"), F.expr(_LONG)).alias("inserted")))
query(
    "c14_numbers",
    f"SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 3 THEN 0 ELSE (CASE o_orderkey % 4 WHEN 1 THEN -1 ELSE 1 END) * (o_custkey + 1) END AS DOUBLE) AS amount, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_custkey % 90 + 2 AS DOUBLE) / 100 END AS rate FROM orders",
)(
    lambda s, d: V.table(s, d, "orders").select(
        "o_orderkey",
        T.amount(F.expr("CASE o_orderkey % 4 WHEN 0 THEN concat('¥', o_custkey + 1, ' 円') WHEN 1 THEN concat('−', o_custkey + 1) WHEN 2 THEN concat('￥', o_custkey + 1) ELSE 'なし' END")).alias("amount"),
        T.rate(F.expr("CASE o_orderkey % 3 WHEN 0 THEN concat(o_custkey % 90 + 2, '%') WHEN 1 THEN concat('', o_custkey % 90 + 2) ELSE 'x' END")).alias("rate"),
    )
)

#: A title of nine signs for each part, so that no other title of its length is a part of it.
_FIXED = "concat('作品', translate(lpad(CAST(p_partkey AS STRING), 7, '0'), '0123456789', 'abcdefghij'))"


def _scanned(s: SparkSession, d: str) -> DataFrame:
    """Of each third of the titles a scan has put a sign in and says so, put one in and does not say so, or put none in."""
    rows = V.table(s, d, "part").withColumn("t", F.expr(_FIXED))
    noisy = F.expr("CASE WHEN p_partkey % 3 < 2 THEN concat(substr(t, 1, 4), '口', substr(t, 5)) ELSE t END")
    now = rows.select(F.lit("Jumptoon").alias("channel"), F.lit("EB").alias("type"), noisy.alias("title_jp"), F.when(F.col("p_partkey") % 3 == 0, S.SCANNED_NOTE).alias("note2"), "p_partkey")
    return S.reconcile_scanned(now, rows.select(F.lit("jumptoon").alias("channel"), F.lit("eb").alias("type"), F.col("t").alias("title_jp")))


_FIXED_SQL = "'作品' || translate(lpad(CAST(p_partkey AS VARCHAR), 7, '0'), '0123456789', 'abcdefghij')"
query(
    "e14g_scanned_titles",
    f"WITH x AS (SELECT p_partkey, {_FIXED_SQL} AS t FROM part), y AS (SELECT *, substr(t, 1, 4) || '口' || substr(t, 5) AS n FROM x) SELECT 'Jumptoon' AS channel, 'EB' AS type, CASE p_partkey % 3 WHEN 1 THEN n ELSE t END AS title_jp, CASE WHEN p_partkey % 3 = 0 THEN 'SHUEISHA_OCR_TITLE' END AS note2, p_partkey, CASE WHEN p_partkey % 3 = 0 THEN n END AS raw_title FROM y",
)(_scanned)


# ---------------------------------------------------------------- the store of comparisons
def _stored(s: SparkSession, d: str) -> DataFrame:
    """Two runs are stored, the second twice; the second is read with the latest reviews."""
    rows = V.ledger(s, d).selectExpr("concat_ws('/', upload_id, line, gross) AS diff_id", "title_jp", "upload_id", "line")
    path = shared_folder(s, "comparisons")
    reports.append_comparison(rows.where("line < 4"), path, "one")
    for _ in range(2):
        reports.append_comparison(rows, path, "two")
    first = rows.where("upload_id % 2 = 0").selectExpr("'two' AS run_id", "diff_id", "'resolved' AS status", "1 AS reviewed_at")
    later = rows.where("upload_id % 6 = 0").selectExpr("'two' AS run_id", "diff_id", "'pending' AS status", "2 AS reviewed_at")
    return reports.read_comparison(s, path, "two", first.union(later)).select("run_id", "diff_id", "title_jp", "status")


query(
    "k10_stored_comparison",
    "SELECT 'two' AS run_id, upload_id || '/' || line || '/' || gross AS diff_id, title_jp, CASE WHEN upload_id % 6 = 0 THEN 'pending' WHEN upload_id % 2 = 0 THEN 'resolved' ELSE 'open' END AS status FROM ledger",
    "ledger",
)(_stored)
