"""Statements of each platform: the ledger as it would stand in the platform's files, from their columns to the amounts.

Batches of the 1990s stand for those thirty years later, so that the months in files' names are found.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans import views as V
from ledgerloom.plans.registry import HALF, query
from ledgerloom.sources import readers, statements

_Y, _M = "CAST(CAST(substr(batch, 1, 4) AS INTEGER) + 30 AS VARCHAR(4))", "substr(batch, 6, 2)"
_MONTH = f"CAST({_Y} || '-' || {_M} || '-01' AS DATE)"
_TEN = "(gross - gross % 10)"
_SPLIT = "title_jp || CASE line % 3 WHEN 1 THEN '【分冊版】' ELSE '' END"
_MARKED = "title_jp || CASE line % 3 WHEN 0 THEN '【タテヨミ】' WHEN 1 THEN '【連載版】' ELSE '' END"
_NONE = "CAST(NULL AS BIGINT)"
AMOUNTS = ("total", "before_tax", "after_tax", "before_tax_income", "after_tax_income", "consumption_tax")


def r(x: str) -> str:
    """To the nearest whole, halves up."""
    return f"CAST(floor({x} + {HALF}) AS BIGINT)"


def d(x: str) -> str:
    return f"CAST(floor({x}) AS BIGINT)"


def by(x: str, factor: float) -> str:
    return f"{x} * CAST({factor} AS DOUBLE)"


def over(x: str, factor: float) -> str:
    return f"{x} / CAST({factor} AS DOUBLE)"


@dataclass(frozen=True)
class Case:
    """A platform's file and what its records are: sums ``s`` and ``p`` of ``sales`` and ``pay``, by the key or by row.

    ``columns``: of the file's columns, by name or by place, the expressions over the ledger; ``sheet``: where the file
    is a workbook, with how many rows above the data.
    """

    platform: str
    file: str
    columns: dict[str | int, str]
    amounts: dict[str, str]
    title: str = "title_jp"
    kind: str = "'WT'"
    channel: str = "'-'"
    sales: str = "gross"
    pay: str = _TEN
    month: str = _MONTH
    wait: str = "0"
    more: dict[str, str] = field(default_factory=dict)
    sheet: str | None = None
    skip: int = 1


_PLAIN = {"after_tax": r("s"), "after_tax_income": r("p")}
_DIFF = "before_tax_income - after_tax_income"
_ADS_AFTER, _ADS_INCOME = (f"CAST(floor(({r(c)} * 2 + 110) / CAST(220 AS DOUBLE)) AS BIGINT)" for c in "sp")
_ADS_TOTAL, _ADS_TAX = f"CAST(floor(({_ADS_AFTER} * 22 + 10) / CAST(20 AS DOUBLE)) AS BIGINT)", d(f"{_ADS_INCOME} / CAST(10 AS DOUBLE)")
_CMOA_AFTER = r(over("p", 0.4))
_COMICO_NET = r(over(r(by("p", 1.1)), 1.1))
_MB_TAX = d(f"{r('p')} * 10 / CAST(110 AS DOUBLE)")
_MAGAZINE = "CAST(substr(title_jp, 2) AS BIGINT) % 3 = 0"

CASES = {
    "p01_cmoa_statement": Case(
        "cmoa",
        f"'CD1_N1_' || {_Y} || {_M} || '_meisai.tsv'",
        {"タイトル名": _MARKED, "支払額": "gross || '.5'"},
        {"total": r(by(_CMOA_AFTER, 1.1)), "before_tax": r(by(_CMOA_AFTER, 1.1)), "after_tax": _CMOA_AFTER, "before_tax_income": d("p"), "after_tax_income": d("p"), "consumption_tax": r(by(d("p"), 0.1))},
        title=_MARKED,
        kind="CASE line % 3 WHEN 0 THEN 'WT' WHEN 1 THEN 'EP' ELSE 'EB' END",
        sales="0",
        pay="gross + CAST(0.5 AS DOUBLE)",
    ),
    "p03_piccoma_ads_statement": Case(
        "piccoma_ads",
        "'x.xlsx'",
        {0: f"{_Y} || '-' || {_M} || '-05'", 3: "title_jp", 6: "gross || '.25'", 7: "'40%'", 8: f"{_TEN}"},
        {"total": _ADS_TOTAL, "before_tax": _ADS_TOTAL, "after_tax": _ADS_AFTER, "before_tax_income": f"{_ADS_INCOME} + {_ADS_TAX}", "after_tax_income": _ADS_INCOME, "consumption_tax": _ADS_TAX},
        sales="gross * 100 + 25",
        pay=f"{_TEN} * 100",
        sheet="'動画リワード_株式会社RIVERSE'",
    ),
    "p04_piccoma_gaiakuhan_statement": Case(
        "piccoma_gaiakuhan",
        "'x.xlsx'",
        {"対象年月": f"{_Y} || '年' || {_M} || '月'", "対象作品": "title_jp", "受領額": "gross", "分配料率": "'50%'", "分配金": _TEN},
        {"total": r(by(r("s"), 1.1)), "after_tax": r("s"), "before_tax_income": f"{r('p')} + {r(by(r('p'), 0.1))}", "after_tax_income": r("p"), "consumption_tax": r(by(r("p"), 0.1))},
        kind="'EB'",
        sheet="'外販お支払報告書'",
    ),
    "p06_line_ebj_statement": Case(
        "line_ebj",
        f"'ExportCSV_' || {_Y} || {_M} || '15123456789.csv'",
        {"タイトル名": _MARKED, "書店名": "CASE upload_id % 2 WHEN 0 THEN 'LINEマンガ' ELSE 'ebookjapan' END", "販売単位区分": "CASE line % 2 WHEN 0 THEN '単話' ELSE '巻' END", "販売額計": "gross", "許諾額計": _TEN},
        _PLAIN,
        title=_MARKED,
        kind="CASE WHEN line % 3 = 0 THEN 'WT' WHEN line % 3 = 1 THEN 'EP' WHEN line % 2 = 0 THEN 'WT' ELSE 'EB' END",
        channel="CASE WHEN upload_id % 2 = 0 THEN 'line' WHEN line % 3 = 0 OR line % 3 = 2 AND line % 2 = 0 THEN 'ebj_webtoon' ELSE 'ebj' END",
        month=f"CAST({_MONTH} - INTERVAL 1 MONTH * (CASE upload_id % 2 WHEN 0 THEN 2 ELSE 1 END) AS DATE)",
        wait="CASE channel WHEN 'line' THEN 1 ELSE 0 END",
    ),
    "p08_booklive_statement": Case(
        "booklive",
        "'x.xlsx'",
        {"配信月": f"{_Y} || '年' || {_M} || '月'", "タイトル名": "title_jp", "書店名称": "CASE line % 2 WHEN 0 THEN 'ブックライブ' ELSE 'ブッコミ' END", "WT/版面": "CASE upload_id % 2 WHEN 0 THEN 'WT' ELSE '版面' END", "BookLive売上": "gross", "権利元取分(税抜)": _TEN, "権利元取分(税込)": "gross", "消費税額": "gross % 10"},
        {"total": r(by("s", 1.1)), "before_tax": r(over("s", 1.1)), "after_tax": r("s"), "before_tax_income": "incl", "after_tax_income": r("p"), "consumption_tax": "tax"},
        kind="CASE upload_id % 2 WHEN 0 THEN 'WT' ELSE 'EP' END",
        channel="CASE line % 2 WHEN 0 THEN 'booklive' ELSE 'bookcomi' END",
        more={"incl": "gross", "tax": "gross % 10"},
    ),
    "p09_mechacomic_statement": Case(
        "mechacomic",
        f"'RIVERSE_' || {_Y} || {_M} || '.xlsx'",
        {"シリーズ名": "title_jp", "書名": "title_jp || '話'", "売上金額": "gross", "率": "'40%'", "支払": _TEN, "種別": "CASE line % 3 WHEN 0 THEN '話' WHEN 1 THEN '巻' ELSE '' END"},
        {"after_tax": r("s"), "before_tax_income": d(by("p", 1.1)), "after_tax_income": r("p")},
        kind="CASE line % 3 WHEN 1 THEN 'EB' ELSE 'WT' END",
        sheet="'アプリ明細'",
    ),
    "p10_comico_statement": Case(
        "comico",
        "'comico_' || batch",
        {0: _Y, 1: _M, 2: f"CASE WHEN {_MAGAZINE} THEN 'magazine_comic' ELSE 'webtoon' END", 5: "title_jp", 10: "gross", 14: "gross + 1", 20: "'50%'", 21: _TEN, 30: f"{_TEN} + 2"},
        {"total": r("s"), "before_tax": r("s"), "after_tax": r(over(r("s"), 1.1)), "before_tax_income": r(by("p", 1.1)), "after_tax_income": _COMICO_NET, "consumption_tax": f"{r(by('p', 1.1))} - {_COMICO_NET}"},
        sales=f"CASE WHEN {_MAGAZINE} THEN gross ELSE gross + 1 END",
        pay=f"CASE WHEN {_MAGAZINE} THEN {_TEN} ELSE {_TEN} + 2 END",
        sheet="'プラットフォーム売上現況'",
        skip=2,
    ),
    "p11_dmm_statement": Case(
        "dmm",
        f"'9_支払通知書_' || {_Y} || {_M} || '.xlsx'",
        {4: "title_jp || ' ' || line || CASE line % 2 WHEN 0 THEN '巻' ELSE '話' END", 8: "1", 9: "gross"},
        {"after_tax": r("s"), "after_tax_income": r(by("s", 0.45))},
        kind="CASE line % 2 WHEN 0 THEN 'EB' ELSE 'EP' END",
        pay="0",
        sheet="CASE upload_id % 2 WHEN 0 THEN 'ﾌﾞｯｸｽ(ｱﾀﾞﾙﾄ)' ELSE 'ﾌﾞｯｸｽ(一般)' END",
    ),
    "p13_mediado_statement": Case(
        "mediado",
        f"'BR1_RIVERSE_' || CASE WHEN {_M} < '07' THEN 'コミック' ELSE 'タテヨミ' END || '_' || {_Y} || {_M} || '.tsv'",
        {"タイトル名称": _SPLIT, "発行形態": "''", "販売価格": "gross % 1000", "DL数": "line", "料率": "'50%'", "税抜き金額": "gross"},
        _PLAIN,
        title=_SPLIT,
        sales="(gross % 1000) * line",
        pay="gross",
    ),
    "p14_mbj_statement": Case(
        "mbj",
        f"'PF_1_RIVERSE_' || {_Y} || {_M} || '.xlsx'",
        {"タイトル": "title_jp || CASE line % 3 WHEN 0 THEN ' 第' || line || '話' WHEN 1 THEN '（' || line || '）' ELSE '' END", "フォーマット": "'x'", "区分": "''", "分配料率": "'60%'", "売上金額": "gross", "支払金額": _TEN},
        _PLAIN,
        kind="CASE line % 3 WHEN 0 THEN 'EP' ELSE 'EB' END",
    ),
    "p15_mangabang_statement": Case(
        "mangabang",
        "'x.csv'",
        {"年月": f"{_Y} || '年' || {_M} || '月'", "タイトル名": "title_jp || '〜'", "総収益（税抜）": "gross", "版権料率": "'50%'", "版権元収益（税込）": _TEN},
        {"total": r(by("s", 1.1)), "before_tax": r(by("s", 1.1)), "after_tax": r("s"), "before_tax_income": r("p"), "after_tax_income": f"{r('p')} - {_MB_TAX}", "consumption_tax": _MB_TAX},
        title="title_jp || '～'",
    ),
    "p17_lezhin_statement": Case(
        "lezhin_beltoon",
        "CASE upload_id % 2 WHEN 0 THEN 'beltoon.xlsx' ELSE 'lezhin.xlsx' END",
        {"タイトル": _SPLIT, "売上額(円)": "gross", "支払(円)": _TEN, "料率": "'40%'", "精算月": f"{_Y} || '.' || {_M}"},
        {"total": r("s"), "before_tax": r("s"), "after_tax": r("s"), "before_tax_income": r("p"), "after_tax_income": r("p"), "consumption_tax": "CAST(0 AS BIGINT)"},
        title=_SPLIT,
    ),
    "p18_beaglee_statement": Case(
        "beaglee",
        "'beaglee_' || batch",
        {"コミック名称": _SPLIT, "課金額（税抜）": "gross", "ロイヤリティ(税抜)": _TEN, "ロイヤリティ率": "'45.5%'"},
        {"total": r(by("s", 1.1)), "after_tax": r("s"), "before_tax_income": r(by("p", 1.1)), "after_tax_income": r("p"), "consumption_tax": f"{r(by('p', 1.1))} - {r('p')}"},
        title=_SPLIT,
        kind="CASE line % 3 WHEN 1 THEN 'EP' ELSE 'EB' END",
        sheet=f"{_Y} || {_M}",
    ),
    "p22_invoice_statement": Case(
        "invoice",
        f"'【請求書】X様_' || {_Y} || '年' || {_M} || '月.xlsx'",
        {"内容": "title_jp", "単価": "'5'", "印税率": "'-'", "数量": "'1'", "金額": "gross"},
        {"total": r(by("s", 1.1)), "before_tax": r(by("s", 1.1)), "after_tax": r("s"), "before_tax_income": r(by("s", 1.1)), "after_tax_income": r("s"), "consumption_tax": f"{r(by('s', 1.1))} - {r('s')}"},
        sheet="'請求書'",
    ),
}


def _table(s: SparkSession, sf_dir: str, case: Case) -> DataFrame:
    ledger, reader = V.ledger(s, sf_dir), readers.READERS[case.platform]
    texts = {c: f"CAST({e} AS STRING)" for c, e in case.columns.items()}
    if case.sheet is None:
        table = ledger.select(F.expr(case.file).alias("file"), *(F.expr(e).alias(c) for c, e in texts.items()))
        return readers.text_table(table, reader, F.col("file"))
    named = all(isinstance(c, str) for c in texts)
    width = len(texts) if named else max(texts) + 1
    at = list(texts.values()) if named else [texts.get(i, "CAST(NULL AS STRING)") for i in range(width)]
    rows = ledger.select(F.expr(case.file).alias("file"), F.expr(case.sheet).alias("sheet"), (F.lit(case.skip) + F.col("line")).cast("int").alias("row_index"), F.array(*map(F.expr, at)).alias("cells"))
    head = F.array(*(F.lit(c if named else "h") for c in (texts if named else range(width))))
    heads = rows.select("file", "sheet").distinct().select("file", "sheet", F.lit(case.skip).alias("row_index"), head.alias("cells"))
    return readers.sheet_table(rows.union(heads), reader)


def _run(case: Case):
    def run(s: SparkSession, sf_dir: str) -> DataFrame:
        own = readers.lines(_table(s, sf_dir, case), case.platform)
        if case.platform == "comico":
            own = readers.comico_lines(own)
        kind = statements.STATEMENTS[case.platform]
        return statements.settled(own, case.platform).select(*kind.key, "sales_month", "settlement_date", "deposit_date", *AMOUNTS, "row_count")

    return run


def _sql(case: Case) -> str:
    kind = statements.STATEMENTS[case.platform]
    keys = ", ".join(kind.key)
    cells = {"title": case.title, "kind": case.kind, "channel": case.channel, "month": case.month, "s": case.sales, "p": case.pay, **case.more}
    rows = f"x AS (SELECT {', '.join(f'{e} AS {c}' for c, e in cells.items())} FROM ledger)"
    extra = "".join(f", {c}" for c in case.more)
    if kind.by_row:
        sums = f"a AS (SELECT {keys}, month, CAST(s AS DOUBLE) AS s, CAST(p AS DOUBLE) AS p{extra}, CAST(1 AS BIGINT) AS row_count FROM x)"
    elif case.platform == "comico":  # a line is a title of a file
        sums = f"a AS (SELECT {keys}, month, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(p) AS DOUBLE) AS p, CAST(1 AS BIGINT) AS row_count FROM x GROUP BY {keys}, month)"
    else:
        sums = f"a AS (SELECT {keys}, month, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(p) AS DOUBLE) AS p, count(*) AS row_count FROM x GROUP BY {keys}, month)"
    amounts = ", ".join(f"{case.amounts.get(a, _NONE)} AS {a}" for a in AMOUNTS)
    late = lambda n: f"last_day(month + INTERVAL 1 MONTH * ({case.wait} + {n}))"
    return f"+{rows}, {sums} SELECT {keys}, month AS sales_month, {late(kind.settle)} AS settlement_date, {late(kind.deposit)} AS deposit_date, {amounts}, row_count FROM a"


for _name, _case in CASES.items():
    query(_name, _sql(_case), "ledger")(_run(_case))


# ---------------------------------------------------------------- piccoma, from its summary and its details
_UNITS = "SELECT title_jp, CAST(substr(title_jp, 2) AS BIGINT) AS k, sum(CASE WHEN line % 2 = 0 THEN gross ELSE 0 END) AS e, sum(CASE WHEN line % 2 = 1 THEN gross ELSE 0 END) AS v FROM ledger GROUP BY title_jp"


def _piccoma(s: SparkSession, sf_dir: str) -> DataFrame:
    """A row a title with its episodes and volumes; of every other title the details state sales."""
    titles = s.sql(_UNITS.replace("FROM ledger", "FROM {ledger}"), ledger=V.ledger(s, sf_dir))

    def cells(rows: DataFrame, sheet: str, skip: int, at: dict[int, str]) -> DataFrame:
        width = max(at) + 1
        own = rows.select(F.lit("取次report_株式会社RIVERSE_20260401.xlsx").alias("file"), F.lit(sheet).alias("sheet"), F.lit(skip + 1).alias("row_index"), F.array(*(F.expr(f"CAST({at[i]} AS STRING)") if i in at else F.lit(None).cast("string") for i in range(width))).alias("cells"))
        return own.union(own.limit(1).select("file", "sheet", F.lit(skip).alias("row_index"), F.array(*(F.lit("h") for _ in range(width))).alias("cells")))

    summary = cells(titles, "227", 3, {1: "title_jp", 2: "'50'", 7: "e", 8: "v - 1", 11: "e - 1", 12: "v"})
    sold = titles.where("k % 2 = 0")
    chapters = cells(sold.where("e > 0"), "<話売>精算対象使用件数", 1, {2: "title_jp", 14: "e * 2 + 1", 15: "'50'", 16: "e"})
    volumes = cells(sold.where("v > 0"), "<巻売>精算対象使用件数", 1, {2: "title_jp", 12: "v * 2 + 1", 13: "'50'", 14: "v"})
    read = lambda rows, kind: readers.lines(readers.sheet_table(rows, readers.READERS[kind]), kind)
    detail = read(chapters, "piccoma_detail").unionByName(read(volumes, "piccoma_detail_volumes"))
    own = readers.piccoma_lines(readers.sheet_table(summary, readers.READERS["piccoma"]), detail, F.lit("2026-04-01").cast("date"))
    kind = statements.STATEMENTS["piccoma"]
    return statements.settled(own, "piccoma").select(*kind.key, "sales_month", "settlement_date", "deposit_date", *AMOUNTS, "row_count")


_P_TOTAL = r(by("s", 1.1))
query(
    "p02_piccoma_statement",
    f"""+t AS ({_UNITS}), u AS (SELECT title_jp AS title, 'WT' AS kind, CAST(e AS DOUBLE) AS p, k FROM t UNION ALL SELECT title_jp, 'EB', CAST(v AS DOUBLE), k FROM t),
 a AS (SELECT title, kind, p, CASE WHEN k % 2 = 0 AND p > 0 THEN p * 2 + 1 ELSE p / CAST(0.5 AS DOUBLE) END AS s FROM u WHERE p <> 0)
 SELECT title, kind, DATE '2026-04-01' AS sales_month, DATE '2026-05-31' AS settlement_date, DATE '2026-06-30' AS deposit_date, {_P_TOTAL} AS total, {_P_TOTAL} AS before_tax, {r(over(_P_TOTAL, 1.1))} AS after_tax, {d(by('p', 1.1))} AS before_tax_income,
 {d('p')} AS after_tax_income, {d(by('p', 1.1))} - {d('p')} AS consumption_tax, CAST(1 AS BIGINT) AS row_count FROM a""",
    "ledger",
)(_piccoma)
