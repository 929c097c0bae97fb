"""Queries over rules of titles, checks against summaries, guessed kinds, all platforms' kinds and signatures, and seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions import titles as N
from ledgerloom.operators import analytics as A
from ledgerloom.operators import masters as M
from ledgerloom.operators import seeding
from ledgerloom.operators import settlement as S
from ledgerloom.plans import views as V
from ledgerloom.plans.registry import HALF, query
from ledgerloom.sources import invoices, overrides, readers, reports, statements
from ledgerloom.sources.detection import detect_daily

_NET = f"CAST(floor({{0}} / CAST(1.1 AS DOUBLE) + {HALF}) AS BIGINT)"
_PLUS = f"CAST(floor({{0}} * CAST(1.1 AS DOUBLE) + {HALF}) AS BIGINT)"


# ---------------------------------------------------------------- U-NEXT against its summary
def _unext(s: SparkSession, d: str) -> DataFrame:
    """A file a month. Of seven titles one is stated too high by five yen, one by one, and one is not stated."""
    rows = V.ledger(s, d).withColumn("file", F.concat(F.lit("hol_"), "batch"))
    table = rows.selectExpr("file", "title_jp AS `タイトル名`", "CAST(gross AS STRING) AS `売上`", "CAST(gross div 10 AS STRING) AS `分配額`", "'40%' AS `料率`")
    own = readers.lines(readers.text_table(table, readers.READERS["u_next"], F.col("file")), "u_next")
    k = "CAST(substr(title_jp, 2) AS BIGINT) % 7"
    stated = rows.groupBy("file", "title_jp").agg(F.expr("sum(gross div 10)").alias("p")).where(f"{k} <> 2")
    listed = stated.selectExpr("file", "'タイトル一覧' AS sheet", "CAST(2 + substr(title_jp, 2) AS INT) AS row_index", f"array(title_jp, CAST(p + CASE {k} WHEN 0 THEN 5 WHEN 1 THEN 1 ELSE 0 END AS STRING)) AS cells")
    files = rows.select("file", "batch").distinct()
    header = files.selectExpr("file", "'ヘッダー' AS sheet", "3 AS row_index", "array('集計対象期間', concat(replace(batch, '-', '/'), '/01-')) AS cells")
    first = files.selectExpr("file", "'タイトル一覧' AS sheet", "1 AS row_index", "array('タイトル名', '当月分配金額') AS cells")
    cells = listed.union(header).union(first)
    return overrides.unext_records(own, overrides.unext_months(cells), overrides.unext_summary(cells)).select("file", "title", "sales_month", "total", "after_tax_income", "consumption_tax", "rate", "row_count", "stated", "differs")


query(
    "p12_unext_against_summary",
    f"""+g AS (SELECT 'hol_' || batch AS file, title_jp AS title, CAST(batch || '-01' AS DATE) AS sales_month, CAST(sum(gross) AS BIGINT) AS s, CAST(sum(gross // 10) AS BIGINT) AS p, count(*) AS row_count, CAST(substr(title_jp, 2) AS BIGINT) % 7 AS k FROM ledger GROUP BY batch, title_jp)
 SELECT file, title, sales_month, {_PLUS.format('s')} AS total, p AS after_tax_income, {_PLUS.format('p')} - p AS consumption_tax, CAST(0.4 AS DOUBLE) AS rate, row_count, CAST(CASE k WHEN 0 THEN p + 5 WHEN 1 THEN p + 1 WHEN 2 THEN NULL ELSE p END AS DOUBLE) AS stated, k = 0 AS differs FROM g""",
    "ledger",
)(_unext)

# ---------------------------------------------------------------- Kadokawa's rules
_RULES = (("T1", "prefix", 1, "one"), ("T12", "prefix", 1, "twelve"), ("T7", "exact", 1, "seven"), ("T129", "prefix", 0, "first"), ("T1290", "exact", 1, "never"))
_ACCOUNT = "CASE line % 5 WHEN 0 THEN '原稿料' WHEN 1 THEN '出版印税' WHEN 2 THEN '版権料' WHEN 3 THEN '二次的利用印税' ELSE 'x' END"


def _kadokawa(s: SparkSession, d: str) -> DataFrame:
    table = V.ledger(s, d).selectExpr("batch AS file", "title_jp AS `書名`", "CAST(gross AS STRING) AS `合計金額（明細）`", "CASE WHEN batch > '1994' THEN replace(concat(batch, '-29'), '-02-29', '-02-28') END AS `支払日`", "concat(batch, '-02') AS `計上日付`", f"{_ACCOUNT} AS `勘定科目`")
    own = readers.lines(readers.text_table(table, overrides.KADOKAWA_READER, F.col("file")), "kadokawa", overrides.KADOKAWA_READER)
    return overrides.kadokawa_records(own, s.createDataFrame(_RULES, overrides.RULES)).drop("is_summary")


query(
    "p16_kadokawa_rules",
    f"""+x AS (SELECT batch AS file, title_jp, gross, {_ACCOUNT} AS account, CASE WHEN title_jp LIKE 'T129%' THEN 'first' WHEN title_jp = 'T7' THEN 'seven' WHEN title_jp LIKE 'T12%' THEN 'twelve' WHEN title_jp LIKE 'T1%' THEN 'one' END AS series FROM ledger),
 r AS (SELECT file, title_jp AS title, CASE account WHEN '原稿料' THEN 'MF' WHEN '出版印税' THEN 'PP' WHEN '版権料' THEN 'PP' ELSE 'EB' END AS kind, gross AS total, 1 AS row_count FROM x WHERE series IS NULL
 UNION ALL SELECT file, series, 'EB', CAST(sum(gross) AS BIGINT), count(*) FROM x WHERE series IS NOT NULL GROUP BY file, series)
 SELECT file, title, kind, CASE WHEN file > '1994' THEN CAST(last_day(CAST(file || '-01' AS DATE) - INTERVAL 1 MONTH) AS DATE) ELSE CAST(file || '-01' AS DATE) END AS sales_month, CASE WHEN file > '1994' THEN CAST(replace(file || '-29', '-02-29', '-02-28') AS DATE) END AS settlement_date,
 total, total AS before_tax_income, {_NET.format('total')} AS after_tax_income, total - {_NET.format('total')} AS consumption_tax, row_count FROM r""",
    "ledger",
)(_kadokawa)

# ---------------------------------------------------------------- guessed kinds, from statement rows to the ledger
_GUESSED = {"シリーズ名": "'T' || CAST(substr(title_jp, 2) AS BIGINT) % 200", "書名": "title_jp", "売上金額": "gross", "率": "'40%'", "支払": "gross", "種別": "CASE line % 3 WHEN 0 THEN '話' WHEN 1 THEN '巻' ELSE '' END"}
_EARLIER = """SELECT DISTINCT CASE WHEN k % 3 = 2 THEN 'other' ELSE 'mechacomic' END AS channel, 'T' || k AS title_jp, type FROM (SELECT DISTINCT CAST(substr(title_jp, 2) AS BIGINT) % 200 AS k FROM ledger) AS t,
 (SELECT 0 AS r, 'WN' AS type UNION ALL SELECT 1, 'EB' UNION ALL SELECT 1, 'WR' UNION ALL SELECT 2, 'EP') AS u WHERE k % 3 = r AND k % 12 <> 11"""


def _guesses(s: SparkSession, d: str) -> DataFrame:
    ledger = V.ledger(s, d)
    table = ledger.select(F.lit("RIVERSE_202604.xlsx").alias("file"), *(F.expr(f"CAST({e} AS STRING)").alias(c) for c, e in _GUESSED.items()))
    own = readers.lines(readers.text_table(table, readers.READERS["mechacomic"], F.col("file")), "mechacomic")
    base = s.sql(_EARLIER.replace("FROM ledger", "FROM {ledger}"), ledger=ledger)
    return S.reconcile_kinds(own.select("channel", F.col("title").alias("title_jp"), F.col("kind").alias("type"), "note2", "sales"), base)


query(
    "e14e_guessed_kinds",
    f"""+b AS ({_EARLIER}), x AS (SELECT 'mechacomic' AS channel, 'T' || CAST(substr(title_jp, 2) AS BIGINT) % 200 AS title_jp, CAST(substr(title_jp, 2) AS BIGINT) % 200 AS k, CASE line % 3 WHEN 1 THEN 'EB' ELSE 'WT' END AS type, line % 3 > 0 AS guess, CAST(gross AS DOUBLE) AS sales FROM ledger),
 c AS (SELECT title_jp, list(DISTINCT type) AS claimed FROM x GROUP BY 1),
 y AS (SELECT x.*, CASE WHEN NOT guess OR k % 12 = 11 THEN 'keep' WHEN k % 3 = 0 THEN 'WN' WHEN k % 3 = 2 THEN 'EP' WHEN type = 'EB' THEN 'ambiguous' WHEN list_contains(claimed, 'EB') THEN 'WR' ELSE 'ambiguous' END AS r FROM x JOIN c USING (title_jp))
 SELECT channel, title_jp, CASE WHEN r IN ('keep', 'ambiguous') THEN type ELSE r END AS type, CASE WHEN guess THEN 'TYPE_HEURISTIC' END AS note2, sales, CASE WHEN r NOT IN ('keep', 'ambiguous') THEN type END AS raw_type, CASE r WHEN 'keep' THEN NULL WHEN 'ambiguous' THEN r ELSE 'baseline' END AS reconciliation FROM y""",
    "ledger",
)(_guesses)

# ---------------------------------------------------------------- the kinds of all platforms
_MARKS = ("", "【完全版】", "【分冊版】", "改訂版", "（ノベル）", "【タテヨミ】", "【タテヨミ】［改訂版］", "【タテヨミ】[完全版]", "【タテコミ】", "【特装版】", "【全年齢版】", "［改訂版］", "【タテコミ】完全版")
_MARK = "CASE p_partkey % 13 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MARKS)) + " END"
_UNIT = "CASE p_size % 3 WHEN 0 THEN '巻' WHEN 1 THEN '話' ELSE '単話' END"


def _kinds(s: SparkSession, d: str) -> DataFrame:
    rows = V.table(s, d, "part").select("p_partkey", F.expr(f"concat(p_name, {_MARK})").alias("t"), F.expr(_UNIT).alias("u"), F.expr("CASE p_size % 4 WHEN 0 THEN 'BOOK' WHEN 1 THEN 'COMIC' ELSE 'TATE' END").alias("src"))
    tall = N.with_tall_sibling(rows, "t").withColumnRenamed("has_sibling", "tall_sibling")
    t, u, sib = F.col("t"), F.col("u"), F.col("has_sibling")
    kinds = {
        "piccoma": N.piccoma_kind(t, u),
        "renta": N.renta_kind(t, sib),
        "line_ebj": N.line_ebj_kind(t, u, F.col("tall_sibling")),
        "line_ebj_guess": N.line_ebj_guessed(t, u),
        "mechacomic": N.mechacomic_kind(t, u, sib),
        "mechacomic_guess": N.mechacomic_guessed(t, u, sib),
        "mediado": N.mediado_kind(t, F.col("src"), sib),
        "comico": N.comico_kind(t, F.when(F.col("src") == "BOOK", "magazine_comic"), F.when(F.col("src") == "COMIC", 0.55), sib),
        "mbj": N.mbj_kind(t, F.when(F.col("src") == "BOOK", "Webtoon").otherwise("x"), F.lit("")),
        "dmm": N.dmm_series(F.concat(t, F.lit(" 3"), u))["kind"],
    }
    return N.with_sibling(tall, "t").select("p_partkey", *(c.alias(n) for n, c in kinds.items()))


query(
    "c11_kinds_of_all",
    f"""WITH t AS (SELECT p_partkey, p_name || {_MARK} AS t, {_UNIT} AS u, CASE p_size % 4 WHEN 0 THEN 'BOOK' WHEN 1 THEN 'COMIC' ELSE 'TATE' END AS src, p_partkey % 13 AS m, p_name FROM part),
 w AS (SELECT DISTINCT replace(regexp_replace(t, '[【［\\[](完全版|改訂版)[】］\\]]', '', 'g'), ' ', '') AS k FROM t WHERE m IN (1, 7)), l AS (SELECT DISTINCT p_name AS k FROM t WHERE m = 7),
 x AS (SELECT *, m NOT IN (1, 7) AND replace(regexp_replace(t, '[【［\\[](完全版|改訂版)[】］\\]]', '', 'g'), ' ', '') IN (SELECT k FROM w) AS sib, m IN (5, 6) AND p_name IN (SELECT k FROM l) AS tall FROM t)
 SELECT p_partkey, CASE WHEN u = '巻' THEN 'EB' WHEN m = 4 THEN 'WN' ELSE 'WT' END AS piccoma,
 CASE WHEN m = 2 THEN 'EP' WHEN m = 9 THEN 'EB' WHEN m = 12 THEN 'WT' WHEN m = 8 THEN CASE WHEN sib THEN 'WR' ELSE 'WT' END ELSE 'EB' END AS renta,
 CASE WHEN m = 4 THEN 'WN' WHEN m = 6 OR tall THEN 'WR' WHEN m IN (5, 7) THEN 'WT' WHEN m = 2 THEN 'EP' WHEN u = '単話' THEN 'WT' ELSE 'EB' END AS line_ebj, m NOT IN (4, 5, 6, 7) AS line_ebj_guess,
 CASE WHEN m = 4 THEN 'WN' WHEN m IN (3, 6, 11) OR sib THEN 'WR' WHEN u <> '巻' THEN 'WT' WHEN m = 2 THEN 'EP' ELSE 'EB' END AS mechacomic,
 m NOT IN (3, 4, 6, 11) AND (sib OR NOT (u <> '巻' OR m = 2)) AS mechacomic_guess,
 CASE WHEN src <> 'TATE' THEN CASE WHEN m = 2 THEN 'EP' ELSE 'EB' END WHEN m IN (6, 11) OR sib THEN 'WR' ELSE 'WT' END AS mediado,
 CASE WHEN src <> 'TATE' THEN CASE WHEN m = 9 THEN 'EB' ELSE 'EP' END WHEN m = 10 THEN 'WR' WHEN m <> 1 AND sib THEN 'WR' ELSE 'WT' END AS comico,
 CASE WHEN src = 'BOOK' THEN 'WT' WHEN m IN (3, 6, 11) THEN 'WR' WHEN m = 2 THEN 'EP' ELSE 'EB' END AS mbj, CASE u WHEN '巻' THEN 'EB' WHEN '話' THEN 'EP' ELSE 'WT' END AS dmm FROM x""",
)(_kinds)

# ---------------------------------------------------------------- the signatures of all platforms
#: A file's name of each platform, with how often its patterns weigh.
_NAMES = (
    ("cmoa", "CD1_N1100_202604_支払案内書.tsv", 100), ("mbj", "Apple Books.csv", 100), ("piccoma_ads", "砂時計_202604.xlsx", 100), ("mediado", "BR1_RIVERSE_タテヨミ.tsv", 100), ("beltoon", "Beltoon_2026.xlsx", 100),
    ("lezhin", "lezhin_2026.xlsx", 100), ("beaglee", "まんが王国_202604.xlsx", 100), ("renta", "PAS1-A-1rnt_jp.csv", 100), ("booklive", "A0698a_株式会社ＲＩＶＥＲＳＥ_4.xlsx", 100), ("comico", "statement_12.xlsx", 50),
    ("dmm", "ポイント上乗せ施策.xlsx", 100), ("ebj_line", "payment-report-12.csv", 100), ("line_ad", "1_N1_R1_N1_(株)RIVERSE様.csv", 100), ("mangabang", "MangaBang_ticket.xlsx", 100), ("sb_creative_m", "【請求書】SBクリエイティブ様.xlsx", 100),
    ("shueisha", "1_支払通知書（集英社）.pdf", 100), ("u_next", "hol1_株式会社RIVERSE御中_202604.xlsx", 100), ("piccoma", "出版社report_株式会社RIVERSE_20260401.xlsx", 100), ("piccoma_gaiakuhan", "外販お支払報告書.xlsx", 100),
    ("mechacomic", "RIVERSE_202604.xlsx", 100), ("ichijinsha", "詳細別送の内訳.pdf", 50), ("kadokawa", "支払通知書_20260529_1.csv", 100), ("sb_creative_e", "支払通知書_2026年5月1日お支払い.pdf", 100),
)


def _detect(s: SparkSession, d: str) -> DataFrame:
    name = F.expr("CASE o_orderkey % 23 " + " ".join(f"WHEN {i} THEN '{f}'" for i, (_, f, _) in enumerate(_NAMES)) + " END")
    return statements.detected(V.table(s, d, "orders").select("o_orderkey", name.alias("file"))).select("o_orderkey", "platform", "confidence")


query(
    "p25_all_signatures",
    "SELECT o_orderkey, CASE o_orderkey % 23 " + " ".join(f"WHEN {i} THEN '{p}'" for i, (p, _, _) in enumerate(_NAMES)) + " END AS platform, CASE o_orderkey % 23 " + " ".join(f"WHEN {i} THEN {w}" for i, (_, _, w) in enumerate(_NAMES)) + " END / CAST(CASE o_orderkey % 23 " + " ".join(f"WHEN {i} THEN {w + 5}" for i, (_, _, w) in enumerate(_NAMES)) + " END AS DOUBLE) AS confidence FROM orders",
)(_detect)

# ---------------------------------------------------------------- seeds
_LIST = """SELECT p_partkey AS place, p_name AS title_jp, CASE WHEN p_partkey % 3 > 0 THEN upper(p_name) END AS title_kr, CASE WHEN p_partkey % 5 > 0 THEN p_brand END AS company, CASE WHEN p_partkey % 4 > 0 THEN p_type END AS genre, 'L' || p_size % 7 AS label,
 CASE p_size % 4 WHEN 0 THEN '版面' WHEN 1 THEN '小説' WHEN 2 THEN 'x' END AS form, CASE p_size % 5 WHEN 0 THEN '-' WHEN 1 THEN '完結済' WHEN 2 THEN '休載' WHEN 3 THEN '謎' END AS status FROM part"""


def _seeds(s: SparkSession, d: str) -> DataFrame:
    """The titles after two loads, the second over what the first has given."""
    part = V.table(s, d, "part")
    rows = s.sql(_LIST.replace("FROM part", "FROM {part}"), part=part)
    launches = F.expr("array(struct(concat('c', place % 3) AS code, date_add(DATE'2020-01-01', CAST(place % 900 AS INT)) AS launch_date), struct('none' AS code, DATE'2020-01-01' AS launch_date))")
    rows = rows.withColumn("launches", launches)
    platforms = s.createDataFrame([("p0", "c0"), ("p1", "c1")], "id string, code string")
    stored = {n: s.createDataFrame([], schema) for n, (schema, _) in seeding.TABLES.items()}
    for _ in range(2):
        stored = seeding.seeded(rows, stored, platforms)
    opened = stored["availability"].groupBy(F.col("title_id").alias("id")).agg(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws("=", "platform_id", "launch_date")))).alias("platforms"))  # a title's platforms
    return stored["titles"].join(opened, "id", "left")


_HASH = "substr(sha256('{0}:' || {1}), 1, 32)"
query(
    "k15_seeded_titles",
    f"""WITH r AS ({_LIST}), l AS (SELECT title_jp, max(place) AS place, arg_max(company, CASE WHEN company IS NOT NULL THEN place END) AS company, arg_max(genre, CASE WHEN genre IS NOT NULL THEN place END) AS genre FROM r GROUP BY 1),
 a AS (SELECT title_jp, place % 3 AS c, arg_max(place, place) AS place FROM r WHERE place % 3 < 2 GROUP BY 1, 2),
 o AS (SELECT title_jp, string_agg('p' || c || '=' || CAST(DATE '2020-01-01' + CAST(place % 900 AS INTEGER) AS VARCHAR), ',' ORDER BY c) AS platforms FROM a GROUP BY 1)
 SELECT {_HASH.format('title', 'title_jp')} AS id, title_jp, r.title_kr, CASE r.form WHEN '版面' THEN 'PAGETOON' WHEN '小説' THEN 'NOVEL' ELSE 'WEBTOON' END AS content_format,
 CASE r.status WHEN '-' THEN NULL WHEN '完結済' THEN '完結' WHEN '休載' THEN '休載中' ELSE r.status END AS serial_status, {_HASH.format('company', 'l.company')} AS company_id, {_HASH.format('genre', 'l.genre')} AS genre_id, {_HASH.format('label', 'r.label')} AS label_id, platforms
 FROM l JOIN r USING (title_jp, place) LEFT JOIN o USING (title_jp)""",
)(_seeds)

# ---------------------------------------------------------------- daily files and reviews
#: Names and headers of daily files, with what they are.
_DAILY = (
    ("Weekly Report 5.xlsx", "", "weekly_report", "", "high", "weekly_report"), ("누계_5.xlsx", "", "ruikei_metadata", "", "high", "ruikei_metadata"), ("product_kpi_5.csv", "", "piccoma_kpi", "Piccoma", "high", "sokuhochi_kpi"),
    ("sp_daily_sales_log_5.csv", "", "piccoma_sokuhochi", "", "medium", "sokuhochi_sp"), ("ピッコマ速報.csv", "", "piccoma_sokuhochi", "Piccoma", "high", "sokuhochi"), ("シーモア_5.tsv", "", "cmoa_sokuhochi", "cmoa", "high", "sokuhochi_cmoa"),
    ("renta_5.csv", "", "renta_sokuhochi", "Renta", "high", "sokuhochi_renta"), ("line_5.csv", "", "linemanga_sokuhochi", "LINEマンガ", "high", "sokuhochi_line"), ("PaymentReport_5.csv", "", "ebookjapan_sokuhochi", "ebookjapan", "high", "sokuhochi_ebj"),
    ("商品別売上_5.csv", "", "dmm_sokuhochi", "DMM", "high", "sokuhochi_dmm"), ("5.csv", "日付,ブック名,購入ポイント数", "piccoma_sokuhochi", "", "medium", "sokuhochi"), ("5.csv", "作品名,05-01 Total売上", "piccoma_kpi", "Piccoma", "high", "sokuhochi_kpi"),
    ("5.csv", "コンテンツID,タイトル名", "cmoa_sokuhochi", "cmoa", "high", "sokuhochi_cmoa"), ("5.csv", "参照ID,商品名,売上金額", "renta_sokuhochi", "Renta", "high", "sokuhochi_renta"), ("5.csv", "書店名,販売額計", "ebookjapan_sokuhochi", "ebookjapan", "high", "sokuhochi_ebj"),
    ("5.csv", "作品ID,取扱高", "linemanga_sokuhochi", "LINEマンガ", "high", "sokuhochi_line"), ("5.csv", "商品タイトル,売上金額,集計期間", "dmm_sokuhochi", "DMM", "high", "sokuhochi_dmm"), ("5.csv", "Title(JP),Channel,Date", "weekly_report", "", "medium", "weekly_report"), ("5.txt", "x", "unknown", "", "low", "sokuhochi"),
)


def _case(at: int) -> str:
    return f"CASE o_orderkey % {len(_DAILY)} " + " ".join(f"WHEN {i} THEN '{r[at]}'" for i, r in enumerate(_DAILY)) + " END"


query("d14_daily_formats", f"SELECT o_orderkey, {_case(2)} AS format, {_case(3)} AS platform, {_case(2)} NOT IN ('weekly_report', 'ruikei_metadata', 'unknown') AS is_preliminary, {_case(4)} AS confidence, {_case(5)} AS sub_source FROM orders")(
    lambda s, d: V.table(s, d, "orders").select("o_orderkey", detect_daily(F.expr(_case(0)), F.expr(_case(1))).alias("d")).select("o_orderkey", "d.*")
)


def _page(s: SparkSession, d: str) -> DataFrame:
    ledger = V.ledger(s, d)
    rows = ledger.selectExpr("batch AS run_id", "concat_ws('/', upload_id, line, gross) AS diff_id", "CASE line % 3 WHEN 0 THEN 'field' WHEN 1 THEN 'missing' ELSE 'extra' END AS category")
    status = "CASE line % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'pending' WHEN 2 THEN 'odd' END AS status"
    reviews = ledger.selectExpr("batch AS run_id", "concat_ws('/', upload_id, line, gross) AS diff_id", status, "CASE WHEN upload_id % 2 = 0 THEN title_jp END AS note", "timestamp'2026-05-01' AS reviewed_at")
    reviews = reviews.union(reviews.where("upload_id % 5 = 0").withColumns({"status": F.lit("needs_review"), "note": F.lit(None).cast("string"), "reviewed_at": F.lit("2026-05-02").cast("timestamp")}))
    kept, _ = reports.checked_reviews(reviews)
    return reports.reviewed(rows, kept)


query(
    "e20_reviewed_differences",
    """+x AS (SELECT batch AS run_id, upload_id || '/' || line || '/' || gross AS diff_id, line % 3 AS c, line % 4 AS k, upload_id, title_jp FROM ledger)
 SELECT run_id, diff_id, CASE c WHEN 0 THEN 'field' WHEN 1 THEN 'missing' ELSE 'extra' END AS category, CASE WHEN upload_id % 5 = 0 THEN 'needs_review' WHEN k = 0 THEN 'resolved' ELSE 'pending' END AS review_status,
 CASE WHEN k <> 2 AND upload_id % 2 = 0 THEN title_jp END AS review_note FROM x""",
    "ledger",
)(_page)
query(
    "b27_listed_titles",
    """+a AS (SELECT title_jp, CAST(sum(sales_amount) AS BIGINT) AS total_sales, min(sale_date) AS first_date, list(DISTINCT channel) AS c FROM sales GROUP BY 1), m AS (SELECT * FROM a JOIN titles USING (title_jp)),
 f AS (SELECT base_title, min(title_jp) AS title_jp FROM m GROUP BY 1), g AS (SELECT base_title, CAST(sum(total_sales) AS BIGINT) AS total_sales, CAST(len(list_distinct(flatten(list(c)))) AS INTEGER) AS channel_count FROM m GROUP BY 1)
 SELECT g.*, m.title_kr, m.genre, m.company, m.first_date FROM g JOIN f USING (base_title) JOIN m USING (title_jp)""",
    "sales",
    "titles",
)(lambda s, d: A.in_list_order(A.listed_titles(V.daily_sales(s, d), V.titles(s, d), T.ORIGINAL), "title_kr"))

query(
    "c17_near_titles",
    "WITH t AS (SELECT DISTINCT substr(p_name, 1, 12) || p_size AS t FROM part) SELECT a.t AS a, b.t AS b, levenshtein(a.t, b.t) AS distance FROM t a JOIN t b ON a.t < b.t WHERE levenshtein(a.t, b.t) <= 2",
)(lambda s, d: M.near_pairs(V.table(s, d, "part").select(F.expr("substr(p_name, 1, 12) || p_size").alias("t")), "t", 2))


def _invoices(s: SparkSession, d: str) -> DataFrame:
    """An invoice an upload; the subtotal of every fifth is off by a yen."""
    upload = Window.partitionBy("upload_id")
    of = {"g": F.sum("gross").over(upload), "batch": F.min("batch").over(upload), "first": F.row_number().over(upload.orderBy("upload_id")) == 1}
    ledger = V.ledger(s, d).select("upload_id", "line", "title_jp", "gross", "batch").withColumns(of)
    row = lambda place, *cells: f"named_struct('row_index', CAST({place} AS INT), 'cells', array({', '.join(f'CAST({c} AS STRING)' for c in cells)}))"
    line = row("10 + line", "line", "title_jp", "'5'", "'-'", "1", "gross")
    around = (
        row("9", "'№'", "'内容'", "'単価'", "'印税率'", "'数量'", "'金額'"),
        row("1", "concat('件名：', substr(batch, 1, 4) + 30, '年', substr(batch, 6, 2), '月分')"),
        row("2", "'お支払期限'", "''", "'2028年6月30日'"),
        row("100", "'小計'", "''", "g + CASE WHEN upload_id % 5 = 0 THEN 1 ELSE 0 END"),
        row("101", "''", "'振込手数料'"),
    )
    rows = F.expr(f"CASE WHEN first THEN array({', '.join((line, *around))}) ELSE array({line}) END")
    cells = ledger.select(F.concat(F.lit("【請求書】X様_"), "upload_id").alias("file"), F.lit("請求書").alias("sheet"), F.inline(rows))
    records, problems = invoices.invoice_records(cells)
    read = records.select("file", "title", "sales_month", "settlement_month", "before_tax_income", "after_tax_income", "consumption_tax", F.lit(None).cast("string").alias("problem"))
    return read.unionByName(problems.select("file", *(F.lit(None).cast(t).alias(c) for c, t in read.dtypes[1:-1]), "problem"))


query(
    "p22_invoices_against_totals",
    f"""+x AS (SELECT '【請求書】X様_' || upload_id AS file, title_jp AS title, gross, CAST(CAST(CAST(substr(min(batch) OVER (PARTITION BY upload_id), 1, 4) AS INTEGER) + 30 AS VARCHAR) || '-' || substr(min(batch) OVER (PARTITION BY upload_id), 6, 2) || '-01' AS DATE) AS sales_month FROM ledger)
 SELECT file, title, sales_month, DATE '2028-06-01' AS settlement_month, {_PLUS.format('gross')} AS before_tax_income, gross AS after_tax_income, {_PLUS.format('gross')} - gross AS consumption_tax, CAST(NULL AS VARCHAR) AS problem FROM x
 UNION ALL SELECT DISTINCT '【請求書】X様_' || upload_id, NULL, CAST(NULL AS DATE), CAST(NULL AS DATE), NULL, NULL, NULL, 'lines differ from the subtotal' FROM ledger WHERE upload_id % 5 = 0""",
    "ledger",
)(_invoices)
