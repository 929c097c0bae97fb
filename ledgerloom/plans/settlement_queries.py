"""Queries from statement lines to the export, over the whole ledger, titles and parts; registered by ``registry.query``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import titles as N
from ledgerloom.operators import ledger as L
from ledgerloom.operators import records as R
from ledgerloom.operators import settlement as S
from ledgerloom.plans import views as V
from ledgerloom.plans.registry import HALF, on_ledger, query
from ledgerloom.sources import readers, statements, workbooks
from ledgerloom.sources.versioned import stored


def _r(x: str) -> str:
    return f"CAST(floor({x} + {HALF}) AS BIGINT)"


# ---------------------------------------------------------------- rates, tax, advances
#: Amounts in whole hundreds, so that sums of shares of them are whole but for rounding errors, in whatever order they are added.
_LINE = """' ' || title_jp AS title_jp, 'c' || client_id % 50 AS client_code, channel AS channel_code, CAST(gross - gross % 100 AS DOUBLE) * CAST(1.1 AS DOUBLE) AS gross_jpy, CASE WHEN upload_id % 2 = 0 THEN rate END AS rate_hint,
 CASE WHEN line % 3 = 0 THEN CAST(gross - gross % 100 - 200 AS DOUBLE) END AS before_tax_jpy, CASE WHEN line % 5 = 0 THEN CAST(gross - 100000 AS DOUBLE) END AS before_tax_income_jpy, upload_id, line, gross"""
_SIDES = {
    "client_aliases": "SELECT DISTINCT 'c' || client_id % 50 AS alias, 'k' || client_id % 50 AS client_code FROM ledger WHERE client_id % 50 % 3 = 0",
    "title_aliases": "SELECT lower(title_jp) AS alias, 'id' || title_jp AS title_id FROM titles WHERE episodes % 4 > 0",
    "rules": "SELECT 'k3' AS client_code, 'id' || title_jp AS title_id, 'NATION_3' AS channel_code, CAST(0.7 AS DOUBLE) AS rate FROM titles WHERE episodes < 20 UNION ALL SELECT 'k3', 'id' || title_jp, '*', CAST(0.65 AS DOUBLE) FROM titles WHERE episodes < 30",
    "defaults": "SELECT DISTINCT 'k' || client_id % 50 AS client_code, CAST(0.55 AS DOUBLE) AS rate FROM ledger WHERE client_id % 50 % 9 = 0",
    "balances": "SELECT 'id' || title_jp AS title_id, CAST(50000 AS DOUBLE) AS balance FROM titles WHERE episodes % 2 = 0",
}


def _of(s: SparkSession, d: str) -> dict[str, DataFrame]:
    frames = {"ledger": stored(V.ledger(s, d), "ledger"), "titles": V.titles(s, d)}  # read once for the lines and what they are looked up in
    side = lambda q: s.sql(q.replace("FROM ledger", "FROM {ledger}").replace("FROM titles", "FROM {titles}"), **{k: v for k, v in frames.items() if f"FROM {k}" in q})
    return {"lines": side(f"SELECT {_LINE}, CAST(NULL AS DOUBLE) AS after_tax_jpy, CAST(NULL AS DOUBLE) AS consumption_tax_jpy, CAST(NULL AS DOUBLE) AS after_tax_income_jpy FROM ledger"), **{k: side(q) for k, q in _SIDES.items()}}


_IN_ORDER = "PARTITION BY title_id ORDER BY upload_id, line, gross"
query(
    "e02_settlement_records",
    "+" + ", ".join(f"{k} AS ({v})" for k, v in _SIDES.items()) + f""", n AS (SELECT {_LINE} FROM ledger),
 a AS (SELECT trim(n.title_jp) AS title_jp, coalesce(c.client_code, n.client_code) AS client_code, n.* EXCLUDE (title_jp, client_code), t.title_id FROM n LEFT JOIN client_aliases c ON n.client_code = c.alias LEFT JOIN title_aliases t ON lower(trim(n.title_jp)) = t.alias),
 b AS (SELECT a.*, coalesce(p.rate, q.rate, d.rate, rate_hint, CAST(0.5 AS DOUBLE)) AS rate, coalesce(before_tax_jpy, gross_jpy / (1 + CAST(0.1 AS DOUBLE))) AS bt FROM a LEFT JOIN rules p ON a.client_code = p.client_code AND a.title_id = p.title_id AND a.channel_code = p.channel_code LEFT JOIN rules q ON a.client_code = q.client_code AND a.title_id = q.title_id AND q.channel_code = '*' LEFT JOIN defaults d ON a.client_code = d.client_code),
 i AS (SELECT *, coalesce(before_tax_income_jpy, bt * rate) AS inc FROM b),
 w AS (SELECT i.*, coalesce(balance, 0) AS bal, coalesce(sum(inc) OVER ({_IN_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM i LEFT JOIN balances USING (title_id)),
 g AS (SELECT *, CASE WHEN title_id IS NULL THEN 0 ELSE greatest(bal, max(s) OVER ({_IN_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - s END AS mg FROM w)
 SELECT title_jp, title_id, client_code, channel_code, upload_id, line, gross, rate, {_r('bt')} AS before_tax_jpy, {_r('inc')} AS before_tax_income_jpy, {_r('inc * 9.2::DOUBLE')} AS sales_krw, {_r('mg')} AS mg_begin, {_r('least(mg, inc)')} AS mg_decrease FROM g""",
    "ledger",
    "titles",
)(lambda s, d: S.settlement_records(**_of(s, d), order=["upload_id", "line", "gross"]).select("title_jp", "title_id", "client_code", "channel_code", "upload_id", "line", "gross", "rate", "before_tax_jpy", "before_tax_income_jpy", "sales_krw", F.floor(F.col("mg_begin") + 0.5).alias("mg_begin"), F.floor(F.col("mg_decrease") + 0.5).alias("mg_decrease")))
_RULE = "SELECT DISTINCT client_id, CAST(client_id AS INTEGER) % 3 AS rule_id, '1995-01' AS effective_from, CAST(NULL AS VARCHAR(9)) AS effective_to, 10 AS priority, CAST(0.5 AS DOUBLE) AS rule_rate FROM ledger WHERE client_id % 3 > 0 UNION ALL SELECT DISTINCT client_id, 7, '1997-01', '1997-12', 1, CAST(0.6 AS DOUBLE) FROM ledger WHERE client_id % 2 = 0"
on_ledger(
    "e03_rate_rules",
    f"+q AS ({_RULE}), a AS (SELECT DISTINCT client_id, batch FROM ledger), m AS (SELECT a.client_id, batch, rule_id, rule_rate, row_number() OVER (PARTITION BY a.client_id, batch ORDER BY priority, effective_from DESC, rule_id) AS n FROM a JOIN q ON a.client_id = q.client_id AND batch >= effective_from AND (effective_to IS NULL OR batch <= effective_to)) SELECT upload_id, line, title_jp, l.client_id, l.batch, rule_id, rule_rate FROM ledger l LEFT JOIN m ON l.client_id = m.client_id AND l.batch = m.batch AND n = 1",
    lambda r: L.rate_for(r.select("upload_id", "line", "title_jp", "client_id", "batch"), r.sparkSession.sql(_RULE.replace("FROM ledger", "FROM {ledger}"), ledger=r)).drop("priority", "effective_from"),
)

# ---------------------------------------------------------------- insertion, months, names, routing
_PICCOMA = "upload_id, line, client_id, channel, title_jp, type, batch AS settlement_month, gross"
on_ledger(
    "e06_suppress_at_insert",
    f"+x AS (SELECT {_PICCOMA} FROM ledger WHERE status = 'O'), h AS (SELECT client_id, channel, title_jp, batch, type, count(*) AS k FROM ledger WHERE status <> 'O' GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY client_id, channel, title_jp, settlement_month, type ORDER BY upload_id, line, gross) AS n FROM x) SELECT upload_id, line, i.client_id, i.channel, i.title_jp, gross FROM i LEFT JOIN h ON i.client_id = h.client_id AND i.channel = h.channel AND i.title_jp = h.title_jp AND i.settlement_month = h.batch AND i.type = h.type WHERE n > coalesce(k, 0)",
    lambda r: (lambda x: S.suppress_at_insert(x.where("status = 'O'"), x.where("status <> 'O'"), "piccoma", ["client_id", "channel", "title_jp", "gross"], ["upload_id", "line", "gross"], ["client_id"]).select("upload_id", "line", "client_id", "channel", "title_jp", "gross"))(r.withColumn("settlement_month", F.col("batch"))),
)
_FILE = "o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '1999-09-01' WHEN o_orderkey % 7 = 1 THEN ' ' END AS active_month, CASE WHEN o_orderkey % 5 < 2 THEN substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) WHEN o_orderkey % 5 = 2 THEN '1998/05' END AS parsed_month, CASE WHEN o_orderkey % 3 = 0 THEN '1998-02-11' END AS fallback_month, o_orderkey % 11 > 0 AS has_records"
query("e10_settlement_month", f"WITH f AS (SELECT {_FILE} FROM orders), g AS (SELECT *, CASE WHEN trim(active_month) <> '' THEN active_month WHEN regexp_matches(parsed_month, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN substr(parsed_month, 1, 7) || '-01' WHEN has_records THEN substr(fallback_month, 1, 7) || '-01' END AS settlement_month FROM f) SELECT o_orderkey, settlement_month, settlement_month IS NULL AND has_records AS month_error FROM g")(
    lambda s, d: S.resolved_months(s.sql(f"SELECT {_FILE} FROM {{orders}}", orders=V.table(s, d, "orders"))).select("o_orderkey", "settlement_month", "month_error")
)
_NAMED = "upload_id, line, gross, CASE WHEN client_id % 4 > 0 THEN client_id END AS client_id, CASE WHEN upload_id % 3 > 0 THEN channel END AS channel_id, CASE WHEN line % 2 = 0 THEN title_jp END AS title_id, CAST(NULL AS VARCHAR(9)) AS title_kr, upload_id AS raw_id, CASE WHEN line = 1 THEN 'SUMMARY_NON_AGGREGATED' END AS note2"
_NAMES = {
    "clients": "SELECT DISTINCT client_id, 'client ' || client_id AS name FROM ledger WHERE client_id % 5 > 0",
    "channels": "SELECT DISTINCT channel AS channel_id, lower(channel) AS code FROM ledger WHERE channel <> 'NATION_4'",
    "titles": "SELECT title_jp AS title_id, title_kr AS name FROM titles WHERE title_kr IS NOT NULL",
    "raw": "SELECT upload_id AS raw_id, min(channel) AS channel_code, CASE WHEN upload_id % 2 = 0 THEN 'raw' END AS client_code FROM ledger WHERE upload_id % 6 < 4 GROUP BY upload_id",
    "template": "SELECT DISTINCT upper(channel) AS channel, 'T ' || channel AS client FROM ledger WHERE channel < 'NATION_6'",
    "uploads": "SELECT DISTINCT upload_id, 'p' || upload_id % 9 AS platform_code FROM ledger",
}


def _named(s: SparkSession, d: str) -> DataFrame:
    frames = {"ledger": stored(V.ledger(s, d), "ledger"), "titles": V.titles(s, d)}  # read once for the lines and what they are looked up in
    side = lambda q: s.sql(q.replace("FROM ledger", "FROM {ledger}").replace("FROM titles", "FROM {titles}"), **{k: v for k, v in frames.items() if f"FROM {k}" in q})
    rows = S.ledger_lines(side(f"SELECT {_NAMED} FROM ledger"))
    return S.named(rows, **{k: side(q) for k, q in _NAMES.items()}).select("upload_id", "line", "gross", "client_name", "channel_name", "title_kr")


query(
    "e11_export_names",
    "+" + ", ".join(f"{k}_ AS ({v})" for k, v in _NAMES.items()) + f", r AS (SELECT {_NAMED} FROM ledger), a AS (SELECT r.*, c.name AS cn, h.code AS hc, t.name AS tn, w.channel_code AS wc, w.client_code AS wl, u.platform_code AS p FROM r LEFT JOIN clients_ c ON r.client_id = c.client_id LEFT JOIN channels_ h ON r.channel_id = h.channel_id LEFT JOIN titles_ t ON r.title_id = t.title_id LEFT JOIN raw_ w ON r.raw_id = w.raw_id LEFT JOIN uploads_ u ON r.upload_id = u.upload_id WHERE coalesce(note2, '') NOT LIKE '%SUMMARY_NON_AGGREGATED%') SELECT upload_id, line, gross, coalesce(cn, m.client, wl, p) AS client_name, coalesce(hc, m.channel, wc, p) AS channel_name, tn AS title_kr FROM a LEFT JOIN template_ m ON lower(coalesce(hc, wc, p)) = lower(m.channel)",
    "ledger",
    "titles",
)(_named)
_CLIENTS = "CASE client_id % 6 WHEN 0 THEN 'KADOKAWA ' || client_id WHEN 1 THEN '株式会社集英社' WHEN 2 THEN 'SB  Creative' WHEN 3 THEN channel END"
on_ledger(
    "e15_routing",
    f"SELECT upload_id, line, gross, batch, CASE WHEN regexp_matches(coalesce({_CLIENTS}, channel), '(?i)kadokawa|角川|ichijinsha|一迅社|shueisha|集英社|sb\\s*creative|sbクリエイティブ|ＳＢクリエイティブ') THEN 'input_出版' ELSE 'input_電子_' || CAST(CAST(substr(batch, 6, 2) AS INTEGER) % 12 + 1 AS VARCHAR) || '月' END AS sheet FROM ledger",
    lambda r: S.routed(r.withColumn("clients", F.expr(_CLIENTS)), F.replace("batch", F.lit("-"), F.lit("")), "clients", "channel").select("upload_id", "line", "gross", "batch", "sheet"),
)
query("e19_source_manifest", "WITH u AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders) SELECT string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY n) FILTER (n <= 500) AS upload_ids, count(*) > 500 AS uploads_truncated, least(count(*), 501) AS observed_at_least FROM u")(
    lambda s, d: S.source_manifest(V.table(s, d, "orders").withColumnRenamed("o_orderkey", "upload_id"), ["o_orderdate", "upload_id"]).withColumn("upload_ids", F.array_join(F.col("upload_ids").cast("array<string>"), ","))
)

# ---------------------------------------------------------------- carrying forward
_CH_OF = "CASE client_id % 6 WHEN 0 THEN 'kadokawa' WHEN 1 THEN 'sb_creative' WHEN 2 THEN 'renta' WHEN 3 THEN 'cmoa' WHEN 4 THEN 'Piccoma' ELSE channel END"
_CARRIED = f"client_id, {_CH_OF} AS channel, type, title_jp, CAST(gross AS BIGINT) AS gross, fee, CAST(batch || '-01' AS DATE) AS sales_month, CASE WHEN line % 2 = 0 THEN last_day(CAST(batch || '-01' AS DATE)) END AS deposit_month, upload_id, line"
_SIDE = "row_number() OVER (PARTITION BY client_id ORDER BY upload_id, line, title_jp, gross) AS n"
_SHIFT = "CASE WHEN {0} = last_day({0}) THEN last_day(CAST({0} + INTERVAL 1 MONTH AS DATE)) ELSE CAST({0} + INTERVAL 1 MONTH AS DATE) END"
_CAD = "b.channel IN ('renta', 'Piccoma')"


def _merged(r: DataFrame) -> DataFrame:
    rows = r.sparkSession.sql(f"SELECT {_CARRIED}, batch FROM {{ledger}}", ledger=r)
    out = S.merge_carry(rows.where("batch = '1998-05'").drop("batch"), rows.where("batch = '1998-06'").drop("batch"), F.lit("1998-06-01").cast("date"), ["client_id"], ["upload_id", "line", "title_jp", "gross"], ["channel", "type"], ["gross", "fee"], series="title_jp")
    return out.select("client_id", "channel", "type", "title_jp", "gross", "fee", "sales_month", "deposit_month", "settlement_month", "provenance")


on_ledger(
    "e14_merge_carry",
    f"""+x AS (SELECT {_CARRIED}, batch FROM ledger), c0 AS (SELECT * FROM x WHERE batch = '1998-06'),
 b AS (SELECT *, {_SIDE} FROM x WHERE batch = '1998-05' AND channel <> 'kadokawa' AND NOT (channel = 'sb_creative' AND title_jp IN (SELECT title_jp FROM c0 WHERE channel = 'sb_creative'))), c AS (SELECT *, {_SIDE} FROM c0)
 SELECT coalesce(b.client_id, c.client_id) AS client_id, coalesce(b.channel, c.channel) AS channel, coalesce(b.type, c.type) AS type, coalesce(c.title_jp, b.title_jp) AS title_jp,
 CASE WHEN c.n IS NOT NULL THEN c.gross WHEN {_CAD} THEN 0 END AS gross, CASE WHEN c.n IS NOT NULL THEN c.fee WHEN {_CAD} THEN 0 END AS fee,
 CASE WHEN c.n IS NOT NULL AND b.n IS NOT NULL THEN coalesce(c.sales_month, b.sales_month) WHEN b.n IS NOT NULL THEN CASE WHEN {_CAD} THEN {_SHIFT.format('b.sales_month')} END ELSE coalesce(c.sales_month, DATE '1998-06-01') END AS sales_month,
 CASE WHEN c.n IS NOT NULL AND b.n IS NOT NULL THEN coalesce(c.deposit_month, b.deposit_month) WHEN b.n IS NOT NULL THEN CASE WHEN {_CAD} THEN {_SHIFT.format('b.deposit_month')} END ELSE coalesce(c.deposit_month, DATE '1998-08-31') END AS deposit_month,
 DATE '1998-07-31' AS settlement_month, CASE WHEN b.n IS NOT NULL AND c.n IS NOT NULL THEN 'overlay' WHEN b.n IS NOT NULL THEN 'carry' ELSE 'append' END AS provenance
 FROM b FULL JOIN c ON b.client_id = c.client_id AND b.n = c.n""",
    _merged,
)

# ---------------------------------------------------------------- masters
_OLD = "SELECT p_name AS title_jp, min(CASE WHEN p_partkey % 3 > 0 THEN p_type END) AS genre, min(p_brand) AS company, min(CASE WHEN p_partkey % 4 > 0 THEN 'F' || p_size END) AS content_format, min(p_partkey) AS place FROM part WHERE p_partkey % 2 = 0 GROUP BY p_name"
_NEW = "SELECT p_name || (CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' 【分冊版】' WHEN 2 THEN '【特集】' ELSE 'X' END) AS title_jp FROM part"
query(
    "k05_register_titles",
    f"WITH m AS ({_OLD}), r AS (SELECT DISTINCT title_jp FROM ({_NEW}) WHERE title_jp NOT IN (SELECT title_jp FROM m)), k AS (SELECT *, replace(title_jp, ' ', '') AS core FROM m), f AS (SELECT core, arg_min(title_jp, place) AS first FROM k GROUP BY 1), a AS (SELECT title_jp, replace(title_jp, ' 【分冊版】', '') AS base, replace(regexp_replace(title_jp, '【[^】]*】', ''), ' ', '') AS core FROM r) SELECT a.title_jp, CASE WHEN x.title_jp IS NOT NULL THEN x.genre ELSE y.genre END AS genre, coalesce(x.company, y.company) AS company, coalesce(CASE WHEN x.title_jp IS NOT NULL THEN coalesce(x.content_format, 'WEBTOON') ELSE y.content_format END, 'WEBTOON') AS content_format FROM a LEFT JOIN m x ON x.title_jp = a.base LEFT JOIN f ON f.core = a.core LEFT JOIN m y ON y.title_jp = f.first",
)(lambda s, d: (lambda p: S.register_titles(s.sql(_NEW.replace("FROM part", "FROM {p}"), p=p), s.sql(_OLD.replace("FROM part", "FROM {p}"), p=p)))(V.table(s, d, "part")))
_STORED = "SELECT p_brand AS source_sheet, p_partkey AS source_row, p_name AS name, 'b0' AS import_batch, p_partkey % 9 > 0 AS is_active FROM part WHERE p_partkey % 5 > 0"
_PARSED = "SELECT p_brand AS source_sheet, p_partkey AS source_row, upper(p_name) AS name FROM part WHERE p_partkey % 3 > 0 AND p_brand < 'Brand#3'"
query("k06_import_master", f"WITH o AS ({_STORED}), n AS ({_PARSED}) SELECT coalesce(n.source_sheet, o.source_sheet) AS source_sheet, coalesce(n.source_row, o.source_row) AS source_row, CASE WHEN n.source_row IS NOT NULL THEN n.name ELSE o.name END AS name, CASE WHEN n.source_row IS NOT NULL THEN 'b1' ELSE import_batch END AS import_batch, CASE WHEN n.source_row IS NOT NULL THEN true WHEN o.source_sheet IN (SELECT source_sheet FROM n) THEN false ELSE is_active END AS is_active FROM o FULL JOIN n ON o.source_sheet = n.source_sheet AND o.source_row = n.source_row")(
    lambda s, d: (lambda p: S.import_master(s.sql(_STORED.replace("FROM part", "FROM {p}"), p=p), s.sql(_PARSED.replace("FROM part", "FROM {p}"), p=p), "b1", ["name"]))(V.table(s, d, "part"))
)

# ---------------------------------------------------------------- titles and kinds of statements
_TAIL = "CASE p_partkey % 7 WHEN 0 THEN ' １２巻' WHEN 1 THEN ' 12巻' WHEN 2 THEN ' 3話 外伝2' WHEN 3 THEN '〜［改訂版］ 4' WHEN 4 THEN '【完全版】' WHEN 5 THEN '（１）' ELSE '' END"
query(
    "c10_canonical_titles",
    f"WITH t AS (SELECT p_partkey, p_name || {_TAIL} AS t FROM part) SELECT p_partkey, translate(t, '〜', '～') AS cmoa, replace(regexp_replace(translate(t, '〜～［］１２', '~~[]12'), '[\\s　]+', '', 'g'), '【完全版】', '[完全版]') AS booklive, translate(replace(t, ' ', ''), '［］～１２', '[]〜12') AS dmm, CASE WHEN regexp_matches(t, '\\d+巻$') THEN 'EB' WHEN regexp_matches(t, '\\d+話(\\s+外伝\\d+)?$') THEN 'EP' ELSE 'WT' END AS dmm_kind, trim(regexp_replace(t, '\\s*\\d+巻$|\\s*3話 外伝2$|\\s*4$', '')) AS series FROM t",
)(lambda s, d: V.table(s, d, "part").select("p_partkey", F.concat("p_name", F.expr(_TAIL)).alias("t")).select("p_partkey", N.CANONICAL["cmoa"](F.col("t")).alias("cmoa"), N.CANONICAL["booklive"](F.col("t")).alias("booklive"), N.CANONICAL["dmm"](F.col("t")).alias("dmm"), N.dmm_series(F.col("t"))["kind"].alias("dmm_kind"), N.dmm_series(F.col("t"))["series"].alias("series")))
_EDITION = "CASE p_partkey % 6 WHEN 0 THEN '【完全版】' WHEN 1 THEN '【分冊版】' WHEN 2 THEN '改訂版' WHEN 3 THEN '（ノベル）' ELSE '' END"
query(
    "c11_kinds",
    f"WITH t AS (SELECT p_partkey, p_name || {_EDITION} AS t, CASE WHEN p_size % 2 = 0 THEN '巻' ELSE '話' END AS u FROM part), x AS (SELECT *, NOT contains(t, '【完全版】') AND replace(t, ' ', '') || '【完全版】' IN (SELECT replace(t, ' ', '') FROM t) AS sib FROM t) SELECT p_partkey, CASE WHEN u = '巻' THEN 'EB' WHEN t LIKE '%（ノベル）' THEN 'WN' ELSE 'WT' END AS piccoma, CASE WHEN t LIKE '%ノベル%' THEN 'WN' WHEN t LIKE '%改訂版%' OR sib THEN 'WR' WHEN u = '話' THEN 'WT' WHEN t LIKE '%分冊版%' THEN 'EP' ELSE 'EB' END AS mechacomic FROM x",
)(lambda s, d: N.with_sibling(V.table(s, d, "part").select("p_partkey", F.concat("p_name", F.expr(_EDITION)).alias("t"), F.expr("case when p_size % 2 = 0 then '巻' else '話' end").alias("u")), "t").select("p_partkey", N.piccoma_kind(F.col("t"), F.col("u")).alias("piccoma"), N.mechacomic_kind(F.col("t"), F.col("u"), F.col("has_sibling")).alias("mechacomic")))
_NAME = "CASE o_orderkey % 6 WHEN 0 THEN 'cmoa_202405.csv' WHEN 1 THEN 'BR1_RIVERSE_書籍.xlsx' WHEN 2 THEN 'RIVERSE_202405.xlsx' WHEN 3 THEN '【請求書】KADOKAWA様' WHEN 4 THEN 'DMM_comico.csv' ELSE 'notes.txt' END"
query("p25_detect", "WITH f AS (SELECT o_orderkey, o_orderkey % 6 AS k, CASE WHEN o_custkey % 2 = 0 THEN 2 ELSE 0 END AS h FROM orders) SELECT o_orderkey, CASE k WHEN 0 THEN 'cmoa' WHEN 1 THEN 'mediado' WHEN 2 THEN 'mechacomic' WHEN 3 THEN 'kadokawa' WHEN 4 THEN 'dmm' ELSE CASE WHEN h > 0 THEN 'cmoa' END END AS platform, CASE k WHEN 0 THEN (103 + h) / CAST(108 + h AS DOUBLE) WHEN 4 THEN 100 / CAST(155 AS DOUBLE) WHEN 5 THEN h / CAST(h + 5 AS DOUBLE) ELSE 100 / CAST(105 + h AS DOUBLE) END AS confidence FROM f")(
    lambda s, d: statements.detected(V.table(s, d, "orders").select("o_orderkey", F.expr(_NAME).alias("file"), F.expr("case when o_orderkey % 6 = 0 then '202405_cmoa' end").alias("folder"), F.expr("case when o_custkey % 2 = 0 then '作品ID,x' end").alias("header"))).select("o_orderkey", "platform", "confidence")
)
query(
    "p23_summary",
    f"WITH f AS (SELECT o_orderkey, o_orderkey % 3 AS k, 1000 + o_custkey AS x FROM orders) SELECT '請求書_2405_' || o_orderkey || '.pdf' AS file, '2024-05-01' AS sales_month, CAST(CASE k WHEN 1 THEN floor(x / CAST(1.1 AS DOUBLE) + {HALF}) ELSE x END AS DOUBLE) AS tax_excl, CAST(CASE k WHEN 0 THEN x + 7 ELSE x END AS DOUBLE) AS tax_incl, CAST(CASE k WHEN 0 THEN 7 WHEN 1 THEN x - floor(x / CAST(1.1 AS DOUBLE) + {HALF}) ELSE 0 END AS DOUBLE) AS consumption_tax, 'invoice_summary_fallback' AS kind, false AS needs_review FROM f",
)(
    lambda s, d: statements.summarised(
        V.table(s, d, "orders").select(F.expr("'請求書_2405_' || o_orderkey || '.pdf'").alias("file"), F.lit("p").alias("platform"), F.expr("case o_orderkey % 3 when 0 then '小計 ￥' || (1000 + o_custkey) || ' 円、消費税 7円、御請求金額 ￥' || (1007 + o_custkey) when 1 then '御請求金額 ￥' || (1000 + o_custkey) else '小計: ' || (1000 + o_custkey) end").alias("text"))
    ).select("file", "sales_month", "tax_excl", "tax_incl", "consumption_tax", F.col("source_file_kind").alias("kind"), "needs_review")
)
_UPLOADS = "SELECT upload_id, channel AS family, CASE upload_id % 4 WHEN 0 THEN 'parsed' WHEN 1 THEN 'aggregated' ELSE 'error' END AS status, line - 1 AS parsed_rows FROM ledger WHERE channel > 'NATION_15' OR upload_id % 4 > 1"
on_ledger(
    "e13_missing_families",
    f"+u AS ({_UPLOADS}) SELECT DISTINCT channel AS family FROM ledger WHERE channel NOT IN (SELECT family FROM u WHERE status IN ('parsed', 'aggregated') AND parsed_rows > 3)",
    lambda r: L.missing_families(r.select(F.col("channel").alias("family")).distinct(), r.sparkSession.sql(_UPLOADS.replace("FROM ledger", "FROM {ledger}"), ledger=r).withColumn("parsed_rows", F.greatest(F.col("parsed_rows") - 3, F.lit(0)))),
)


# ---------------------------------------------------------------- records of three shapes of rows
_RECORD_UPLOADS = "SELECT upload_id, min(batch) || '-01' AS settlement_month, CASE WHEN upload_id % 2 = 0 THEN max(batch) || '-15' END AS sales_month, upload_id % 5 = 0 AS forced FROM ledger GROUP BY upload_id"
_RECORD_CLIENTS = "SELECT DISTINCT 'id' || client_id AS client_id, 'C' || client_id AS code FROM ledger WHERE client_id % 4 > 0"
_RECORD_CHANNELS = "SELECT DISTINCT 'ch' || channel AS channel_id, channel AS code FROM ledger WHERE channel <> 'NATION_3'"


def _records(s: SparkSession, d: str) -> DataFrame:
    ledger, titles = stored(V.ledger(s, d), "records-ledger"), V.titles(s, d)  # read once for the shapes and their sides
    side = lambda q: stored(s.sql(q.replace("FROM ledger", "FROM {ledger}"), ledger=ledger), "records-side")
    sides = {"uploads": side(_RECORD_UPLOADS), "clients": side(_RECORD_CLIENTS).withColumn("aliases", F.array(F.concat(F.lit(" Alias"), F.expr("substr(code, 2)")))), "channels": side(_RECORD_CHANNELS), "titles": titles.where("episodes % 4 > 0").select(F.concat(F.lit("id"), "title_jp").alias("title_id"), "title_jp")}
    third = lambda n: ledger.where(f"upload_id % 3 = {n}").withColumn("row_index", F.col("line").cast("long"))
    month, code = F.when(F.col("line") % 2 == 0, F.concat("batch", F.lit("/20"))), F.concat(F.lit("ALIAS"), "client_id")
    raw = third(0).select("upload_id", "row_index", F.struct(code.alias("client_code"), F.col("channel"), F.lower("title_jp").alias("title_jp"), month.alias("sales_month"), "type", F.col("gross").alias("gross_jpy"), F.col("fee").alias("fee_jpy"), F.col("rate").alias("rs_rate_hint"), (F.col("line") == 3).alias("is_summary"), F.lit("notice").alias("source_file_kind")).alias("data"))
    sales = third(1).select("upload_id", "row_index", F.concat(F.lit(" c"), "client_id").alias("client_code"), F.col("channel").alias("channel_code"), "title_jp", month.alias("sales_month"), "type", F.col("gross").alias("total_amount_jpy"), F.col("fee").alias("fee_jpy"), F.col("rate").alias("rs_rate"))
    sheet = third(2).select("upload_id", "row_index", code.alias("clients"), "channel", "title_jp", month.alias("sales_month"), F.lit(" ").alias("type"), F.col("gross").cast("string").alias("total_amount_jpy"), F.col("fee").cast("string").alias("fee_jpy"), F.col("rate").alias("rs"))
    parts = [R.sales_records(rows, **sides) for rows in (raw, sales, sheet)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    kept = ("client_id", "channel_id", "title_id", "sales_month", "settlement_month", "title_jp", "type", "total_amount_jpy", "fee_jpy", "rs_rate", "note2")
    return every.select("upload_id", "row_index", *kept, F.size("unresolved").cast("long").alias("n_unresolved"))


_SUMMARY = "(upload_id % 3 = 0 AND line = 3)"
_OWN_DAY = "CASE WHEN line % 2 = 0 THEN CASE WHEN upload_id % 3 = 0 THEN CAST(batch || '-20' AS DATE) ELSE CAST(batch || '-01' AS DATE) END END"
query(
    "e01_sales_records",
    f"""+u AS ({_RECORD_UPLOADS}), c AS ({_RECORD_CLIENTS}), h AS ({_RECORD_CHANNELS}), t AS (SELECT 'id' || title_jp AS title_id, title_jp AS name FROM titles WHERE episodes % 4 > 0)
 SELECT ledger.upload_id, CAST(line AS BIGINT) AS row_index, c.client_id, channel_id, title_id,
 coalesce({_OWN_DAY.replace('upload_id', 'ledger.upload_id')}, CASE WHEN ledger.upload_id % 3 = 0 THEN CAST(sales_month AS DATE) ELSE CAST(date_trunc('month', CAST(sales_month AS DATE)) AS DATE) END, CAST(settlement_month AS DATE)) AS sales_month,
 CAST(settlement_month AS DATE) AS settlement_month, CASE WHEN ledger.upload_id % 3 = 0 THEN lower(title_jp) ELSE title_jp END AS title_jp, CASE WHEN ledger.upload_id % 3 = 2 THEN 'WT' ELSE type END AS type,
 CASE WHEN NOT {_SUMMARY.replace('upload_id', 'ledger.upload_id')} THEN CAST(gross AS DOUBLE) END AS total_amount_jpy, CASE WHEN {_SUMMARY.replace('upload_id', 'ledger.upload_id')} THEN CAST(0 AS DOUBLE) ELSE CAST(coalesce(fee, 0) AS DOUBLE) END AS fee_jpy,
 CASE WHEN NOT {_SUMMARY.replace('upload_id', 'ledger.upload_id')} THEN CAST(rate AS DOUBLE) END AS rs_rate, CASE WHEN {_SUMMARY.replace('upload_id', 'ledger.upload_id')} THEN 'SUMMARY_NON_AGGREGATED:notice' END AS note2,
 CASE WHEN ledger.upload_id % 3 = 0 THEN 0 ELSE CAST(c.client_id IS NULL AS BIGINT) + CAST(channel_id IS NULL AS BIGINT) END AS n_unresolved
 FROM ledger LEFT JOIN u ON ledger.upload_id = u.upload_id LEFT JOIN c ON c.code = 'C' || ledger.client_id LEFT JOIN h ON h.code = channel LEFT JOIN t ON name = title_jp""",
    "ledger",
    "titles",
)(_records)


# ---------------------------------------------------------------- statement files, from their columns to the amounts
#: What the ledger would look like in two platforms' files; batches of the 1990s stand for those thirty years later.
_IN_FILE = "'PAS_' || CAST(CAST(substr(batch, 1, 4) AS INTEGER) + 30 AS VARCHAR(4)) || substr(batch, 6, 2) || '.csv'"
_FILE_MONTH = "CAST(CAST(CAST(substr(batch, 1, 4) AS INTEGER) + 30 AS VARCHAR(4)) || '-' || substr(batch, 6, 2) || '-01' AS DATE)"
_RENTA = {"書名": "title_jp || CASE line % 3 WHEN 0 THEN '【タテコミ】完全版' WHEN 1 THEN '【分冊版】' ELSE '' END", "価格": "gross", "売上冊数": "line", "アップグレード冊数": "line % 2", "支払額": "gross - gross % 10"}
_LINE_AD = {"タイトル": "title_jp", "報告年月": "batch", "売上額(基準額)": "'¥' || gross", "配分料率": "'40%'", "支払額": "gross - gross % 10"}


def _settled(platform: str, columns: dict[str, str], keep: list[str]):
    def run(s: SparkSession, d: str) -> DataFrame:
        table = V.ledger(s, d).select(F.expr(_IN_FILE).alias("file"), *(F.expr(f"CAST({e} AS STRING)").alias(c) for c, e in columns.items()))
        own = readers.lines(readers.text_table(table, readers.READERS[platform], F.col("file")), platform)
        return statements.settled(own, platform).select(*keep)

    return run


query(
    "p05_renta_statement",
    f"""+f AS (SELECT title_jp || CASE line % 3 WHEN 0 THEN '【タテコミ】完全版' WHEN 1 THEN '【分冊版】' ELSE '' END AS title, CASE line % 3 WHEN 0 THEN 'WT' WHEN 1 THEN 'EP' ELSE 'EB' END AS kind, {_FILE_MONTH} AS sales_month,
 gross * (line + line % 2) AS sales, gross - gross % 10 AS pay FROM ledger), a AS (SELECT title, kind, sales_month, CAST(sum(sales) AS BIGINT) AS s, CAST(sum(pay) AS BIGINT) AS p, count(*) AS row_count FROM f GROUP BY ALL)
 SELECT title, kind, sales_month, last_day(sales_month + INTERVAL 2 MONTH) AS settlement_date, (11 * s + 5) // 10 AS total, s AS after_tax, p + p // 10 AS before_tax_income, p AS after_tax_income, p // 10 AS consumption_tax, row_count FROM a""",
    "ledger",
)(_settled("renta", _RENTA, ["title", "kind", "sales_month", "settlement_date", "total", "after_tax", "before_tax_income", "after_tax_income", "consumption_tax", "row_count"]))
query(
    "p07_line_ad_statement",
    """SELECT title_jp AS title, CAST(batch || '-01' AS DATE) AS sales_month, (11 * gross + 5) // 10 AS total, gross AS after_tax, gross - gross % 10 AS after_tax_income, (gross - gross % 10) // 10 AS consumption_tax FROM ledger""",
    "ledger",
)(_settled("line_ad", _LINE_AD, ["title", "sales_month", "total", "after_tax", "after_tax_income", "consumption_tax"]))


# ---------------------------------------------------------------- workbooks
def _initial(s: SparkSession, d: str) -> DataFrame:
    """Launches as rows of the daily sheet and of the weekly one; some are in one alone."""
    rows = V.table(s, d, "orders")
    amount = lambda i: f"CAST(o_custkey + {i} AS STRING)"
    sheet = lambda name, share, n: rows.where(share).selectExpr("'f' AS file", f"'{name}' AS sheet", "CAST(o_orderkey + 3 AS INT) AS row_index", "array(concat('o', o_orderkey), CASE WHEN o_orderkey % 2 = 0 THEN '픽코마' ELSE 'Other' END, o_orderpriority, '', date_format(o_orderdate, 'yy.MM.dd'), '', '1', " + ", ".join(amount(i) for i in range(n)) + ") AS cells")
    return workbooks.initial_sales(sheet("일별", "o_orderkey % 3 < 2", 8).union(sheet("주간", "o_orderkey % 3 > 0", 12))).select("title_kr", "platform_code", "launch_date", "genre_kr", "launch_type", "d1", "d8", "w1", "w12")


_SHARE = lambda i, n: f"CASE WHEN {n} THEN CAST(o_custkey + {i} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
query(
    "d16_initial_sales",
    f"""SELECT 'o' || o_orderkey AS title_kr, CASE WHEN o_orderkey % 2 = 0 THEN 'piccoma' ELSE 'other' END AS platform_code, CAST(o_orderdate AS DATE) AS launch_date, o_orderpriority AS genre_kr, '비독점' AS launch_type,
 {_SHARE(0, 'o_orderkey % 3 < 2')} AS d1, {_SHARE(7, 'o_orderkey % 3 < 2')} AS d8, {_SHARE(0, 'o_orderkey % 3 > 0')} AS w1, {_SHARE(11, 'o_orderkey % 3 > 0')} AS w12 FROM orders""",
)(_initial)
on_ledger(
    "k09_old_workbook",
    "SELECT 'u' || upload_id AS unique_identifier, title_jp, CAST(batch || '-01' AS DATE) AS sales_month, channel, 'RJ' AS company, CAST(gross AS DOUBLE) AS total_amount_jpy, CAST(coalesce(fee, 0) AS DOUBLE) AS fee_jpy, CASE WHEN line % 2 = 0 THEN '50%' ELSE 'x' END AS rs, CAST(0 AS DOUBLE) AS mg_end, CAST(1 AS DOUBLE) AS rate_krw_krw FROM ledger",
    lambda r: workbooks.old_workbook_rows(
        r.selectExpr("'' AS unique_identifier", "concat('u', upload_id) AS unique_id", "title_jp", "concat(batch, '-01') AS sales_month", "channel AS channel_code", "gross AS total_amount_jpy", "fee AS fee_jpy", "CASE WHEN line % 2 = 0 THEN '50%' END AS rs_label", "'x' AS rs")
    ).select("unique_identifier", "title_jp", "sales_month", "channel", "company", "total_amount_jpy", "fee_jpy", "rs", "mg_end", "rate_krw_krw"),
)
