"""Queries over statements known as text: the ledger as it would stand in such files, an upload or a month a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans import views as V
from ledgerloom.plans.registry import HALF, query
from ledgerloom.sources import notices
from ledgerloom.sources.versioned import stored


def _net(gross: str) -> str:
    return f"CAST(floor({gross} / CAST(1.1 AS DOUBLE) + {HALF}) AS BIGINT)"


def _gross(net: str) -> str:
    return f"CAST(floor({net} * CAST(1.1 AS DOUBLE) + {HALF}) AS BIGINT)"


def _files(rows: DataFrame, text: str) -> DataFrame:
    """One text an upload: its lines in order."""
    each = rows.select(F.concat(F.lit("f"), "upload_id").alias("file"), "upload_id", F.struct("line", "gross", F.expr(text).alias("t")).alias("x"))
    lines = F.array_sort(F.collect_list("x"))
    return each.groupBy("file", "upload_id").agg(F.array_join(F.transform(lines, lambda x: x["t"]), " ").alias("text"))


# ---------------------------------------------------------------- ichijinsha
_WORK = "'T' || CAST(substr(title_jp, 2) AS BIGINT) % 2"
_PERIOD = "' 集計期間：' || substr(batch, 1, 4) || '年' || substr(batch, 6, 2) || '月 '"
_DETAIL = f"'国内電子 ' || {_WORK} || ' (' || line % 2 || ')' || {_PERIOD} || gross || CASE WHEN fee IS NOT NULL THEN ' 国内電子 ' || {_WORK} || '（' || line % 2 || '）（MG）' || {_PERIOD} || '-' || fee ELSE '' END"


def _ichijinsha(s: SparkSession, d: str) -> DataFrame:
    """Every tenth file ends with an offset that meets no row, and so gives a problem alone."""
    files = _files(V.ledger(s, d), _DETAIL)
    stray = "concat(text, CASE WHEN upload_id % 10 = 0 THEN ' 国内電子 X（MG） 集計期間：1997年5月 -1' ELSE '' END)"
    records, problems = notices.ichijinsha_details(files.select("file", F.expr(stray).alias("text")))
    none = F.lit(None)
    read = records.select("file", "title", "sales_month", "before_tax_income", "after_tax_income", none.cast("string").alias("problem"))
    return read.unionByName(problems.select("file", "title", none.cast("date").alias("sales_month"), none.cast("long").alias("before_tax_income"), none.cast("long").alias("after_tax_income"), "problem"))


query(
    "p20_ichijinsha_details",
    f"""+x AS (SELECT upload_id, line, {_WORK} AS t, line % 2 AS v, gross, fee, batch FROM ledger WHERE upload_id % 10 > 0),
 a AS (SELECT *, row_number() OVER (PARTITION BY upload_id, t, v ORDER BY line, gross) AS n, sum(fee) OVER (PARTITION BY upload_id, t, v) AS off FROM x),
 b AS (SELECT *, CAST(gross - CASE WHEN n = 1 THEN coalesce(off, 0) ELSE 0 END AS BIGINT) AS net FROM a)
 SELECT 'f' || upload_id AS file, t || '（' || translate(CAST(v AS VARCHAR), '01', '０１') || '）' AS title, CAST(batch || '-01' AS DATE) AS sales_month, {_gross('net')} AS before_tax_income, net AS after_tax_income, CAST(NULL AS VARCHAR) AS problem FROM b
 UNION ALL SELECT DISTINCT 'f' || upload_id, 'X（MG）', CAST(NULL AS DATE), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 'offset without a row' FROM ledger WHERE upload_id % 10 = 0""",
    "ledger",
)(_ichijinsha)

_COUNT = "upload_id % 4 + 1"
_INVOICE = {
    "file": "'f' || upload_id",
    "place": "line",
    "title": f"CASE line % 3 WHEN 0 THEN '電子「' WHEN 1 THEN '素材費 「' ELSE '「電子の' END || title_jp || '」第' || line || CASE WHEN {_COUNT} > 1 THEN '～' || (line + {_COUNT} - 1) ELSE '' END || '巻'",
    "quantity": f"CASE WHEN upload_id % 7 = 0 THEN {_COUNT} + 1 WHEN upload_id % 7 < 4 THEN {_COUNT} END",
    "unit_price": f"CASE WHEN line % 2 = 0 THEN gross // ({_COUNT}) - 1 END",
    "amount": "gross",
    "sales_month": "CASE WHEN upload_id % 2 = 0 THEN batch || '-01' END",
    "settlement_month": "CASE WHEN line % 2 = 0 THEN '1998-09-01' END",
}


def _invoice(s: SparkSession, d: str) -> DataFrame:
    columns = (F.expr(e.replace("gross //", "gross div")).alias(c) for c, e in _INVOICE.items())
    return notices.ichijinsha_invoice(V.ledger(s, d).select(*columns)).drop("channel_title", "item")


query(
    "p20_ichijinsha_invoice",
    f"""+x AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _INVOICE.items())}, {_COUNT} AS n, title_jp, line FROM ledger),
 y AS (SELECT *, n > 1 AND quantity IS NOT NULL AND quantity <> n AS unfit, coalesce(unit_price, amount // n) AS unit FROM x),
 z AS (SELECT *, unnest(CASE WHEN n > 1 AND NOT unfit THEN generate_series(line, line + n - 1) ELSE [line] END) AS v FROM y),
 w AS (SELECT *, CAST(CASE WHEN n = 1 OR unfit THEN amount WHEN v = line + n - 1 THEN amount - unit * (n - 1) ELSE unit END AS BIGINT) AS net FROM z)
 SELECT file, place, CASE WHEN unfit THEN title ELSE CASE WHEN line % 3 = 2 THEN '電子の' ELSE '' END || title_jp || '（' || translate(CAST(v AS VARCHAR), '0123456789', '０１２３４５６７８９') || '）' END AS title, CASE WHEN line % 3 = 0 THEN 'EB' ELSE 'MF' END AS kind,
 coalesce(settlement_month, sales_month) AS sales_month, {_gross('net')} AS before_tax_income, net AS after_tax_income, {_gross('net')} - net AS consumption_tax, CASE WHEN unfit THEN 'quantity differs from the volumes' END AS problem FROM w""",
    "ledger",
)(_invoice)

# ---------------------------------------------------------------- SB Creative
_SERIES, _VOLUME = "CAST(substr(title_jp, 2) AS BIGINT) % 2", "CAST(substr(title_jp, 2) AS BIGINT) % 3 + 8"


def _sb(s: SparkSession, d: str) -> DataFrame:
    """Every fourth line has no volume: its series has none, one or several volumes in its upload."""
    rows = V.ledger(s, d).withColumn("file", F.concat(F.lit("f"), "upload_id"))
    title = f"CASE WHEN line % 4 = 0 THEN '「作品' || {_SERIES} || 'w」【分冊版】(1話〜9話)' ELSE '作品' || {_SERIES} || 'W 第0' || ({_VOLUME}) || '巻' END"
    details = rows.select("file", F.col("line").alias("place"), F.expr(title).alias("title"), F.col("gross").alias("royalty"))
    draws = rows.where("fee is not null").select("file", F.col("line").alias("place"), F.expr(f"'作品' || {_SERIES} || 'w（' || ({_VOLUME}) || '）'").alias("title"), (F.col("fee") * 9).alias("draw"))
    months = rows.groupBy("file").agg(F.to_date(F.concat(F.min("batch"), F.lit("-01"))).alias("sales_month"))
    records, problems = notices.sb_net(details, draws, months)
    read = records.select("file", "title", "deposit_date", "before_tax_income", "after_tax_income", F.lit(None).cast("string").alias("problem"))
    return read.unionByName(problems.select("file", F.lit(None).cast("string").alias("title"), F.lit(None).cast("date").alias("deposit_date"), *(F.lit(None).cast("long").alias(c) for c in ("before_tax_income", "after_tax_income")), "problem"))


query(
    "p21_sb_report",
    f"""+x AS (SELECT 'f' || upload_id AS file, line, {_SERIES} AS s, CASE WHEN line % 4 > 0 THEN {_VOLUME} END AS v, {_VOLUME} AS w, gross, fee * 9 AS draw, batch FROM ledger),
 o AS (SELECT file, s, min(v) AS lo, max(v) AS hi, min(CASE WHEN draw IS NOT NULL THEN w END) AS dlo, max(CASE WHEN draw IS NOT NULL THEN w END) AS dhi FROM x GROUP BY ALL),
 b AS (SELECT x.*, CASE WHEN v IS NOT NULL THEN v WHEN lo IS NOT NULL THEN CASE WHEN lo = hi THEN lo END WHEN dlo = dhi THEN dlo END AS bound, lo IS NULL AND dlo IS NULL AS none FROM x JOIN o USING (file, s)),
 e AS (SELECT file, s, bound AS v, gross, 0 AS draw, CASE WHEN v IS NOT NULL THEN 0 ELSE 2 END AS k, line FROM b WHERE bound IS NOT NULL UNION ALL SELECT file, s, w, 0, draw, 1, line FROM x WHERE draw IS NOT NULL),
 g AS (SELECT file, s, v, CAST(sum(gross) - sum(draw) AS BIGINT) AS net, min(k) AS k FROM e GROUP BY ALL), m AS (SELECT file, CAST(min(batch) || '-01' AS DATE) AS month FROM x GROUP BY file)
 SELECT file, '作品' || s || CASE k WHEN 0 THEN 'W' ELSE 'w' END || '（' || translate(CAST(v AS VARCHAR), '0123456789', '０１２３４５６７８９') || '）' AS title, last_day(month + INTERVAL 4 MONTH) AS deposit_date, net AS before_tax_income, {_net('net')} AS after_tax_income, CAST(NULL AS VARCHAR) AS problem FROM g JOIN m USING (file) WHERE net > 0
 UNION ALL SELECT file, NULL, NULL, NULL, NULL, CASE WHEN none THEN 'no volume' ELSE 'several volumes' END FROM b WHERE bound IS NULL""",
    "ledger",
)(_sb)

# ---------------------------------------------------------------- shueisha
_NOTICE = "batch || '/' || client_id % 50"
_SPELT = "repeat(title_jp, 3) || CASE line % 3 WHEN 0 THEN '口' ELSE '' END"


def _shueisha(s: SparkSession, d: str) -> DataFrame:
    """A notice a month and fiftieth of the clients; the totals of every fifth are off by one yen."""
    rows = V.ledger(s, d).selectExpr(f"{_NOTICE} AS file", "(upload_id * 8 + line) * 10000000 + gross AS place", f"{_SPELT} AS title", "CASE WHEN line % 2 = 0 THEN '単行本' ELSE '話配信' END AS kind", "gross AS payment", "client_id % 50 AS k")
    sums = stored(rows.groupBy("file", "k").agg(F.sum("payment").alias("summary_total")), "notice-sums")  # a row a file
    day, month = F.lit("1998-09-25").cast("date"), F.to_date(F.concat(F.substring("file", 1, 7), F.lit("-01")))
    total = (F.col("summary_total") + F.when(F.col("k") % 5 == 0, 1).otherwise(0)).alias("detail_total")
    pages = sums.select("file", day.alias("payment_date"), day.alias("second_date"), (F.col("summary_total") + 1100).alias("grand_total"), "summary_total", total, month.alias("detail_month"))
    adverts = sums.select("file", F.lit(0).alias("place"), F.lit("作品（広告）").alias("title"), F.lit(1100).cast("long").alias("payment"), month.alias("sales_month"))
    records, problems = notices.shueisha_notice(pages, adverts, rows)
    read = records.select("file", "channel_title", "kind", "sales_month", "before_tax_income", "after_tax_income", F.lit(None).cast("string").alias("problem"))
    return read.unionByName(problems.select("file", *(F.lit(None).cast(t).alias(c) for c, t in read.dtypes[1:6]), "problem"))


_NEAR = "(h = {0} OR levenshtein(h, {0}) <= greatest(2, CAST(floor(greatest(length(h), length({0})) * CAST(0.45 AS DOUBLE)) AS BIGINT)))"
query(
    "p19_shueisha_notice",
    f"""+d AS (SELECT {_NOTICE} AS file, (upload_id * 8 + line) * 10000000 + gross AS place, replace({_SPELT}, '口', '_') AS key, CASE WHEN line % 2 = 0 THEN '単行本' ELSE '話配信' END AS kind, gross, batch FROM ledger WHERE client_id % 50 % 5 > 0),
 s AS (SELECT file, kind, key, min(place) AS place, count(*) AS n, CAST(sum(gross) AS BIGINT) AS payment FROM d GROUP BY ALL),
 p AS (SELECT file, kind, list_reduce(list([key] ORDER BY place), lambda heads, x: CASE WHEN len(list_filter(heads, lambda h: {_NEAR.format('x[1]')})) > 0 THEN heads ELSE list_concat(heads, x) END) AS heads FROM s GROUP BY ALL),
 e AS (SELECT s.*, list_filter(heads, lambda h: {_NEAR.format('key')})[1] AS head FROM s JOIN p USING (file, kind)),
 g AS (SELECT file, kind, list(key ORDER BY n DESC, place)[1] AS title, CAST(sum(payment) AS BIGINT) AS pay FROM e GROUP BY file, kind, head)
 SELECT file, replace(title, '_', '口') || '(' || kind || ')' AS channel_title, 'EB' AS kind, CAST(substr(file, 1, 7) || '-01' AS DATE) AS sales_month, pay AS before_tax_income, {_net('pay')} AS after_tax_income, CAST(NULL AS VARCHAR) AS problem FROM g
 UNION ALL SELECT DISTINCT {_NOTICE}, '作品(広告)', 'AD', CAST(batch || '-01' AS DATE), 1100, 1000, CAST(NULL AS VARCHAR) FROM ledger WHERE client_id % 50 % 5 > 0
 UNION ALL SELECT DISTINCT {_NOTICE}, NULL, NULL, CAST(NULL AS DATE), NULL, NULL, 'details differ from their total' FROM ledger WHERE client_id % 50 % 5 = 0""",
    "ledger",
)(_shueisha)
