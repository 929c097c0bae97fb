"""Queries that store the whole fact in versions and read it again: upserts, precedence, cumulative files, kept views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import sales_store as S
from ledgerloom.plans import views as V
from ledgerloom.plans.registry import query
from ledgerloom.sources.versioned import VersionedTable, shared_folder

#: Sales of fifty titles on three days a month, so that keys meet.
_COARSE = """x AS (SELECT 'T' || CAST(substr(title_jp, 2) AS BIGINT) % 50 AS title_jp, channel, CAST(date_trunc('month', sale_date) AS DATE) + CAST(line % 3 AS INTEGER) AS sale_date, sales_amount, sales_amount_gross, data_source FROM sales)"""
_FOLD = "SELECT title_jp, channel, sale_date, CAST(sum(sales_amount) AS BIGINT) AS sales_amount, CAST(sum(sales_amount_gross) AS BIGINT) AS sales_amount_gross FROM x WHERE {} GROUP BY ALL"
_AMOUNTS = "title_jp, channel, sale_date, sales_amount, sales_amount_gross"
WEEKLY, EARLY, MANUAL = "data_source = 'weekly_report'", "data_source = 'sokuhochi'", "data_source = 'manual'"
YEAR97, YEAR98 = "sale_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'", "sale_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'"


def _coarse(s: SparkSession, d: str) -> DataFrame:
    title = F.expr("concat('T', CAST(substr(title_jp, 2) AS BIGINT) % 50)")
    return V.daily_sales(s, d).select(title.alias("title_jp"), "channel", F.expr("date_add(trunc(sale_date, 'MM'), line % 3)").alias("sale_date"), "sales_amount", "sales_amount_gross", "data_source")


def _table(s: SparkSession) -> VersionedTable:
    return S.sales_table(s, shared_folder(s, "sales"))


def _upsert(s: SparkSession, d: str) -> DataFrame:
    rows, table = _coarse(s, d), _table(s)
    S.store_sales(table, rows.where(WEEKLY), "manual", "b1")
    S.store_sales(table, rows.where(MANUAL), "manual", "b2")
    return table.read().select(*_AMOUNTS.split(", "), "batch")


query(
    "k01_stored_upsert",
    f"""+{_COARSE}, o AS ({_FOLD.format(WEEKLY)}), n AS ({_FOLD.format(MANUAL)})
 SELECT coalesce(n.title_jp, o.title_jp) AS title_jp, coalesce(n.channel, o.channel) AS channel, coalesce(n.sale_date, o.sale_date) AS sale_date, coalesce(n.sales_amount, o.sales_amount) AS sales_amount,
 coalesce(n.sales_amount_gross, o.sales_amount_gross) AS sales_amount_gross, CASE WHEN n.title_jp IS NOT NULL THEN 'b2' ELSE 'b1' END AS batch
 FROM o FULL JOIN n ON o.title_jp = n.title_jp AND o.channel = n.channel AND o.sale_date = n.sale_date""",
    "sales",
)(_upsert)


def _precedence(s: SparkSession, d: str) -> DataFrame:
    rows, table = _coarse(s, d), _table(s)
    S.store_by_precedence(table, rows.where(EARLY), "sokuhochi", "b1", preliminary=True)
    S.store_by_precedence(table, rows.where(f"{WEEKLY} AND {YEAR97}"), S.CONFIRMED, "b2")
    S.store_by_precedence(table, rows.where(MANUAL), "manual", "b3")
    return table.read().select(*_AMOUNTS.split(", "), "data_source")


query(
    "k03_stored_precedence",
    f"""+{_COARSE}, e AS ({_FOLD.format(EARLY)}), w AS ({_FOLD.format(f'{WEEKLY} AND {YEAR97}')}), m AS ({_FOLD.format(MANUAL)})
 SELECT *, 'sokuhochi' AS data_source FROM e WHERE sale_date < (SELECT min(sale_date) FROM w) OR sale_date > (SELECT max(sale_date) FROM w)
 UNION ALL SELECT *, 'weekly_report' FROM w UNION ALL SELECT *, 'manual' FROM m ANTI JOIN w USING (title_jp, channel, sale_date)""",
    "sales",
)(_precedence)


def _cumulative(s: SparkSession, d: str) -> DataFrame:
    rows, table = _coarse(s, d), _table(s)
    S.store_cumulative(table, rows, "cumulative", "b1")
    S.store_cumulative(table, rows.where(f"{MANUAL} AND {YEAR97} AND channel < 'NATION_3'"), "cumulative", "b2")
    return table.read().select(*_AMOUNTS.split(", "), "batch")


query(
    "k04_stored_cumulative",
    f"""+{_COARSE}, o AS ({_FOLD.format('true')}), n AS ({_FOLD.format(f"{MANUAL} AND {YEAR97} AND channel < 'NATION_3'")}), r AS (SELECT channel, min(sale_date) AS lo, max(sale_date) AS hi FROM n GROUP BY 1)
 SELECT {_AMOUNTS}, 'b1' AS batch FROM o LEFT JOIN r USING (channel) WHERE r.lo IS NULL OR sale_date < lo OR sale_date > hi UNION ALL SELECT {_AMOUNTS}, 'b2' FROM n""",
    "sales",
)(_cumulative)


def _views(s: SparkSession, d: str) -> S.KeptViews:
    """The views after three batches, of which the later ones touch some months."""
    rows, table = _coarse(s, d), _table(s)
    S.store_sales(table, rows.where(EARLY), "sokuhochi", "b1", preliminary=True)
    views = S.KeptViews(table)
    views.refresh()
    S.store_sales(table, rows.where(f"{MANUAL} AND {YEAR98}"), "manual", "b2")
    S.store_by_precedence(table, rows.where(f"{WEEKLY} AND {YEAR97}"), S.CONFIRMED, "b3")
    views.refresh()
    return views


_STORED = f"""+{_COARSE}, e AS ({_FOLD.format(EARLY)}), w AS ({_FOLD.format(f'{WEEKLY} AND {YEAR97}')}), m AS ({_FOLD.format(f'{MANUAL} AND {YEAR98}')}),
 a AS (SELECT *, true AS p FROM e WHERE sale_date < (SELECT min(sale_date) FROM w) OR sale_date > (SELECT max(sale_date) FROM w) UNION ALL SELECT *, false FROM w UNION ALL SELECT *, false FROM m WHERE sale_date < (SELECT min(sale_date) FROM w) OR sale_date > (SELECT max(sale_date) FROM w)),
 d AS (SELECT title_jp, channel, sale_date, max(sales_amount) AS sales_amount, max(sales_amount_gross) AS sales_amount_gross, bool_or(p) AS is_preliminary FROM a GROUP BY ALL)"""
query("a17_kept_daily_sales", f"{_STORED} SELECT * FROM d", "sales")(lambda s, d: _views(s, d).daily_sales())
query(
    "a18_kept_title_sales",
    f"{_STORED} SELECT title_jp, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels, CAST(sum(sales_amount) AS BIGINT) AS total_sales, count(DISTINCT sale_date) AS days, min(sale_date) AS first_date, max(sale_date) AS last_date FROM d GROUP BY 1",
    "sales",
)(lambda s, d: _views(s, d).title_sales())
