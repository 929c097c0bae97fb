"""The reference queries by name, with the SQL that gives the same rows: ``QUERIES`` and ``ORACLE_SQL``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.functions import text as T
from ledgerloom.operators import analytics as A
from ledgerloom.operators import ledger as L
from ledgerloom.operators import masters as M
from ledgerloom.plans import views as V
from ledgerloom.plans.views import AS_OF
from ledgerloom.sources.reports import report_rows, workbook_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CH, TITLE = "NATION_3", "T17"
YEAR, PREV = ("1997-01-01", "1997-12-31"), ("1996-01-01", "1996-12-31")
_VIEWS = {"sales": V.SALES_SQL, "titles": V.TITLES_SQL, "ledger": V.LEDGER_SQL}
IN_YEAR = f"sale_date BETWEEN DATE '{YEAR[0]}' AND DATE '{YEAR[1]}'"
TOTAL = "CAST(sum(sales_amount) AS BIGINT) AS total_sales"
HALF = "CAST(0.5 AS DOUBLE)"
AVG = f"CAST(floor(sum(sales_amount) / CAST(greatest(count(DISTINCT sale_date), 1) AS DOUBLE) + {HALF}) AS BIGINT) AS avg_daily"
GROUP = f"{TOTAL}, count(DISTINCT title_jp) AS title_count, {AVG}"
THIS, LAST = "DATE '1998-07-01'", "DATE '1998-06-01'"
NOW_LAST = f"CAST(coalesce(sum(CASE WHEN sale_date >= {THIS} THEN sales_amount END), 0) AS BIGINT) AS this_month, CAST(coalesce(sum(CASE WHEN sale_date >= {LAST} AND sale_date < {THIS} THEN sales_amount END), 0) AS BIGINT) AS last_month"


def pct(now: str, before: str) -> str:
    x = f"(({now} - {before}) * CAST(100 AS DOUBLE) / {before})"
    return f"CASE WHEN {before} > 0 THEN sign({x}) * floor(abs({x}) * 10 + {HALF}) / CAST(10 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"


def query(name: str, sql: str | None, *views: str):
    """Register a function of (spark, sf_dir); ``sql`` may use the views named."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            head = ", ".join(_VIEWS[v] for v in views)
            ORACLE_SQL[name] = (f"WITH {head}, " if sql.startswith("+") else f"WITH {head} ") * bool(head) + sql.removeprefix("+")
        return f

    return put


def on_sales(name: str, sql: str | None, f, *more: str):
    """``f`` takes the sales, and the titles where ``more`` names them."""
    return query(name, sql, "sales", *more)(lambda s, d: f(V.daily_sales(s, d), *([V.titles(s, d)] if "titles" in more else [])))


def on_ledger(name: str, sql: str | None, f):
    return query(name, sql, "ledger")(lambda s, d: f(V.ledger(s, d)))


# ---------------------------------------------------------------- A: the core analytics
on_sales("a01_dashboard_kpis", f"SELECT *, {pct('this_month', 'last_month')} AS mom_pct FROM (SELECT {TOTAL}, {NOW_LAST}, count(DISTINCT title_jp) AS titles, count(DISTINCT channel) AS channels FROM sales)", lambda s: A.dashboard_kpis(s, AS_OF))
on_sales("a02_monthly_trend", f"SELECT strftime(sale_date, '%Y-%m') AS month, {TOTAL} FROM sales GROUP BY 1", A.monthly_trend)
on_sales("a03_platform_summary", f"SELECT channel, {GROUP} FROM sales GROUP BY 1", lambda s: A.by_group(s, "channel"))
_TOP = "SELECT t.title_jp, total_sales, channels, days, title_kr FROM (SELECT title_jp, CAST(sum(sales_amount) AS BIGINT) AS total_sales, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels, count(DISTINCT sale_date) AS days FROM sales {} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) t LEFT JOIN titles k ON t.title_jp = k.title_jp"
on_sales("a04_top_titles", _TOP.format(""), lambda s, t: A.top_titles(s, t), "titles")
on_sales("a04_top_titles_month", _TOP.format("WHERE strftime(sale_date, '%Y-%m') = '1997-05'"), lambda s, t: A.top_titles(s, t, month="1997-05"), "titles")
_DETAIL = f"""SELECT 'summary' AS section, channel AS name, {TOTAL} FROM sales WHERE channel = '{CH}' {{0}} GROUP BY 2
 UNION ALL SELECT 'monthly', strftime(sale_date, '%Y-%m'), CAST(sum(sales_amount) AS BIGINT) FROM sales WHERE channel = '{CH}' {{0}} GROUP BY 2
 UNION ALL SELECT * FROM (SELECT 'titles', title_jp, CAST(sum(sales_amount) AS BIGINT) FROM sales WHERE channel = '{CH}' {{0}} GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 20)"""
_PARTS = {"summary": "channel", "monthly": "month", "titles": "title_jp"}
on_sales("a05_platform_detail", _DETAIL.format(""), lambda s: A.flat(A.platform_detail(s, CH), _PARTS))
on_sales("a05b_platform_detail_range", _DETAIL.format(f"AND {IN_YEAR}"), lambda s: A.flat(A.platform_detail(s, CH, *YEAR), _PARTS))
on_sales("a06_title_detail", f"""SELECT 'summary' AS section, title_jp AS name, {TOTAL} FROM sales WHERE title_jp = '{TITLE}' GROUP BY 2
 UNION ALL SELECT 'monthly', strftime(sale_date, '%Y-%m'), CAST(sum(sales_amount) AS BIGINT) FROM sales WHERE title_jp = '{TITLE}' GROUP BY 2
 UNION ALL SELECT 'platforms', channel, CAST(sum(sales_amount) AS BIGINT) FROM sales WHERE title_jp = '{TITLE}' GROUP BY 2
 UNION ALL SELECT 'daily', CAST(sale_date AS VARCHAR), CAST(sum(sales_amount) AS BIGINT) FROM sales WHERE title_jp = '{TITLE}' AND sale_date >= DATE '{AS_OF}' - 90 GROUP BY 2""", lambda s: A.flat(A.title_detail(s, TITLE, AS_OF), {"summary": "title_jp", "monthly": "month", "platforms": "channel", "daily": "sale_date"}))
_GROWTH = f"SELECT title_jp, {NOW_LAST} FROM sales GROUP BY 1 HAVING coalesce(sum(CASE WHEN sale_date >= {LAST} AND sale_date < {THIS} THEN sales_amount END), 0) > 0"
on_sales("a07_growth_alerts", f"SELECT *, {pct('this_month', 'last_month')} AS growth_pct FROM ({_GROWTH}) ORDER BY growth_pct, title_jp LIMIT 30", lambda s: A.growth_alerts(s, AS_OF))
for _id, _dim in (("a08_genre_summary", "genre"), ("a09_company_summary", "company"), ("a10_format_summary", "content_format")):
    on_sales(_id, f"SELECT {_dim}, {GROUP} FROM sales JOIN titles USING (title_jp) WHERE {_dim} IS NOT NULL AND {IN_YEAR} GROUP BY 1", lambda s, t, dim=_dim: A.dimension_summary(s, t, dim, *YEAR), "titles")
on_sales("a11_daily_trend", f"SELECT sale_date, {TOTAL} FROM sales WHERE {IN_YEAR} GROUP BY 1", lambda s: A.daily_trend(s, *YEAR))
on_sales("a12_weekly_trend", f"SELECT CAST(date_trunc('week', sale_date) AS DATE) AS week, {TOTAL} FROM sales WHERE {IN_YEAR} GROUP BY 1", lambda s: A.weekly_trend(s, *YEAR))
on_sales("a13_platform_genre_matrix", f"SELECT channel, coalesce(genre, '{A.UNCLASSIFIED}') AS genre, {TOTAL} FROM sales LEFT JOIN titles USING (title_jp) GROUP BY 1, 2", lambda s, t: A.platform_genre_matrix(s, t), "titles")
on_sales("a14_period_kpis", f"SELECT CAST(coalesce(sum(sales_amount), 0) AS BIGINT) AS total_sales, count(DISTINCT title_jp) AS titles, count(DISTINCT channel) AS channels FROM sales WHERE {IN_YEAR}", lambda s: A.period_kpis(s, *YEAR))
_IN_PREV = f"sale_date BETWEEN DATE '{PREV[0]}' AND DATE '{PREV[1]}'"
on_sales("a15_title_rankings", f"""+now AS (SELECT title_jp, {TOTAL}, row_number() OVER (ORDER BY sum(sales_amount) DESC, title_jp) AS rk FROM sales WHERE {IN_YEAR} GROUP BY 1),
 prev AS (SELECT title_jp, row_number() OVER (ORDER BY sum(sales_amount) DESC, title_jp) AS prev_rk FROM sales WHERE {_IN_PREV} GROUP BY 1)
 SELECT title_jp, total_sales, CAST(rk AS INTEGER) AS rk, CAST(prev_rk AS INTEGER) AS prev_rk, CAST(coalesce(prev_rk, 51) - rk AS INTEGER) AS rank_change FROM now LEFT JOIN prev USING (title_jp) WHERE rk <= 50""", lambda s: A.title_rankings(s, YEAR, PREV))
on_sales("a16_platform_health", f"SELECT strftime(sale_date, '%Y-%m') AS month, {GROUP} FROM sales WHERE channel = '{CH}' AND sale_date >= DATE '1998-01-01' GROUP BY 1", lambda s: A.platform_health(s, CH, AS_OF))
_DEDUP = "SELECT title_jp, channel, sale_date, max(sales_amount) AS sales_amount, max(sales_amount_gross) AS sales_amount_gross, bool_or(is_preliminary) AS is_preliminary FROM sales GROUP BY 1, 2, 3"
on_sales("a17_daily_sales_deduped", _DEDUP, A.deduped)
on_sales("a18_title_sales", f"SELECT title_jp, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels, {TOTAL}, count(DISTINCT sale_date) AS days, min(sale_date) AS first_date, max(sale_date) AS last_date FROM ({_DEDUP}) GROUP BY 1", A.title_sales)
_BATCH = f"count(*) AS row_count, CAST(sum(gross) AS BIGINT) AS gross, CAST(sum(CAST(floor(gross * rate + {HALF}) AS BIGINT)) AS BIGINT) AS income, CAST(coalesce(sum(fee), 0) AS BIGINT) AS fee"
on_ledger("a19_monthly_summary", f"SELECT batch, {_BATCH} FROM ledger GROUP BY 1", lambda r: L.batch_summary(r, "batch"))
on_ledger("a20_monthly_summary_by_client", f"SELECT batch, client_id, {_BATCH} FROM ledger GROUP BY 1, 2", lambda r: L.batch_summary(r, "batch", "client_id"))
query("a21_public_titles", "SELECT title_jp, base_title, genre, content_format FROM titles WHERE episodes > 5", "titles")(lambda s, d: V.titles(s, d).where("episodes > 5").select("title_jp", "base_title", "genre", "content_format"))

# ---------------------------------------------------------------- B: what the application computes
on_sales("b01_platform_summary_period", f"SELECT channel, {GROUP} FROM sales WHERE {IN_YEAR} GROUP BY 1", lambda s: A.by_group(A.between(s, *YEAR), "channel"))
on_sales("b02_platform_genre_classified", f"SELECT channel, genre, {TOTAL} FROM sales JOIN titles USING (title_jp) WHERE genre IS NOT NULL AND {IN_YEAR} GROUP BY 1, 2", lambda s, t: A.platform_genre_matrix(s, t, *YEAR, keep_unclassified=False), "titles")
on_sales("b03_platform_health_with_data", f"SELECT strftime(sale_date, '%Y-%m') AS month, {TOTAL}, count(DISTINCT title_jp) AS title_count, count(DISTINCT sale_date) AS days_with_sales FROM sales WHERE channel = '{CH}' GROUP BY 1 ORDER BY 1 DESC LIMIT 6", lambda s: A.platform_health_with_data(s, CH))
on_sales("b04_growth_alerts_rounded", f"SELECT *, floor((this_month - last_month) * CAST(1000 AS DOUBLE) / last_month + {HALF}) / CAST(10 AS DOUBLE) AS growth_pct FROM ({_GROWTH}) ORDER BY growth_pct, title_jp LIMIT 30", lambda s: A.growth_alerts(s, AS_OF, js_rounding=True))
on_sales("b05_title_summaries_range", f"SELECT title_jp, base_title, total_sales, channels, days, first_date FROM (SELECT title_jp, {TOTAL}, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels, count(DISTINCT sale_date) AS days, min(sale_date) AS first_date FROM sales WHERE {IN_YEAR} GROUP BY 1) JOIN titles USING (title_jp)", lambda s, t: A.between(s, *YEAR).groupBy("title_jp").agg(A.total(), F.concat_ws(",", F.array_sort(F.collect_set("channel"))).alias("channels"), F.countDistinct("sale_date").alias("days"), F.min("sale_date").alias("first_date")).join(t.select("title_jp", "base_title"), "title_jp"), "titles")
on_sales("b06_title_daily_sales", f"SELECT sale_date, {TOTAL} FROM sales WHERE title_jp = '{TITLE}' GROUP BY 1", lambda s: s.where(F.col("title_jp") == TITLE).groupBy("sale_date").agg(A.total()))
_ROW = "title_jp, channel, sale_date, sales_amount, upload_id, line"
on_sales("b07_paginated_sales", f"SELECT {_ROW} FROM sales WHERE channel = '{CH}' AND title_jp ILIKE '%t1%' AND {IN_YEAR} ORDER BY sales_amount DESC, upload_id, line, title_jp LIMIT 50 OFFSET 50", lambda s: A.between(s.where((F.col("channel") == CH) & F.col("title_jp").ilike(T.like_escaped("t1"))), *YEAR).orderBy(F.desc("sales_amount"), "upload_id", "line", "title_jp").offset(50).limit(50).select(*_ROW.split(", ")))
on_sales("b08_all_sales", f"SELECT {_ROW} FROM sales ORDER BY sale_date DESC, upload_id, line, title_jp, channel, sales_amount LIMIT 200000", lambda s: s.orderBy(F.desc("sale_date"), "upload_id", "line", "title_jp", "channel", "sales_amount").limit(200_000).select(*_ROW.split(", ")))
on_sales("b09_active_channels", "SELECT channel, count(*) AS row_count FROM sales GROUP BY 1", lambda s: s.groupBy("channel").agg(F.count("*").alias("row_count")))
query("b11_client_month_summary", f"SELECT client_id, c_name, {_BATCH} FROM ledger LEFT JOIN customer ON client_id = c_custkey WHERE batch = '1997-05' GROUP BY 1, 2", "ledger")(lambda s, d: L.batch_summary(V.ledger(s, d).where("batch = '1997-05'"), "client_id").join(V.table(s, d, "customer").select(F.col("c_custkey").alias("client_id"), "c_name"), "client_id", "left"))
on_ledger("b12_settlement_records", "SELECT upload_id, line, client_id, channel, title_jp, gross FROM ledger WHERE batch = '1997-05' AND channel = 'NATION_3' ORDER BY gross DESC NULLS LAST, upload_id, line, title_jp LIMIT 500", lambda r: r.where("batch = '1997-05' and channel = 'NATION_3'").orderBy(F.desc_nulls_last("gross"), "upload_id", "line", "title_jp").limit(500).select("upload_id", "line", "client_id", "channel", "title_jp", "gross"))
on_ledger("b13_settlement_months", "SELECT batch, count(*) AS row_count, CAST(sum(gross) AS BIGINT) AS gross FROM ledger GROUP BY 1", lambda r: r.groupBy("batch").agg(F.count("*").alias("row_count"), F.sum("gross").alias("gross")))
on_ledger("b14_month_platforms", "SELECT batch, string_agg(DISTINCT coalesce(channel, 'unknown'), ',' ORDER BY coalesce(channel, 'unknown')) AS platforms FROM ledger GROUP BY 1", lambda r: r.groupBy("batch").agg(F.concat_ws(",", F.array_sort(F.collect_set(F.coalesce("channel", F.lit("unknown"))))).alias("platforms")))
_STATS = ("genre", "company", "content_format", "base_title")
query("b15_content_master_stats", " UNION ALL ".join(f"SELECT '{c}' AS dim, coalesce({c}, '(미지정)') AS value, count(*) AS n FROM titles GROUP BY 2" for c in _STATS), "titles")(lambda s, d: V.titles(s, d).select(F.explode(F.array(*(F.struct(F.lit(c).alias("dim"), F.coalesce(c, F.lit("(미지정)")).alias("value")) for c in _STATS))).alias("x")).groupBy("x.dim", "x.value").agg(F.count("*").alias("n")))
query("b16_content_master_search", "SELECT title_jp, base_title, genre FROM titles WHERE content_format = 'NOVEL' AND contains(lower(base_title), 'ring') ORDER BY title_jp LIMIT 5000", "titles")(lambda s, d: V.titles(s, d).where((F.col("content_format") == "NOVEL") & F.lower("base_title").contains("ring")).orderBy("title_jp").limit(5000).select("title_jp", "base_title", "genre"))
query(
    "b17_company_title_counts",
    "SELECT company, count(*) AS titles, count(*) FILTER (episodes > 45) AS long_titles FROM titles GROUP BY 1",
    "titles",
)(lambda s, d: V.titles(s, d).groupBy("company").agg(F.count("title_jp").alias("titles"), F.count_if(F.col("episodes") > 45).alias("long_titles")))
query("b18_title_search", "SELECT title_jp, title_kr, base_title FROM titles WHERE (title_kr ILIKE '%blue%' OR base_title ILIKE '%bolt%') AND genre = 'SMALL' ORDER BY title_jp LIMIT 100", "titles")(lambda s, d: V.titles(s, d).where((F.col("title_kr").ilike("%blue%") | F.col("base_title").ilike("%bolt%")) & (F.col("genre") == "SMALL")).orderBy("title_jp").limit(100).select("title_jp", "title_kr", "base_title"))
on_sales("b21_range_with_mom", f"SELECT *, {pct('total_sales', 'previous')} AS mom_pct FROM (SELECT CAST(coalesce(sum(CASE WHEN {IN_YEAR} THEN sales_amount END), 0) AS BIGINT) AS total_sales, CAST(coalesce(sum(CASE WHEN sale_date >= DATE '1996-12-01' AND sale_date < DATE '1997-01-01' THEN sales_amount END), 0) AS BIGINT) AS previous, count(DISTINCT CASE WHEN {IN_YEAR} THEN title_jp END) AS titles FROM sales)", lambda s: A.range_with_mom(s, *YEAR))
on_sales("b22_platform_rank_change", f"""+now AS (SELECT channel, {TOTAL}, row_number() OVER (ORDER BY sum(sales_amount) DESC, channel) AS rk FROM sales WHERE {IN_YEAR} GROUP BY 1),
 prev AS (SELECT channel, row_number() OVER (ORDER BY sum(sales_amount) DESC, channel) AS prev_rk FROM sales WHERE sale_date < DATE '1997-01-01' AND sale_date >= DATE '1997-01-01' - 365 GROUP BY 1)
 SELECT channel, total_sales, CAST(rk AS INTEGER) AS rk, CAST(coalesce(prev_rk, rk) - rk AS INTEGER) AS rank_change FROM now LEFT JOIN prev USING (channel)""", lambda s: A.platform_rank_change(s, *YEAR))
_CHS = ["NATION_1", "NATION_2", "NATION_3"]
on_sales("b23_platform_compare_pivot", "SELECT strftime(sale_date, '%Y-%m') AS month, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN channel = '{c}' THEN sales_amount END), 0) AS BIGINT) AS \"{c}\"" for c in _CHS) + " FROM sales WHERE channel IN ('NATION_1', 'NATION_2', 'NATION_3') GROUP BY 1", lambda s: A.month_pivot(s, "channel", _CHS))
on_sales("b24_base_title_grouping", f"SELECT base_title, count(DISTINCT title_jp) AS products, {TOTAL}, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels FROM sales JOIN titles USING (title_jp) GROUP BY 1", lambda s, t: A.base_title_groups(s, t), "titles")
query("b25_group_filters", "SELECT base_title, count(*) AS products FROM titles GROUP BY 1 HAVING bool_or(genre IS NULL) AND bool_or(company = 'Brand#4')", "titles")(lambda s, d: V.titles(s, d).groupBy("base_title").agg(F.count("*").alias("products"), F.bool_or(F.col("genre").isNull()).alias("a"), F.bool_or(F.col("company") == "Brand#4").alias("b")).where("a and b").drop("a", "b"))
on_sales("b26_sales_percentile", "+r AS (SELECT title_jp, row_number() OVER (ORDER BY sum(sales_amount) DESC, title_jp) AS rk, count(*) OVER () AS n FROM sales GROUP BY 1) SELECT title_jp, CAST(rk AS INTEGER) AS rk, CASE WHEN rk <= ceil(n * CAST(0.1 AS DOUBLE)) THEN 'top10' WHEN rk <= ceil(n * CAST(0.5 AS DOUBLE)) THEN 'top50' ELSE 'bottom50' END AS band FROM r", A.percentile_bands)
on_sales("b27_multi_key_sort", "SELECT title_jp, channel, total_sales FROM (SELECT title_jp, channel, CAST(sum(sales_amount) AS BIGINT) AS total_sales FROM sales GROUP BY 1, 2) ORDER BY total_sales DESC, channel, title_jp LIMIT 100", lambda s: s.groupBy("title_jp", "channel").agg(A.total()).orderBy(F.desc("total_sales"), "channel", "title_jp").limit(100))
_FORMATS = ["WEBTOON", "PAGETOON", "NOVEL"]
on_sales("b29_product_trend_pivot", "SELECT strftime(sale_date, '%Y-%m') AS month, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN content_format = '{c}' THEN sales_amount END), 0) AS BIGINT) AS \"{c}\"" for c in _FORMATS) + ", CAST(sum(sales_amount) AS BIGINT) AS total FROM sales JOIN titles USING (title_jp) GROUP BY 1", lambda s, t: A.month_pivot(s.join(t.select("title_jp", "content_format"), "title_jp"), "content_format", _FORMATS).withColumn("total", F.col("WEBTOON") + F.col("PAGETOON") + F.col("NOVEL")), "titles")
on_sales("b30_peaks", "+d AS (SELECT title_jp, sale_date, sum(sales_amount) AS t FROM sales GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY title_jp ORDER BY t DESC, sale_date) AS n, min(sale_date) OVER (PARTITION BY title_jp) AS first_date FROM d) SELECT title_jp, sale_date AS peak_day, CAST(t AS BIGINT) AS peak_sales, first_date FROM r WHERE n = 1", A.peaks)
on_sales("b31_per_episode_sales", f"SELECT title_jp, CASE WHEN episodes <> 0 THEN CAST(floor(t / CAST(episodes AS DOUBLE) + {HALF}) AS BIGINT) END AS per_episode FROM (SELECT title_jp, sum(sales_amount) AS t FROM sales GROUP BY 1) JOIN titles USING (title_jp)", lambda s, t: A.per_episode(s, t), "titles")
on_sales("b32_pareto", f"+r AS (SELECT channel, CAST(sum(sales_amount) AS BIGINT) AS total_sales FROM sales GROUP BY 1), w AS (SELECT channel, total_sales, sum(total_sales) OVER (ORDER BY total_sales DESC, channel ROWS UNBOUNDED PRECEDING) AS run, sum(total_sales) OVER () AS al FROM r) SELECT channel, total_sales, CAST(floor(run * CAST(100 AS DOUBLE) / al + {HALF}) AS BIGINT) AS cumulative_pct FROM w ORDER BY total_sales DESC, channel LIMIT 20", lambda s: A.pareto(s, "channel"))
on_sales("b33_relative_day_compare", "+d AS (SELECT title_jp, sale_date, sum(sales_amount) AS t, min(sale_date) OVER (PARTITION BY title_jp) AS f FROM sales GROUP BY 1, 2), b AS (SELECT title_jp, (sale_date - f) // 7 + 1 AS bucket, sum(t) AS t FROM d GROUP BY 1, 2), k AS (SELECT DISTINCT title_jp, unnest(range(1, 13)) AS bucket FROM sales) SELECT title_jp, CAST(k.bucket AS INTEGER) AS bucket, CAST(coalesce(t, 0) AS BIGINT) AS total_sales FROM k LEFT JOIN b USING (title_jp, bucket)", A.relative_buckets)
on_sales("b34_launch_curve", "+d AS (SELECT title_jp, sale_date, sum(sales_amount) AS t FROM sales GROUP BY 1, 2), k AS (SELECT title_jp, unnest(range(1, 29)) AS day, f FROM (SELECT title_jp, min(sale_date) AS f FROM sales GROUP BY 1)) SELECT title_jp, CAST(day AS INTEGER) AS day, CAST(coalesce(t, 0) AS BIGINT) AS total_sales, CAST(sum(coalesce(t, 0)) OVER (PARTITION BY title_jp ORDER BY day) AS BIGINT) AS cumulative, CAST((day + 6) // 7 AS INTEGER) AS week FROM k LEFT JOIN d USING (title_jp) WHERE false UNION ALL SELECT k.title_jp, CAST(k.day AS INTEGER), CAST(coalesce(d.t, 0) AS BIGINT), CAST(sum(coalesce(d.t, 0)) OVER (PARTITION BY k.title_jp ORDER BY k.day) AS BIGINT), CAST((k.day + 6) // 7 AS INTEGER) FROM k LEFT JOIN d ON k.title_jp = d.title_jp AND d.sale_date = k.f + CAST(k.day - 1 AS INTEGER)", A.launch_curve)
_AB = f"CAST(coalesce(sum(CASE WHEN {_IN_PREV} THEN sales_amount END), 0) AS BIGINT) AS a, CAST(coalesce(sum(CASE WHEN {IN_YEAR} THEN sales_amount END), 0) AS BIGINT) AS b"
on_sales("b35_period_compare", f"SELECT *, b - a AS diff, {pct('b', 'a')} AS pct FROM (SELECT channel, {_AB} FROM sales GROUP BY 1)", lambda s: A.period_compare(s, PREV, YEAR, "channel"))
on_sales("b36_platform_contribution", f"SELECT *, this_month - last_month AS change FROM (SELECT channel, {NOW_LAST} FROM sales GROUP BY 1)", lambda s: A.contribution(s, AS_OF))
on_sales("b37_platform_share_series", f"SELECT month, channel, total_sales, CAST(floor(total_sales * CAST(100 AS DOUBLE) / sum(total_sales) OVER (PARTITION BY month) + {HALF}) AS BIGINT) AS share_pct FROM (SELECT strftime(sale_date, '%Y-%m') AS month, channel, {TOTAL} FROM sales GROUP BY 1, 2)", A.month_channel_share)
_ROUND = f"sign(v) * floor(abs(v) * 10 + {HALF}) / CAST(10 AS DOUBLE)"


def _leader_sql(rows: str, key: str) -> str:
    return f"SELECT arg_min({key}, r) AS name, max(t) AS first, sum(t) FILTER (r <= 3) AS three, sum(t) AS whole, count(*) AS n FROM (SELECT *, row_number() OVER (ORDER BY t DESC, {key}) AS r FROM (SELECT {key}, sum(sales_amount) AS t FROM {rows} WHERE {key} IS NOT NULL GROUP BY 1))"


def _rule_sql(place: int, source: str, value: str, cases: list[tuple[str, int, str]], subject: str = "NULL") -> str:
    which = lambda k: " ".join(f"WHEN {c} THEN {p if k == 'p' else repr(r)}" for c, p, r in cases)
    return f"SELECT CASE {which('p')} END AS priority, {place} AS place, CASE {which('r')} END AS rule, CAST({subject} AS VARCHAR) AS subject, CAST(v AS DOUBLE) AS v FROM (SELECT *, {value} AS v FROM ({source}))"


_SHARE, _SEVERAL = "first * CAST(100 AS DOUBLE) / whole", "n >= 2 AND whole > 0"
_MOVED = f"SELECT arg_max(title_jp, (g, -place)) AS up, max(g) AS top, arg_min(title_jp, (g, place)) AS down, min(g) AS low, count(*) FILTER (g >= 50) AS n FROM (SELECT title_jp, row_number() OVER (ORDER BY title_jp) AS place, {pct('this_month', 'last_month')} AS g FROM (SELECT title_jp, {NOW_LAST} FROM bounded GROUP BY 1) WHERE last_month > 0)"
_RULES = " UNION ALL ".join(
    (
        _rule_sql(1, f"SELECT {NOW_LAST} FROM bounded", pct("this_month", "last_month"), [("v <= -20", 1, "sharp_fall"), ("v <= -5", 3, "fall"), ("v >= 20", 2, "sharp_rise"), ("v >= 5", 4, "rise")]),
        _rule_sql(2, _leader_sql("recent", "channel"), _SHARE, [(f"{_SEVERAL} AND v >= 60", 2, "platform_risk"), (f"{_SEVERAL} AND v >= 45", 5, "top_platform")], "name"),
        _rule_sql(3, _MOVED, "top", [("v >= 50", 2, "surging")], "up"),
        _rule_sql(4, _MOVED, "n - 1", [("n >= 3", 6, "more_surging")]),
        _rule_sql(5, _MOVED, "low", [("v <= -30", 1, "declining")], "down"),
        _rule_sql(6, _leader_sql("recent", "title_jp"), "three * CAST(100 AS DOUBLE) / whole", [("n >= 5 AND whole > 0 AND v >= 50", 3, "top_titles")]),
        _rule_sql(7, _leader_sql("(SELECT * FROM recent JOIN titles USING (title_jp))", "company"), _SHARE, [(f"{_SEVERAL} AND v >= 50", 4, "top_company")], "name"),
        _rule_sql(8, _leader_sql("(SELECT * FROM recent JOIN titles USING (title_jp))", "genre"), _SHARE, [("n >= 2", 5, "top_genre")], "name"),
        _rule_sql(9, "SELECT sum(t) FILTER (r <= 7) AS a, sum(t) FILTER (r > 7) AS b, count(*) AS days FROM (SELECT sum(sales_amount) AS t, row_number() OVER (ORDER BY sale_date DESC) AS r FROM recent GROUP BY sale_date) WHERE r <= 14", "(a - b) * CAST(100 AS DOUBLE) / nullif(b, 0)", [("days >= 14 AND b > 0 AND v >= 30", 2, "speeding_up"), ("days >= 14 AND b > 0 AND v <= -30", 1, "slowing_down")]),
        _rule_sql(11, "SELECT (SELECT sum(sales_amount) FROM recent) AS a, sum(sales_amount) AS b FROM sales WHERE sale_date >= DATE '1997-06-01' AND sale_date < DATE '1997-08-01'", "(a - b) * CAST(100 AS DOUBLE) / nullif(b, 0)", [("v <= -15", 2, "year_fall"), ("v >= 15", 4, "year_rise")]),
    )
)
on_sales("b38_insights", f"+bounded AS (SELECT * FROM sales WHERE sale_date < DATE '1998-08-01'), recent AS (SELECT * FROM bounded WHERE sale_date >= {LAST}) SELECT priority, place, rule, subject, {_ROUND} AS value FROM ({_RULES}) WHERE priority IS NOT NULL ORDER BY priority, place LIMIT 8", lambda s, t: A.insights(s, t, AS_OF), "titles")
on_sales("b39_surging_declining", f"SELECT *, CASE WHEN growth_pct >= 50 THEN 'surging' ELSE 'declining' END AS kind FROM (SELECT *, {pct('this_month', 'last_month')} AS growth_pct FROM ({_GROWTH})) WHERE growth_pct >= 50 OR growth_pct <= -30", lambda s: A.growth_alerts(s, AS_OF, limit=1 << 30).where("growth_pct >= 50 or growth_pct <= -30").withColumn("kind", F.when(F.col("growth_pct") >= 50, "surging").otherwise("declining")))
on_sales("b40_goal_rate", "SELECT t / CAST(1000000000 AS DOUBLE) * 100 AS rate, least(t / CAST(1000000000 AS DOUBLE) * 100, CAST(100 AS DOUBLE)) AS capped FROM (SELECT sum(sales_amount) AS t FROM sales)", lambda s: s.agg((F.sum("sales_amount") / F.lit(1e9) * 100).alias("rate")).withColumn("capped", F.least("rate", F.lit(100.0))))
on_sales("b42_currency_display", f"SELECT channel, CAST(floor(sum(sales_amount) * CAST(9.2 AS DOUBLE) + {HALF}) AS BIGINT) AS krw FROM sales GROUP BY 1", lambda s: s.groupBy("channel").agg(money.half_up(F.sum("sales_amount") * V.KRW_PER_JPY).alias("krw")))
on_sales("b43_report_filter", f"SELECT count(*) AS row_count, {TOTAL}, count(DISTINCT title_jp) AS titles FROM sales WHERE {IN_YEAR} AND channel IN ('NATION_1', 'NATION_2')", lambda s: A.between(s, *YEAR).where(F.col("channel").isin("NATION_1", "NATION_2")).agg(F.count("*").alias("row_count"), A.total(), F.countDistinct("title_jp").alias("titles")))
on_sales("b44_new_title_detection", "SELECT DISTINCT s.title_jp FROM sales s WHERE NOT EXISTS (SELECT 1 FROM titles t WHERE t.title_jp = s.title_jp AND t.genre IS NOT NULL)", lambda s, t: L.unseen_titles(s, t.where("genre is not null")), "titles")
on_sales("b45_upload_validation", "+m AS (SELECT avg(sales_amount) AS mean FROM sales) SELECT count(*) FILTER (channel IN ('NATION_1', 'NATION_2')) AS unknown_channel, count(*) FILTER (sales_amount < 0) AS negative, count(*) FILTER (sales_amount > 10 * mean) AS outlier, count(*) FILTER (sale_date IS NULL) AS bad_date FROM sales, m", lambda s: A.upload_checks(s, s.where("channel not in ('NATION_1', 'NATION_2')").select("channel")))
on_sales("b46_channel_audit", "SELECT channel, count(DISTINCT title_jp) AS titles FROM sales GROUP BY 1", lambda s: s.groupBy("channel").agg(F.countDistinct("title_jp").alias("titles")))
on_sales("b49_is_new_title", f"SELECT title_jp, coalesce(coalesce(launch_date, f) >= DATE '1998-04-01', false) AS is_new FROM titles LEFT JOIN (SELECT title_jp, min(sale_date) AS f FROM sales GROUP BY 1) USING (title_jp)", lambda s, t: A.is_new(s, t, AS_OF), "titles")
on_sales("b50_genre_share", "SELECT genre, total_sales, total_sales / CAST(sum(total_sales) OVER () AS DOUBLE) AS share FROM (SELECT genre, CAST(sum(sales_amount) AS BIGINT) AS total_sales FROM sales JOIN titles USING (title_jp) GROUP BY 1)", lambda s, t: A.share_of_all(s.join(t.select("title_jp", "genre"), "title_jp"), "genre"), "titles")
on_ledger("b51_upload_result_totals", "SELECT count(*) FILTER (status = 'F') AS failed, count(*) FILTER (status <> 'F') AS successful, CAST(sum(CASE WHEN status <> 'F' THEN gross ELSE 0 END) AS BIGINT) AS written FROM ledger", lambda r: r.agg(F.count_if(F.col("status") == "F").alias("failed"), F.count_if(F.col("status") != "F").alias("successful"), F.sum(F.when(F.col("status") != "F", F.col("gross")).otherwise(0)).alias("written")))
on_sales("b52_confirmable_selection", "SELECT upload_id, line, title_jp, channel FROM sales WHERE data_source = 'sokuhochi' AND upload_id % 10 = 3", lambda s: s.where("data_source = 'sokuhochi' and upload_id % 10 = 3").select("upload_id", "line", "title_jp", "channel"))

# ---------------------------------------------------------------- E: the ledger
_KEYS = ["client_id", "channel", "title_jp"]
_ORDER = ["upload_id", "line", "gross"]
on_ledger("e02_settle", f"+x AS (SELECT upload_id, line, title_jp, gross, CAST(floor(gross / (1 + CAST(0.1 AS DOUBLE)) + {HALF}) AS BIGINT) AS after_tax, CAST(floor(gross * rate + {HALF}) AS BIGINT) AS income FROM ledger) SELECT *, CAST(floor(income * CAST(0.1 AS DOUBLE)) AS BIGINT) AS consumption_tax, CAST(floor(income * CAST(9.2 AS DOUBLE) + {HALF}) AS BIGINT) AS income_krw FROM x", lambda r: L.settle(r).select("upload_id", "line", "title_jp", "gross", "after_tax", "income", "consumption_tax", "income_krw"))
on_ledger("e02_draw_down", "+x AS (SELECT upload_id, line, title_jp, gross AS income, 100000 AS balance FROM ledger), y AS (SELECT *, greatest(balance - coalesce(sum(income) OVER (PARTITION BY title_jp ORDER BY upload_id, line, income ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS b FROM x) SELECT upload_id, line, title_jp, income, CAST(b AS BIGINT) AS \"begin\", CAST(least(b, income) AS BIGINT) AS decrease FROM y", lambda r: L.draw_down(r.select("upload_id", "line", "title_jp", F.col("gross").alias("income")), r.select("title_jp").distinct().withColumn("balance", F.lit(100_000).cast("long")), ["upload_id", "line", "income"]).select("upload_id", "line", "title_jp", "income", "begin", "decrease"))
on_ledger("e05_suppress_existing", "+i AS (SELECT *, row_number() OVER (PARTITION BY client_id, channel ORDER BY upload_id, line, gross, title_jp) AS n FROM ledger), h AS (SELECT client_id, channel, count(*) AS k FROM ledger WHERE batch = '1997-12' GROUP BY 1, 2) SELECT upload_id, line, i.client_id, i.channel, title_jp, gross FROM i LEFT JOIN h ON i.client_id = h.client_id AND i.channel = h.channel WHERE n > coalesce(k, 0)", lambda r: L.suppress_existing(r, r.where("batch = '1997-12'"), ["client_id", "channel"], [*_ORDER, "title_jp"]).select("upload_id", "line", "client_id", "channel", "title_jp", "gross"))
on_ledger("e08_largest_upload", "+c AS (SELECT client_id, channel, upload_id, count(*) AS n FROM ledger GROUP BY 1, 2, 3), b AS (SELECT client_id, channel, upload_id FROM (SELECT *, row_number() OVER (PARTITION BY client_id, channel ORDER BY n DESC, upload_id) AS r FROM c) WHERE r = 1) SELECT l.upload_id, line, l.client_id, l.channel, title_jp, gross FROM ledger l JOIN b ON l.client_id = b.client_id AND l.channel = b.channel AND l.upload_id = b.upload_id", lambda r: L.largest_upload(r, ["client_id", "channel"]).select("upload_id", "line", "client_id", "channel", "title_jp", "gross"))
on_ledger("e09_exact_source_gate", "SELECT DISTINCT upload_id, batch FROM ledger l WHERE EXISTS (SELECT 1 FROM ledger k WHERE k.batch = l.batch AND k.title_jp = l.title_jp AND k.status = 'F' AND k.upload_id <> l.upload_id)", lambda r: r.alias("l").join(r.where("status = 'F'").select("batch", "title_jp", "upload_id").alias("k"), (F.col("k.batch") == F.col("l.batch")) & (F.col("k.title_jp") == F.col("l.title_jp")) & (F.col("k.upload_id") != F.col("l.upload_id")), "left_semi").select("upload_id", "batch").distinct())
on_ledger("e12_latest_roster", "+r AS (SELECT *, rank() OVER (PARTITION BY client_id, channel ORDER BY batch DESC) AS k FROM ledger WHERE batch < '1998-07') SELECT upload_id, line, client_id, channel, title_jp, batch FROM r WHERE k = 1", lambda r: L.latest_roster(r, ["client_id", "channel"], "batch", "1998-07").select("upload_id", "line", "client_id", "channel", "title_jp", "batch"))
_CARRY = "row_number() OVER (PARTITION BY client_id, channel ORDER BY upload_id, line, gross, title_jp) AS n"
on_ledger("e14_carry_forward", f"+b AS (SELECT *, {_CARRY} FROM ledger WHERE batch = '1998-05'), c AS (SELECT *, {_CARRY} FROM ledger WHERE batch = '1998-06') SELECT coalesce(b.client_id, c.client_id) AS client_id, coalesce(b.channel, c.channel) AS channel, CAST(coalesce(b.n, c.n) AS INTEGER) AS place, CASE WHEN b.n IS NOT NULL AND c.n IS NOT NULL THEN 'overlay' WHEN b.n IS NOT NULL THEN 'carry' ELSE 'append' END AS action, coalesce(b.type, c.type) AS type, coalesce(b.title_jp, c.title_jp) AS title_jp, c.gross, c.fee FROM b FULL JOIN c ON b.client_id = c.client_id AND b.channel = c.channel AND b.n = c.n", lambda r: L.carry_forward(r.where("batch = '1998-05'"), r.where("batch = '1998-06'"), ["client_id", "channel"], [*_ORDER, "title_jp"], ["type", "title_jp"], ["gross", "fee"]))
on_ledger("e16_modal_attribute", "+c AS (SELECT channel, type, count(*) AS n, min(upload_id) AS seen FROM ledger GROUP BY 1, 2) SELECT channel, type FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY n DESC, seen, type) AS r FROM c) WHERE r = 1", lambda r: L.month_roster_modes(r, "channel", "type", "upload_id"))
on_ledger("e17_duplicate_audit", "+g AS (SELECT channel, client_id, title_jp, count(*) AS n, count(DISTINCT upload_id) AS u FROM ledger GROUP BY 1, 2, 3) SELECT channel, CAST(sum(n) AS BIGINT) AS row_count, count(*) AS key_groups, count(*) FILTER (n > 1) AS dup_groups, count(*) FILTER (u > 1) AS cross_upload_groups FROM g GROUP BY 1", lambda r: L.duplicate_audit(r, "channel", _KEYS))
on_ledger("e03_effective_rate", "+q AS (SELECT client_id, CAST(0 AS INTEGER) AS rule_id, '1995-01' AS effective_from, CAST(NULL AS VARCHAR) AS effective_to, 10 AS priority, CAST(0.5 AS DOUBLE) AS rule_rate FROM (SELECT DISTINCT client_id FROM ledger) UNION ALL SELECT client_id, 1, '1997-01', '1997-12', 1, CAST(0.6 AS DOUBLE) FROM (SELECT DISTINCT client_id FROM ledger) WHERE client_id % 2 = 0), m AS (SELECT upload_id, line, title_jp, l.client_id, rule_id, rule_rate, row_number() OVER (PARTITION BY upload_id, line, title_jp ORDER BY priority, effective_from DESC, rule_id) AS n FROM (SELECT DISTINCT upload_id, line, title_jp, client_id, batch FROM ledger) l JOIN q ON l.client_id = q.client_id AND l.batch >= q.effective_from AND (q.effective_to IS NULL OR l.batch <= q.effective_to)) SELECT client_id, rule_rate, count(*) AS n_rows FROM (SELECT * FROM m WHERE n = 1) GROUP BY 1, 2", lambda r: L.rate_for(r.select("upload_id", "line", "title_jp", "client_id", "batch"), r.select("client_id").distinct().withColumns({"rule_id": F.lit(0), "effective_from": F.lit("1995-01"), "effective_to": F.lit(None).cast("string"), "priority": F.lit(10), "rule_rate": F.lit(0.5)}).union(r.where("client_id % 2 = 0").select("client_id").distinct().withColumns({"rule_id": F.lit(1), "effective_from": F.lit("1997-01"), "effective_to": F.lit("1997-12"), "priority": F.lit(1), "rule_rate": F.lit(0.6)}))).withColumn("_n", F.row_number().over(Window.partitionBy("upload_id", "line", "title_jp").orderBy("priority", F.desc("effective_from"), "rule_id"))).where("_n = 1").groupBy("client_id", "rule_rate").agg(F.count("*").alias("n_rows")))
def _as_key(rows: DataFrame) -> DataFrame:
    """The ledger as another hand might keep it: failed rows one higher, urgent ones without a fee, low ones a month later."""
    late = F.date_format(F.add_months(F.to_date(F.concat("batch", F.lit("-01"))), 1), "yyyy-MM")
    low, urgent = F.col("type") == "5-LOW", F.col("type") == "1-URGENT"
    return rows.withColumns({"gross": F.when(F.col("status") == "F", F.col("gross") + 1).otherwise(F.col("gross")), "fee": F.when(~urgent, F.col("fee")), "batch": F.when(low, late).otherwise(F.col("batch"))})


on_ledger("e18_compare_sheets", None, lambda r: L.compare_sheets(r, _as_key(r), ["client_id", "channel", "batch"], ["title_jp", "gross", "fee"]))

# ---------------------------------------------------------------- K: what is stored
_FOLD = "SELECT title_jp, channel, sale_date, CAST(sum(sales_amount) AS BIGINT) AS sales_amount, CAST(sum(sales_amount_gross) AS BIGINT) AS sales_amount_gross FROM sales {} GROUP BY 1, 2, 3"
on_sales("k01_upsert", "+o AS (" + _FOLD.format("WHERE data_source = 'weekly_report'") + "), n AS (" + _FOLD.format("WHERE data_source = 'manual'") + ") SELECT coalesce(o.title_jp, n.title_jp) AS title_jp, coalesce(o.channel, n.channel) AS channel, coalesce(o.sale_date, n.sale_date) AS sale_date, coalesce(n.sales_amount, o.sales_amount) AS sales_amount, coalesce(n.sales_amount_gross, o.sales_amount_gross) AS sales_amount_gross, CASE WHEN n.sales_amount IS NOT NULL AND o.sales_amount IS NOT NULL THEN 'updated' WHEN n.sales_amount IS NOT NULL THEN 'inserted' ELSE 'kept' END AS action FROM o FULL JOIN n ON o.title_jp = n.title_jp AND o.channel = n.channel AND o.sale_date = n.sale_date", lambda s: L.upsert(L.fold_batch(s.where("data_source = 'weekly_report'")), L.fold_batch(s.where("data_source = 'manual'")), ["title_jp", "channel", "sale_date"], ["sales_amount"], ["sales_amount_gross"]))
on_sales("k02_fold_batch", _FOLD.format(""), L.fold_batch)
_SRC = "title_jp, channel, sale_date, sales_amount, data_source, upload_id, line"
on_sales("k03_source_precedence", f"+w AS (SELECT * FROM sales WHERE data_source = 'weekly_report' AND {IN_YEAR}) SELECT {_SRC} FROM sales WHERE data_source = 'manual' AND (sale_date < (SELECT min(sale_date) FROM w) OR sale_date > (SELECT max(sale_date) FROM w)) UNION ALL SELECT {_SRC} FROM w UNION ALL SELECT {_SRC} FROM sales s WHERE data_source = 'sokuhochi' AND NOT EXISTS (SELECT 1 FROM w WHERE w.title_jp = s.title_jp AND w.channel = s.channel AND w.sale_date = s.sale_date)", lambda s: (lambda r: L.source_precedence(r.where("data_source = 'manual'"), A.between(r.where("data_source = 'weekly_report'"), *YEAR), r.where("data_source = 'sokuhochi'")))(s.select(*_SRC.split(", "))))
on_sales("k04_replace_range", f"+i AS (SELECT * FROM sales WHERE data_source = 'manual' AND channel = '{CH}' AND sale_date BETWEEN DATE '1997-03-01' AND DATE '1997-05-31' AND line < 4), x AS (SELECT channel, data_source, min(sale_date) AS lo, max(sale_date) AS hi FROM i GROUP BY 1, 2) SELECT {_SRC} FROM sales s WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.channel = s.channel AND x.data_source = s.data_source AND s.sale_date BETWEEN x.lo AND x.hi) UNION ALL SELECT {_SRC} FROM i", lambda s: (lambda r: L.replace_range(r, A.between(r.where((F.col("data_source") == "manual") & (F.col("channel") == CH) & (F.col("line") < 4)), "1997-03-01", "1997-05-31")))(s.select(*_SRC.split(", "))))
on_sales("k11_delete_by_filter", f"SELECT {_SRC} FROM sales WHERE NOT (channel = '{CH}' AND {IN_YEAR})", lambda s: s.where(~((F.col("channel") == CH) & F.col("sale_date").between(F.lit(YEAR[0]).cast("date"), F.lit(YEAR[1]).cast("date")))).select(*_SRC.split(", ")))
on_sales("k12_confirm_preliminary", "SELECT upload_id, line, title_jp, channel, CASE WHEN upload_id % 10 = 3 THEN false ELSE is_preliminary END AS is_preliminary FROM sales", lambda s: s.select("upload_id", "line", "title_jp", "channel", F.when(F.col("upload_id") % 10 == 3, False).otherwise(F.col("is_preliminary")).alias("is_preliminary")))
query("k13_company_merge", "SELECT title_jp, CASE WHEN company = 'Brand#4' THEN 'Brand#5' ELSE company END AS company FROM titles", "titles")(lambda s, d: V.titles(s, d).select("title_jp", F.when(F.col("company") == "Brand#4", "Brand#5").otherwise(F.col("company")).alias("company")))

# ---------------------------------------------------------------- C: functions
# titles with the marks that shops put on them: every part's name and one of these
_MARKS = ["", "（ノベル）", "(ノベル)", "（版面）", "（LDF）", "[完全版]", "【分冊版】", "【特装版】", "【連載版】", "【完全版】 2巻", "【タテヨミ】", "(巻)", " 改訂版", "　完全版", " 1巻", "～副題～", "（１）", "！Ａ９", "［特装版］", "小説", "【改訂版】(版面)"]
_MARK_LIST = ", ".join(f"'{m}'" for m in _MARKS)
_TITLED = f"titled AS (SELECT p_partkey, p_name || ([{_MARK_LIST}])[1 + p_partkey % {len(_MARKS)}] AS title, CASE WHEN p_size > 25 THEN p_name END AS title_kr FROM part)"
_BARE = "(改訂版|完全版|分冊版|特装版|連載版)"
_BRACKETED = "（(ノベル|版面|LDF|巻)）|\\((ノベル|版面|LDF|巻)\\)|\\[(完全版|分冊版|特装版|連載版|改訂版)\\]|【(分冊版|特装版|連載版|完全版|改訂版|タテヨミ)】"
_BASE_SQL = f"trim(regexp_replace(regexp_replace(regexp_replace(title, '{_BRACKETED}', '', 'g'), '[\\s　]*{_BARE}', '', 'g'), '[\\s　]+', ' ', 'g'))"
_CORE_SQL = "translate(title, 'Ａ９１～！？［］　', 'A91~!?[] ')"
for _pattern in ("~[^~]*~", "【[^】]*】", "\\[[^\\]]*\\]", "（[^）]*）", "\\([^)]*\\)", f"\\s*{_BARE}", "[\\s　]+"):
    _CORE_SQL = f"regexp_replace({_CORE_SQL}, '{_pattern}', '', 'g')"
_KIND_SQL = "CASE WHEN regexp_matches(title, '（ノベル）|\\(ノベル\\)') THEN 'ノベル' WHEN regexp_matches(title, '（版面）|\\(版面\\)') THEN '版面' WHEN regexp_matches(title, '（LDF）|\\(LDF\\)') THEN 'LDF' WHEN title LIKE '%【分冊版】%' THEN '分冊版' WHEN title LIKE '%【特装版】%' THEN '特装版' WHEN title LIKE '%【連載版】%' THEN '連載版' WHEN title LIKE '%[完全版]%' OR title LIKE '%【完全版】%' THEN '完全版' ELSE 'オリジナル' END"
_SUFFIX_SQL = "CASE " + " ".join(f"WHEN title LIKE '%{m}%' THEN '{k}'" for m, k in T.KR_SUFFIXES) + " ELSE '' END"


def titled(s: SparkSession, d: str) -> DataFrame:
    mark = F.get(F.array(*map(F.lit, _MARKS)), (F.col("p_partkey") % len(_MARKS)).cast("int"))
    return V.table(s, d, "part").select("p_partkey", F.concat("p_name", mark).alias("title"), F.when(F.col("p_size") > 25, F.col("p_name")).alias("title_kr"))


query("c01_base_title", f"WITH {_TITLED} SELECT p_partkey, title, {_BASE_SQL} AS base_title FROM titled")(lambda s, d: titled(s, d).select("p_partkey", "title", T.base_title(F.col("title")).alias("base_title")))
query("c02_product_type", f"WITH {_TITLED} SELECT p_partkey, title, {_KIND_SQL} AS product_type FROM titled")(lambda s, d: titled(s, d).select("p_partkey", "title", T.product_type(F.col("title")).alias("product_type")))
query("c03_core_title", f"WITH {_TITLED} SELECT p_partkey, title, {_CORE_SQL} AS core_title FROM titled")(lambda s, d: titled(s, d).select("p_partkey", "title", T.core_title(F.col("title")).alias("core_title")))
query(
    "c04_match_korean",
    f"""WITH {_TITLED}, named AS (SELECT *, {_BASE_SQL} AS base, {_CORE_SQL} AS core FROM titled), known AS (SELECT * FROM named WHERE title_kr IS NOT NULL),
 e AS (SELECT title, arg_max(title_kr, p_partkey) AS kr FROM known GROUP BY 1), b AS (SELECT base, arg_max(title_kr, p_partkey) AS kr FROM known GROUP BY 1), c AS (SELECT core, arg_min(title_kr, p_partkey) AS kr FROM known WHERE core <> '' GROUP BY 1)
 SELECT p_partkey, n.title AS title_jp, coalesce(e.kr, coalesce(b.kr, c.kr) || {_SUFFIX_SQL.replace("title", "n.title")}, '') AS matched_kr FROM named n LEFT JOIN e ON n.title = e.title LEFT JOIN b ON n.base = b.base LEFT JOIN c ON n.core = c.core""",
)(lambda s, d: M.match_korean(titled(s, d).select("p_partkey", F.col("title").alias("title_jp")), titled(s, d).select(F.col("title").alias("title_jp"), "title_kr", F.col("p_partkey").alias("place"))))
_SPELLINGS = [x for known in M.CHANNEL_ALIASES.values() for x in known] + ["unknown shop", ""]
_SPELT = f"([{', '.join(repr(x) for x in _SPELLINGS)}])[1 + p_partkey % {len(_SPELLINGS)}]"
_ALIAS_ROWS = ", ".join(f"('{x}', '{name}')" for name, known in M.CHANNEL_ALIASES.items() for x in known)
query("c06_channel_alias", f"SELECT p_partkey, spelling, coalesce(name, spelling) AS channel FROM (SELECT p_partkey, {_SPELT} AS spelling FROM part) LEFT JOIN (VALUES {_ALIAS_ROWS}) AS k(known, name) ON spelling = known")(
    lambda s, d: V.table(s, d, "part").select("p_partkey", F.get(F.array(*map(F.lit, _SPELLINGS)), (F.col("p_partkey") % len(_SPELLINGS)).cast("int")).alias("spelling")).withColumn("channel", M.channel_kept(F.col("spelling")))
)
query("c15_json_access", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")(lambda s, d: V.table(s, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k")))
query("c16_content_hash", "SELECT page_id, sha256(coalesce(html, '')) AS sha FROM pages")(lambda s, d: V.table(s, d, "pages").select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha")))
query("c17_levenshtein", "SELECT a.base_title AS a, b.base_title AS b, levenshtein(a.base_title, b.base_title) AS distance FROM (SELECT DISTINCT base_title FROM titles) a JOIN (SELECT DISTINCT base_title FROM titles) b ON split_part(a.base_title, ' ', 2) = split_part(b.base_title, ' ', 2) AND a.base_title < b.base_title", "titles")(lambda s, d: (lambda t: t.select(F.col("base_title").alias("a"), F.split_part("base_title", F.lit(" "), F.lit(2)).alias("k")).join(t.select(F.col("base_title").alias("b"), F.split_part("base_title", F.lit(" "), F.lit(2)).alias("k")), "k").where("a < b").select("a", "b", F.levenshtein("a", "b").cast("long").alias("distance")))(V.titles(s, d).select("base_title").distinct()))

# ---------------------------------------------------------------- masters and sinks
on_sales("b10_initial_sales", "+d AS (SELECT title_jp, channel, sale_date, sum(sales_amount) AS t FROM sales GROUP BY 1, 2, 3) SELECT title_jp, channel, genre, min(sale_date) AS launch, CAST(arg_min(t, sale_date) AS BIGINT) AS first_day FROM d JOIN titles USING (title_jp) WHERE channel = 'NATION_3' AND genre = 'SMALL' GROUP BY 1, 2, 3", lambda s, t: M.where_equal(s.join(t.select("title_jp", "genre"), "title_jp"), channel=CH, genre="SMALL", content_format=None).groupBy("title_jp", "channel", "genre", "sale_date").agg(A.total()).groupBy("title_jp", "channel", "genre").agg(F.min("sale_date").alias("launch"), F.min_by("total_sales", "sale_date").alias("first_day")), "titles")
query("b19_title_master", "+c AS (SELECT company, count(*) AS company_titles FROM titles WHERE company <> 'Brand#4' GROUP BY 1), g AS (SELECT DISTINCT genre, lower(genre) AS genre_name FROM titles WHERE genre IS NOT NULL) SELECT title_jp, t.company, t.genre, company_titles, genre_name FROM titles t LEFT JOIN c ON t.company = c.company LEFT JOIN g ON t.genre = g.genre WHERE episodes > 5", "titles")(lambda s, d: (lambda t: M.title_master(t.select("title_jp", "company", "genre", "episodes"), t.where("company <> 'Brand#4'").groupBy("company").agg(F.count("*").alias("company_titles")), t.where("genre is not null").select("genre", F.lower("genre").alias("genre_name")).distinct(), F.col("episodes") > 5).drop("episodes"))(V.titles(s, d)))
query("b20_audit_log_page", "SELECT event_id, user_id, event_type, (SELECT count(*) FROM events WHERE event_type = 'error') AS total_count FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 50")(lambda s, d: M.page_of(M.where_equal(V.table(s, d, "events"), event_type="error", user_id=None), [F.desc("ts"), F.col("event_id")], page=2).select("event_id", "user_id", "event_type", "total_count"))
on_sales("b41_stacked_matrix", "SELECT genre, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN channel = '{c}' THEN sales_amount END), 0) AS BIGINT) AS \"{c}\"" for c in _CHS) + " FROM sales JOIN titles USING (title_jp) WHERE genre IS NOT NULL GROUP BY 1", lambda s, t: M.stacked_matrix(s, t, _CHS), "titles")
_BOOK = "CASE WHEN episodes % 4 = 0 THEN '-' WHEN episodes % 6 = 1 THEN lower(genre) ELSE genre END"
query("b47_reconciliation", f"+w AS (SELECT title_jp || CASE WHEN episodes % 5 = 0 THEN '改' ELSE '' END AS title_jp, {_BOOK} AS genre, company FROM titles), m AS (SELECT title_jp, genre, CASE WHEN episodes % 9 > 0 THEN company END AS company FROM titles), j AS (SELECT m.title_jp AS a, w.title_jp AS b, m.genre AS mg, w.genre AS wg, m.company AS mc, w.company AS wc FROM m FULL JOIN w ON m.title_jp = w.title_jp), x AS (SELECT 'genre' AS field, a, b, mg AS p, wg AS q FROM j UNION ALL SELECT 'company', a, b, mc, wc FROM j) SELECT field, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND q <> '-' AND q = coalesce(p, '')) AS equal, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND q <> '-' AND q <> coalesce(p, '')) AS different, count(*) FILTER (b IS NULL) AS only_in_master, count(*) FILTER (a IS NULL) AS only_in_workbook FROM x GROUP BY 1", "titles")(lambda s, d: (lambda t: M.reconcile(t.select("title_jp", "genre", F.expr("case when episodes % 9 > 0 then company end").alias("company")), t.select(F.expr("concat(title_jp, case when episodes % 5 = 0 then '改' else '' end)").alias("title_jp"), F.expr(_BOOK).alias("genre"), "company"), "title_jp", ["genre", "company"]))(V.titles(s, d)))
_ASKED = "CASE episodes % 4 WHEN 0 THEN base_title WHEN 1 THEN base_title || ' 12' WHEN 2 THEN substr(base_title, 1, 6) ELSE 'zzz' END"
query("b48_genre_backfill", f"+k AS (SELECT base_title AS t, genre AS g, CAST(substr(title_jp, 2) AS BIGINT) AS place FROM titles WHERE genre IS NOT NULL), f AS (SELECT t, arg_min(g, place) AS g, min(place) AS place FROM k GROUP BY 1), a AS (SELECT title_jp AS id, {_ASKED} AS title_jp, CASE WHEN episodes % 2 = 0 THEN genre END AS genre FROM titles), b AS (SELECT *, trim(regexp_replace(title_jp, '\\s*[0-9]+$', '')) AS base FROM a), p AS (SELECT base, arg_min(g, place) AS g FROM (SELECT DISTINCT base FROM b WHERE length(base) >= 4) JOIN f ON starts_with(t, substr(base, 1, 10)) GROUP BY 1) SELECT id, b.title_jp, coalesce(b.genre, e.g, h.g, p.g) AS genre, CASE WHEN b.genre IS NOT NULL THEN NULL WHEN e.g IS NOT NULL THEN 'title' WHEN h.g IS NOT NULL THEN 'base' WHEN p.g IS NOT NULL THEN 'prefix' END AS filled_by FROM b LEFT JOIN f e ON e.t = b.title_jp LEFT JOIN f h ON h.t = b.base LEFT JOIN p ON p.base = b.base", "titles")(lambda s, d: (lambda t: M.backfill_genre(t.select(F.col("title_jp").alias("id"), F.expr(_ASKED).alias("title_jp"), F.expr("case when episodes % 2 = 0 then genre end").alias("genre")), t.select(F.col("base_title").alias("title_jp"), "genre", F.expr("cast(substr(title_jp, 2) as bigint)").alias("place"))))(V.titles(s, d)))
on_sales("k07_report_rows", "SELECT title_jp, channel, CAST(sum(coalesce(sales_amount, 0)) AS BIGINT) AS sales_amount, CAST(sum(coalesce(sales_amount_gross, 0)) AS BIGINT) AS sales_amount_gross FROM sales GROUP BY 1, 2", lambda s: report_rows(s, ["title_jp", "channel"], ["sales_amount", "sales_amount_gross"]))
on_ledger("k08_workbook_rows", "SELECT batch AS month, channel, coalesce(title_jp, '') AS title, CASE WHEN status <> 'F' THEN gross END AS amount, CASE WHEN status <> 'F' THEN coalesce(fee, 0) END AS fee FROM ledger", lambda r: workbook_rows(r, {"month": F.col("batch"), "channel": F.col("channel"), "title": F.coalesce("title_jp", F.lit("")), "amount": F.col("gross"), "fee": F.coalesce("fee", F.lit(0))}, F.col("status") == "F", ("amount", "fee")))
query("k14_normalise_names", "SELECT CASE WHEN company = 'Brand#4' THEN 'B4' ELSE company END AS channel, replace(base_title, ' ', ' ') || '[' || company || ']' AS title_jp, episodes FROM titles", "titles")(lambda s, d: M.normalise_names(V.titles(s, d).select(F.col("company").alias("channel"), F.concat(F.regexp_replace("base_title", " ", " \t "), F.lit("  ["), "company", F.lit("］ ")).alias("title_jp"), "episodes"), {"Brand#4": "B4"}))
_PAIR = ", ".join(f"CASE WHEN b.line IS NOT NULL THEN b.{c} ELSE o.{c} END AS {c}" for c in ("upload_id", "line", "client_id", "channel", "title_jp", "gross"))
on_ledger("e07_companions", f"""+c AS (SELECT client_id, channel, upload_id, count(*) AS n FROM ledger GROUP BY 1, 2, 3),
 p AS (SELECT client_id, channel, count(*) AS u, arg_min(upload_id, -n * 10000000000 + upload_id) AS a, arg_min(upload_id, -n * 10000000000 + upload_id) FILTER (upload_id % 3 = 0) AS b, arg_min(upload_id, -n * 10000000000 + upload_id) FILTER (upload_id % 3 = 1) AS o FROM c GROUP BY 1, 2),
 k AS (SELECT l.*, u, a, b AS pb, o AS po FROM ledger l JOIN p ON l.client_id = p.client_id AND l.channel = p.channel),
 m AS (SELECT *, row_number() OVER (PARTITION BY client_id, channel, upload_id ORDER BY title_jp, line, gross) AS n FROM k WHERE u > 1 AND pb IS NOT NULL AND po IS NOT NULL AND upload_id IN (pb, po))
 SELECT upload_id, line, client_id, channel, title_jp, gross, fee FROM k WHERE (u = 1 OR pb IS NULL OR po IS NULL) AND upload_id = a
 UNION ALL SELECT {_PAIR}, coalesce(o.fee, b.fee) AS fee FROM (SELECT * FROM m WHERE upload_id = pb) b FULL JOIN (SELECT * FROM m WHERE upload_id = po) o ON b.client_id = o.client_id AND b.channel = o.channel AND b.n = o.n""", lambda r: L.reconcile_companions(r.select("upload_id", "line", "client_id", "channel", "title_jp", "gross", "fee"), r.select("upload_id").distinct().withColumn("role", F.expr("case upload_id % 3 when 0 then 'publisher_detail' when 1 then 'broker_summary' end")), ["client_id", "channel"], ["title_jp", "line", "gross"], ["fee"]))
query("e14d_title_aliases", "+s AS (SELECT DISTINCT company AS channel, base_title AS canonical, lower(replace(base_title, ' ', '')) AS g FROM titles), x AS (SELECT channel, canonical, g AS alias FROM s UNION SELECT channel, canonical, substr(g, 1, i - 1) || substr(g, i + 1) FROM (SELECT *, CAST(unnest(range(1, length(g) + 1)) AS INTEGER) AS i FROM s WHERE length(g) >= 8)) SELECT channel, alias, CASE WHEN min(canonical) = max(canonical) THEN min(canonical) END AS canonical FROM x GROUP BY 1, 2", "titles")(lambda s, d: L.title_aliases(V.titles(s, d).select(F.col("company").alias("channel"), F.col("base_title").alias("canonical"), F.lower(F.regexp_replace("base_title", " ", "")).alias("signature")).distinct()))
on_ledger("e14f_siblings", "SELECT client_id, channel, CAST(sum(gross) AS BIGINT) AS gross, CAST(sum(fee) AS BIGINT) AS fee, count(*) AS source_count, string_agg(DISTINCT CAST(upload_id AS VARCHAR), ',' ORDER BY CAST(upload_id AS VARCHAR)) AS sources FROM ledger GROUP BY 1, 2", lambda r: L.consolidate_siblings(r, ["client_id", "channel"], ["gross", "fee"], "upload_id").select("client_id", "channel", "gross", "fee", "source_count", "sources"))

# the queries of the settlement register themselves by ``query``
from ledgerloom.plans import daily_queries, notice_queries, override_queries, platform_queries, settlement_queries, store_queries  # noqa: E402, F401
