"""Domain tables over the star schema of the test data: the daily fact, its title dimension and the settlement ledger.

Each view exists twice, as a DataFrame and as the SQL of the oracle (``SALES_SQL``, ``TITLES_SQL``, ``LEDGER_SQL``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for the current date, so that results can be compared.
AS_OF = "1998-07-01"
KRW_PER_JPY = 9.2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_suppkey, channel): small next to the fact; Spark broadcasts it where its size allows.

    The nations are one value, not a table to join: Spark takes a join's size for the product of its sides', so that it
    would shuffle the whole fact for a few suppliers.
    """
    nations = table(spark, sf_dir, "nation").agg(F.collect_list(F.struct("n_nationkey", "n_name"))).scalar()
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey", F.explode(nations).alias("_n"))
    return own.where("s_nationkey = _n.n_nationkey").select("l_suppkey", F.col("_n.n_name").alias("channel"))


def daily_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """title_jp, channel, sale_date, sales_amount, sales_amount_gross, data_source, is_preliminary, upload_id, line."""
    fact = table(spark, sf_dir, "lineitem").join(channels(spark, sf_dir), "l_suppkey")
    return fact.select(
        F.concat(F.lit("T"), F.col("l_partkey")).alias("title_jp"),
        "channel",
        F.col("l_shipdate").cast("date").alias("sale_date"),
        F.expr("cast(floor(l_extendedprice * (1 - l_discount) + 0.5D) as bigint)").alias("sales_amount"),
        F.expr("case when l_tax > 0 then cast(floor(l_extendedprice + 0.5D) as bigint) end").alias("sales_amount_gross"),
        F.expr("case l_returnflag when 'R' then 'weekly_report' when 'A' then 'sokuhochi' else 'manual' end").alias("data_source"),
        (F.col("l_linestatus") == "O").alias("is_preliminary"),
        F.col("l_orderkey").alias("upload_id"),
        F.col("l_linenumber").alias("line"),
    )


SALES_SQL = """sales AS (SELECT 'T' || l_partkey AS title_jp, n_name AS channel, CAST(l_shipdate AS DATE) AS sale_date,
 CAST(floor(l_extendedprice * (1 - l_discount) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS sales_amount,
 CASE WHEN l_tax > 0 THEN CAST(floor(l_extendedprice + CAST(0.5 AS DOUBLE)) AS BIGINT) END AS sales_amount_gross,
 CASE l_returnflag WHEN 'R' THEN 'weekly_report' WHEN 'A' THEN 'sokuhochi' ELSE 'manual' END AS data_source,
 l_linestatus = 'O' AS is_preliminary, l_orderkey AS upload_id, l_linenumber AS line
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """title_jp, title_kr, base_title, genre, company, content_format, launch_date; some genres and Korean titles are null."""
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("T"), F.col("p_partkey")).alias("title_jp"),
        F.expr("case when p_partkey % 3 > 0 then upper(p_name) end").alias("title_kr"),
        F.col("p_name").alias("base_title"),
        F.expr("case when p_partkey % 7 > 0 then p_type end").alias("genre"),
        F.col("p_brand").alias("company"),
        F.expr("case when p_size <= 15 then 'WEBTOON' when p_size <= 30 then 'PAGETOON' else 'NOVEL' end").alias("content_format"),
        F.expr("case when p_partkey % 2 = 0 then date_add(date'1995-01-01', cast(p_partkey % 1500 as int)) end").alias("launch_date"),
        F.col("p_size").alias("episodes"),
    )


TITLES_SQL = """titles AS (SELECT 'T' || p_partkey AS title_jp, CASE WHEN p_partkey % 3 > 0 THEN upper(p_name) END AS title_kr, p_name AS base_title,
 CASE WHEN p_partkey % 7 > 0 THEN p_type END AS genre, p_brand AS company,
 CASE WHEN p_size <= 15 THEN 'WEBTOON' WHEN p_size <= 30 THEN 'PAGETOON' ELSE 'NOVEL' END AS content_format,
 CASE WHEN p_partkey % 2 = 0 THEN DATE '1995-01-01' + CAST(p_partkey % 1500 AS INTEGER) END AS launch_date, p_size AS episodes FROM part)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlement rows: upload_id, line, client_id, channel, title, batch (month), type, gross, fee, rate, status."""
    rows = table(spark, sf_dir, "lineitem").join(channels(spark, sf_dir), "l_suppkey").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("l_orderkey").alias("upload_id"),
        F.col("l_linenumber").alias("line"),
        F.col("o_custkey").alias("client_id"),
        "channel",
        F.concat(F.lit("T"), F.col("l_partkey")).alias("title_jp"),
        F.date_format(F.col("l_shipdate"), "yyyy-MM").alias("batch"),
        F.col("o_orderpriority").alias("type"),
        F.expr("cast(floor(l_extendedprice + 0.5D) as bigint)").alias("gross"),
        F.expr("case when l_tax > 0.02 then cast(floor(l_extendedprice * l_tax + 0.5D) as bigint) end").alias("fee"),
        F.expr("1 - l_discount").alias("rate"),
        F.col("l_linestatus").alias("status"),
    )


LEDGER_SQL = """ledger AS (SELECT l_orderkey AS upload_id, l_linenumber AS line, o_custkey AS client_id, n_name AS channel, 'T' || l_partkey AS title_jp, strftime(l_shipdate, '%Y-%m') AS batch,
 o_orderpriority AS type, CAST(floor(l_extendedprice + CAST(0.5 AS DOUBLE)) AS BIGINT) AS gross, CASE WHEN l_tax > CAST(0.02 AS DOUBLE) THEN CAST(floor(l_extendedprice * l_tax + CAST(0.5 AS DOUBLE)) AS BIGINT) END AS fee,
 1 - l_discount AS rate, l_linestatus AS status
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN orders ON l_orderkey = o_orderkey)"""
