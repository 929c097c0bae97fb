"""Mixing sources to target weights.

Sizes are summed by source; targets follow from the sums by filling up to each source's cap; a document of a source
with rate target / size is emitted floor(rate) times, and once more with probability rate - floor(rate), drawn from a
hash of the seed and the doc_id, so that reruns and any partitioning agree. The sources table has one row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORD, materialize

WEIGHTS = (3, 1, 2)


def n_words(text: str | Column = "text") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): ``share`` of all sizes, dealt by weight.

    Weights repeat over the sources by code point, null last. A source's target stops at ``cap`` times its size and the
    excess is dealt anew by weight, until none is above: in order of cap / weight, sources stop as long as that is at
    most the level that the rest would then have, which is the fixed point of dealing anew.
    """
    by_name, every = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    s = sizes.withColumn("at", F.row_number().over(by_name))
    s = s.withColumns({"weight": F.get(F.array(*map(F.lit, weights)), (F.col("at") - 1) % len(weights)), "cap": F.col("source_size") * cap})
    before = Window.orderBy(F.col("cap") / F.col("weight"), "at").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"gone": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "light": F.coalesce(F.sum("weight").over(before), F.lit(0)), "all": F.sum("source_size").over(every) * share, "heavy": F.sum("weight").over(every)})
    s = s.withColumn("level", (F.col("all") - F.col("gone")) / (F.col("heavy") - F.col("light")))
    s = s.withColumn("full", F.col("cap") / F.col("weight") <= F.col("level"))
    s = s.withColumn("level", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "at", "level"))).over(every)["level"])
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("level") * F.col("weight")).cast("double").alias("target"))


def draw(seed: int = 17, doc_id: str | Column = "doc_id") -> Column:
    """A number in [0, 1) that the seed and the doc_id decide; rows of one doc_id, and all without one, share it, so that
    a source of few ids may miss its target."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def with_copies(rows: DataFrame, sums: DataFrame, doc_id: str = "doc_id", source: str = "source", seed: int = 17) -> DataFrame:
    """``rows`` with source_size, target and copies (int), each row of the mix emitted that many times."""
    t = targets(sums).select(F.col("source").alias("mix_source"), "source_size", "target")
    t = materialize(t, "mix-targets")
    rows = rows.join(t, rows[source].eqNullSafe(t.mix_source), "left").drop("mix_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = F.when(draw(seed, doc_id) < rate - F.floor(rate), 1).otherwise(0)
    return rows.withColumn("copies", (F.floor(rate) + extra).cast("int"))


def mix_plan(docs: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs`` (doc_id, text, source; more are not read).

    Size is the number of words; null and empty texts have none. A null source is a source, the last. A source without
    words has target 0. Repeated rows count and are drawn alike. An empty table gives an empty result.
    """
    sized = materialize(docs.select("doc_id", "source", n_words().alias("size")), "mix-sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    mixed = with_copies(sized, sums, seed=seed)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    sums = docs.groupBy("source").agg(F.sum(n_words()).alias("source_size"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    boxed = docs.select(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_src"), F.struct(*(F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True))).alias("all"))
    copied = with_copies(boxed, sums, "mix_id", "mix_src", seed).where("copies > 0")
    copied = copied.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copied.select(*(F.col(f"all.{n}").alias(c) for c, n in zip(docs.columns, names, strict=True)))


#: The query's rows in DuckDB's SQL.
SQL = """
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
named AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS pos FROM sums),
weighed AS (SELECT *, CASE (pos - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, source_size * CAST(2 AS DOUBLE) AS cap FROM named),
ordered AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
  coalesce(sum(weight) OVER (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS light,
  sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS al, sum(weight) OVER () AS heavy FROM weighed),
levelled AS (SELECT *, (al - gone) / CAST(heavy - light AS DOUBLE) AS lv FROM ordered),
water AS (SELECT min_by(lv, row(cap / weight, pos)) AS water FROM levelled WHERE cap / weight > lv),
aimed AS (SELECT source, source_size, CASE WHEN cap / weight <= lv THEN cap ELSE water * weight END AS target FROM levelled LEFT JOIN water ON true),
rated AS (SELECT d.doc_id, d.size, a.source_size, a.target, CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0 END AS rate
  FROM sized d JOIN aimed a ON d.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated
"""
