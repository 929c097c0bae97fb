"""Joins of rows with one row a group, where a group may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more rows than this have their row broadcast: there is at most one such key for as many rows.
LARGE = 100_000


def taken_once(rows: DataFrame) -> DataFrame:
    """``rows`` behind a generator, which no filter is moved through: columns that take long are not computed again below."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner", large: int = LARGE, counted: str | None = None, near_hint: str | None = None) -> DataFrame:
    """``rows`` joined (inner or left) with ``groups``, which has a row a key: its other columns follow those of ``rows``.

    Keys of more than ``large`` rows are few, so that their row of ``groups`` is broadcast; their rows are dealt out by
    their own hash. All other keys meet by a shuffle. So no task gets all rows of one large sheet or file. ``counted``:
    the column of ``groups`` that says how many rows a key has (inner only), so that ``rows`` are not read for that. ``near_hint``: Spark's hint for
    the join of the other keys.
    """
    values = [c for c in groups.columns if c not in (*keys, counted)]
    one = groups.select(*keys, F.struct(*values).alias("_one"), *([counted] if counted else []))
    if counted:
        far, one = one.where(F.col(counted) > large).drop(counted), one.where(F.col(counted) <= large).drop(counted)
        far = far.withColumnRenamed("_one", "_far")
    else:
        many = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > large).drop("_n")
        far = many.join(one.withColumnRenamed("_one", "_far"), keys, "left")
    far = far.withColumn("_large", F.lit(True))
    near = one.withColumnRenamed("_one", "_near").withColumn("_deal", F.lit(0).cast("long"))
    near = near.hint(near_hint) if near_hint else near
    out = rows.join(F.broadcast(far), keys, "left").withColumn("_deal", F.when(F.col("_large"), F.xxhash64(*rows.columns)).otherwise(F.lit(0).cast("long")))
    out = out.join(near, [*keys, "_deal"], "left").withColumn("_one", F.when(F.col("_large"), F.col("_far")).otherwise(F.col("_near")))
    met = out if how == "left" else out.where("_one is not null")
    return met.select(*rows.columns, *(F.col(f"_one.{v}").alias(v) for v in values))
