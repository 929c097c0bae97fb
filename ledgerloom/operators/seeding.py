"""Masters loaded from a content list in the order of their references: companies, genres, labels, titles, availability.

An id is a hash of what names the row, so that a load can be repeated, by any number of tasks and at any time, and gives
the same tables; rows that are there keep their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.versioned import ACTION, VersionedTable

#: The tables by name, in the order in which they are loaded, with what names a row in each.
TABLES = {
    "companies": ("id string, name string", ["name"]),
    "genres": ("id string, code string, name_jp string", ["name_jp"]),
    "labels": ("id string, name string", ["name"]),
    "titles": ("id string, title_jp string, title_kr string, content_format string, serial_status string, company_id string, genre_id string, label_id string", ["title_jp"]),
    "availability": ("title_id string, platform_id string, launch_date date, is_available boolean", ["title_id", "platform_id"]),
}
#: Forms of contents and states of serials by the words for them, in order of precedence.
FORMATS = (("WEBTOON|ウェブ", "WEBTOON"), ("PAGE|版面|ページ", "PAGETOON"), ("NOVEL|小説|ノベル", "NOVEL"))
STATES = (("連載中", "連載中"), ("完結", "完結"), ("休載", "休載中"), ("未連載|未配信", "未連載"))


def name_id(kind: str, *names: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", F.lit(kind), *names), 256), 1, 32)


def content_format(text: Column) -> Column:
    out = F.lit("WEBTOON")
    for words, kind in reversed(FORMATS):
        out = F.when(F.upper(F.trim(text)).rlike(words), kind).otherwise(out)
    return out


def serial_status(text: Column) -> Column:
    out = F.nullif(F.nullif(F.trim(text), F.lit("")), F.lit("-"))
    for words, state in reversed(STATES):
        out = F.when(F.trim(text).rlike(words), state).otherwise(out)
    return out


def genre_code(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]", "_"), "_+", "_")


def _named(stored: DataFrame, names: Column, rows: DataFrame, key: str, kind: str, **more: Column) -> DataFrame:
    """``stored`` with a row for each name it lacks."""
    new = rows.select(names.alias(key)).where(F.col(key) != "").distinct().join(stored.select(key), key, "left_anti")
    new = new.withColumns({"id": name_id(kind, F.col(key)), **more})
    return stored.unionByName(new.select(*stored.columns))


def seeded(rows: DataFrame, stored: dict[str, DataFrame], platforms: DataFrame) -> dict[str, DataFrame]:
    """The TABLES after loading ``rows``: place, title_jp, title_kr, company, genre, label, form, status, launches.

    ``launches``: array of (code, launch_date); codes that ``platforms`` (id, code) lacks are left aside, and so are
    launches without a date. Of several rows of a title the last in ``place`` holds; a company, genre or label that a
    row leaves blank does not empty an earlier one. What is stored and not in ``rows`` stays.
    """
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    list_ = rows.select("place", text("title_jp").alias("title_jp"), text("title_kr").alias("title_kr"), text("company").alias("company"), text("genre").alias("genre"), text("label").alias("label"), content_format(F.coalesce("form", F.lit(""))).alias("content_format"), serial_status(F.col("status")).alias("serial_status"), "launches").where("title_jp is not null")
    companies = _named(stored["companies"], F.col("company"), list_, "name", "company")
    genres = _named(stored["genres"], F.col("genre"), list_, "name_jp", "genre", code=genre_code(F.col("name_jp")))
    labels = _named(stored["labels"], F.col("label"), list_, "name", "label")
    last = lambda c: F.max_by(c, F.struct("place", c))
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("place")))
    fields = ("title_kr", "content_format", "serial_status")
    new = list_.groupBy("title_jp").agg(F.max_by(F.struct(*fields), F.struct("place", *fields)).alias("own"), *(known(c).alias(c) for c in ("company", "genre", "label")))
    for column, table, key in (("company", companies, "name"), ("genre", genres, "name_jp"), ("label", labels, "name")):
        new = new.join(table.select(F.col(key).alias(column), F.col("id").alias(f"new_{column}")), column, "left")
    met = stored["titles"].withColumn("_old", F.lit(True)).join(new.select("title_jp", "own", *(f"new_{c}" for c in ("company", "genre", "label")), F.lit(True).alias("_new")), "title_jp", "full")
    pick = lambda c: F.when(F.col("_new"), F.col(f"own.{c}")).otherwise(F.col(c)).alias(c)
    titles = met.select(F.coalesce("id", name_id("title", F.col("title_jp"))).alias("id"), "title_jp", *(pick(c) for c in fields), *(F.coalesce(f"new_{c}", f"{c}_id").alias(f"{c}_id") for c in ("company", "genre", "label")))
    each = list_.select("title_jp", "place", F.explode("launches").alias("x")).where("x.launch_date is not null").select("title_jp", "place", F.col("x.code").alias("code"), F.col("x.launch_date").alias("launch_date"))
    each = each.groupBy("title_jp", "code").agg(last("launch_date").alias("launch_date"))
    each = each.join(platforms.select("code", F.col("id").alias("platform_id")), "code").join(titles.select("title_jp", F.col("id").alias("title_id")), "title_jp")
    old = stored["availability"].join(each.select("title_id", "platform_id"), ["title_id", "platform_id"], "left_anti")
    available = old.unionByName(each.select("title_id", "platform_id", "launch_date", F.lit(True).alias("is_available")))
    return {"companies": companies, "genres": genres, "labels": labels, "titles": titles, "availability": available}


def store_seeds(spark: SparkSession, path: str, rows: DataFrame, platforms: DataFrame, batch: str) -> dict[str, VersionedTable]:
    """Load ``rows`` into the tables under ``path``, each published before those that refer to it; a batch is loaded once.

    A load that fails in between is taken up again by the same call: the tables that hold the batch are left as they are.
    """
    tables = {name: VersionedTable(spark, f"{path}/{name}", schema, "part", lambda key=key: F.substring(F.sha2(F.concat_ws("\u0000", *key), 256), 1, 1)) for name, (schema, key) in TABLES.items()}
    every = [f"{i:x}" for i in range(16)]
    for name, table in tables.items():
        base = table.version()
        if batch in base.batches:
            continue
        loaded = seeded(rows, {n: t.read() for n, t in tables.items()}, platforms)[name]
        table.change(batch, lambda _: every, lambda _, new=loaded: new.withColumn(ACTION, F.lit("stored")))
    return tables
