"""Daily sales files as DataFrames of (title_jp, channel, sale_date, sales_amount, sales_amount_gross).

A format is a declaration: which columns hold what, how a date is read, how amounts are netted. Spark reads the files;
nothing of a file passes the driver but its header line.
"""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.functions import text as T
from ledgerloom.functions.joins import taken_once

COLUMNS = ["title_jp", "channel", "sale_date", "sales_amount", "sales_amount_gross"]


def read_table(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", skip: int = 0) -> DataFrame:
    """A quoted text table, all columns as strings. Shift-JIS needs spark.sql.legacy.javaCharsets=true on the session."""
    rows = spark.read.option("header", skip == 0).option("sep", sep).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(path)
    if skip == 0:
        return rows
    lines = spark.read.option("encoding", encoding).text(path, wholetext=False)
    header = next(csv_line(r[0], sep) for r in lines.limit(skip + 1).collect()[skip:])  # one line
    named = rows.toDF(*(header + [f"_{i}" for i in range(len(header), len(rows.columns))])[: len(rows.columns)])
    return named.where(F.col(named.columns[0]) != F.lit(header[0]))


def csv_line(line: str, sep: str = ",") -> list[str]:
    import csv

    return next(csv.reader([line], delimiter=sep))


@dataclass(frozen=True)
class Daily:
    """A format whose rows are sales of a day or a month. ``amount``: the first of these columns that is no blank."""

    channel: str | None
    title: str
    date: str
    amount: tuple[str, ...]
    suffix: str = ""
    gross: bool = False  # amounts hold tax: net them and keep the gross
    monthly: bool = False
    channel_column: str | None = None
    strip: tuple[str, ...] = field(default=())


#: The formats' columns.
FORMATS = {
    "weekly_report": Daily(None, "title_jp", "sale_date", ("sales_amount",), channel_column="channel"),
    "sokuhochi": Daily("piccoma", "作品名", "日付", ("ポイント",), gross=True),
    "sokuhochi_kan": Daily("piccoma", "作品名", "日付", ("ポイント",), suffix="(巻)", gross=True),
    "cmoa": Daily("cmoa", "タイトル名", "販売年月", ("消費PT", "支払額"), monthly=True),
    "ebookjapan": Daily("ebookjapan", "タイトル名", "販売日", ("販売額計",)),
    "line_manga": Daily("line", "タイトル名", "販売日", ("販売額（税抜）", "販売額計")),
    "dmm": Daily("dmm", "商品タイトル", "集計期間", ("売上金額",), monthly=True),
}
#: The readers' own keys of FORMATS by a file's name and header, in order; ``detection`` holds the formats' full rules.
DETECTION = (("weekly", None, "weekly_report", 0.9), ("速報.*巻", None, "sokuhochi_kan", 0.9), ("速報|sokuhochi", None, "sokuhochi", 0.9), ("cmoa|シーモア", None, "cmoa", 0.8), (None, "消費PT", "cmoa", 0.7), (None, "集計期間", "dmm", 0.7), (None, "書店名", "ebookjapan", 0.5))


def detect(file: Column, header: Column) -> Column:
    """struct(format, confidence) by the rules above; null where none fits."""
    out = F.lit(None).cast("struct<format:string,confidence:double>")
    for name, token, kind, sure in reversed(DETECTION):
        fits = F.lower(file).rlike(name) if name else header.contains(token)
        out = F.when(fits, F.struct(F.lit(kind).alias("format"), F.lit(sure).alias("confidence"))).otherwise(out)
    return out


def day_of(text: Column, monthly: bool = False) -> Column:
    """A date in texts such as 2024/5/3, 2024-05-03, 20240503 or a range; its month's first day for monthly formats."""
    pattern = r"(\d{4})\D?(\d{1,2})(?:\D?(\d{1,2}))?"
    part = lambda i: F.lpad(F.regexp_extract(text, pattern, i), 2, "0")
    day = F.lit("01") if monthly else part(3)
    found = F.concat_ws("-", F.regexp_extract(text, pattern, 1), part(2), day).try_cast("date")
    if monthly:
        return found
    whole = (F.char_length(text) == 10) & (F.substring(text, 5, 1) == "-") & (F.substring(text, 8, 1) == "-")
    return F.coalesce(F.when(whole, text.try_cast("date")), found)


def daily_rows(table: DataFrame, kind: Daily) -> DataFrame:
    """The format's rows, added up by title, channel and day; rows without a title or a date go."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    there = [c for c in kind.amount if c in table.columns]
    raw = F.coalesce(*(F.when(~blank(c), T.amount(F.col(c))) for c in there), F.lit(0.0))
    title = F.trim(F.col(kind.title))
    for pattern in kind.strip:
        title = F.trim(F.regexp_replace(title, pattern, ""))
    channel = F.trim(F.col(kind.channel_column)) if kind.channel_column else F.lit(kind.channel)
    rows = table.where(~blank(kind.title)).select(F.concat(title, F.lit(kind.suffix)).alias("title_jp"), channel.alias("channel"), day_of(F.col(kind.date), kind.monthly).alias("sale_date"), raw.alias("raw"))
    summed = taken_once(rows).where("sale_date is not null").groupBy("title_jp", "channel", "sale_date").agg(F.sum("raw").alias("raw"))
    net = money.net_of(F.col("raw")) if kind.gross else money.half_up(F.col("raw"))
    gross = money.half_up(F.col("raw")) if kind.gross else F.lit(None).cast("long")
    return summed.select("title_jp", "channel", "sale_date", net.alias("sales_amount"), gross.alias("sales_amount_gross"))


def unpivoted(table: DataFrame, title: str, channel: str, year: int, pattern: str = r"^(\d{1,2})-(\d{1,2}) ", price: str | None = None, gross: bool = True, tails: tuple[str, ...] = ()) -> DataFrame:
    """Wide files with a column a day (``MM-DD ...``): one row a title and day; counts times ``price`` where given.

    Columns of months (``MM月``) count only in files without any of days, and then for the month's first day.

    ``tails`` are taken off the ends of titles (RENTA_TAILS three times over for Renta's files)."""
    days = {c: re.match(pattern, c) for c in table.columns if re.match(pattern, c)}
    if not days:  # a file by month
        days = {c: m for c in table.columns if (m := re.match(r"^(\d{1,2})月()$", c))}
    return _long(table, title, channel, {c: f"{year}-{int(m[1]):02d}-{int(m[2] or 1):02d}" for c, m in days.items()}, price, gross, tails)


def month_of_days(table: DataFrame, title: str, channel: str, year: int, month: int, gross: bool = False) -> DataFrame:
    """Wide files of one month with columns 1日 to 31日; days that the month does not have are left out."""
    last = calendar.monthrange(year, month)[1]
    days = {c: int(m[1]) for c in table.columns if (m := re.match(r"^(\d{1,2})日$", c))}
    return _long(table, title, channel, {c: f"{year}-{month:02d}-{d:02d}" for c, d in days.items() if 1 <= d <= last}, None, gross, ())


def _long(table: DataFrame, title: str, channel: str, days: dict[str, str], price: str | None, gross: bool, tails: tuple[str, ...]) -> DataFrame:
    """One row a title and day of a table whose columns ``days`` are days."""
    keep = [title, *([price] if price else [])]
    long = table.select(*keep, *(F.col(f"`{c}`").cast("string").alias(day) for c, day in days.items()))
    long = long.unpivot(keep, [c for c in long.columns if c not in keep], "day", "value")
    raw = T.amount(F.col("value")) * (T.amount(F.col(price)) if price else F.lit(1.0))
    net = money.net_of(F.sum(raw)) if gross else money.half_up(F.sum(raw))
    name = F.trim(F.col(title))
    for tail in tails:
        name = F.regexp_replace(name, tail, "")
    out = long.where(raw != 0).groupBy(F.trim(name).alias("title_jp"), F.col("day").cast("date").alias("sale_date")).agg(net.alias("sales_amount"), money.half_up(F.sum(raw)).alias("sales_amount_gross"))
    return out.select("title_jp", F.lit(channel).alias("channel"), "sale_date", "sales_amount", (F.col("sales_amount_gross") if gross else F.lit(None).cast("long")).alias("sales_amount_gross"))


#: What titles of Renta's and DMM's files bear at their ends, taken off three times over.
RENTA_TAILS = (r"\s*【フルカラー】\s*$", r"\s*第?\s*\d+[話巻]\s*【[^】]*】\s*$", r"\s*第?\s*\d+[話巻]\s*$", r"\s+\d+\s*【[^】]*】\s*$", r"\s*\d+\s*$")
DMM_TAILS = (r"\s*第?\s*\d+[話巻]\s*【[^】]*】\s*$", r"\s*第?\s*\d+[話巻]\s*$", r"\s*【フルカラー】\s*$", r"\s*\d+\s*$")
DMM_TITLES, DMM_SITES = ("商品タイトル", "タイトル名", "作品名"), ("配信サイト", "サイト")


def dmm_rows(table: DataFrame) -> DataFrame:
    """DMM's file as daily rows: FANZA's site is a channel of its own, a range of days is its month, amounts above 0 count."""
    found = lambda test: next((c for c in table.columns if test(c)), None)
    names = lambda *words: lambda c: any(w in c for w in words)
    title, site = found(lambda c: c in DMM_TITLES), found(lambda c: c in DMM_SITES)
    date = found(lambda c: c == "日付" or names("売上月", "売上日", "集計期間", "集計単位", "販売日")(c))
    amount = found(lambda c: names("売上金額", "販売額計", "取扱高")(c) and "税込" not in c) or found(names("売上金額", "販売額計", "金額"))
    if not (title and date and amount):
        raise ValueError(f"no title, date or amount among {table.columns}")
    name = F.trim(F.col(title))
    for pattern in DMM_TAILS * 3:
        name = F.regexp_replace(name, pattern, "")
    ranged = F.col(date).rlike(r"^\d{4}\D\d{1,2}\D\d{1,2}日?\s*[～~]\s*\d{4}")
    day = F.when(ranged, day_of(F.col(date), monthly=True)).otherwise(day_of(F.col(date)))
    channel = F.when(F.upper(F.col(site)).contains("FANZA"), "DMM(FANZA)").otherwise("DMM") if site else F.lit("DMM")
    whole = F.regexp_extract(F.regexp_replace(F.col(amount), "[¥,]", ""), r"^\s*(-?\d+)", 1).try_cast("long")
    rows = table.select(F.trim(name).alias("title_jp"), channel.alias("channel"), day.alias("sale_date"), whole.alias("n"))
    rows = rows.where("title_jp <> '' and sale_date is not null and n > 0")
    return rows.groupBy("title_jp", "channel", "sale_date").agg(F.sum("n").alias("sales_amount")).withColumn("sales_amount_gross", F.lit(None).cast("long"))


def _decoded(contents: pd.Series) -> pd.Series:
    def one(raw):
        if raw is None:
            return None
        try:
            return raw.decode("utf-8-sig")
        except UnicodeDecodeError:
            return raw.decode("cp932", "replace")

    return contents.map(one)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of whole files in UTF-8, with a mark or without, or else in Shift-JIS; one file is one row."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("file"), F.pandas_udf(_decoded, "string")("content").alias("text"))
