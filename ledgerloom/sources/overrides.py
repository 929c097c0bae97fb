"""What a platform's lines need besides the files' own columns: rules of titles, roll-ups, checks against a summary.

Rules are data: pattern, match (exact or prefix), priority (the least first) and what they give. Titles meet them by
equi-joins, an exact title by itself and a prefix by the title's first signs, for the lengths that prefixes have.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money
from ledgerloom.functions import text as T
from ledgerloom.functions.titles import half_digits
from ledgerloom.sources.readers import READERS

#: Kadokawa's kinds by account, and its rules: a series of which all volumes are one record, and the rounding row that goes into it.
KADOKAWA_KINDS = {"原稿料": "MF", "出版印税": "PP", "版権料": "PP", "二次的利用印税": "EB"}
KADOKAWA_RULES = (("盗掘王", "prefix", 1, "盗掘王"), ("消費税端数差額調整", "exact", 0, "盗掘王"))
#: As the platform's own reader, with the account that the kinds hang on.
KADOKAWA_READER = replace(READERS["kadokawa"], columns={**READERS["kadokawa"].columns, "account": "勘定科目"}, optional=("booked_on", "account"))
RULES = "pattern string, match string, priority int, series string"


def kadokawa_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KADOKAWA_RULES, RULES)


def by_rules(rows: DataFrame, rules: DataFrame, title: str, gives: list[str]) -> DataFrame:
    """``rows`` with the columns ``gives`` of the rule that holds for each title; null where none does.

    ``rules``: pattern, match, priority and ``gives``. Of the rules that fit, that of the least priority holds, then an
    exact one, then the longest prefix, then the least pattern. Each title is looked up once, so that repeated titles do
    not multiply rows; a title has as many keys as prefixes have lengths.
    """
    rules = rules.where("pattern <> ''")
    prefixes = rules.where("match = 'prefix'")
    lengths = prefixes.agg(F.coalesce(F.collect_set(F.char_length("pattern")), F.array().cast("array<int>")).alias("_lengths"))  # one row
    titles = rows.select(F.col(title).alias("_title")).where("_title is not null").distinct()
    begun = titles.crossJoin(F.broadcast(lengths)).select("_title", F.explode("_lengths").alias("_n")).where("char_length(_title) >= _n")
    begun = begun.select("_title", F.substring("_title", F.lit(1), F.col("_n")).alias("pattern"))
    met = titles.withColumn("pattern", F.col("_title")).join(rules.where("match = 'exact'"), "pattern").unionByName(begun.join(prefixes, "pattern"))
    order = F.struct("priority", (F.col("match") != "exact").alias("m"), (-F.char_length("pattern")).alias("l"), "pattern")
    found = met.groupBy("_title").agg(F.min_by(F.struct(*gives), order).alias("_found"))
    out = rows.join(found, F.col(title) == F.col("_title"), "left")
    return out.select(*rows.columns, *(F.col(f"_found.{g}").alias(g) for g in gives))


def kadokawa_records(own: DataFrame, rules: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """Records of Kadokawa's lines (``readers.lines``): a row each, but one a file for each series of ``rules``.

    A row's kind is that of its account, else EB; a series' is EB. The payment is booked for the month before it, to its
    last day; where a file does not say when it is paid, for the month of its latest booking.
    """
    kinds = KADOKAWA_KINDS if kinds is None else kinds
    days = own.groupBy("file").agg(F.min("paid_on").alias("_paid"), F.max("booked_on").alias("_booked"))
    rows = by_rules(own.withColumn("raw_title", F.trim("raw_title")), rules, "raw_title", ["series"]).join(days, "file")
    day = F.try_to_timestamp(F.regexp_replace(F.trim("_paid"), r"^(\d{4})[-/]?(\d{1,2})[-/]?(\d{1,2})$", "$1-$2-$3"), F.lit("y-M-d")).cast("date")
    kind = F.coalesce(*(F.when(F.trim("account") == a, k) for a, k in kinds.items()), F.lit("EB"))
    rows = rows.withColumns({"paid": day, "amount": money.half_up(F.col("sales")), "account_kind": kind})
    sales_month = F.coalesce(F.last_day(F.add_months("paid", -1)), dates.iso_month(F.col("_booked")))
    rows = rows.withColumns({"sales_month": sales_month, "settlement_date": F.col("paid")})
    single = rows.where("series is null").select("file", F.col("raw_title").alias("title"), F.col("account_kind").alias("kind"), "sales_month", "settlement_date", "amount", F.lit(1).cast("long").alias("row_count"))
    rolled = rows.where("series is not null").groupBy("file", "series", "sales_month", "settlement_date").agg(F.sum("amount").alias("amount"), F.count("*").alias("row_count"))
    out = single.unionByName(rolled.withColumnRenamed("series", "title").withColumn("kind", F.lit("EB")))
    net = money.half_up(F.col("amount") / 1.1)
    return out.select(
        "file", "title", "kind", "sales_month", "settlement_date", F.col("amount").alias("total"), F.col("amount").alias("before_tax_income"),
        net.alias("after_tax_income"), (F.col("amount") - net).alias("consumption_tax"), "row_count", F.lit(True).alias("is_summary"),
    )


# ---------------------------------------------------------------- U-NEXT
#: U-NEXT's sheets and labels, its share and its tax.
UNEXT_PERIOD, UNEXT_TITLES = "対象期間", "タイトル一覧"
UNEXT_TITLE, UNEXT_PAYOUT = "タイトル名", "当月分配金額"
UNEXT_TAX = 1.1


def unext_months(cells: DataFrame) -> DataFrame:
    """(file, month) by the sheet that states the period, from ``xlsx.read_xlsx``; the first such row of a file."""
    label, value = F.coalesce(F.get("cells", F.lit(0)), F.lit("")), half_digits(F.coalesce(F.get("cells", F.lit(1)), F.lit("")))
    form = r"(\d{4})[/年-](\d{1,2})"
    month = F.to_date(F.concat_ws("-", F.regexp_extract(value, form, 1), F.lpad(F.regexp_extract(value, form, 2), 2, "0"), F.lit("01")))
    stated = cells.where(F.col("sheet").contains("ヘッダー") & label.contains(UNEXT_PERIOD) & value.rlike(form))
    return stated.groupBy("file").agg(F.min_by(month, F.struct("row_index")).alias("month"))


def unext_summary(cells: DataFrame) -> DataFrame:
    """(file, title, payout) of the sheet that lists the titles; its header is its first row."""
    rows = cells.where(F.col("sheet").contains(UNEXT_TITLES))
    place = lambda name: F.array_position(F.transform("cells", lambda c: F.coalesce(c.contains(name), F.lit(False))), True).cast("int")
    heads = rows.where("row_index = 1").select("file", "sheet", place(UNEXT_TITLE).alias("t"), place(UNEXT_PAYOUT).alias("p")).where("t > 0 and p > 0")
    body = rows.where("row_index > 1").join(heads, ["file", "sheet"])  # a row a sheet
    title, payout = F.trim(F.get("cells", F.col("t") - 1)), T.amount(F.coalesce(F.get("cells", F.col("p") - 1), F.lit("")))
    out = body.select("file", title.alias("title"), payout.alias("payout"), "row_index").where("title <> ''")
    return out.groupBy("file", "title").agg(F.max_by("payout", "row_index").alias("payout"))


def respelt(title: Column, spellings: tuple[tuple[str, str], ...]) -> Column:
    for old, new in spellings:
        title = F.replace(title, F.lit(old), F.lit(new))
    return title


def unext_records(own: DataFrame, months: DataFrame, summary: DataFrame, multiplier: float = UNEXT_TAX, spellings: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Records of U-NEXT's lines by file and title, set against the file's own summary.

    ``stated``: the payout that the summary states, null without one; ``differs``: it is off the details' by more than a
    yen. Titles that the summary alone has give rows without amounts, as ``differs``: nothing is dropped. The month is
    that of the header's sheet, else of the file's name.
    """
    lines = own.withColumn("title", respelt(F.col("title"), spellings))
    sums = lines.groupBy("file", "title").agg(
        F.sum("sales").alias("s"), F.sum("pay").alias("p"), F.max(F.when(F.col("rate") > 0, F.col("rate"))).alias("rate"), F.max("month").alias("named"), F.count("*").alias("row_count")
    )
    listed = summary.withColumn("title", respelt(F.col("title"), spellings)).groupBy("file", "title").agg(F.max("payout").alias("stated"))
    met = sums.join(listed, ["file", "title"], "full").join(months, "file", "left")
    r = money.half_up
    total, before, after = r(F.col("s") * multiplier), r(F.col("p") * multiplier), r(F.col("p"))
    differs = F.when(F.col("stated").isNull(), False).otherwise(F.coalesce(F.abs(F.col("stated") - after) > 1, F.lit(True)))
    return met.select(
        "file", "title", F.coalesce("month", "named").alias("sales_month"), total.alias("total"), total.alias("before_tax"), r(F.col("s")).alias("after_tax"), before.alias("before_tax_income"),
        after.alias("after_tax_income"), (before - after).alias("consumption_tax"), "rate", "row_count", "stated", differs.alias("differs"),
    )
