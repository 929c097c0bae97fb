"""Read-only analytics over the daily fact and its dimensions: each takes and returns DataFrames.

Dates are closed ranges; None leaves an end open. Ties are broken by name. Aggregates combine before their shuffle;
dimension joins are left to Spark, which broadcasts a side only where its size allows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.sources.versioned import stored

UNCLASSIFIED = "미분류"


def total() -> Column:
    return F.sum("sales_amount").alias("total_sales")



def between(df: DataFrame, start: str | None = None, end: str | None = None, column: str = "sale_date") -> DataFrame:
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("date"))
    return df if end is None else df.where(F.col(column) <= F.lit(end).cast("date"))


def _day(as_of: str) -> Column:
    return F.lit(as_of).cast("date")


def _months(as_of: str) -> tuple[Column, Column]:
    this = F.trunc(_day(as_of), "MM")
    return this, F.add_months(this, -1)


def _this_and_last(as_of: str) -> tuple[Column, Column]:
    this, last = _months(as_of)
    now = F.coalesce(F.sum(F.when(F.col("sale_date") >= this, F.col("sales_amount"))), F.lit(0))
    return now, F.coalesce(F.sum(F.when((F.col("sale_date") >= last) & (F.col("sale_date") < this), F.col("sales_amount"))), F.lit(0))


def dashboard_kpis(sales: DataFrame, as_of: str) -> DataFrame:
    now, last = _this_and_last(as_of)
    out = sales.agg(F.coalesce(F.sum("sales_amount"), F.lit(0)).alias("total_sales"), now.alias("this_month"), last.alias("last_month"), F.countDistinct("title_jp").alias("titles"), F.countDistinct("channel").alias("channels"))
    return out.withColumn("mom_pct", money.percent_change(F.col("this_month"), F.col("last_month")))


def monthly_trend(sales: DataFrame) -> DataFrame:
    return sales.groupBy(F.date_format(F.trunc("sale_date", "MM"), "yyyy-MM").alias("month")).agg(total())


def by_group(rows: DataFrame, *keys: str) -> DataFrame:
    """Total, distinct titles and the average of selling days, by ``keys``.

    One scan gives the groups by title and those by day side by side, so that neither set of values is held in a group.
    """
    own = rows.select(*keys, "title_jp", "sale_date", "sales_amount").groupingSets([[*keys, "title_jp"], [*keys, "sale_date"]], *keys, "title_jp", "sale_date")
    each = own.agg(total(), F.grouping("sale_date").alias("_by_title"))
    by_title, by_day = F.col("_by_title") == 1, F.col("_by_title") == 0
    out = each.groupBy(*keys).agg(
        F.sum(F.when(by_title, F.col("total_sales"))).alias("total_sales"),
        F.count(F.when(by_title, F.col("title_jp"))).alias("title_count"),
        F.count(F.when(by_day, F.col("sale_date"))).alias("_days"),
    )
    return out.select(*keys, "total_sales", "title_count", money.per_day(F.col("total_sales"), F.col("_days")).alias("avg_daily"))


def top_titles(sales: DataFrame, names: DataFrame, limit: int = 20, month: str | None = None) -> DataFrame:
    """The best titles with their channels and days, which are gathered for these titles alone."""
    if month is not None:
        first = F.to_date(F.lit(f"{month}-01"))
        sales = sales.where((F.col("sale_date") >= first) & (F.col("sale_date") < F.add_months(first, 1)))
    top = sales.groupBy("title_jp").agg(total()).orderBy(F.desc("total_sales"), "title_jp").limit(limit)
    own = sales.join(F.broadcast(top), "title_jp").groupBy("title_jp", "total_sales", "channel", "sale_date").agg(F.lit(1).alias("_one"))  # ``limit`` rows
    out = own.groupBy("title_jp", "total_sales").agg(F.concat_ws(",", F.array_sort(F.collect_set("channel"))).alias("channels"), F.countDistinct("sale_date").alias("days"))
    return out.select("title_jp", "total_sales", "channels", "days").join(names.select("title_jp", "title_kr"), "title_jp", "left")


def platform_detail(sales: DataFrame, channel: str, start: str | None = None, end: str | None = None, limit: int = 20) -> dict[str, DataFrame]:
    """The parts of one channel's page: summary, monthly trend, top titles."""
    own = between(sales.where(F.col("channel") == channel), start, end)
    top = own.groupBy("title_jp").agg(total()).orderBy(F.desc("total_sales"), "title_jp").limit(limit)
    return {"summary": by_group(own, "channel"), "monthly": monthly_trend(own), "titles": top}


def title_detail(sales: DataFrame, title: str, as_of: str) -> dict[str, DataFrame]:
    own = sales.where(F.col("title_jp") == title)
    daily = own.where(F.col("sale_date") >= F.date_sub(_day(as_of), 90)).groupBy("sale_date").agg(total())
    return {"summary": own.groupBy("title_jp").agg(total(), F.concat_ws(",", F.array_sort(F.collect_set("channel"))).alias("channels")), "monthly": monthly_trend(own), "platforms": own.groupBy("channel").agg(total()), "daily": daily}


def flat(parts: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """(section, name, total_sales) of the parts of a page."""
    out = None
    for section, key in keys.items():
        rows = parts[section].select(F.lit(section).alias("section"), F.col(key).cast("string").alias("name"), "total_sales")
        out = rows if out is None else out.union(rows)
    return out


def growth_alerts(sales: DataFrame, as_of: str, limit: int = 30, js_rounding: bool = False) -> DataFrame:
    now, last = _this_and_last(as_of)
    recent = sales.where(F.col("sale_date") >= _months(as_of)[1])  # neither month has earlier rows, so the scan is cut
    both = recent.groupBy("title_jp").agg(now.alias("this_month"), last.alias("last_month")).where("last_month > 0")
    pct = F.floor((F.col("this_month") - F.col("last_month")) * 1000.0 / F.col("last_month") + 0.5) / 10.0 if js_rounding else money.percent_change(F.col("this_month"), F.col("last_month"))
    return both.withColumn("growth_pct", pct).orderBy("growth_pct", "title_jp").limit(limit)


def dimension_summary(sales: DataFrame, titles: DataFrame, dimension: str, start=None, end=None) -> DataFrame:
    """By a column of the title dimension; titles without it do not count."""
    return by_group(between(sales, start, end).join(titles.where(F.col(dimension).isNotNull()).select("title_jp", dimension), "title_jp"), dimension)


def daily_trend(sales: DataFrame, start=None, end=None) -> DataFrame:
    return between(sales, start, end).groupBy("sale_date").agg(total())


def weekly_trend(sales: DataFrame, start=None, end=None) -> DataFrame:
    return between(sales, start, end).groupBy(F.date_trunc("week", "sale_date").cast("date").alias("week")).agg(total())


def platform_genre_matrix(sales: DataFrame, titles: DataFrame, start=None, end=None, keep_unclassified: bool = True) -> DataFrame:
    rows = between(sales, start, end).join(titles.select("title_jp", "genre"), "title_jp", "left")
    rows = rows.withColumn("genre", F.coalesce("genre", F.lit(UNCLASSIFIED))) if keep_unclassified else rows.where("genre is not null")
    return rows.groupBy("channel", "genre").agg(total())


def period_kpis(sales: DataFrame, start=None, end=None) -> DataFrame:
    return between(sales, start, end).agg(F.coalesce(F.sum("sales_amount"), F.lit(0)).alias("total_sales"), F.countDistinct("title_jp").alias("titles"), F.countDistinct("channel").alias("channels"))


def ranked(sales: DataFrame, key: str, alias: str = "rk") -> DataFrame:
    """(key, total_sales, rank): one row a value of ``key``, so the window has far fewer rows than the fact."""
    return sales.groupBy(key).agg(total()).withColumn(alias, F.row_number().over(Window.orderBy(F.desc("total_sales"), key)))


def title_rankings(sales: DataFrame, current: tuple[str, str], previous: tuple[str, str], limit: int = 50) -> DataFrame:
    """The top titles of a period with their move against another; new ones come from below the list's end.

    The current ranking is cut before its numbers are given. An earlier rank is the number of titles that sold more: all
    titles' totals are held against those of the ``limit`` titles asked for, so that no task sees all of them in order.
    """
    now = between(sales, *current).groupBy("title_jp").agg(total()).orderBy(F.desc("total_sales"), "title_jp").limit(limit)
    now = now.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("total_sales"), "title_jp")))
    before = between(sales, *previous).groupBy("title_jp").agg(total())
    asked = before.join(F.broadcast(now.select("title_jp")), "title_jp").select(F.col("title_jp").alias("own"), F.col("total_sales").alias("own_sales"))
    above = (F.col("total_sales") > F.col("own_sales")) | ((F.col("total_sales") == F.col("own_sales")) & (F.col("title_jp") <= F.col("own")))
    prev = before.join(F.broadcast(asked), above).groupBy(F.col("own").alias("title_jp")).agg(F.count("*").cast("int").alias("prev_rk"))  # ``limit`` rows
    out = now.join(prev, "title_jp", "left")
    return out.select("title_jp", "total_sales", "rk", "prev_rk", (F.coalesce("prev_rk", F.lit(limit + 1)) - F.col("rk")).alias("rank_change"))


def platform_health(sales: DataFrame, channel: str, as_of: str, months: int = 6) -> DataFrame:
    own = sales.where((F.col("channel") == channel) & (F.col("sale_date") >= F.add_months(_day(as_of), -months)))
    return by_group(own.withColumn("month", F.date_format("sale_date", "yyyy-MM")), "month")


def platform_health_with_data(sales: DataFrame, channel: str, months: int = 6) -> DataFrame:
    """The last ``months`` months that have rows."""
    own = sales.where(F.col("channel") == channel).withColumn("month", F.date_format("sale_date", "yyyy-MM"))
    out = own.groupBy("month").agg(total(), F.countDistinct("title_jp").alias("title_count"), F.countDistinct("sale_date").alias("days_with_sales"))
    return out.orderBy(F.desc("month")).limit(months)


def deduped(sales: DataFrame) -> DataFrame:
    """Of the sources of one title, channel and day, the largest amounts."""
    return sales.groupBy("title_jp", "channel", "sale_date").agg(F.max("sales_amount").alias("sales_amount"), F.max("sales_amount_gross").alias("sales_amount_gross"), F.bool_or("is_preliminary").alias("is_preliminary"))


def title_sales(sales: DataFrame) -> DataFrame:
    """Figures by title over its days, and its channels, in one aggregation of the deduplicated rows.

    Rows are dealt out by title and day at first, which serves the deduplication and the days that are told apart; then
    a row a title and task is left. A title's channels are few.
    """
    dealt = sales.select("title_jp", "channel", "sale_date", "sales_amount", "sales_amount_gross", "is_preliminary").repartition("title_jp", "sale_date")
    out = deduped(dealt).groupBy("title_jp").agg(
        F.array_sort(F.collect_set("channel")).alias("_channels"),
        total(),
        F.countDistinct("sale_date").alias("days"),
        F.min("sale_date").alias("first_date"),
        F.max("sale_date").alias("last_date"),
    )
    return out.select("title_jp", F.array_join("_channels", ",").alias("channels"), "total_sales", "days", "first_date", "last_date")


# ---------------------------------------------------------------- what pages make of them
def range_with_mom(sales: DataFrame, start: str, end: str) -> DataFrame:
    """A range's figures against the calendar month before its start; one pass."""
    first = F.trunc(_day(start), "MM")
    own = F.col("sale_date").between(_day(start), _day(end))
    before = (F.col("sale_date") >= F.add_months(first, -1)) & (F.col("sale_date") < first)
    out = sales.agg(*(F.coalesce(F.sum(F.when(c, F.col("sales_amount"))), F.lit(0)).alias(n) for c, n in ((own, "total_sales"), (before, "previous"))), F.countDistinct(F.when(own, F.col("title_jp"))).alias("titles"))
    return out.withColumn("mom_pct", money.percent_change(F.col("total_sales"), F.col("previous")))


def platform_rank_change(sales: DataFrame, start: str, end: str) -> DataFrame:
    """Ranks in a range and in the range of equal length just before; a channel new there moves by 0."""
    days = F.datediff(_day(end), _day(start)) + 1
    now = ranked(between(sales, start, end), "channel")
    prev = ranked(sales.where((F.col("sale_date") < _day(start)) & (F.col("sale_date") >= F.date_sub(_day(start), days))), "channel", "prev_rk").select("channel", "prev_rk")
    return now.join(prev, "channel", "left").withColumn("rank_change", F.coalesce("prev_rk", "rk") - F.col("rk")).drop("prev_rk")


def month_pivot(sales: DataFrame, column: str, values: list[str]) -> DataFrame:
    wide = sales.where(F.col(column).isin(values)).groupBy(F.date_format("sale_date", "yyyy-MM").alias("month")).pivot(column, values).sum("sales_amount")
    return wide.na.fill(0)


def base_title_groups(sales: DataFrame, titles: DataFrame) -> DataFrame:
    """A title is of one base title, so titles are counted as rows; channels are gathered title by title first."""
    t = sales.groupBy("title_jp", "channel").agg(total()).groupBy("title_jp").agg(F.sum("total_sales").alias("total_sales"), F.collect_list("channel").alias("_channels"))
    t = t.join(titles.select("title_jp", "base_title"), "title_jp")
    return t.groupBy("base_title").agg(F.count("*").alias("products"), F.sum("total_sales").alias("total_sales"), F.concat_ws(",", F.array_sort(F.array_distinct(F.flatten(F.collect_list("_channels"))))).alias("channels"))


def percentile_bands(sales: DataFrame) -> DataFrame:
    """top10, top50 or bottom50 of the titles by sales.

    Titles are ranked within ranges of sales, whose bounds are approximate quantiles (a number a partition), and the
    numbers of titles in the ranges above are added, so that no task ranks all of them.
    """
    totals = sales.groupBy("title_jp").agg(total())
    parts = int(sales.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(totals.where("total_sales is not null").approxQuantile("total_sales", [i / parts for i in range(1, parts)], 0.01))) if parts > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b > F.coalesce("total_sales", F.lit(-1 << 62)))) if bounds else F.lit(0)
    dealt = totals.withColumn("_part", part)
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    above = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"), F.sum("_n").over(Window.partitionBy()).alias("n"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc("total_sales"), "title_jp"))
    r = dealt.withColumn("_own", own).join(F.broadcast(offsets), "_part").withColumn("rk", (F.col("_own") + F.col("_above")).cast("int"))  # a row a range
    return r.select("title_jp", "rk", F.when(F.col("rk") <= F.ceil(F.col("n") * 0.1), "top10").when(F.col("rk") <= F.ceil(F.col("n") * 0.5), "top50").otherwise("bottom50").alias("band"))


def peaks(sales: DataFrame) -> DataFrame:
    """Each title's best day and first day; the earlier of equal days."""
    d = sales.groupBy("title_jp", "sale_date").agg(total())
    best = F.min_by("sale_date", F.struct(-F.col("total_sales"), F.col("sale_date")))
    return d.groupBy("title_jp").agg(best.alias("peak_day"), F.max("total_sales").alias("peak_sales"), F.min("sale_date").alias("first_date"))


def per_episode(sales: DataFrame, titles: DataFrame) -> DataFrame:
    t = sales.groupBy("title_jp").agg(total()).join(titles.select("title_jp", "episodes"), "title_jp")
    return t.select("title_jp", money.half_up(F.try_divide(F.col("total_sales"), F.col("episodes"))).alias("per_episode"))


def pareto(sales: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """The top values with their running share of all, in whole percent."""
    all_ = sales.agg(F.sum("sales_amount").alias("all"))
    top = sales.groupBy(key).agg(total()).orderBy(F.desc("total_sales"), key).limit(limit)
    run = F.sum("total_sales").over(Window.orderBy(F.desc("total_sales"), key).rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumn("running", run).crossJoin(F.broadcast(all_)).select(key, "total_sales", money.half_up(F.col("running") * 100.0 / F.col("all")).alias("cumulative_pct"))  # one row


def launch_curve(sales: DataFrame, days: int = 28) -> DataFrame:
    """Each title's first ``days`` days, gaps as 0, with the running sum and the week: ``days`` values of a title in one array."""
    sold = sales.groupBy("title_jp", "sale_date").agg(total())
    first = F.min("sale_date").over(Window.partitionBy("title_jp"))  # a title has no more rows than days
    early = sold.withColumn("day", F.datediff("sale_date", first) + 1).where(F.col("day") <= days)
    sold = early.groupBy("title_jp").agg(F.map_from_entries(F.collect_list(F.struct("day", "total_sales"))).alias("_sold"))
    values = F.transform(F.sequence(F.lit(1), F.lit(days)), lambda d: F.coalesce(F.try_element_at("_sold", d), F.lit(0)))
    sold = sold.withColumn("_values", values)
    run = F.transform(F.sequence(F.lit(1), F.lit(days)), lambda d: F.struct(d.alias("day"), F.get("_values", d - 1).alias("total_sales"), F.aggregate(F.slice("_values", F.lit(1), d), F.lit(0).cast("long"), lambda a, x: a + x).alias("cumulative")))
    out = sold.select("title_jp", F.explode(run).alias("x")).select("title_jp", "x.*")
    return out.withColumn("week", F.ceil(F.col("day") / 7).cast("int"))


def relative_buckets(sales: DataFrame, width: int = 7, buckets: int = 12) -> DataFrame:
    """Titles aligned on their own first day: totals of ``width``-day buckets from 1 on, gaps as 0."""
    d = sales.groupBy("title_jp", "sale_date").agg(total())
    first = d.groupBy("title_jp").agg(F.min("sale_date").alias("first_date"))
    spine = first.select("title_jp", F.explode(F.sequence(F.lit(1), F.lit(buckets))).alias("bucket"))
    at = d.join(first, "title_jp").select("title_jp", F.expr(f"datediff(sale_date, first_date) div {width} + 1").alias("bucket"), "total_sales").where(F.col("bucket") <= buckets)
    return spine.join(at.groupBy("title_jp", "bucket").agg(F.sum("total_sales").alias("total_sales")), ["title_jp", "bucket"], "left").na.fill(0, ["total_sales"])


def period_compare(sales: DataFrame, a: tuple[str, str], b: tuple[str, str], key: str) -> DataFrame:
    total = lambda p: F.coalesce(F.sum(F.when(F.col("sale_date").between(_day(p[0]), _day(p[1])), F.col("sales_amount"))), F.lit(0))
    out = sales.groupBy(key).agg(total(a).alias("a"), total(b).alias("b"))
    return out.withColumns({"diff": F.col("b") - F.col("a"), "pct": money.percent_change(F.col("b"), F.col("a"))})


def contribution(sales: DataFrame, as_of: str) -> DataFrame:
    """Each channel's share of the last month's change, from the exact months."""
    now, last = _this_and_last(as_of)
    d = sales.groupBy("channel").agg(now.alias("this_month"), last.alias("last_month")).withColumn("change", F.col("this_month") - F.col("last_month"))
    return d


def share_of_all(rows: DataFrame, key: str) -> DataFrame:
    d = rows.groupBy(key).agg(total())
    return d.withColumn("share", F.col("total_sales") / F.sum("total_sales").over(Window.partitionBy()))


def month_channel_share(sales: DataFrame) -> DataFrame:
    d = sales.groupBy(F.date_format("sale_date", "yyyy-MM").alias("month"), "channel").agg(total())
    return d.withColumn("share_pct", money.half_up(F.col("total_sales") * 100.0 / F.sum("total_sales").over(Window.partitionBy("month"))))


def is_new(sales: DataFrame, titles: DataFrame, as_of: str, months: int = 3) -> DataFrame:
    first = sales.groupBy("title_jp").agg(F.min("sale_date").alias("first_date"))
    since = F.coalesce("launch_date", "first_date") >= F.add_months(_day(as_of), -months)
    return titles.join(first, "title_jp", "left").select("title_jp", F.coalesce(since, F.lit(False)).alias("is_new"))


def upload_checks(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Per row of a batch: channel unknown, amount negative, above ten times the batch's mean, date missing."""
    mean = rows.agg(F.avg("sales_amount").alias("mean"))
    k = known.select(F.lower("channel").alias("known")).distinct()
    out = rows.crossJoin(F.broadcast(mean)).join(k, F.lower("channel") == F.col("known"), "left")  # one row
    flags = {"unknown_channel": F.col("known").isNull(), "negative": F.col("sales_amount") < 0, "outlier": F.col("sales_amount") > 10 * F.col("mean"), "bad_date": F.col("sale_date").isNull()}
    return out.agg(*(F.count_if(c).alias(n) for n, c in flags.items()))


def insights(sales: DataFrame, titles: DataFrame, as_of: str, limit: int = 8, goal_rate: float | None = None) -> DataFrame:
    """(priority, place, rule, subject, value): threshold rules over the month of ``as_of`` and the one before, the most
    pressing first, of equals in the order of the rules. Later sales do not count.

    Each rule gives one row or none; values are per cent but for the number of further surging titles.
    """
    this, last = _months(as_of)
    now, before = _this_and_last(as_of)
    is_recent = F.col("sale_date") >= last
    year = F.sum(F.when((F.col("sale_date") >= F.add_months(last, -12)) & (F.col("sale_date") < F.add_months(this, -11)), F.col("sales_amount")))
    own = sales.where((F.col("sale_date") < F.add_months(this, 1)) & (F.col("sale_date") >= F.add_months(last, -12))).select("channel", "title_jp", "sale_date", "sales_amount")
    sets = own.groupingSets([["channel"], ["title_jp"], ["sale_date"]], "channel", "title_jp", "sale_date")
    by = F.when(F.grouping("channel") == 0, "channel").when(F.grouping("title_jp") == 0, "title_jp").otherwise("sale_date")
    sums = sets.agg(
        by.alias("by"),
        now.alias("this_month"),
        before.alias("last_month"),
        F.sum(F.when(is_recent, F.col("sales_amount"))).alias("total_sales"),
        F.count_if(is_recent).alias("recent_rows"),
        year.alias("year_before"),
    )
    sums = stored(sums, "insights")  # a row a channel, title and day: the fact is read once for all rules
    group = lambda key: sums.where((F.col("by") == key) & (F.col("recent_rows") > 0)).select(key, "total_sales", "this_month", "last_month")
    rows: list[DataFrame] = []

    def put(d: DataFrame, place: int, value: Column, cases: list[tuple[Column, int, str]], subject: Column | None = None) -> None:
        """A row of ``d``, which has one, where the first of ``cases`` (condition, priority, rule) that fits."""
        which = F.coalesce(*(F.when(c, F.struct(F.lit(p).alias("priority"), F.lit(r).alias("rule"))) for c, p, r in cases))
        got = d.select(which.alias("_w"), (F.lit(None) if subject is None else subject).cast("string").alias("subject"), money.half_away(value.cast("double"), 1).alias("value")).where("_w is not null")
        rows.append(got.select("_w.priority", F.lit(place).alias("place"), "_w.rule", "subject", "value"))

    def leader(d: DataFrame, key: str) -> DataFrame:
        """The first group by sales, its share of all, the share of the first three and the number of groups."""
        each = d.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("total_sales").alias("total_sales"))
        top = each.orderBy(F.desc("total_sales"), key).limit(3).agg(F.min_by(key, F.struct(-F.col("total_sales"), F.col(key))).alias("name"), F.max("total_sales").alias("first"), F.sum("total_sales").alias("three"))
        return top.crossJoin(F.broadcast(each.agg(F.sum("total_sales").alias("whole"), F.count("*").alias("n"))))  # one row each

    every = sums.where("by = 'channel'")
    mom = every.agg(F.coalesce(F.sum("this_month"), F.lit(0)).alias("n"), F.coalesce(F.sum("last_month"), F.lit(0)).alias("l")).select(money.percent_change(F.col("n"), F.col("l")).alias("v"))
    v = F.col("v")
    put(mom, 1, v, [(v <= -20, 1, "sharp_fall"), (v <= -5, 3, "fall"), (v >= 20, 2, "sharp_rise"), (v >= 5, 4, "rise")])
    share, several = F.col("first") * 100.0 / F.col("whole"), (F.col("n") >= 2) & (F.col("whole") > 0)
    put(leader(group("channel"), "channel"), 2, share, [(several & (share >= 60), 2, "platform_risk"), (several & (share >= 45), 5, "top_platform")], F.col("name"))
    grown = group("title_jp").where("last_month > 0").withColumn("g", money.percent_change(F.col("this_month"), F.col("last_month")))
    extreme = lambda up: F.min_by(F.struct("title_jp", "g"), F.struct(-F.col("g") if up else F.col("g"), F.col("title_jp")))
    moved = grown.agg(extreme(True).alias("up"), extreme(False).alias("down"), F.count_if(F.col("g") >= 50).alias("n"))
    put(moved, 3, F.col("up.g"), [(F.col("up.g") >= 50, 2, "surging")], F.col("up.title_jp"))
    put(moved, 4, F.col("n") - 1, [(F.col("n") >= 3, 6, "more_surging")])
    put(moved, 5, F.col("down.g"), [(F.col("down.g") <= -30, 1, "declining")], F.col("down.title_jp"))
    three = F.col("three") * 100.0 / F.col("whole")
    put(leader(group("title_jp"), "title_jp"), 6, three, [((F.col("n") >= 5) & (F.col("whole") > 0) & (three >= 50), 3, "top_titles")])
    joined = group("title_jp").join(titles.select("title_jp", "company", "genre"), "title_jp")
    put(leader(joined, "company"), 7, share, [(several & (share >= 50), 4, "top_company")], F.col("name"))
    put(leader(joined, "genre"), 8, share, [(F.col("n") >= 2, 5, "top_genre")], F.col("name"))
    days = group("sale_date").orderBy(F.desc("sale_date")).limit(14).withColumn("_n", F.row_number().over(Window.orderBy(F.desc("sale_date"))))  # 14 rows
    pace = days.agg(F.sum(F.when(F.col("_n") <= 7, F.col("total_sales"))).alias("n"), F.sum(F.when(F.col("_n") > 7, F.col("total_sales"))).alias("l"), F.count("*").alias("days"))
    speed = (F.col("n") - F.col("l")) * 100.0 / F.nullif(F.col("l"), F.lit(0))
    enough = (F.col("days") >= 14) & (F.col("l") > 0)
    put(pace, 9, speed, [(enough & (speed >= 30), 2, "speeding_up"), (enough & (speed <= -30), 1, "slowing_down")])
    if goal_rate is not None and goal_rate > 0:
        goal = sales.sparkSession.createDataFrame([(float(goal_rate),)], "v double")
        put(goal, 10, v, [(v >= 100, 3, "goal_met"), (v < 50, 3, "goal_far")])
    both = every.agg(F.sum("total_sales").alias("n"), F.sum("year_before").alias("l"))
    yoy = (F.col("n") - F.col("l")) * 100.0 / F.nullif(F.col("l"), F.lit(0))
    put(both, 11, yoy, [(yoy <= -15, 2, "year_fall"), (yoy >= 15, 4, "year_rise")])
    return reduce(DataFrame.union, rows).orderBy("priority", "place").limit(limit)


#: Keys by which base titles can be listed, and the language whose order holds for texts.
LIST_ORDERS = {"sales": "total_sales", "title_jp": "base_title", "title_kr": "title_kr", "genre": "genre", "company": "company", "platforms": "channel_count", "newest": "first_date"}
LANGUAGES = {"title_jp": "ja", "title_kr": "ko", "genre": "ja", "company": "ja"}


def listed_titles(sales: DataFrame, titles: DataFrame, original: str) -> DataFrame:
    """A row a base title: its sales, channels, first day, and Korean name, genre and company of its main title.

    The main title is the first whose product type is ``original``, else the first of all.
    """
    from ledgerloom.functions.text import product_type

    own = sales.groupBy("title_jp", "channel").agg(total(), F.min("sale_date").alias("first_date"))
    own = own.groupBy("title_jp").agg(F.sum("total_sales").alias("total_sales"), F.min("first_date").alias("first_date"), F.collect_list("channel").alias("_channels"))
    met = own.join(titles.select("title_jp", "base_title", "title_kr", "genre", "company"), "title_jp")
    main = F.min_by(F.struct("title_kr", "genre", "company", "first_date"), F.struct(product_type(F.col("title_jp")) != original, F.col("title_jp")))
    out = met.groupBy("base_title").agg(F.sum("total_sales").alias("total_sales"), F.size(F.array_distinct(F.flatten(F.collect_list("_channels")))).alias("channel_count"), main.alias("m"))
    return out.select("base_title", "total_sales", "channel_count", "m.*")


def in_list_order(rows: DataFrame, key: str = "sales", descending: bool = True) -> DataFrame:
    """``listed_titles`` in the order of one of LIST_ORDERS, texts by their language, blank ones as empty; ties by the title."""
    by = F.col(LIST_ORDERS.get(key, "total_sales"))
    if key in LANGUAGES:
        by = F.collate(F.coalesce(by, F.lit("")), LANGUAGES[key])
    elif key == "newest":
        by = F.coalesce(by.cast("string"), F.lit(""))
    return rows.orderBy(by.desc() if descending else by.asc(), "base_title")
