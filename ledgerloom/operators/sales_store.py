"""The stored daily sales, month by month: upserts, precedence of sources, cumulative files, and the views kept beside.

The table and both views are ``VersionedTable``s. A view remembers the version of the table it was made from; a refresh
reads the months alone whose folders differ since.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import analytics as A
from ledgerloom.operators import ledger as L
from ledgerloom.sources.versioned import ACTION, Version, VersionedTable

KEYS = ["title_jp", "channel", "sale_date", "data_source"]
SALES = "title_jp string, channel string, sale_date date, data_source string, sales_amount long, sales_amount_gross long, is_preliminary boolean, batch string"
DEDUPED = "title_jp string, channel string, sale_date date, sales_amount long, sales_amount_gross long, is_preliminary boolean"
PARTIAL = "title_jp string, month string, channels array<string>, total_sales long, days long, first_date date, last_date date"
#: Fixed value: the source whose days no other may fill.
CONFIRMED = "weekly_report"


def _month() -> Column:
    return F.date_format("sale_date", "yyyy-MM")


def sales_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, SALES, "month", _month)


def folded(rows: DataFrame) -> DataFrame:
    """One row a key of a batch, amounts added; rows without a day belong to no month and are left out."""
    return rows.where("sale_date is not null").groupBy("title_jp", "channel", "sale_date").agg(F.sum("sales_amount").alias("sales_amount"), F.sum("sales_amount_gross").alias("sales_amount_gross"))


def _merged(old: DataFrame, new: DataFrame, batch: str) -> DataFrame:
    """An upsert: the amount is replaced, a gross amount only by a known one; what else a stored row says stays."""
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in KEYS]
    joined = old.withColumn("_old", F.lit(True)).alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), same, "full")
    is_old, is_new = F.col("o._old").isNotNull(), F.col("n._new").isNotNull()
    pick = lambda c: F.when(is_old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return joined.select(
        *(pick(k) for k in KEYS),
        F.when(is_new, F.col("n.sales_amount")).otherwise(F.col("o.sales_amount")).alias("sales_amount"),
        F.coalesce("n.sales_amount_gross", "o.sales_amount_gross").alias("sales_amount_gross"),
        pick("is_preliminary"),
        F.when(is_new, F.lit(batch)).otherwise(F.col("o.batch")).alias("batch"),
        F.when(is_old & is_new, "updated").when(is_new, "inserted").otherwise("kept").alias(ACTION),
    )


def store_sales(table: VersionedTable, rows: DataFrame, source: str, batch: str, preliminary: bool = False) -> dict[str, int]:
    """Upsert a batch of a source (title_jp, channel, sale_date, amounts); counts of rows inserted, updated and kept."""
    new = folded(rows).withColumns({"data_source": F.lit(source), "is_preliminary": F.lit(preliminary)})
    return table.change(batch, lambda _: table.parts_of(new), lambda old: _merged(old, new, batch))


def _between(version: Version, low: str | None, high: str | None) -> list[str]:
    return [m for m in version.parts if low is not None and low[:7] <= m <= high[:7]]


def store_by_precedence(table: VersionedTable, rows: DataFrame, source: str, batch: str, preliminary: bool = False) -> dict[str, int]:
    """Upsert where one source goes before the others.

    The confirmed source first takes away what the others hold between its first and last day; of another source's
    batch those keys are left out that the confirmed one holds.
    """
    new = folded(rows).withColumns({"data_source": F.lit(source), "is_preliminary": F.lit(preliminary)})
    low, high = (str(x) if x else None for x in new.agg(F.min("sale_date"), F.max("sale_date")).first())

    def content(old: DataFrame) -> DataFrame:
        if source == CONFIRMED:
            kept = old if low is None else old.where(~(F.col("sale_date").between(low, high) & (F.col("data_source") != source)))
            return _merged(kept, new, batch)
        held = old.where(F.col("data_source") == CONFIRMED).select("title_jp", "channel", "sale_date")
        return _merged(old, new.join(held, ["title_jp", "channel", "sale_date"], "left_anti"), batch)

    def touched(version: Version) -> list[str]:
        own = table.parts_of(new)
        return sorted({*own, *_between(version, low, high)}) if source == CONFIRMED else own

    return table.change(batch, touched, content)


def store_cumulative(table: VersionedTable, rows: DataFrame, source: str, batch: str, preliminary: bool = False) -> dict[str, int]:
    """A cumulative file: what its channels hold of its source between their first and last day goes before it is stored."""
    new = folded(rows).withColumns({"data_source": F.lit(source), "is_preliminary": F.lit(preliminary), "batch": F.lit(batch)})
    low, high = (str(x) if x else None for x in new.agg(F.min("sale_date"), F.max("sale_date")).first())

    def content(old: DataFrame) -> DataFrame:
        left = L.replace_range(old.withColumn(ACTION, F.lit("kept")), new.withColumn(ACTION, F.lit("inserted")))
        return left.select(*table.schema.names, ACTION)

    return table.change(batch, lambda v: sorted({*table.parts_of(new), *_between(v, low, high)}), content)


# ---------------------------------------------------------------- views that follow the table
class KeptViews:
    """Beside a table of sales: its rows without the sources' duplicates, and figures by title and month of those."""

    def __init__(self, table: VersionedTable) -> None:
        spark, at = table.spark, f"{table.path}-views"
        self.table = table
        self.deduped = VersionedTable(spark, f"{at}/deduped", DEDUPED, "month", _month)
        self.partial = VersionedTable(spark, f"{at}/titles", PARTIAL, "part", lambda: F.col("month"))

    @staticmethod
    def _source(version: Version) -> int:
        return max((int(b) for b in version.batches), default=0)

    def stale(self, view: VersionedTable) -> list[str]:
        """The months whose rows have changed since the view was made."""
        seen, now = self.table.version(self._source(view.version())), self.table.version()
        return sorted(m for m in {*seen.parts, *now.parts} if seen.parts.get(m) != now.parts.get(m))

    def refresh(self) -> list[str]:
        """Bring both views to the table's version; returns the months read again."""
        now, months = self.table.version(), self.stale(self.deduped)
        mark = lambda df: df.withColumn(ACTION, F.lit("refreshed"))
        self.deduped.change(str(now.number), lambda _: months, lambda _: mark(A.deduped(self.table.read(months, now))))
        late = self.stale(self.partial)
        source = self.deduped.read(late).withColumn("month", _month())
        self.partial.change(str(now.number), lambda _: late, lambda _: mark(month_figures(source)))
        return months

    def daily_sales(self) -> DataFrame:
        return self.deduped.read()

    def title_sales(self) -> DataFrame:
        """As ``analytics.title_sales`` of the whole table, added up from a row a title and month."""
        each = self.partial.read()
        out = each.groupBy("title_jp").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("channels")))).alias("names"),  # of a title's channels
            *(F.sum(c).alias(c) for c in ("total_sales", "days")),
            F.min("first_date").alias("first_date"),
            F.max("last_date").alias("last_date"),
        )
        return out.select("title_jp", F.array_join("names", ",").alias("channels"), "total_sales", "days", "first_date", "last_date")


def month_figures(deduped: DataFrame) -> DataFrame:
    """Figures by title and month of deduplicated sales with ``month``: days of different months are different days."""
    days = deduped.groupBy("title_jp", "month", "sale_date").agg(F.sum("sales_amount").alias("t"), F.collect_set("channel").alias("c"))
    return days.groupBy("title_jp", "month").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("c")))).alias("channels"),
        F.sum("t").alias("total_sales"),
        F.count("*").alias("days"),
        F.min("sale_date").alias("first_date"),
        F.max("sale_date").alias("last_date"),
    )
