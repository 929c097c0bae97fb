"""Sinks: reports as CSV that spreadsheets open, projections to a workbook's columns, the store of comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "\ufeff"


def report_rows(rows: DataFrame, keys: list[str], amounts: list[str]) -> DataFrame:
    """Rows of equal keys as one, amounts added; blank amounts count as 0."""
    return rows.groupBy(*keys).agg(*(F.sum(F.coalesce(F.col(a), F.lit(0))).alias(a) for a in amounts))


def write_csv_report(rows: DataFrame, path: str, bom: bool = True) -> None:
    """A CSV file a task, each with the header; ``bom`` puts a byte order mark before it, for spreadsheets."""
    if bom and rows.columns:
        rows = rows.withColumnRenamed(rows.columns[0], BOM + rows.columns[0])
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def workbook_rows(rows: DataFrame, columns: dict[str, Column], blank_when: Column | None = None, blank: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` under the workbook's columns, in their order; ``blank`` ones are emptied where ``blank_when`` holds.

    A column's default is part of its expression (``coalesce``).
    """
    hidden = F.lit(False) if blank_when is None else F.coalesce(blank_when, F.lit(False))
    return rows.select(*(F.when(~hidden, c).alias(n) if n in blank else c.alias(n) for n, c in columns.items()))


def append_comparison(results: DataFrame, path: str, run_id: str) -> None:
    """A run's differences under its own folder: written again, they replace that run alone."""
    results.write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def read_comparison(spark: SparkSession, path: str, run_id: str | None = None, reviews: DataFrame | None = None) -> DataFrame:
    """Stored differences, one run's where it is named (only its folder is read), with the latest review of each.

    ``reviews``: run_id, diff_id, status, reviewed_at; an unreviewed difference is 'open'.
    """
    rows = spark.read.option("basePath", path).parquet(path).withColumn("run_id", F.col("run_id").cast("string"))
    if run_id is not None:
        rows = rows.where(F.col("run_id") == run_id)
    if reviews is None:
        return rows
    last = reviews.groupBy("run_id", "diff_id").agg(F.max_by("status", F.struct("reviewed_at", "status")).alias("status"))
    return rows.join(last, ["run_id", "diff_id"], "left").withColumn("status", F.coalesce("status", F.lit("open")))


#: What a review may say, how long its note may be, and how many differences a page may hold.
REVIEW_STATUSES = ("pending", "candidate_correct", "golden_correct", "needs_review", "resolved")
CATEGORIES = ("field", "missing", "extra")
LONGEST_NOTE, LARGEST_PAGE, USUAL_PAGE = 2000, 200, 100


def checked_reviews(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``reviews`` (run_id, diff_id, status, note, reviewed_at) that may be stored, and the others with ``problem``."""
    problem = (
        F.when(F.col("status").isNull() & F.col("note").isNull(), "neither status nor note")
        .when(F.col("status").isNotNull() & ~F.col("status").isin(*REVIEW_STATUSES), "unknown status")
        .when(F.char_length("note") > LONGEST_NOTE, "note too long")
    )
    out = reviews.withColumn("problem", problem)
    return out.where("problem is null").drop("problem"), out.where("problem is not null")


def reviewed(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """``rows`` (run_id, diff_id, more) with review_status and review_note: the latest of each that a review states."""
    at = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("reviewed_at", c)))
    last = reviews.groupBy("run_id", "diff_id").agg(at("status").alias("review_status"), at("note").alias("review_note"))
    return rows.join(last, ["run_id", "diff_id"], "left").withColumn("review_status", F.coalesce("review_status", F.lit(REVIEW_STATUSES[0])))


def diff_page(rows: DataFrame, category: str | None = None, status: str | None = None, offset: int = 0, limit: int = USUAL_PAGE) -> tuple[DataFrame, int]:
    """A page of ``reviewed`` rows in order of diff_id, and how many rows there are in all; the limit is 1 to 200."""
    if category is not None and category not in CATEGORIES:
        raise ValueError(f"category must be one of {CATEGORIES}")
    if status is not None and status not in REVIEW_STATUSES:
        raise ValueError(f"review_status must be one of {REVIEW_STATUSES}")
    for column, wanted in (("category", category), ("review_status", status)):
        rows = rows if wanted is None else rows.where(F.col(column) == wanted)
    page = rows.orderBy("run_id", "diff_id").offset(max(0, offset)).limit(min(max(1, limit), LARGEST_PAGE))
    return page, rows.count()
