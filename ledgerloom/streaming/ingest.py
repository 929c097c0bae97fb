"""Streaming ingest of daily sales: an extension beyond the batch reference, with the same folds as the batch upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.ledger import fold_batch


def daily_windows(events: DataFrame, time: str, value: str, late: str = "2 days", width: str = "1 day") -> DataFrame:
    """Totals of tumbling windows; rows later than ``late`` no longer change them."""
    return events.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.sum(value).alias("total"), F.count("*").alias("row_count"))


def once_only(uploads: DataFrame, time: str, key: str, late: str = "7 days") -> DataFrame:
    """Uploads whose content was not seen within ``late``."""
    return uploads.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def append_batches(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Fold each micro-batch by title, channel and day and write it under its own number: a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        fold_batch(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
