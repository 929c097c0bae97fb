"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing and sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes to the shared folder and reads
again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.common import drop_table, materialize, scratch_scope
from ledgerloom.llm.decontamination import without_leaks
from ledgerloom.llm.hilbert_sharding import placed_rows, size_of
from ledgerloom.llm.jaccard_join import keep_first
from ledgerloom.llm.mixing import mix
from ledgerloom.llm.quality_rules import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the certified cutoffs reject go.

    Null and empty texts have no words and are rejected; repeated rows are judged alike and stay or go together; other
    columns pass as they are. Without labels the base rules alone decide.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that 5-word shingles link at 0.8 or more, that of the smallest doc_id stays; null ids come last.

    Null and empty texts are linked with nothing and stay. Of rows equal in every column all stand or fall together.
    """
    return keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none; rows of one doc_id, and of none, are judged by their own texts, repeated rows alike.
    An empty benchmark takes nothing away.
    """
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null source is one of its own, the last; null and empty texts have no words, and are drawn as others of their
    source. Whether a row is drawn once more hangs on its doc_id alone, so that repeated rows, and all rows without one,
    share that.
    """
    return mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their size, index on the curve (h), shard and slot; ``run`` writes them, a folder a shard.

    Null sources and languages come last along their dimension, null and empty texts have size 1; repeated rows lie side
    by side, each with a slot of its own.
    """
    return placed_rows(docs).withColumn("size", size_of())


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]
#: Near duplicates and decontamination have no SQL of bearable length; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's tables go once its output is written, and that once the next stage's is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch_scope(spark):
            folders = ["shard"] if stage is shard else None
            before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}".replace("_", "-"), folders, keep=True)
        drop_table(before)
    return docs
