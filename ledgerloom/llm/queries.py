"""The thin queries over the operators, as their contracts state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup, mixing, pii, token_files, warc, whitening
from ledgerloom.llm.conversation_repair import repair_verdicts
from ledgerloom.llm.decontamination import leaks
from ledgerloom.llm.hilbert_sharding import shard_plan
from ledgerloom.llm.html_text import extract_pages
from ledgerloom.llm.jaccard_join import jaccard_components
from ledgerloom.llm.quality_rules import quality_verdicts
from ledgerloom.llm.substring_dedup import dedup_substrings


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ["doc_id"])
    return judged.selectExpr("doc_id", "q_n as n_words", "q_chars as word_chars", "q_symbols as n_symbols", "q_dup_lines as n_dup_lines", "q_repeated as n_repeat_words", "base_failed", "kept")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_table(spark, sf_dir, "documents"))


def op5_digest(docs: DataFrame) -> DataFrame:
    found = pii.find_pii(docs.select("doc_id", "text"))
    counts = [F.size(f"pii_base.{k}").cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed("pii_base"), 256).alias("base_sha256"), pii.listed("pii_spans").alias("spans"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_digest(_table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_tokens(token_files.write_tokens(_table(spark, sf_dir, "documents")))


def op10_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_plan(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_verdicts(_table(spark, sf_dir, "conversations"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components_of(whitening.whiten(_table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_warc": op2_warc,
    "op3_quality_rules": op3_quality_rules,
    "op4_mixing": op4_mixing,
    "op5_pii": op5_pii,
    "op6_html_text": op6_html_text,
    "op7_decontamination": op7_decontamination,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_files": op9_token_files,
    "op10_hilbert_sharding": op10_hilbert_sharding,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL: dict[str, str] = {"op4_mixing": mixing.SQL, "op12_exact_dedup": exact_dedup.SQL}
