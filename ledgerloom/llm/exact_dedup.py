"""Exact dedup: a two-pass Bloom filter finds the rows whose text may be repeated; only those are shuffled.

The first pass counts, over all rows, the positions that each text's hash sets in a bit table, and keeps the positions
set twice or more, as bitmaps of 32,768 bits. The second pass looks each row's positions up in these bitmaps, which are
broadcast: ``max_bits`` bounds them (2^30 bits, 128 MB) whatever the input's size. A row with a position that is set
once has no copy and passes straight through; the others meet by their whole hash. A table of more rows than the bits
serve well only sends more rows (of an id, a length and a hash each, never a text) through the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize

SPACES = " \t\n\x0b\f\r"
MAX_BITS = 1 << 30
BITS_A_ROW = 16
HASHES = 2


def text_key(text: str = "text") -> Column:
    """SHA-256 of the text without white space, as hexadecimal; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), SPACES, ""), 256)


def filter_bits(rows: int, max_bits: int = MAX_BITS) -> int:
    """A power of two of at least BITS_A_ROW for each row, within a page of 32,768 and ``max_bits``."""
    return min(max_bits, max(1 << 15, 1 << (max(1, rows) * BITS_A_ROW - 1).bit_length()))


def positions(key: Column, bits: int) -> list[Column]:
    """HASHES positions below ``bits`` from separate parts of a hexadecimal hash."""
    part = lambda i: F.conv(F.substring(key, 1 + 15 * i, 15), 16, 10).cast("long")
    return [part(i) % bits for i in range(HASHES)]


def repeated_positions(keyed: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap): of the positions that the rows' keys set, those set twice or more.

    Positions are counted before they are shuffled, so that a text with very many copies is one row a task.
    """
    each = keyed.select(F.explode(F.array(*positions(F.col("key"), bits))).alias("p"))
    twice = each.groupBy("p").agg(F.count("*").alias("n")).where("n > 1")
    return twice.groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bitmap")
    )


def _is_set(bitmap: str, p: Column) -> Column:
    bit = F.call_function("bitmap_bit_position", p)
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10)
    mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (bit % 8 + 1).cast("int"))
    return F.coalesce(byte.cast("int").bitwiseAND(mask) != 0, F.lit(False))


def flag_repeated(keyed: DataFrame, rows: int, max_bits: int = MAX_BITS) -> DataFrame:
    """``keyed`` (with ``key``) and ``maybe_repeated``: false only where no other row has the key. Nothing is shuffled here."""
    bits = filter_bits(rows, max_bits)
    bitmaps = repeated_positions(keyed, bits)
    out, tests = keyed, []
    for i, p in enumerate(positions(F.col("key"), bits)):
        side = bitmaps.select(F.col("bucket").alias(f"_bucket{i}"), F.col("bitmap").alias(f"_bitmap{i}"))
        at = F.call_function("bitmap_bucket_number", p)
        out = out.join(F.broadcast(side), at == F.col(f"_bucket{i}"), "left")  # bits / 8 bytes at most
        tests.append(_is_set(f"_bitmap{i}", p))
    return out.select(*keyed.columns, reduce(Column.__and__, tests).alias("maybe_repeated"))


def exact_groups(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are without white space; a null text is an empty one, and all empty ones are equal. Of a
    group the row with the most code points stays, then that of the smallest doc_id (null last), then any one. Exactly
    one row of a group has ``kept``, also among repeated rows. Other columns are left aside; an empty table gives none.
    """
    chars = F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("chars")
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    keyed = docs.select(doc_id, chars, text_key().alias("key")).withColumn("row", F.monotonically_increasing_id())
    keyed = materialize(keyed, "exact-keys")  # texts are read once; row ids stay as they are
    flagged = materialize(flag_repeated(keyed, keyed.count(), max_bits), "exact-flags", partition_by=["maybe_repeated"])
    first = F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    alone = flagged.where("not maybe_repeated").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col("key").alias("text_sha256"),
    )
    several = flagged.where("maybe_repeated")
    groups = several.groupBy("key").agg(F.min(first).alias("first"), F.count("*").alias("group_size"))
    groups = materialize(groups, "exact-groups")  # so that both sides of the join are shuffled as they are, and skew is split
    met = several.join(groups, "key").select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.col("key").alias("text_sha256"),
    )
    return alone.unionByName(met)


def drop_copies(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one whole row of each group of equal texts, chosen as in ``exact_groups``.

    Rows without a copy are never shuffled; of the others each task sends one row a group.
    """
    names = docs.columns
    keyed = docs.select(F.struct("*").alias("doc"), text_key().alias("key"))
    flagged = flag_repeated(keyed, docs.count(), max_bits)
    text = F.coalesce(F.col("doc.text").cast("string"), F.lit(""))
    order = F.struct((-F.length(text)).alias("chars"), F.col("doc.doc_id").isNull().alias("no_id"), F.col("doc.doc_id"))
    several = flagged.where("maybe_repeated").groupBy("key").agg(F.min_by("doc", order).alias("doc"))
    return flagged.where("not maybe_repeated").select("doc.*").union(several.select("doc.*")).select(*names)


#: The query's rows in DuckDB's SQL, for unique ids.
SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT doc_id, length(t) AS chars, sha256(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256 FROM d)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, first_value(doc_id) OVER w = doc_id AS kept, text_sha256
FROM k WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""
