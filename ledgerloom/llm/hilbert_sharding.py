"""Sharding along a Hilbert curve over several metadata dimensions; DataFrame functions only.

Language and source are quantised by equal depth (the share of rows before a value, in order of value), size by its
logarithm. Rows are put in range partitions by (curve index, doc_id), numbered within them, and the sizes of the
partitions give each row its place on the whole curve; runs of equal row counts are the shards. Only metadata moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize

BITS = 8
CELLS_BYTES = 8 << 20  # of a dimension's distinct values, up to which their cells are broadcast


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """The index on the curve of a point of ``len(dims)`` dimensions of ``bits`` bits (Skilling's transform).

    Written as folds over (level, dimension), so that the expression stays small.
    """
    n = len(dims)
    axes = F.array(*(d.cast("int") for d in dims))
    steps = [(q, i) for q in range(bits - 1, 0, -1) for i in range(n)]
    plan = F.array(*(F.struct(F.lit(1 << q).alias("q"), F.lit(i).alias("i")) for q, i in steps))

    def undo(x, s):
        q, i = s["q"], s["i"]
        low = q - 1
        first, own = F.get(x, F.lit(0)), F.get(x, i)
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        flip = own.bitwiseAND(q) != 0
        return F.transform(x, lambda v, j: F.when(flip, F.when(j == 0, v.bitwiseXOR(low)).otherwise(v)).when((i != 0) & ((j == 0) | (j == i)), v.bitwiseXOR(swap)).otherwise(v))

    x = F.aggregate(plan, axes, undo)
    # Gray code: each axis with the ones before it, then the fold of the last
    gray = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), x, lambda a, i: F.transform(a, lambda v, j: F.when(j == i, v.bitwiseXOR(F.get(a, i - 1))).otherwise(v)))
    top = F.array(*(F.lit(1 << q) for q in range(bits - 1, 0, -1)))
    state = F.struct(gray.alias("a"), F.lit(0).alias("t"))
    folded = F.aggregate(top, state, lambda s, q: F.struct(s["a"].alias("a"), F.when(F.get(s["a"], F.lit(n - 1)).bitwiseAND(q) != 0, s["t"].bitwiseXOR(q - 1)).otherwise(s["t"]).alias("t")), lambda s: F.transform(s["a"], lambda v: v.bitwiseXOR(s["t"])))
    order = F.array(*(F.struct(F.lit(1 << q).alias("q"), F.lit(i).alias("i")) for q in range(bits - 1, -1, -1) for i in range(n)))
    start = F.struct(F.lit(0).cast("long").alias("h"), folded.alias("a"))
    return F.aggregate(order, start, lambda s, o: F.struct((s["h"] * 2 + F.when(F.get(s["a"], o["i"]).bitwiseAND(o["q"]) != 0, 1).otherwise(0)).alias("h"), s["a"].alias("a")), lambda s: s["h"])


def _cells(rows: DataFrame, name: str) -> DataFrame:
    """(name, cell): equal-depth cells of the values, null as the last. One row a value; windows run over these only."""
    order = Window.orderBy(F.col(name).asc_nulls_last())
    n = rows.groupBy(name).agg(F.count("*").alias("n"))
    before = F.sum("n").over(order) - F.col("n")
    return n.select(F.col(name).alias(f"{name}_value"), F.least(F.floor(before * (1 << BITS) / F.sum("n").over(Window.partitionBy())), F.lit((1 << BITS) - 1)).cast("int").alias(f"{name}_cell"))


def _at_curve(rows: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """``rows`` (with size) and their curve index ``h``."""
    for name in dims:
        cells = materialize(_cells(rows, name), "hilbert-cells")
        amount = cells.agg(F.sum(F.coalesce(F.octet_length(f"{name}_value"), F.lit(0)) + 16)).first()[0] or 0
        # broadcast, the rows stay in the tasks that scan them; joined by a shuffle, few values leave few tasks with rows
        side = F.broadcast(cells) if amount <= CELLS_BYTES else cells
        rows = rows.join(side, rows[name].eqNullSafe(cells[f"{name}_value"]), "left").drop(f"{name}_value")
    size = F.least(F.floor(F.log2(F.col("size")) * 8), F.lit((1 << BITS) - 1)).cast("int")
    return rows.withColumn("h", hilbert_index([*(F.col(f"{n}_cell") for n in dims), size]))


def place(meta: DataFrame, shards: int = 16, dims: tuple[str, ...] = ("source", "lang"), ties: list[str] | None = None) -> DataFrame:
    """``meta`` (doc_id, size, the dimensions, more) with h, shard and slot.

    Shards are runs of the order by (h, doc_id, ``ties``: all other columns if None), their row counts at most one
    apart; slots count from 0 within a shard. Rows equal in all of these are interchangeable. An empty table gives an
    empty result. The dimensions are strings.
    """
    curve = _at_curve(meta, dims)
    rest = [c for c in meta.columns if c not in ("doc_id", "h")] if ties is None else ties
    parts = int(meta.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = curve.repartitionByRange(parts, "h", "doc_id", *rest).sortWithinPartitions("h", "doc_id", *rest)
    # the id holds the partition in its upper bits and the row's place in the partition in its lower 33; written, it stays
    ranged = materialize(ranged.select(*meta.columns, "h", F.monotonically_increasing_id().alias("mid")), "hilbert-ranged")
    part = F.shiftright("mid", 33)
    counts = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    order = Window.orderBy("part")
    offsets = counts.select("part", (F.sum("n").over(order) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    # one row a partition, whose number is the setting's: small
    placed = ranged.withColumn("part", part).join(F.broadcast(offsets), "part")
    rank = F.col("before") + F.col("mid").bitwiseAND((1 << 33) - 1)
    placed = placed.withColumn("rank", rank).withColumn("shard", F.expr(f"cast(rank * {shards} div total as int)"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return placed.withColumn("slot", (F.col("rank") - first).cast("long")).drop("part", "mid", "before", "total", "rank")


def size_of(text: str | Column = "text") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def crc_of(text: str | Column = "text") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long")


def shard_plan(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``; the law is ``rows``.

    ``docs``: doc_id, text, lang, source; more columns are not read. A null text has size 1; null languages and sources
    come last along their dimension.
    """
    meta = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size_of().alias("size"), crc_of().alias("text_crc32"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    placed = place(meta, shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _boxed(docs: DataFrame, shards: int) -> DataFrame:
    """(row, h, shard, slot), in runs of the curve; the sort key holds metadata and a hash of the row, which is moved once."""
    row = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))
    boxed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size_of().alias("size"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), row.alias("row"))
    boxed = boxed.withColumn("sign", F.xxhash64(F.to_json("row")))
    placed = place(boxed, shards, ties=["size", "source", "lang", "sign"])
    # the partitions of ``place`` are runs of the curve already, so that the rows need no second shuffle
    return placed.select("row", "h", "shard", "slot").sortWithinPartitions("shard", "slot")


def placed_rows(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source, lang, more, of any types) with h, shard and slot, in runs of the curve.

    Null texts have size 1, null sources and languages come last along their dimension, rows equal in all columns are
    interchangeable. Columns of ``docs`` that bear the names h, shard or slot are replaced.
    """
    docs = docs.drop("h", "shard", "slot")
    return _boxed(docs, shards).select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)), "h", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """The rows of ``docs`` as Parquet, a folder a shard, each file a run of the curve, for pruning by file statistics.

    Columns may have any names but ``_shard``, that of the folders.
    """
    own = (F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns))
    _boxed(docs, shards).select(F.col("shard").alias("_shard"), *own).write.partitionBy("_shard").parquet(path)
