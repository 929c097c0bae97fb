"""Benchmark decontamination by SimHash of item-sized windows; DataFrame functions only.

1. Windows as long as an item are laid over a text wherever they hold as many shingles of items of that length as a match
   needs, whichever items these are of; no window that could match is left out.
2. Multi-index Hamming search: each window and each item has a 64-bit SimHash of its weighted shingles, cut into
   ``radius`` + 1 blocks. Fingerprints within the radius agree in a block, so an equality join on (item length, block,
   value) proposes every window and item within the radius; those farther apart are dropped.
3. Exact verification of the pairs proposed: shingles weigh as often as they occur, similarity is the sum of the smaller
   weights over the sum of the larger ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import SPACES, drop_table, materialize, runtime_filters

BROADCAST_ROWS = 1_000_000  # rows (shingle, item length) of a benchmark, 24 MB; one with more is joined by shuffle
RADIUS = 24
STRETCH = 4096  # positions of a text that are sliced to windows together


def words_of(text: Column) -> Column:
    """Words without ASCII white space, in lower case, without signs other than letters and digits."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\x20\x09-\x0D]+", "")
    return F.array_remove(F.split(plain, SPACES), "")


def _shingles(words: str, width: int) -> Column:
    """Hashes of all ``width`` consecutive words, in order; none where there are fewer."""
    at = F.sequence(F.lit(0), F.size(words) - width)
    return F.when(F.size(words) >= width, F.transform(at, lambda i: F.xxhash64(F.lit(width), *(F.get(words, i + j) for j in range(width)))))


def _simhash(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows (keys, h, w): the keys and ``fp``, whose bit b is set when most of the weight has bit b of h set."""
    sums = [F.sum(F.when(F.shiftrightunsigned("h", b).bitwiseAND(1) == 1, F.col("w")).otherwise(-F.col("w"))).alias(f"s{b}") for b in range(64)]
    bits = F.lit(0).cast("long")
    for b in range(64):
        bits = bits.bitwiseOR(F.when(F.col(f"s{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return rows.groupBy(*keys).agg(*sums).select(*keys, bits.alias("fp"))


def _blocks(fp: str, radius: int) -> Column:
    """(block, value) of the radius + 1 parts of a fingerprint."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.explode(F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND((1 << (b - a)) - 1).alias("value")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))))


def _row_id(doc_id: Column, text: Column) -> Column:
    """128 bits of a row's id and text."""
    own = (doc_id.cast("long"), doc_id.isNull(), text.cast("string"))
    return F.struct(F.xxhash64(*own).alias("a"), F.xxhash64(F.lit(1), *own).alias("b"))


def _starts() -> Column:
    """Starts of the windows of ``size`` that hold ``need`` of the positions ``p`` (in order): they hold ``need`` in a row.

    Each such run gives the starts from one place to another; both grow from run to run, so that a start that an earlier
    run has given is left out as it is made.
    """
    i = F.sequence(F.lit(0), F.size("p") - F.col("need"))
    last = lambda x: F.get("p", x + F.col("need") - 1)
    dense = F.filter(i, lambda x: last(x) - F.get("p", x) < F.col("size"))
    spans = F.transform(dense, lambda x: F.struct(F.greatest(F.lit(0), last(x) - F.col("size") + 1).alias("lo"), F.least(F.get("p", x), F.greatest(F.lit(0), F.col("n") - F.col("len"))).alias("hi")))
    return F.transform(F.array(spans), lambda s: F.flatten(F.transform(s, lambda x, j: _fresh(x["lo"], x["hi"], F.get(s, j - 1)["hi"]))))[0]


def _fresh(lo: Column, hi: Column, before: Column) -> Column:
    """lo to hi without what goes up to ``before``."""
    lo = F.greatest(lo, F.coalesce(before + 1, F.lit(0)))
    return F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi))).otherwise(F.array().cast("array<int>"))


def _row_leaks(docs: DataFrame, benchmark: DataFrame, width: int, percent: int, radius: int) -> DataFrame:
    """(rid, doc_id, item_id, start, similarity, distance) by row of ``docs`` (doc_id, text, rid); equal rows are one."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where("size(words) > 0").dropDuplicates(["item_id", "words"])
    items = items.withColumn("item_key", F.xxhash64("item_id", F.col("item_id").isNull(), "words"))
    items = items.withColumns({"len": F.size("words"), "k": F.least(F.size("words"), F.lit(width))})
    of_item = F.coalesce(*(F.when(F.col("k") == k, _shingles("words", k)) for k in range(1, width + 1)))
    item_rows = items.select("item_key", "item_id", "len", "k", F.explode(of_item).alias("h"))
    item_rows = materialize(item_rows.groupBy("item_key", "item_id", "len", "k", "h").agg(F.count("*").alias("w")), "decon-items")
    shapes = item_rows.select("h", "len").distinct()
    facts = item_rows.agg(F.collect_set("k"), F.max("len")).first()  # at most ``width`` widths, and one number
    widths, longest = sorted(set(facts[0])) or [width], facts[1] or 1
    small = shapes.count() <= BROADCAST_ROWS

    # where the texts hold shingles of items, by the items' lengths
    worded = docs.select("rid", words_of(F.col("text")).alias("words"))
    each_width = [worded.select("rid", F.size("words").alias("n"), F.lit(k).alias("k"), F.posexplode(_shingles("words", k)).alias("pos", "h")) for k in widths]
    every = each_width[0]
    for more in each_width[1:]:
        every = every.union(more)
    with runtime_filters(spark):
        found = every.join(F.broadcast(shapes) if small else shapes.where("len > 0"), "h")
        hits = materialize(found.select("rid", "n", "k", "len", "pos"), "decon-hits")
    held = hits.groupBy("rid", "n", "k", "len").agg(F.sort_array(F.collect_set("pos")).alias("p"))  # positions of one text
    held = held.withColumn("size", F.least("len", "n") - F.col("k") + 1)
    held = held.withColumn("need", F.ceil((F.col("size") + F.col("len") - F.col("k") + 1) * percent / (100 + percent)).cast("int"))
    held = held.where("size >= 1 and need <= size and size(p) >= need")
    windows = materialize(held.select("rid", "k", "len", "size", F.explode(_starts()).alias("start")), "decon-windows")
    drop_table(hits)

    # the shingles of those windows, sliced from stretches of their texts
    with runtime_filters(spark):
        texts = docs.join(windows.where("size > 0").select("rid").distinct(), "rid", "left_semi").dropDuplicates(["rid"])
        worded = texts.select("rid", words_of(F.col("text")).alias("words"))
        parts = None
        for k in widths:
            hashed = worded.withColumn("hs", _shingles("words", k)).where("hs is not null").withColumn("last", F.expr(f"(size(hs) - 1) div {STRETCH}").cast("int"))
            cut = F.transform(F.sequence(F.lit(0), F.col("last")), lambda c: F.struct(c.alias("c"), F.slice("hs", c * STRETCH + 1, F.lit(STRETCH + longest)).alias("part")))
            cut = hashed.select("rid", F.lit(k).alias("k"), F.explode(cut).alias("x")).select("rid", "k", "x.*")
            parts = cut if parts is None else parts.union(cut)
        c = F.expr(f"cast(start div {STRETCH} as int)")
        wanted = windows.groupBy("rid", "k", c.alias("c")).agg(F.collect_list(F.struct("len", "size", "start")).alias("ws"))
        sliced = F.transform("ws", lambda w: F.struct(w["len"].alias("len"), w["size"].alias("size"), w["start"].alias("start"), F.slice("part", w["start"] - F.col("c") * STRETCH + 1, w["size"]).alias("hs")))
        slices = materialize(parts.join(wanted, ["rid", "k", "c"]).select("rid", "k", F.explode(sliced).alias("x")).select("rid", "k", "x.*"), "decon-slices")

    # fingerprints, and the items within the radius of each
    own = ["rid", "k", "len", "size", "start"]
    prints = _simhash(slices.select(*own, F.explode("hs").alias("h"), F.lit(1).alias("w")), own)
    of_items = _simhash(item_rows, ["item_key", "len", "k"]).select("item_key", "len", "k", F.col("fp").alias("item_fp"), _blocks("fp", radius).alias("b"))
    met = prints.select(*own, "fp", _blocks("fp", radius).alias("b")).join(of_items, ["len", "k", "b"])
    met = met.select(*own, "item_key", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).alias("distance"))
    near = materialize(met.where(F.col("distance") <= radius).distinct(), "decon-near")

    # exact similarity of the pairs within the radius
    pair = [*own, "item_key", "distance"]
    counted = near.join(slices, own).select(*pair, F.explode("hs").alias("h")).groupBy(*pair, "h").agg(F.count("*").alias("n"))
    both = counted.join(item_rows.select("item_key", "item_id", "h", "w"), ["item_key", "h"]).groupBy(*pair, "item_id").agg(F.sum(F.least("n", "w")).alias("both"))
    union = F.col("size") + F.col("len") - F.col("k") + 1 - F.col("both")
    verified = both.where(100 * F.col("both") >= percent * union).withColumn("similarity", F.col("both") / union)
    best = F.max_by(F.struct("start", "similarity", "distance"), F.struct("similarity", -F.col("start"))).alias("x")
    verified = materialize(verified.groupBy("rid", "item_key", "item_id").agg(best).select("rid", "item_id", "x.*"), "decon-found")
    drop_table(slices), drop_table(near), drop_table(windows)
    ids = docs.select("rid", "doc_id").join(verified.where("similarity > 0").select("rid").distinct(), "rid", "left_semi").distinct()
    return verified.join(ids, "rid")


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 80, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start, similarity, distance): for each document and item, the most similar window (the first of
    equals), where its weighted-shingle similarity is at least ``percent`` / 100. Documents without a leak have no row.

    ``docs``: doc_id, text; ``benchmark``: item_id, text; other columns are not read. Shingles have ``width`` words, or
    the item's whole sequence where it is shorter; a window has the item's number of words, or the whole document where
    that is shorter. Null and empty texts match nothing; empty tables give an empty result. Rows of one doc_id (null is
    one too) are searched each on its own text and have one row an item in the result, that of their best window. An
    item is an item_id, null too, and its words: rows equal in both are one, and other texts of an item_id are items of
    their own, each with its row in the result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("rid", _row_id(F.col("doc_id"), F.col("text")))
    found = _row_leaks(rows, benchmark, width, percent, radius)
    return found.select("doc_id", "item_id", "start", "similarity", "distance")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose texts hold no benchmark item; rows of one doc_id, and of none, are judged one by one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("rid", _row_id(F.col("doc_id"), F.col("text")))
    found = _row_leaks(rows, benchmark, 5, 80, RADIUS).select("rid").distinct()
    found = materialize(found, "decon-rows")
    return docs.withColumn("_rid", _row_id(docs.doc_id, docs.text)).join(found.withColumnRenamed("rid", "_rid"), "_rid", "left_anti").drop("_rid")
