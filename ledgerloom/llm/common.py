"""What several operators share: scratch tables, vectorised word splitting, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word pattern of the contracts, for Spark's regular expressions.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


# ---------------------------------------------------------------- scratch tables
def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; one of our own only where none is set and all runs on one machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


#: The scopes around, of each thread of control its own.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def materialize(df: DataFrame, tag: str, partition_by: list[str] | None = None, keep: bool = False) -> DataFrame:
    """Write to a table in the shared folder and read it again: cuts the lineage, survives lost executors.

    Within a ``scratch_scope`` the table is removed at its end, unless ``keep``."""
    path = scratch_path(df.sparkSession, tag)
    if (scopes := _SCOPES.get()) and not keep:
        scopes[-1].append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes the tables materialized within; what is to outlast it is written within it, with ``keep``."""
    paths: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), paths))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in paths:
            _remove(spark, path)


def drop_table(df: DataFrame) -> None:
    """Remove the scratch tables that ``df`` reads, where no later step does; tables outside the scratch folder stay."""
    spark = df.sparkSession
    bare = lambda x: re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", x)
    own = re.compile(re.escape(bare(scratch_root(spark))) + r"/[a-z0-9-]+-[0-9a-f]{12}(?=/)")
    for name in {f[: len(f) - len(bare(f)) + m.end()] for f in df.inputFiles() if (m := own.match(bare(f)))}:
        _remove(spark, name)


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


def range_parts(df: DataFrame, keys: list[str], parts: int, per: int = 60) -> DataFrame:
    """``df`` with ``part`` (int): one of ``parts`` ranges of the order by ``keys`` (null first), about equal in rows.

    Bounds come from a sample of the keys alone, ``per`` a range, so that nothing else of ``df`` is computed for them;
    the sample decides the ranges and no row's place in the order. Each row finds its range by binary search.
    """
    keyed = df.select(*keys)
    share = min(1.0, parts * per / max(1, keyed.count()))
    seen = sorted((tuple(r) for r in keyed.sample(share, 7).collect()), key=lambda r: [(x is not None, x) for x in r])
    bounds = [seen[len(seen) * i // parts] for i in range(1, parts)] if seen else []
    if not bounds:
        return df.withColumn("part", F.lit(0))
    own = F.struct(*keys)
    fields = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in keyed.schema.fields)
    table = df.sparkSession.createDataFrame([(bounds,)], f"_bounds array<struct<{fields}>>")
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def step(s, _):
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        over = F.get("_bounds", mid) <= own
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & over, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~over, mid).otherwise(s["hi"]).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), start, step, lambda s: s["lo"])
    return df.crossJoin(F.broadcast(table)).withColumn("part", found).drop("_bounds")  # one row


# ---------------------------------------------------------------- words and hashes, over whole Arrow batches
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15 | 1
_POW: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}
_PINV = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["p"]) < n:
        size = max(n, 1 << 21)
        for name, base in (("p", _P), ("q", _PINV)):
            a = np.full(size, np.uint64(base))
            a[0] = 1
            with np.errstate(over="ignore"):
                _POW[name] = np.cumprod(a, dtype=np.uint64)
    return _POW["p"][:n], _POW["q"][:n]


def text_chunks(column: pa.Array, limit: int = 1_500_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [i, j) with their bytes and row offsets, about ``limit`` bytes at a time; a row is never cut. Null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of each row's first word (one more entry for the end)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    solid = ~_SPACE[data]
    first = np.empty(len(data), bool)
    first[0], first[1:] = True, ~solid[:-1]
    first[off[:-1][off[:-1] < len(data)]] = True
    starts = np.flatnonzero(solid & first)
    last = np.empty(len(data), bool)
    last[-1], last[:-1] = True, ~solid[1:]
    last[off[1:][off[1:] > 0] - 1] = True
    ends = np.flatnonzero(solid & last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each word: a polynomial over prefix sums, then mixed with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if lower:
        data = _LOWER[data]
    p, q = _powers(len(data))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p, out=total[1:])
        return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """A hash for each k consecutive words; windows that cross a row's end are the caller's to leave out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    consts = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 7919)) | np.uint64(1)
    with np.errstate(over="ignore"):
        if k <= 16:
            total = np.zeros(n, np.uint64)
            for i in range(k):
                total += words[i : i + n] * consts[i]
            return mix(total)
        c = np.uint64(int(consts[0]))
        p = np.cumprod(np.full(len(words), c), dtype=np.uint64)
        inv = np.cumprod(np.full(n, np.uint64(pow(int(c), -1, 1 << 64))), dtype=np.uint64)
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words + np.uint64(seed)) * p, out=total[1:])
        return mix((total[k:] - total[:n]) * inv)


# ---------------------------------------------------------------- connected components
def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, label): the smallest node each node reaches over ``edges`` (a, b), for nodes that have an edge.

    Each round points every node to the least of itself and its neighbours and contracts the graph along these
    pointers, until no edge is left; the rounds' pointers are then followed. A component's least node always points to
    itself. Minimums are combined before each shuffle, so that a node with very many edges is no hot task.
    """
    left = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{tag}-edges")
    labels = None
    while labels is None or not is_empty(left):
        ends = left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        edges, to = left, materialize(ends.groupBy(F.col("e.a").alias("node")).agg(F.min("e.b").alias("least")).select("node", F.least("node", "least").alias("to")), f"{tag}-pointers")
        side = lambda n: to.select(F.col("node").alias(n), F.col("to").alias(f"to_{n}"))  # noqa: B023, E731
        moved = left.join(side("a"), "a").join(side("b"), "b").where("to_a <> to_b")
        left = materialize(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), f"{tag}-edges")
        drop_table(edges)
        if labels is None:
            labels = to.select("node", F.col("to").alias("label"))
        else:
            labels = labels.join(to.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return labels


@contextmanager
def runtime_filters(spark: SparkSession):
    """Within, Spark may put a Bloom filter of a join's smaller side (of bounded size, by its own settings) before the
    shuffle of the larger one, however small that is; by default it does so from 10 GB."""
    name = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "1MB")
    try:
        yield
    finally:
        spark.conf.set(name, before)
