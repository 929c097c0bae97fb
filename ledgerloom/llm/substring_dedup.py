"""Substring dedup over a log-structured fingerprint index.

A window is ``window`` consecutive words. Its fingerprint is the least hash among its ``gram``-word sequences, which
depends on the window's words alone, so that equal windows have equal fingerprints; neighbouring windows mostly share
theirs, so that an index of fingerprints is about a twentieth of one of windows.

``FingerprintIndex`` keeps sorted immutable runs of (fingerprint, least doc_id, greatest doc_id), listed by a manifest
beside them. ``add`` sorts a new batch into a run, merge-joins it with each earlier run and returns the fingerprints
that two documents share; ``compact`` merges the runs once there are many. Shared fingerprints are then verified: of the documents that hold
one, the 96-bit hashes of the windows under it are compared, and a window repeats an earlier one if a smaller
doc_id holds its hash. Windows are combined in each task before the shuffle, so that a passage in very many
documents is one row a task.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize, runtime_filters, scratch_path, text_chunks, window_hashes, word_hashes, word_spans


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    done = 1
    while done * 2 <= width:
        g, done = np.minimum(g[:-done], g[done:]), done * 2
    return np.minimum(g[: len(g) - (width - done)], g[width - done :]) if width > done else g


def _windows(column: pa.Array, window: int, gram: int):
    """For each text: its bytes, and each window's fingerprint and two hashes."""
    for i, j, data, off in text_chunks(column):
        starts, ends, first = word_spans(data, off)
        words = word_hashes(data, starts, ends)
        small, n = window_hashes(words, gram, seed=3), len(words)
        marks = _least(small, window - gram + 1) if n >= window else small[:0]
        h1, h2 = window_hashes(words, window, seed=4), window_hashes(words, window, seed=5)
        for d in range(j - i):
            a, b = int(first[d]), max(int(first[d]), int(first[d + 1]) - window + 1)
            yield data[off[d] : off[d + 1]], int(first[d + 1] - first[d]), marks[a:b], h1[a:b], h2[a:b]


def _facts(window: int, gram: int):
    def run(batches):
        for b in batches:
            n, sha, marks = [], [], []
            for data, words, m, _, _ in _windows(b.column("text"), window, gram):
                n.append(words)
                sha.append(hashlib.sha256(b" ".join(data.tobytes().split())).hexdigest())
                marks.append(np.unique(m).view(np.int64))
            lengths = np.concatenate(([0], np.cumsum([len(m) for m in marks]))).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(marks) if marks else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rid"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), arrays], names=["doc_id", "rid", "n_words", "sha", "marks"])

    return run


class FingerprintIndex:
    """Sorted immutable runs under ``path`` in shared storage, listed by a manifest there, so that any process goes on.

    Runs are bucketed and sorted by fingerprint, all alike, so that merge joins of runs need no shuffle of the history.
    A manifest is written under a new number and never changed; the highest one holds, and a run is known from it alone,
    so that what a lost process has left is not read. One process writes at a time.
    """

    COLUMNS = "mark long, low long, high long"

    def __init__(self, spark: SparkSession, path: str, most_runs: int = 4, buckets: int | None = None):
        self.spark, self.path, self.most_runs = spark, path.rstrip("/"), most_runs
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(conf)
        self._fs.mkdirs(self._at("manifest"))
        known = sorted(f.getPath().getName() for f in self._fs.listStatus(self._at("manifest")) if f.getPath().getName().endswith(".json"))
        self.version, self.buckets, self.runs = 0, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), []
        if known:
            told = json.loads(spark.read.text(f"{self.path}/manifest/{known[-1]}").first()[0])
            self.version, self.buckets, self.runs = told["version"], told["buckets"], told["runs"]

    def _publish(self, runs: list[str]) -> None:
        self.version, self.runs = self.version + 1, runs
        body = json.dumps({"version": self.version, "buckets": self.buckets, "runs": runs})
        name = f"manifest/{self.version:08d}.json"
        out = self._fs.create(self._at(f"{name}.part"), True)
        out.write(bytearray(body.encode()))
        out.close()
        self._fs.rename(self._at(f"{name}.part"), self._at(name))

    def read(self, run: str) -> DataFrame:
        """A run as a bucketed table; its files' names carry their buckets."""
        table = f"run_{hashlib.md5(f'{self.path}/{run}'.encode()).hexdigest()}"
        if not self.spark.catalog.tableExists(table):
            self.spark.sql(f"CREATE TABLE {table} ({self.COLUMNS}) USING parquet CLUSTERED BY (mark) SORTED BY (mark) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}'")
        return self.spark.table(table)

    def _write(self, rows: DataFrame) -> str:
        """A new run: one row for each fingerprint."""
        run = f"run-{uuid.uuid4().hex[:12]}"
        rows = rows.groupBy("mark").agg(F.min("low").alias("low"), F.max("high").alias("high")).repartition(self.buckets, "mark")
        table = f"run_{hashlib.md5(f'{self.path}/{run}'.encode()).hexdigest()}"
        rows.write.option("compression", "zstd").option("path", f"{self.path}/{run}").bucketBy(self.buckets, "mark").sortBy("mark").saveAsTable(table, format="parquet")
        return run

    def add(self, batch: DataFrame) -> DataFrame:
        """``batch``: (mark, doc_id). Returns (mark): fingerprints of this batch that two documents hold, here or earlier."""
        name = self._write(batch.select("mark", F.col("doc_id").alias("low"), F.col("doc_id").alias("high")))
        run = self.read(name)
        shared = run.where("low < high").select("mark")
        for old in map(self.read, self.runs):
            old = old.select("mark", F.col("low").alias("l"), F.col("high").alias("h"))
            shared = shared.union(run.hint("merge").join(old.hint("merge"), "mark").where("least(low, l) < greatest(high, h)").select("mark"))
        # written first: Spark takes a union of bucketed tables for bucketed itself, and would not bring equal rows together
        shared = materialize(shared, "substring-shared").distinct()
        self._publish([*self.runs, name])
        if len(self.runs) > self.most_runs:
            self.compact()
        return shared

    def compact(self) -> None:
        """One run of all runs; the old ones' files stay until ``remove_old``."""
        merged = self.spark.read.schema(self.COLUMNS).parquet(*(f"{self.path}/{run}" for run in self.runs))
        self._publish([self._write(merged)])

    def remove_old(self) -> None:
        """Removes the runs that the latest manifest does not list."""
        for f in self._fs.listStatus(self._at("")):
            name = f.getPath().getName()
            if name.startswith("run-") and name not in self.runs:
                self.spark.sql(f"DROP TABLE IF EXISTS run_{hashlib.md5(f'{self.path}/{name}'.encode()).hexdigest()}")
                self._fs.delete(f.getPath(), True)


def _emit(window: int, gram: int, flush: int = 1_000_000):
    """Rows (kind, h1, h2, doc_id, rid, pos) of windows under shared fingerprints: kind 1 repeats a window of this task."""

    def out(parts):
        h1, h2, doc, rid, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((pos, doc, h2, h1))
        h1, h2, doc, rid, pos = h1[order], h2[order], doc[order], rid[order], pos[order]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        kind = (doc != doc[np.flatnonzero(new)][np.cumsum(new) - 1]).astype(np.int8)
        for s in range(0, len(h1), 200_000):
            e = slice(s, s + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(kind[e]), pa.array(h1[e]), pa.array(h2[e]), pa.array(doc[e]), pa.array(rid[e]), pa.array(pos[e])], names=["kind", "h1", "h2", "doc_id", "rid", "pos"])

    def run(batches):
        parts, held = [], 0
        for b in batches:
            ids, rids, shared = b.column("doc_id").to_numpy(), b.column("rid").to_numpy(), b.column("shared")
            for n, (_, _, marks, h1, h2) in enumerate(_windows(b.column("text"), window, gram)):
                at = np.flatnonzero(np.isin(marks.view(np.int64), shared[n].values.to_numpy()))
                if len(at):
                    parts.append((h1[at].view(np.int64), (h2[at] & np.uint64(0x7FFFFFFF)).astype(np.int32), np.full(len(at), ids[n]), np.full(len(at), rids[n]), at.astype(np.int32)))
                    held += len(at)
                if held >= flush:
                    yield from out(parts)
                    parts, held = [], 0
        if held:
            yield from out(parts)

    return run


def _cut(window: int):
    """(rid, n_removed, kept_sha256, kept) of texts with the starts of their repeated windows."""

    def run(batches):
        for b in batches:
            ids, texts, starts = b.column("rid"), b.column("text"), b.column("starts")
            removed, sha, kept = [], [], []
            for n in range(len(ids)):
                words = texts[n].as_buffer().to_pybytes().split()
                at = starts[n].values.to_numpy()
                edge = np.zeros(len(words) + 1, np.int32)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                drop = np.cumsum(edge[:-1]) > 0
                text = b" ".join([w for w, d in zip(words, drop.tolist(), strict=True) if not d])
                removed.append(int(drop.sum())), sha.append(hashlib.sha256(text).hexdigest()), kept.append(text.decode())
            yield pa.RecordBatch.from_arrays([ids, pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], names=["rid", "n_removed", "kept_sha256", "kept"])

    return run


def dedup_substrings(docs: DataFrame, window: int = 50, gram: int = 10, batches: int = 2, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) for each row of ``docs`` (doc_id, text; other columns are not read).

    Words are maximal runs without ASCII white space, compared unchanged. Each word covered by a window whose words
    also start in a document of smaller doc_id is removed; windows are judged on the input. kept_sha256: lower-case hex
    of the kept words, joined by one space, in UTF-8; ``kept`` is that text, given where words were removed. Null and
    empty texts have no words. Rows of one doc_id are judged row by row against smaller doc_ids, and each has one row in
    the result; a null doc_id is neither smaller nor larger than any, so its rows keep all words and remove none. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("rid", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text"))
    facts = materialize(docs.mapInArrow(_facts(window, gram), "doc_id long, rid long, n_words long, sha string, marks array<long>"), "substring-facts")
    marks = facts.where("doc_id is not null").select("doc_id", "rid", F.explode("marks").alias("mark"))
    index = FingerprintIndex(spark, scratch_path(spark, "substring-index"))
    shared = None
    for i in range(batches):
        part = index.add(marks.where(F.expr(f"pmod(xxhash64(doc_id), {batches}) = {i}")).select("mark", "doc_id"))
        shared = part if shared is None else shared.union(part)
    # a fingerprint is shared for all documents that hold it, those of earlier batches too
    held = marks.join(shared.distinct(), "mark").groupBy("rid").agg(F.collect_set("mark").alias("shared"))
    held = materialize(held, "substring-held")
    with runtime_filters(spark):
        texts = docs.join(held.where("size(shared) > 0"), "rid").dropDuplicates(["rid"])
        texts = materialize(texts.select("rid", "doc_id", F.coalesce("text", F.lit("")).alias("text"), "shared"), "substring-texts")
    rows = materialize(texts.mapInArrow(_emit(window, gram), "kind byte, h1 long, h2 int, doc_id long, rid long, pos int"), "substring-windows")
    own = rows.where("kind = 0")
    # a window has a row or so a task here, so that none is a hot group, and one shuffle serves to find and to mark
    least = F.min("doc_id").over(Window.partitionBy("h1", "h2"))
    again = own.withColumn("least", least).where("doc_id > least").select("rid", "pos").union(rows.where("kind = 1").select("rid", "pos"))
    starts = again.groupBy("rid").agg(F.collect_list("pos").alias("starts"))
    cut = texts.select("rid", "text").join(starts, "rid").mapInArrow(_cut(window), "rid long, n_removed long, kept_sha256 string, kept string")
    out = facts.select("doc_id", "rid", "n_words", "sha").join(cut, "rid", "left")
    names = ["doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")]
    return out.select(*names, *([F.col("kept")] if with_text else []))
