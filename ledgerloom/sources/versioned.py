"""A table on shared storage in versions: its parts are rewritten one by one and published by a manifest, all or none.

``<path>/manifests/<n>.json`` lists, for each value of the part column, the folder that holds its rows in version n. A
change writes the parts it touches to a folder of its own and then puts the next manifest there by a rename that fails
where one exists. Until then readers see the version before, so that a job that dies in between leaves nothing but an
unread folder. A batch is named; one that a version already holds is not applied again.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ACTION = "change"


class Conflict(RuntimeError):
    """Another writer has published first."""


@dataclass(frozen=True)
class Version:
    """``parts``: the folder of each part; ``batches``: what each batch has done, as counts of its actions."""

    number: int = 0
    parts: dict[str, str] = field(default_factory=dict)
    batches: dict[str, dict[str, int]] = field(default_factory=dict)


class VersionedTable:
    """``schema``: the rows' columns (as DDL) without ``part``, a string column by which ``part_of`` deals them out."""

    def __init__(self, spark: SparkSession, path: str, schema: str, part: str, part_of: Callable[[], object]) -> None:
        self.spark, self.path, self.schema, self.part, self.part_of = spark, path.rstrip("/"), T.StructType.fromDDL(schema), part, part_of
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    # ------------------------------------------------------------ files
    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("x").getFileSystem(self.conf)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [f.getPath().getName() for f in self._fs().listStatus(at)] if self._fs().exists(at) else []

    def _read(self, name: str) -> str:
        stream = self._fs().open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        """Writes a file under another name and renames it; fails where ``name`` exists."""
        draft = self._at(f"drafts/{uuid.uuid4().hex}")
        stream = self._fs().create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.getFileSystem(self.conf).getUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        self._fs().mkdirs(self._at("manifests"))
        try:
            files.rename(draft, self._at(name), options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception.getClass()):
                raise
            self._fs().delete(draft, False)
            raise Conflict(name) from e

    # ------------------------------------------------------------ versions
    def version(self, number: int | None = None) -> Version:
        """The latest version, or one by its number; 0 is the empty table."""
        if number is None:
            number = max((int(n[:-5]) for n in self._names("manifests") if n.endswith(".json")), default=0)
        return Version(**json.loads(self._read(f"manifests/{number:08d}.json"))) if number else Version()

    def read(self, parts: list[str] | None = None, version: Version | None = None) -> DataFrame:
        """The rows of all parts, or of some: no other part's files are opened."""
        version = version or self.version()
        folders = [version.parts[p] for p in (version.parts if parts is None else parts) if p in version.parts]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*(f"{self.path}/{f}" for f in sorted(folders))) if folders else self.spark.createDataFrame([], self.schema)

    def parts_of(self, rows: DataFrame) -> list[str]:
        """The parts that rows belong to: as many as months or the like, not as rows."""
        return sorted(r[0] for r in rows.select(self.part_of().alias("p")).where("p is not null").distinct().collect())

    def change(self, batch: str, touched: Callable[[Version], list[str]], content: Callable[[DataFrame], DataFrame], tries: int = 5) -> dict[str, int]:
        """Rewrite the touched parts as ``content`` of their rows (with ``change``, an action a row), once for each batch.

        Returns how many rows of each action the batch has. Where another writer was faster, the parts are computed
        again from its version.
        """
        for _ in range(tries):
            base = self.version()
            if batch in base.batches:
                return base.batches[batch]
            parts = touched(base)
            folder = f"data/{uuid.uuid4().hex}"
            rows = content(self.read(parts, base)).withColumn(self.part, self.part_of())
            # a part of many rows is dealt to several tasks
            rows.hint("rebalance", self.part).write.partitionBy(self.part).parquet(f"{self.path}/{folder}")
            new = {unquote(n.split("=", 1)[1]): f"{folder}/{n}" for n in self._names(folder) if n.startswith(f"{self.part}=")}
            if odd := set(new) - set(parts):
                raise ValueError(f"rows of parts that are not touched: {sorted(odd)}")
            written = self.spark.read.schema(T.StructType([T.StructField(ACTION, T.StringType())])).parquet(*(f"{self.path}/{f}" for f in new.values())) if new else None
            counts = {r[0]: r[1] for r in written.groupBy(ACTION).count().collect()} if new else {}
            kept = {k: v for k, v in base.parts.items() if k not in parts}
            version = Version(base.number + 1, {**kept, **new}, {**base.batches, batch: counts})
            try:
                self._put(f"manifests/{version.number:08d}.json", json.dumps(version.__dict__))
                return counts
            except Conflict:
                self._fs().delete(self._at(folder), True)
        raise Conflict(f"{batch}: {tries} tries")

    def remove_old(self, keep: int = 2) -> None:
        """Remove the folders that none of the last ``keep`` versions reads; no writer may be at work."""
        last = self.version().number
        used = {f.split("/")[1] for n in range(max(1, last - keep + 1), last + 1) for f in self.version(n).parts.values()}
        for name in set(self._names("data")) - used:
            self._fs().delete(self._at(f"data/{name}"), True)
        for n in range(1, last - keep + 1):
            self._fs().delete(self._at(f"manifests/{n:08d}.json"), False)


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared one that the cluster names; on one machine without one (tests), a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


def stored(rows: DataFrame, tag: str) -> DataFrame:
    """``rows`` written to a new folder and read again, for what several steps read."""
    path = shared_folder(rows.sparkSession, tag)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
