import threading

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize, scratch_scope
from ledgerloom.llm.decontamination import _starts

SCHEMA = "doc_id long, text string, lang string, source string, h string"
TEXT = " ".join(f"w{i}" for i in range(80))
OTHER = " ".join(f"v{i}" for i in range(80))
ITEM = " ".join(f"v{i}" for i in range(20, 45))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(7, ITEM), (8, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.fixture
def docs(spark):
    rows = [(1, TEXT), (1, TEXT), (2, f"{TEXT} more"), (3, OTHER), (None, " ".join(f"u{i}" for i in range(70))), (4, None), (5, ""), (6, "short")]
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None if i == 2 else "s", "own") for i, t in rows], SCHEMA).repartition(3)


def ids(df):
    return sorted((r.doc_id if r.doc_id is not None else -1 for r in df.collect()))


def test_quality(spark, docs, folder):
    out = corpus_pipeline.quality(spark, docs, folder)
    assert ids(out) == [-1, 1, 1, 2, 3] and out.columns == docs.columns


def test_near_duplicates(spark, docs, folder):
    out = corpus_pipeline.near_duplicates(spark, docs, folder)
    assert ids(out) == [-1, 1, 1, 3, 4, 5, 6] and out.columns == docs.columns


def test_decontaminate(spark, docs, folder):
    out = corpus_pipeline.decontaminate(spark, docs, folder)
    assert ids(out) == [-1, 1, 1, 2, 4, 5, 6] and out.columns == docs.columns


def test_mix_sources(spark, docs, folder):
    out = corpus_pipeline.mix_sources(spark, docs, folder)
    assert out.columns == docs.columns and set(ids(out)) <= {-1, 1, 2, 3, 4, 5, 6}
    assert ids(out).count(1) % 2 == 0 and ids(out) == ids(corpus_pipeline.mix_sources(spark, docs, folder))


def test_shard_keeps_the_documents(spark, docs, folder):
    out = corpus_pipeline.shard(spark, docs, folder).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.text or "")
    assert sorted(((r.doc_id, r.text, r.lang, r.source) for r in out), key=str) == sorted(((r.doc_id, r.text, r.lang, r.source) for r in docs.collect()), key=str)
    assert len({(r.shard, r.slot) for r in out}) == len(out) == 8 and {r.slot for r in out} == {0}
    assert all(r.size == len((r.text or "").encode()) + 1 for r in out) and key(out[0])


def test_run_writes_a_folder_a_shard(spark, docs, folder, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs.drop("h").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert all("/shard=" in f for f in out.inputFiles()) and {"text", "doc_id", "lang", "source", "shard", "slot", "size", "h"} <= set(out.columns)


def test_scopes_of_two_threads_are_apart(spark):
    tables = {}

    def hold():
        with scratch_scope(spark):
            tables["theirs"] = materialize(spark.range(3), "theirs")
            go.set()
            done.wait(60)
            tables["count"] = tables["theirs"].count()

    go, done = threading.Event(), threading.Event()
    t = threading.Thread(target=hold)
    t.start()
    go.wait(60)
    with scratch_scope(spark):
        materialize(spark.range(2), "ours").count()
    done.set()
    t.join()
    assert tables["count"] == 3


def test_starts_of_dense_texts_are_made_once(spark):
    rows = [(list(range(20_000)), 20_004, 2004, 2000, 1600), ([0, 1, 5, 6, 7], 12, 8, 4, 3), ([3, 9], 30, 8, 4, 3), ([0], 5, 5, 1, 1)]
    out = spark.createDataFrame(rows, "p array<int>, n int, len int, size int, need int").select("*", _starts().alias("s")).collect()

    def plain(p, n, length, size, need):
        return [s for s in range(max(0, n - length) + 1) if sum(s <= x < s + size for x in p) >= need]

    for r in out[1:]:
        assert list(r.s) == plain(r.p, r.n, r.len, r["size"], r.need)
    assert list(out[0].s) == list(range(18_001)) and F is not None
