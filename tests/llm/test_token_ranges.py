from pyspark.sql import functions as F

from ledgerloom.llm import token_files as K


def test_coded_documents_are_dealt_out_by_their_ids_alone(spark, tmp_path, monkeypatch):
    ids = [None, -(1 << 62), -3, 0, 1, 2, 2, 5, (1 << 53) + 1, (1 << 63) - 1]
    docs = spark.createDataFrame([(i, f"text {i} of some words") for i in ids], "doc_id long, text string").repartition(3)

    def twice(*_):
        raise AssertionError("a partitioning by range runs what it deals out twice")

    monkeypatch.setattr(type(docs), "repartitionByRange", twice)
    files = K.write_tokens(docs, folder=str(tmp_path))
    rows = K.read_tokens(files).orderBy("start").collect()
    assert [r.doc_id for r in rows] == ids
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    assert K.read_tokens(K.write_tokens(docs.limit(0), folder=str(tmp_path / "none"))).count() == 0


def test_ranges_count_the_bounds_below(spark):
    out = spark.range(6).select(K.range_of(F.col("id"), [1, 3, 3, 1 << 63]).alias("r"), K.range_of(F.col("id"), []).alias("one")).collect()
    assert [r.r for r in out] == [0, 0, 1, 1, 3, 3] and {r.one for r in out} == {0}
