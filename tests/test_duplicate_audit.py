from ledgerloom.operators import ledger as L


def test_uploads_of_a_key_are_not_counted_apart(spark):
    rows = spark.createDataFrame([("a", "t", 1), ("a", "t", 1), ("a", "u", 1), ("a", "u", 2), ("a", "v", None), ("a", "v", 3), ("b", "t", None), ("b", "t", None)], "channel string, title string, upload_id long")
    out = L.duplicate_audit(rows, "channel", ["channel", "title"])
    assert sorted(map(tuple, out.collect())) == [("a", 6, 3, 3, 1), ("b", 2, 1, 1, 0)]
    assert "distinct" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
