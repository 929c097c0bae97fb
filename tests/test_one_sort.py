"""Queries whose rows a task must not sort several times over."""

from pyspark.sql import functions as F

from ledgerloom.operators import ledger as L


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(spark):
    data = [(1, 1, "a", "x", "t", 5, None), (1, 2, "a", "x", "u", 6, 1), (3, 1, "a", "x", "t", 7, 9), (4, 1, "a", "y", "t", 1, 2), (None, 1, "a", "y", "s", 3, 4), (6, 1, None, "x", "t", 8, 1)]
    return spark.createDataFrame(data, "upload_id long, line int, client string, channel string, title string, gross long, fee long")


def test_companions_join_no_plan_back_to_the_rows(spark):
    rows = _rows(spark)
    roles = rows.select("upload_id").distinct().withColumn("role", F.expr("case upload_id when 1 then 'publisher_detail' when 3 then 'broker_summary' end"))
    out = L.reconcile_companions(rows, roles, ["client", "channel"], ["title", "line"], ["fee"])
    assert sorted(map(tuple, out.select("upload_id", "line", "client", "channel", "gross", "fee").collect()), key=str) == [(1, 1, "a", "x", 5, 9), (1, 2, "a", "x", 6, 1), (6, 1, None, "x", 8, 1)]
    # the rows meet their roles and nothing else: a join for each of the two branches
    assert _plan(out).count("Join ") <= 2


def test_largest_upload_reads_its_rows_once(spark):
    out = L.largest_upload(_rows(spark), ["client", "channel"])
    assert sorted((r.upload_id or 0, r.line) for r in out.collect()) == [(0, 1), (1, 1), (1, 2), (6, 1)]
    assert "Join" not in _plan(out)


def test_effective_rate_takes_each_line_once_without_a_distinct(spark):
    from ledgerloom.plans.registry import QUERIES

    plan = QUERIES["e03_effective_rate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate [" in x and all(c in x for c in ("upload_id", "line", "title_jp"))]
