import datetime
import threading

import pytest

from ledgerloom.operators import analytics as A
from ledgerloom.operators import sales_store as S
from ledgerloom.sources.versioned import Conflict, VersionedTable

ROWS = "title_jp string, channel string, sale_date date, sales_amount long, sales_amount_gross long"
KEY = ["title_jp", "channel", "sale_date", "data_source"]


def batch(spark, *rows):
    return spark.createDataFrame([(t, c, datetime.date.fromisoformat(d) if d else None, a, g) for t, c, d, a, g in rows], ROWS)


def held(table, *columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in table.read().collect())


@pytest.fixture
def table(spark, tmp_path):
    return S.sales_table(spark, f"file://{tmp_path}/sales")


def test_an_upsert_rewrites_its_months_alone(spark, table):
    first = batch(spark, ("a", "x", "2024-01-31", 1, 5), ("a", "x", "2024-01-31", 2, None), ("b", "x", "2024-02-01", 4, None), ("n", None, "2024-03-01", 1, 1), ("lost", "x", None, 1, 1))
    assert S.store_sales(table, first, "manual", "b1") == {"inserted": 3}
    before = table.version()
    second = batch(spark, ("a", "x", "2024-01-31", 9, None), ("c", "x", "2024-01-02", 7, 8), ("n", None, "2024-03-01", 6, None))
    assert S.store_sales(table, second, "manual", "b2") == {"inserted": 1, "updated": 2}
    assert S.store_sales(table, second, "manual", "b2") == {"inserted": 1, "updated": 2}  # a retry changes nothing
    after = table.version()
    assert (before.number, after.number) == (1, 2)
    assert {m for m in after.parts if after.parts[m] != before.parts.get(m)} == {"2024-01", "2024-03"}
    assert held(table, "title_jp", "channel", "sales_amount", "sales_amount_gross", "batch") == [("a", "x", "9", "5", "b2"), ("b", "x", "4", "None", "b1"), ("c", "x", "7", "8", "b2"), ("n", "None", "6", "1", "b2")]
    assert table.read(version=before).count() == 3
    assert all("2024-01" in f for f in table.read(["2024-01"]).inputFiles())
    assert S.store_sales(table, second.limit(0), "manual", "b3") == {}


def test_a_failed_change_leaves_the_version_before(spark, table):
    S.store_sales(table, batch(spark, ("a", "x", "2024-01-31", 1, 5)), "manual", "b1")
    bad = batch(spark, ("a", "x", "2024-01-31", 1, 5), ("b", "x", "2024-01-30", 0, 5)).selectExpr("title_jp", "channel", "sale_date", "10 div sales_amount as sales_amount", "sales_amount_gross")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        S.store_sales(table, bad, "manual", "b2")
    assert table.version().number == 1 and held(table, "title_jp", "sales_amount") == [("a", "1")]
    S.store_sales(table, batch(spark, ("a", "x", "2024-01-31", 2, 5)), "manual", "b3")
    table.remove_old(1)
    assert len(table._names("data")) == 1 and held(table, "sales_amount") == [("2",)]


def test_writers_do_not_lose_each_others_rows(spark, table):
    def store(i):
        S.store_sales(table, batch(spark, (f"t{i}", "x", "2024-01-31", i, None)), "manual", f"b{i}")

    threads = [threading.Thread(target=store, args=(i,)) for i in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert held(table, "title_jp") == [("t0",), ("t1",), ("t2",)] and table.version().number == 3
    with pytest.raises(Conflict):
        table._put("manifests/00000003.json", "{}")
    with pytest.raises(ValueError, match="not touched"):
        table.change("odd", lambda _: ["2024-02"], lambda _: table.read().selectExpr("*", "'kept' as change"))


def test_the_confirmed_source_goes_before(spark, table):
    S.store_by_precedence(table, batch(spark, ("a", "x", "2024-01-10", 1, None), ("a", "x", "2024-02-20", 2, None), ("a", "x", "2024-03-05", 3, None)), "sokuhochi", "b1", preliminary=True)
    counts = S.store_by_precedence(table, batch(spark, ("b", "x", "2024-01-15", 5, None), ("a", "x", "2024-03-01", 6, None)), S.CONFIRMED, "b2")
    assert counts == {"inserted": 2, "kept": 2}
    assert held(table, "title_jp", "sale_date", "sales_amount") == [("a", "2024-01-10", "1"), ("a", "2024-03-01", "6"), ("a", "2024-03-05", "3"), ("b", "2024-01-15", "5")]
    S.store_by_precedence(table, batch(spark, ("a", "x", "2024-03-01", 7, None), ("a", "x", "2024-03-02", 8, None)), "sokuhochi", "b3")
    assert ("a", "2024-03-01", "6") in (now := held(table, "title_jp", "sale_date", "sales_amount")) and ("a", "2024-03-02", "8") in now and len(now) == 5


def test_a_cumulative_file_replaces_its_days(spark, table):
    S.store_sales(table, batch(spark, *((t, c, d, 1, None) for t in "ab" for c in "xy" for d in ("2024-01-01", "2024-01-20", "2024-02-10"))), "cum", "b1")
    S.store_sales(table, batch(spark, ("a", "x", "2024-01-20", 50, None)), "other", "b2")
    assert S.store_cumulative(table, batch(spark, ("a", "x", "2024-01-15", 2, None), ("c", "x", "2024-02-10", 3, None)), "cum", "b3") == {"inserted": 2, "kept": 9}
    assert [r for r in held(table, "channel", "title_jp", "sale_date", "sales_amount") if r[0] == "x"] == [("x", "a", "2024-01-01", "1"), ("x", "a", "2024-01-15", "2"), ("x", "a", "2024-01-20", "50"), ("x", "b", "2024-01-01", "1"), ("x", "c", "2024-02-10", "3")]


def test_views_read_changed_months_alone(spark, table):
    views = S.KeptViews(table)
    assert views.refresh() == [] and views.title_sales().count() == 0
    days = ("2024-01-01", "2024-01-02", "2024-02-01", "2024-03-01")
    S.store_sales(table, batch(spark, *((t, c, d, len(t + d) + i, i) for i, t in enumerate(("a", "b", "cc")) for c in "xy" for d in days)), "manual", "b1")
    assert views.refresh() == ["2024-01", "2024-02", "2024-03"]
    S.store_sales(table, batch(spark, ("a", "z", "2024-02-01", 100, None), ("d", "x", "2024-04-01", 1, 1)), "other", "b2")
    S.store_by_precedence(table, batch(spark, ("b", "x", "2024-03-01", 5, None)), S.CONFIRMED, "b3")
    assert views.stale(views.partial) == ["2024-02", "2024-03", "2024-04"]
    kept = views.deduped.version().parts["2024-01"]
    assert views.refresh() == ["2024-02", "2024-03", "2024-04"] and views.refresh() == []
    assert views.deduped.version().parts["2024-01"] == kept
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(views.title_sales()) == plain(A.title_sales(table.read()).select(*views.title_sales().columns))
    assert plain(views.daily_sales()) == plain(A.deduped(table.read()))


def test_parts_are_any_string(spark, tmp_path):
    schema = "k string, v int"
    t = VersionedTable(spark, f"file://{tmp_path}/t", schema, "p", lambda: S.F.col("k"))
    t.change("1", lambda _: ["a b", "c"], lambda _: spark.createDataFrame([("a b", 1), ("c", 2)], schema).selectExpr("*", "'x' as change"))
    t.change("2", lambda _: ["c"], lambda old: old.where("false").selectExpr("*", "'x' as change"))
    assert t.read().collect() == [("a b", 1)]
