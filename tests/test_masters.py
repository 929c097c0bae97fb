from pyspark.sql import functions as F

from ledgerloom.operators import ledger as L
from ledgerloom.operators import masters as M
from ledgerloom.sources import reports as R


def test_lookup_and_tidy_titles(spark):
    got = spark.range(1).select(M.lookup_title(F.lit("花【分冊版】 12")), M.tidy_title(F.lit(" a　 b  [x］")), M.lookup_title(F.lit(None).cast("string"))).first()
    assert list(got) == ["花", "a b[x]", None]


def test_aliases_drop_last_punctuation_and_tell_collisions(spark):
    base = spark.createDataFrame([("c", "Abcdefgh!?", "abcdefgh!?"), ("c", "one", "same"), ("c", "two", "same"), ("c", "none", "")], "channel string, canonical string, signature string")
    got = {r.alias: r.canonical for r in L.title_aliases(base).collect()}
    assert got["abcdefgh"] == got["abcdefgh!"] == got["bcdefgh!?"] == "Abcdefgh!?" and got["same"] is None and "" not in got and "ame" not in got


def test_siblings_take_the_rest_from_the_least_row(spark):
    rows = spark.createDataFrame([("k", "b", 1, None, "u2"), ("k", "a", 2, None, "u1"), (None, "z", None, None, "")], "key string, kind string, x int, y int, src string")
    got = {r.key: r for r in L.consolidate_siblings(rows, ["key"], ["x", "y"], "src").collect()}
    assert (got["k"].kind, got["k"].x, got["k"].y, got["k"].source_count, got["k"].sources) == ("a", 3, None, 2, "u1,u2") and got[None].sources == ""


def test_companions_keep_rows_that_one_side_lacks(spark):
    rows = spark.createDataFrame([("k", 1, 1, "x", None), ("k", 1, 2, "y", "5"), ("k", 2, 1, "x", "7"), ("j", 2, 1, "q", " ")], "key string, upload_id int, line int, title string, fee string")
    roles = spark.createDataFrame([(1, "publisher_detail"), (2, "broker_summary")], "upload_id int, role string")
    got = sorted(map(tuple, L.reconcile_companions(rows, roles, ["key"], ["line"], ["fee"]).collect()))
    assert got == [("j", 2, 1, "q", " "), ("k", 1, 1, "x", "7"), ("k", 1, 2, "y", "5")]


def test_report_file_begins_with_the_mark(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", None)], "title string, amount int")
    R.write_csv_report(R.report_rows(rows, ["title"], ["amount"]), str(tmp_path / "r"))
    text = next((tmp_path / "r").glob("part-*")).read_bytes()
    assert text.startswith("\ufefftitle".encode()) and b"a,1" in text


def test_comparison_runs_replace_themselves_and_show_reviews(spark, tmp_path):
    path, one = str(tmp_path / "c"), spark.createDataFrame([(1, "x"), (2, "y")], "diff_id int, field string")
    for run in ("r1", "r2", "r1"):
        R.append_comparison(one, path, run)
    reviews = spark.createDataFrame([("r1", 1, "closed", 2), ("r1", 1, "kept", 1)], "run_id string, diff_id int, status string, reviewed_at int")
    assert R.read_comparison(spark, path).count() == 4
    assert {(r.diff_id, r.status) for r in R.read_comparison(spark, path, "r1", reviews).collect()} == {(1, "closed"), (2, "open")}


def test_titles_lose_the_marks_of_editions_only(spark):
    from ledgerloom.functions import text as T

    rows = [("作品（版面）", "作品", "版面", "作品"), ("作品（LDF）", "作品", "LDF", "作品"), ("作品【特装版】", "作品", "特装版", "作品"), ("作品 1巻", "作品 1巻", "オリジナル", "作品1巻"), ("小説家になろう", "小説家になろう", "オリジナル", "小説家になろう"), ("フルカラー作品 改訂版", "フルカラー作品", "オリジナル", "フルカラー作品"), ("Ａ～副題～　Ｂ！(巻)", "Ａ～副題～ Ｂ！", "オリジナル", "AB!"), ("題［完全版］", "題［完全版］".replace("完全版", ""), "オリジナル", "題")]
    df = spark.createDataFrame(rows, "t string, base string, kind string, core string")
    got = df.select("t", "base", "kind", "core", T.base_title(F.col("t")).alias("b"), T.product_type(F.col("t")).alias("k"), T.core_title(F.col("t")).alias("c")).collect()
    for r in got:
        assert (r.b, r.k, r.c) == (r.base, r.kind, r.core), r.t


def test_korean_names(spark):
    master = spark.createDataFrame([("作品A", "가", 1), ("作品B（ノベル）", "나", 2), ("作品B", "다", 3), ("題【x】", "라", 4), ("題", None, 5)], "title_jp string, title_kr string, place int")
    rows = spark.createDataFrame([("作品A",), ("作品A【完全版】",), ("作品B（版面）",), ("題 ~y~ 改訂版",), ("無",), (None,)], "title_jp string")
    got = {r.title_jp: r.matched_kr for r in M.match_korean(rows, master).collect()}
    assert got == {"作品A": "가", "作品A【完全版】": "가 완전판", "作品B（版面）": "다", "題 ~y~ 改訂版": "라 개정판", "無": "", None: ""}
    names = spark.createDataFrame([("ebj",), ("line",), ("ＸＹ",), (None,)], "c string")
    assert [r.x for r in names.select(M.channel_kept(F.col("c")).alias("x")).collect()] == ["ebookjapan", "LINEマンガ", "ＸＹ", None]
