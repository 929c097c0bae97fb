import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.functions import titles as N
from ledgerloom.operators import ledger as L
from ledgerloom.operators import seeding
from ledgerloom.operators import settlement as S
from ledgerloom.sources import overrides as O
from ledgerloom.sources import readers

CELLS = "file string, sheet string, row_index int, cells array<string>"


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_rules_by_priority_exactness_and_length(spark):
    rules = spark.createDataFrame([("ab", "prefix", 1, "two"), ("abc", "prefix", 1, "three"), ("abcd", "exact", 1, "exact"), ("abx", "prefix", 0, "first"), ("abxy", "exact", 2, "late"), ("", "prefix", 0, "none")], O.RULES)
    rows = spark.createDataFrame([("ab",), ("abz",), ("abcz",), ("abcd",), ("abxy",), ("b",), (None,), ("abz",)], "t string")
    got = sorted((r.t or "", r.series) for r in O.by_rules(rows, rules, "t", ["series"]).collect())
    assert got == [("", None), ("ab", "two"), ("abcd", "exact"), ("abcz", "three"), ("abxy", "first"), ("abz", "two"), ("abz", "two"), ("b", None)]
    assert {r.series for r in O.by_rules(rows, rules.limit(0), "t", ["series"]).collect()} == {None}


def test_kadokawa_rolls_series_up(spark):
    rows = [("f", "盗掘王 1", "1,100", "2026/5/29", "", "原稿料"), ("f", " 盗掘王【分冊版】", "220", "2026/5/29", "", ""), ("f", "消費税端数差額調整", "-1", "2026/5/29", "", ""), ("f", "別", "110", "2026/5/29", "", "版権料"), ("f", "別", "110", "2026/5/29", "", "版権料"), ("g", "別", "50", "", "2026/05/14", "x"), ("g", "別", "0", "", "2026/05/14", "x")]
    table = spark.createDataFrame(rows, "file string, `書名` string, `合計金額（明細）` string, `支払日` string, `計上日付` string, `勘定科目` string")
    own = readers.lines(readers.text_table(table, O.KADOKAWA_READER, F.col("file")), "kadokawa", O.KADOKAWA_READER)
    got = sorted((r.file, r.title, r.kind, r.total, r.after_tax_income, r.row_count, str(r.sales_month), str(r.settlement_date)) for r in O.kadokawa_records(own, O.kadokawa_rules(spark)).collect())
    april = ("2026-04-30", "2026-05-29")
    assert got == [("f", "別", "PP", 110, 100, 1, *april), ("f", "別", "PP", 110, 100, 1, *april), ("f", "盗掘王", "EB", 1319, 1199, 3, *april), ("g", "別", "EB", 50, 45, 1, "2026-05-01", "None")]


def test_unext_is_set_against_its_summary(spark):
    head = ["タイトル名", "売上", "分配額", "料率"]
    cells = [("hol1_202601.xlsx", "ヘッダー", 2, ["集計対象期間", "2026/03/01-2026/03/31"]), ("hol1_202601.xlsx", "コンテンツ明細", 1, head)]
    cells += [("hol1_202601.xlsx", "コンテンツ明細", i, r) for i, r in enumerate([["A", "1000", "400.6", "40"], ["A", "5", "1", "0"], ["B", "10", "4", ""], ["C", "10", "4", ""], ["合計", "9", "9", ""]], 2)]
    cells += [("hol1_202601.xlsx", "タイトル一覧", i, r) for i, r in enumerate([["No", "タイトル名", "当月分配金額(円)"], ["1", "A", "401"], ["2", "B", "6"], ["3", "D", "7"], ["4", None, "7"]], 1)]
    cells += [("hol1_202602.xlsx", "コンテンツ明細", 1, head), ("hol1_202602.xlsx", "コンテンツ明細", 2, ["A", "1", "1", ""])]
    frame = spark.createDataFrame(cells, CELLS)
    own = readers.lines(readers.sheet_table(frame, readers.READERS["u_next"]), "u_next")
    out = O.unext_records(own, O.unext_months(frame), O.unext_summary(frame))
    got = sorted((r.file[5:11], r.title, str(r.sales_month), r.total, r.after_tax_income, r.stated, r.differs) for r in out.collect())
    assert got[:3] == [("202601", "A", "2026-03-01", 1106, 402, 401.0, False), ("202601", "B", "2026-03-01", 11, 4, 6.0, True), ("202601", "C", "2026-03-01", 11, 4, None, False)]
    assert got[3:] == [("202601", "D", "2026-03-01", None, None, 7.0, True), ("202602", "A", "2026-02-01", 1, 1, None, False)]
    assert O.unext_records(own, O.unext_months(frame), O.unext_summary(frame), spellings=(("C", "B"),)).where("title = 'B' and after_tax_income = 8").count() == 1


def test_kinds_that_are_guessed(spark):
    def noted(platform, columns, *rows):
        table = spark.createDataFrame([("p_20260401123456.csv", *r) for r in rows], "file string, " + ", ".join(f"`{c}` string" for c in columns))
        own = readers.lines(readers.text_table(table, readers.READERS[platform], F.col("file")), platform)
        return {r.title: (r.kind, r.note2) for r in own.collect()}

    guess = S.GUESSED_NOTE
    columns = ["タイトル名", "書店名", "販売単位区分", "販売額計", "許諾額計"]
    got = noted("line_ebj", columns, ("作品A【タテヨミ】［改訂版］", "LINE", "単話", "1", "1"), ("作品B【タテヨミ】", "E", "単話", "1", "1"), ("作品B【タテヨミ】[完全版]", "E", "単話", "1", "1"), ("作品C", "E", "単話", "1", "1"), ("作品C[完全版]", "E", "巻", "1", "1"), ("作品D【分冊版】", "E", "", "1", "1"), ("（ノベル）作品E", "E", "", "1", "1"))
    assert got == {"作品A【タテヨミ】［改訂版］": ("WR", None), "作品B【タテヨミ】": ("WR", None), "作品B【タテヨミ】[完全版]": ("WT", None), "作品C": ("WT", guess), "作品C[完全版]": ("EB", guess), "作品D【分冊版】": ("EP", guess), "（ノベル）作品E": ("WN", None)}
    columns = ["シリーズ名", "書名", "売上金額", "率", "支払", "種別"]
    got = noted("mechacomic", columns, ("A", "x", "1", "1", "1", "話"), ("A【完全版】", "x", "1", "1", "1", "話"), ("B", "x", "1", "1", "1", "巻"), ("C分冊版", "x", "1", "1", "1", "巻"), ("D改訂版", "x", "1", "1", "1", "巻"), ("E", "x", "1", "1", "1", ""), ("F小説", "x", "1", "1", "1", ""))
    assert got == {"A": ("WR", guess), "A【完全版】": ("WT", None), "B": ("EB", guess), "C分冊版": ("EP", None), "D改訂版": ("WR", None), "E": ("WT", guess), "F小説": ("WN", None)}


def test_siblings_are_sought_in_their_file_alone(spark):
    rows = spark.createDataFrame([("f", "A"), ("g", "A"), ("g", "A【完全版】")], "file string, t string")
    assert sorted((r.file, r.t, r.has_sibling) for r in N.with_sibling(rows, "t", ["file"]).collect()) == [("f", "A", False), ("g", "A", True), ("g", "A【完全版】", False)]


def test_piccoma_marks_its_guesses(spark):
    summary = spark.createDataFrame([("f", t, "50", "10", "5", "0", "0") for t in ("A", "B（ノベル）", "C")], "file string, title string, rate string, current_episodes string, current_volumes string, final_episodes string, final_volumes string")
    detail = spark.createDataFrame([], "title string, kind string, sales double")
    known = spark.createDataFrame([("C", "WR")], "title string, kind string")
    got = sorted((r.title, r.kind, r.note2) for r in readers.piccoma_lines(summary, detail, F.lit("2026-04-01").cast("date"), known).collect() if r.note2)
    assert got == [("A", "EB", "TYPE_HEURISTIC:volume"), ("A", "WT", "TYPE_HEURISTIC:chapter"), ("B（ノベル）", "EB", "TYPE_HEURISTIC:volume")]


def test_rows_without_a_title_meet_no_window(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), (None, 1, 5), (None, 2, -3)], "title_jp string, i int, income long")
    out = L.draw_down(rows, spark.createDataFrame([("a", 8)], "title_jp string, balance long"), ["i"])
    assert sorted((r.title_jp or "", r.i, r.balance, r.begin, r.decrease) for r in out.collect()) == [("", 1, 0, 0, 0), ("", 2, 0, 0, -3), ("a", 1, 8, 8, 5), ("a", 2, 8, 3, 3)]
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("isnull(title_jp") == 1 and text.count("isnotnull(title_jp") >= 1


def test_seeds_are_loaded_once_and_again_alike(spark, tmp_path):
    day = dt.date(2026, 1, 1)
    rows = [
        (1, " A ", "에이", "co", "恋愛", "L", "ウェブ", "連載中です", [("cmoa", day), ("x", day), ("renta", None)]),
        (2, "A", None, None, "BL", None, "小説", "-", [("cmoa", dt.date(2026, 2, 1))]),
        (3, "B", "비", "co", None, "L2", None, "謎", []),
        (4, " ", "x", "lost", None, None, None, None, None),
    ]
    schema = "place int, title_jp string, title_kr string, company string, genre string, label string, form string, status string, launches array<struct<code:string,launch_date:date>>"
    list_ = spark.createDataFrame(rows, schema)
    platforms = spark.createDataFrame([("p1", "cmoa"), ("p2", "renta")], "id string, code string")
    empty = {n: spark.createDataFrame([], s) for n, (s, _) in seeding.TABLES.items()}
    empty["titles"] = spark.createDataFrame([("old", "B", "k", "NOVEL", "s", "c0", "g0", "l0"), ("z", "Z", *[None] * 6)], seeding.TABLES["titles"][0])
    first = seeding.seeded(list_, empty, platforms)
    named = {r.title_jp: r for r in first["titles"].join(first["companies"].selectExpr("id as company_id", "name as company"), "company_id", "left").join(first["labels"].selectExpr("id as label_id", "name as label"), "label_id", "left").join(first["genres"].selectExpr("id as genre_id", "name_jp as genre"), "genre_id", "left").collect()}
    assert tuple(named["A"][c] for c in ("title_kr", "content_format", "serial_status", "company", "genre", "label")) == (None, "NOVEL", None, "co", "BL", "L")
    assert (named["B"].id, named["B"].genre_id, named["B"].label, named["B"].serial_status, named["Z"].id) == ("old", "g0", "L2", "謎", "z")
    assert [(r.platform_id, str(r.launch_date)) for r in first["availability"].collect()] == [("p1", "2026-02-01")]
    assert {r.name for r in first["companies"].collect()} == {"co"} and {r.name_jp for r in first["genres"].collect()} == {"恋愛", "BL"}
    second = seeding.seeded(list_, first, platforms)
    assert all(rows_of(first[n]) == rows_of(second[n]) for n in first)
    path = f"file://{tmp_path}/seeds"
    stored = {n: rows_of(t.read()) for n, t in seeding.store_seeds(spark, path, list_, platforms, "b1").items()}
    again = seeding.store_seeds(spark, path, list_, platforms, "b1")
    assert stored == {n: rows_of(t.read()) for n, t in again.items()} and again["titles"].version().number == 1
    later = seeding.store_seeds(spark, path, list_, platforms, "b2")
    assert stored == {n: rows_of(t.read()) for n, t in later.items()} and later["titles"].version().number == 2
    assert {r.title_id for r in later["availability"].read().collect()} <= {r.id for r in later["titles"].read().collect()}
