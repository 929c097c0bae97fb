import random

from pyspark.sql import functions as F

from ledgerloom.functions import titles as N
from ledgerloom.operators import ledger as L
from ledgerloom.operators import settlement as S
from ledgerloom.sources import daily, statements


def test_draw_down_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, f"t{rng.randrange(4)}" if rng.random() < 0.9 else None, rng.randrange(-50, 80)) for i in range(300)]
    balances = [("t0", 500), ("t1", 0), ("t2", 90)]
    got = L.draw_down(spark.createDataFrame(rows, "i int, title_jp string, income long"), spark.createDataFrame(balances, "title_jp string, balance long"), ["i"]).collect()
    left, want = dict(balances), {}
    for i, t, x in rows:
        begin = left.get(t, 0) if t else 0
        want[i] = (begin, min(begin, x))
        left[t] = begin - min(begin, x)
    assert {r.i: (r.begin, r.decrease) for r in got} == want


def test_rates_lose_and_merge_no_rows(spark):
    rows = spark.createDataFrame([(1, 1, "A", 1, "1997-05")] * 2 + [(1, 2, "B", 2, "1997-05"), (1, 3, "C", None, "1997-05")], "upload_id int, line int, title_jp string, client_id int, batch string")
    rules = spark.createDataFrame([(1, 1, "1997-01", None, 5, 0.5), (2, 1, "1997-03", None, 5, 0.6), (3, 1, "1996-01", "1996-12", 1, 0.9)], "rule_id int, client_id int, effective_from string, effective_to string, priority int, rule_rate double")
    assert sorted((r.title_jp, r.rule_id) for r in L.rate_for(rows, rules).na.fill(0, ["rule_id"]).collect()) == [("A", 2), ("A", 2), ("B", 0), ("C", 0)]


def one(spark, title, f, *more):
    d = spark.createDataFrame([(title, *more)], ", ".join(["t string", *(f"m{i} string" for i in range(len(more)))]))
    r = d.select(f(F.col("t"), *(F.col(f"m{i}") for i in range(len(more)))).alias("x")).first().x
    return tuple(r) if hasattr(r, "_fields") or isinstance(r, tuple) else r


def test_forms_of_titles(spark):
    assert one(spark, "作品　Ａ１ （広告）", N.CANONICAL["shueisha"]) == "作品A1"
    assert one(spark, "作品 第３話 前編", N.mbj_title, "WT") == "作品" and one(spark, "作品 第3話", N.mbj_title, "EP") == "作品" and one(spark, "作品（１～３）", N.mbj_title, "EB") == "作品"
    assert one(spark, "作品 （３）", N.ichijinsha_volume) == ("作品", 3) and one(spark, "作品 12", N.ichijinsha_volume) == ("作品", 12) and one(spark, "作品", N.ichijinsha_volume) == ("作品", None)
    assert one(spark, "「作品」第 02 巻【分冊版】", N.sb_work) == ("作品", "2") and one(spark, "Work (3)", N.sb_work) == ("work", "3") and one(spark, "作品", N.sb_work) == ("作品", None)
    assert one(spark, "作品 12巻", N.dmm_series) == ("作品", "EB") and one(spark, "作品 3話 外伝2", N.dmm_series) == ("作品", "EP") and one(spark, "作品 4", N.dmm_series) == ("作品", "WT")


def test_kinds_and_siblings(spark):
    rows = [("作品",), ("作品 【完全版】",), ("別",), (None,), ("作品",)]
    got = N.with_sibling(spark.createDataFrame(rows, "title_jp string")).collect()
    assert sorted((r.title_jp or "", r.has_sibling) for r in got) == [("", False), ("作品", True), ("作品", True), ("作品 【完全版】", False), ("別", False)]
    lit = F.lit
    kinds = {
        "WR": [N.renta_kind(lit("作品【タテコミ】"), lit(True)), N.mediado_kind(lit("作品［改訂版］"), lit("TATE"), lit(False)), N.comico_kind(lit("作品【全年齢版】"), lit("x"), lit(0.4), lit(False)), N.mbj_kind(lit("作品改訂版"), lit("comic"), lit(""))],
        "WT": [N.renta_kind(lit("作品【タテコミ】"), lit(False)), N.line_ebj_kind(lit("作品"), lit("単話"), lit(False)), N.mbj_kind(lit("作品改訂版"), lit("Webtoon"), lit("")), N.comico_kind(lit("作品"), lit(None), lit(None), lit(False))],
        "EP": [N.renta_kind(lit("作品【分冊版】"), lit(True)), N.mediado_kind(lit("作品【連載版】"), lit("BOOK"), lit(False)), N.comico_kind(lit("作品"), lit("magazine_comic"), lit(0.4), lit(True)), N.mbj_kind(lit("作品第3話"), lit("x"), lit(""))],
        "WN": [N.line_ebj_kind(lit("作品（ノベル）"), lit("巻"), lit(False))],
    }
    for kind, cols in kinds.items():
        assert set(spark.range(1).select(*(c.alias(str(i)) for i, c in enumerate(cols))).first()) == {kind}


def test_amounts_of_summaries(spark):
    rows = [("【請求書】a_202403.pdf", "件名: 三月分 御請求金額 ￥1,100、消費税 100", "p"), ("b.txt", None, "p"), ("c明細.txt", "1,200円 小計", "p")]
    got = {r.file: r for r in statements.summarised(spark.createDataFrame(rows, "file string, text string, platform string")).collect()}
    a, b, c = got["【請求書】a_202403.pdf"], got["b.txt"], got["c明細.txt"]
    assert (a.raw_title, a.sales_month, a.tax_incl, a.tax_excl, a.consumption_tax, a.needs_review) == ("三月分", "2024-03-01", 1100.0, 1000.0, 100.0, False)
    assert (b.tax_incl, b.sales_month, b.needs_review) == (0.0, None, True) and (c.tax_incl, c.tax_excl, c.source_file_kind) == (1200.0, 1200.0, "detail_report_summary_fallback")


def test_sheets_and_folders_speak_for_a_platform(spark):
    files = spark.createDataFrame([("a.xlsx", "", ["精算書(JP)"]), ("BR1_RIVERSE_書籍", "202603_mediado", None), ("q", None, [])], "file string, folder string, sheets array<string>")
    assert {r.file: (r.platform, round(r.confidence, 3)) for r in statements.detected(files).collect()} == {"a.xlsx": ("comico", round(25 / 30, 3)), "BR1_RIVERSE_書籍": ("mediado", round(103 / 108, 3)), "q": (None, 0.0)}


def test_empty_tables(spark):
    lines = spark.createDataFrame([], "title_jp string, client_code string, channel_code string, gross_jpy double, rate_hint double, before_tax_jpy double, after_tax_jpy double, before_tax_income_jpy double, consumption_tax_jpy double, after_tax_income_jpy double, i int")
    alias = lambda out: spark.createDataFrame([], f"alias string, {out} string")
    none = S.settlement_records(lines, alias("client_code"), alias("title_id"), spark.createDataFrame([], "client_code string, title_id string, channel_code string, rate double"), spark.createDataFrame([], "client_code string, rate double"), spark.createDataFrame([], "title_id string, balance double"), ["i"])
    assert none.count() == 0
    uploads = spark.createDataFrame([], "upload_id int, at int")
    r = S.source_manifest(uploads, ["at", "upload_id"]).first()
    assert (r.upload_ids, r.uploads_truncated, r.observed_at_least) == ([], False, 0)
    rows = spark.createDataFrame([("a", "x"), (None, "y")], "title_jp string, z string")
    assert S.register_titles(rows.where("false"), spark.createDataFrame([], "title_jp string, genre string, company string, content_format string, place int")).count() == 0


def test_guessed_kinds_follow_the_earlier_ledger(spark):
    base = [("line", "a", "WN"), ("ebj", "b", "WT"), ("ebj", "b", "WR"), ("ebj", "g", "WT"), ("ebj", "g", "WR"), ("other", "c", "EP"), ("piccoma", "d", "WR"), ("piccoma", "d", "EB"), ("other", "f", "EB")]
    guess = "TYPE_HEURISTIC"
    rows = [("line", "a", "EP", guess), ("line", "a", "EP", None), ("ebj", "b", "EB", guess), ("ebj", "b", "WT", None), ("ebj", "g", "WT", guess), ("ebj", "c", "WT", guess), ("piccoma", "d", "WT", guess + ":chapter"), ("piccoma", "d", "EB", guess + ":volume"), ("other", "f", "WT", guess), ("line", None, "WT", guess)]
    got = S.reconcile_kinds(spark.createDataFrame(rows, "channel string, title_jp string, type string, note2 string"), spark.createDataFrame(base, "channel string, title_jp string, type string")).collect()
    found = {(r.channel, r.title_jp, r.raw_type or r.type, r.note2): (r.type, r.reconciliation) for r in got}
    assert len(got) == len(rows) and [found[r] for r in rows] == [("WN", "baseline"), ("EP", None), ("WR", "baseline"), ("WT", None), ("WT", "ambiguous"), ("EP", "baseline"), ("WR", "baseline"), ("EB", None), ("WT", None), ("WT", None)]


def test_scanned_titles(spark):
    mark = "SHUEISHA_OCR_TITLE"
    base = [("s", "EB", "山の話"), ("s", "EB", "川"), ("s", "EB", "海辺の家"), ("s", "EB", "空"), ("s", "EB", "森の道")]
    rows = [("s", "EB", "山のX話", mark), ("s", "EB", "川", mark), ("s", "EB", "海1辺の家", mark), ("s", "EB", "海辺の家2", mark), ("s", "EP", "空と", mark), ("s", "EB", "森のの道", None), ("s", "EB", None, mark)]
    got = S.reconcile_scanned(spark.createDataFrame(rows, "channel string, type string, title_jp string, note2 string"), spark.createDataFrame(base, "channel string, type string, title_jp string")).collect()
    assert len(got) == len(rows) and {r.raw_title: r.title_jp for r in got if r.raw_title} == {"山のX話": "山の話"}


def test_dmm_and_encodings(spark, tmp_path):
    rows = [("作品 第3話【x】 4", "2025/04/01～2025/04/30", "1,200", "FANZA"), ("作品", "2025/04/01～2025/04/30", "¥300", "fanza"), ("作品", "2025年04月05日", "10", "DMM"), ("作品", "2025/04/05", "0", "DMM"), (None, "2025/04/05", "5", None)]
    table = spark.createDataFrame(rows, "`商品タイトル` string, `集計期間` string, `売上金額` string, `配信サイト` string")
    got = {(r.title_jp, r.channel, str(r.sale_date)): r.sales_amount for r in daily.dmm_rows(table).collect()}
    assert got == {("作品", "DMM(FANZA)", "2025-04-01"): 1500, ("作品", "DMM", "2025-04-05"): 10}
    for name, raw in (("a", "題名".encode("cp932")), ("b", "題名".encode("utf-8-sig")), ("c", "題名".encode())):
        (tmp_path / name).write_bytes(raw)
    assert {r.text for r in daily.read_texts(spark, str(tmp_path)).collect()} == {"題名"}


def test_counts_of_renta_lose_the_tails_of_titles(spark):
    table = spark.createDataFrame([("作品 第10話【x】", "100", "2"), ("作品 11", "100", "1")], "`書名` string, `価格` string, `04-01 (火)` string")
    got = daily.unpivoted(table, "書名", "renta", 2025, price="価格", gross=False, tails=daily.RENTA_TAILS * 3).collect()
    assert [(r.title_jp, str(r.sale_date), r.sales_amount) for r in got] == [("作品", "2025-04-01", 300)]
