import random

from ledgerloom.operators import settlement as S
from ledgerloom.sources import notices as N

FILE = "file string, text string"


def listed(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_offsets_of_advances_meet_their_volume(spark):
    text = "御中 国内電子 作品 (3) 集計期間：2026年4月～6月 1,200 国内電子 別の 作品（３）（MG） 集計期間：2026年05月 -100 国内電子 別の作品　３ 集計期間: 2025年12月～2026年1月 ３00 国内電子 別の作品 (3) 集計期間：2026年5月 7 国内電子 単巻 集計期間：2026年5月 11"
    files = spark.createDataFrame([("a", text, "x/支払_20260625"), ("b", "国内電子 作品 集計期間：なし 国内電子 (2)（MG） 集計期間：2026年5月 5", "20261345"), ("c", None, None), ("d", "国内電子 作 2 集計期間：2026年5月 なし", None)], f"{FILE}, folder string")
    records, problems = N.ichijinsha_details(files)
    got = listed(records, "place", "title", "after_tax_income", "before_tax_income", "consumption_tax")
    assert got == [(0, "作品（３）", 1200, 1320, 120), (2, "別の作品（３）", 200, 220, 20), (3, "別の作品（３）", 7, 8, 1), (4, "単巻", 11, 12, 1)]
    assert {str(r.sales_month) for r in records.collect()} == {"2026-06-01", "2026-01-01", "2026-05-01"}
    assert {str(r.deposit_date) for r in records.collect()} == {"2026-06-25"}
    assert listed(problems, "file", "problem") == [("b", "no month"), ("b", "no rows"), ("b", "offset without a row"), ("c", "no rows"), ("d", "no amount"), ("d", "no rows")]


def test_ranges_of_volumes_add_up_to_the_line(spark):
    rows = [
        ("f", 1, "電子版「作品」第7～9巻", 3, 100, 310),
        ("f", 2, "素材費「作品」１-２巻", None, None, 101),
        ("f", 3, "単行本「作品」第7～9巻", 4, 100, 310),
        ("f", 4, "挿絵 原稿料（税抜）", 1, 5, 5),
        ("20周年記念", 5, "「素材費の国」", 1, 5, 5),
        ("f", 6, None, None, None, 9),
        ("f", 7, "電子 第5～2巻「逆」", None, None, 9),
    ]
    lines = spark.createDataFrame([(*r, None, "2026-06-01") for r in rows], "file string, place int, title string, quantity int, unit_price long, amount long, sales_month string, settlement_month string")
    out = N.ichijinsha_invoice(lines)
    got = listed(out.where("place < 7"), "place", "title", "kind", "after_tax_income", "channel_title")
    assert got == [
        (1, "作品（７）", "EB", 100, "作品（７）"), (1, "作品（８）", "EB", 100, "作品（８）"), (1, "作品（９）", "EB", 110, "作品（９）"),
        (2, "作品（１）", "MF", 50, "作品（１）"), (2, "作品（２）", "MF", 51, "作品（２）"),
        (3, "単行本「作品」第7～9巻", "PP", 310, "単行本「作品」第7～9巻"),
        (4, "挿絵 原稿料", "MF", 5, "挿絵 原稿料（20th色紙原稿料）"),
        (5, "素材費の国", "MF", 5, "素材費の国（20th色紙原稿料）"), (6, "", "MF", 9, ""),
    ]
    assert [r.problem for r in out.where("place = 3").collect()] == ["quantity differs from the volumes"]
    assert {r.place: r.sales_month for r in out.collect()}[5] is None
    assert {r.place for r in lines.collect()} == {r.place for r in out.collect()}
    for place, total in ((1, 310), (2, 101), (7, 9)):
        assert sum(r.after_tax_income for r in out.where(f"place = {place}").collect()) == total


def report(rows, draws, sales, drawn, extra=""):
    works = " ".join(f"{t} ¥{a:,}" for t, a in rows)
    listed = " ".join(f"{1000 + i} {t} 2025年4月 ¥9,000 ¥8,000 ¥{a:,} ¥7,000" for i, (t, a) in enumerate(draws))
    return f"対象期間 2026年 5月 ¥0 書名 価格 ロイヤリティ（税込） {works} 総合計額 当期売上合計① 当期MG取崩額② MG一覧シート参照 ¥{sales:,} ¥{drawn:,} ¥{sales - drawn:,} {extra} チャネル別 電子書籍/A ¥5 MG一覧 計 9,000 8,000 {drawn:,} 7,000 {listed}"


def test_a_report_of_sales_and_advances(spark):
    rows = [("作品 第1巻【単行本】", 2100), ("① 500 作品（1） 20%", 220), ("作品【分冊版】(1話～9話)", 330), ("小計 電子書籍/A", 2650), ("別（2）", 50), ("Other 【分冊版】", 70)]
    draws = [("作品 第01巻", 1150), ("OTHER (4)", 20), ("別 2", 50)]
    good = report(rows, draws, 2770, 1220)
    files = [("ok", good), ("sum", good.replace("2,100", "2,101")), ("draw", good.replace("¥20 ", "¥21 ")), ("labels", good.replace("総合計額", "")), ("none", None), ("two", report([("作品 第1巻", 9100), ("作品 第2巻", 10), ("作品 (分冊版)", 5)], [("作品", 1009)], 9115, 1009))]
    records, problems = N.sb_statement(spark.createDataFrame(files, FILE))
    assert listed(records.where("file = 'ok'"), "title", "before_tax_income", "after_tax_income") == [("OTHER（４）", 50, 45), ("作品（１）", 1500, 1364)]
    assert {str(r.deposit_date) for r in records.collect()} == {"2026-09-30"}
    assert listed(problems, "file", "problem") == [
        ("draw", "draw-downs do not add up"), ("labels", "labels of the totals are missing or out of order"), ("none", "labels of the totals are missing or out of order"),
        ("sum", "details do not add up"), ("two", "draw-down without a volume"), ("two", "several volumes"),
    ]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def plain_groups(rows):
    groups = []
    for file, _, title, kind, payment in sorted(rows, key=lambda r: r[1]):
        for g in groups:
            if g[:2] == [file, kind] and (g[2] == title or distance(g[2], title) <= max(2, int(max(len(g[2]), len(title)) * 0.45))):
                break
        else:
            g = [file, kind, title, {}, 0]
            groups.append(g)
        g[3][title] = g[3].get(title, 0) + 1
        g[4] += payment
    return sorted((f, k, max(s, key=lambda t: s[t]), p, sum(s.values())) for f, k, _, s, p in groups)


def test_spellings_of_a_scan_against_a_plain_walk(spark):
    r = random.Random(4)
    names = ["再婚の承認", "喧嘩独学", "ボクサー", "生まれ変わってもよろしく", "ab", "abcd", "abcdefghij"]
    rows = []
    for i in range(400):
        title = list(r.choice(names))
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            at = r.randrange(len(title) + 1)
            title[at : at + r.choice([0, 1])] = r.choice(["x", "口", ""])
        rows.append((f"f{i % 5}", i, "".join(title) or "z", r.choice(["単行本", "話配信"]), r.randrange(1, 999)))
    out = N.spelling_groups(spark.createDataFrame(rows, "file string, place int, title string, kind string, payment long").repartition(5))
    assert listed(out, "file", "kind", "title", "payment", "source_rows") == plain_groups(rows)
    assert N.spelling_groups(out.select("file", "title", "kind", "payment").selectExpr("*", "1 as place").limit(0)).count() == 0


def test_a_notice_must_add_up(spark):
    day = "2026-06-25"
    page = lambda f, **k: {"file": f, "payment_date": day, "second_date": None, "grand_total": 1111, "summary_total": 1011, "detail_total": 1011, "detail_month": "2026-02-01", **k}
    pages = [page("ok"), page("day", second_date="2026-06-26"), page("sum", detail_total=1012), page("grand", grand_total=1), page("blank", payment_date=None, grand_total=None), page("none"), page("zero")]
    frame = spark.createDataFrame([tuple(p.values()) for p in pages], "file string, payment_date string, second_date string, grand_total long, summary_total long, detail_total long, detail_month string")
    frame = frame.selectExpr("file", "cast(payment_date as date) payment_date", "cast(second_date as date) second_date", "grand_total", "summary_total", "detail_total", "cast(detail_month as date) detail_month")
    files = [p["file"] for p in pages if p["file"] != "none"]
    adverts = spark.createDataFrame([(f, 0, "喧嘩独学（広告）", 100, "2026-01-01") for f in files], "file string, place int, title string, payment long, sales_month string").withColumn("sales_month", S.F.col("sales_month").cast("date"))
    details = spark.createDataFrame([(f, i, t, "単行本", p) for f in files for i, (t, p) in enumerate([("喧嘩独学", 500), ("喧嘩口独学", 500), ("喧嘩口独学", 0 if f == "zero" else 11)])], "file string, place int, title string, kind string, payment long")
    records, problems = N.shueisha_notice(frame, adverts, details)
    assert listed(records, "file", "channel_title", "kind", "before_tax_income", "after_tax_income") == [("ok", "喧嘩口独学(単行本)", "EB", 1011, 919), ("ok", "喧嘩独学(広告)", "AD", 100, 91)]
    found = listed(problems, "file", "problem")
    assert found == [("blank", "no grand total"), ("blank", "no payment date"), ("day", "payment dates differ"), ("grand", "rows differ from the grand total"), ("none", "no adverts"), ("none", "no details"), ("sum", "details differ from their total"), ("zero", "a detail's amount")]
    base = spark.createDataFrame([("Jumptoon", "EB", "喧嘩独学")], "channel string, type string, title_jp string")
    carried = S.reconcile_scanned(records.selectExpr("channel", "kind as type", "title as title_jp", "note2"), base)
    assert listed(carried, "channel", "title_jp") == [("Jumptoon", "喧嘩独学"), ("manga mee", "喧嘩独学")]


def test_cells_and_dates_of_a_scan(spark):
    def one(column, text):
        return spark.createDataFrame([(text,)], "t string").select(column(N.F.col("t")).alias("x")).first().x

    assert str(one(N.payment_date, "御文払日 ２026年 06月 25日")) == "2026-06-25" and one(N.payment_date, "支払日 2026年13月1日") is None
    assert str(one(N.source_month, "2026年２月 発生分")) == "2026-02-01" and one(N.source_month, "2026年13月発生分") is None
    assert str(one(N.advert_month, "マンガMee 広告 202602")) == "2026-02-01" and one(N.advert_month, "なし") is None
    assert tuple(one(N.work_cell, "喧嘩 独学　単行本版【フルカラー】 EPUB版")) == ("喧嘩独学", "単行本")
    assert tuple(one(N.work_cell, "喧嘩独学 話配信")) == ("喧嘩独学", "話配信") and one(N.work_cell, " ") is None and one(N.work_cell, None) is None
    assert one(N.title_line, "マンガMee WEB広告\n2026/02/01\n喧嘩 独学 広告202602\n次") == "喧嘩独学" and one(N.title_line, "12\n一") is None


def test_amounts_are_chosen_by_the_printed_total(spark):
    rows = [("a", 0, [500, 5], 516), ("a", 1, [17, 11], 516), ("a", 2, [5], 516), ("b", 0, [1], 9), ("b", 1, None, 9), ("c", 0, [4, 2], None), ("d", 0, [-1, 3, 2], 5), ("d", 1, [501, 2, 3], 5)]
    out = N.choose_amounts(spark.createDataFrame(rows, "file string, place int, readings array<long>, total long"))
    assert listed(out, "file", "place", "payment") == [("a", 0, 500), ("a", 1, 11), ("a", 2, 5), ("b", 0, 1), ("b", 1, 0), ("c", 0, 4), ("d", 0, 3), ("d", 1, 2)]
