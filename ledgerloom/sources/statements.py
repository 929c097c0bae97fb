"""Royalty statements as declarations: group key, amounts and dates of each platform.

``settled`` takes a platform's statement lines (title, kind, sales, pay, report month; further columns by platform),
adds them up by the platform's key and computes the ledger's amounts: total, before_tax, after_tax, before_tax_income,
after_tax_income, consumption_tax. An amount that a platform leaves open is null, which is not 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money

AMOUNTS = ("total", "before_tax", "after_tax", "before_tax_income", "after_tax_income", "consumption_tax")
Sums = Callable[[Column, Column], dict[str, Column]]
R, DOWN = money.half_up, money.down


@dataclass(frozen=True)
class Statement:
    """``amounts`` takes the sums of sales and pay; sales are due ``settle`` and paid ``deposit`` months after the report month.

    ``by_row``: each line is a record of its own. ``stated``: amounts that a further column of the lines holds, where
    it is there. ``summary``: the records are evidence, whose amounts are not added up with others. ``later``: channels
    that settle, and pay, a month after the others.
    """

    amounts: Sums
    key: tuple[str, ...] = ("title", "kind")
    settle: int = 1
    deposit: int = 2
    by_row: bool = False
    stated: tuple[tuple[str, str], ...] = ()
    summary: bool = False
    later: tuple[str, ...] = ()


def _cmoa(sales: Column, pay: Column) -> dict[str, Column]:
    after = F.when(sales > 0, R(sales)).otherwise(R(pay / 0.4))
    income = DOWN(pay)
    return {"total": R(after * 1.1), "before_tax": R(after * 1.1), "after_tax": after, "before_tax_income": income, "after_tax_income": income, "consumption_tax": R(income * 0.1)}


def _piccoma(sales: Column, pay: Column) -> dict[str, Column]:
    total, before, after = R(sales * 1.1), DOWN(pay * 1.1), DOWN(pay)
    return {"total": total, "before_tax": total, "after_tax": R(total / 1.1), "before_tax_income": before, "after_tax_income": after, "consumption_tax": before - after}


def _renta(sales: Column, pay: Column) -> dict[str, Column]:
    total, tax = money.half_up_guarded(sales * 1.1), DOWN(pay * 0.1 + 1e-9)
    return {"total": total, "before_tax": total, "after_tax": R(sales), "before_tax_income": R(pay) + tax, "after_tax_income": R(pay), "consumption_tax": tax}


def _plain(sales: Column, pay: Column) -> dict[str, Column]:
    return {"after_tax": R(sales), "after_tax_income": R(pay)}


def _line_ad(sales: Column, pay: Column) -> dict[str, Column]:
    after, income = R(sales), R(pay)
    tax = DOWN(income * 0.1)
    return {"total": R(after * 1.1), "after_tax": after, "before_tax_income": income + tax, "after_tax_income": income, "consumption_tax": tax}


def _gaiakuhan(sales: Column, pay: Column) -> dict[str, Column]:
    after, income = R(sales), R(pay)
    tax = R(income * 0.1)
    return {"total": R(after * 1.1), "after_tax": after, "before_tax_income": income + tax, "after_tax_income": income, "consumption_tax": tax}


def _booklive(sales: Column, pay: Column) -> dict[str, Column]:
    return {"total": R(sales * 1.1), "before_tax": R(sales / 1.1), "after_tax": R(sales), "before_tax_income": R(pay * 1.1), "after_tax_income": R(pay)}


def _mechacomic(sales: Column, pay: Column) -> dict[str, Column]:
    return {"after_tax": R(sales), "before_tax_income": DOWN(pay * 1.1), "after_tax_income": R(pay)}


def _comico(sales: Column, pay: Column) -> dict[str, Column]:
    return _taxed(R(sales), R(pay * 1.1))


def _comico_ads(sales: Column, pay: Column) -> dict[str, Column]:
    return _taxed(R(sales * 1.1), R(pay * 1.1))


def _taxed(total: Column, income: Column) -> dict[str, Column]:
    """Of amounts with tax."""
    net = R(income / 1.1)
    return {"total": total, "before_tax": total, "after_tax": R(total / 1.1), "before_tax_income": income, "after_tax_income": net, "consumption_tax": income - net}


def _u_next(sales: Column, pay: Column) -> dict[str, Column]:
    total, before, after = R(sales * 1.1), R(pay * 1.1), R(pay)
    return {"total": total, "before_tax": total, "after_tax": R(sales), "before_tax_income": before, "after_tax_income": after, "consumption_tax": before - after}


def _mangabang(sales: Column, pay: Column) -> dict[str, Column]:
    total, before = R(sales * 1.1), R(pay)
    tax = DOWN(before * 10 / 110)
    return {"total": total, "before_tax": total, "after_tax": R(sales), "before_tax_income": before, "after_tax_income": before - tax, "consumption_tax": tax}


def _kadokawa(sales: Column, pay: Column) -> dict[str, Column]:
    return _taxed(R(sales), R(sales))


def _untaxed(sales: Column, pay: Column) -> dict[str, Column]:
    return {"total": R(sales), "before_tax": R(sales), "after_tax": R(sales), "before_tax_income": R(pay), "after_tax_income": R(pay), "consumption_tax": F.lit(0).cast("long")}


def _beaglee(sales: Column, pay: Column) -> dict[str, Column]:
    before, after = R(pay * 1.1), R(pay)
    return {"total": R(sales * 1.1), "after_tax": R(sales), "before_tax_income": before, "after_tax_income": after, "consumption_tax": before - after}


def _invoice(sales: Column, pay: Column) -> dict[str, Column]:
    total = R(sales * 1.1)
    return {"total": total, "before_tax": total, "before_tax_income": total, "after_tax": R(sales), "after_tax_income": R(sales), "consumption_tax": total - R(sales)}


def _dmm(sales: Column, pay: Column) -> dict[str, Column]:
    return {"after_tax": R(sales), "after_tax_income": R(sales * 0.45)}


def _ads(sales: Column, pay: Column) -> dict[str, Column]:
    """Sums in cents, whole numbers throughout."""
    after, income = money.cents_half_up(R(sales), 1, 110), money.cents_half_up(R(pay), 1, 110)
    tax, total = DOWN(income / 10), money.cents_half_up(after, 11, 10)
    return {"total": total, "before_tax": total, "after_tax": after, "before_tax_income": income + tax, "after_tax_income": income, "consumption_tax": tax}


STATEMENTS = {
    "cmoa": Statement(_cmoa, settle=0, deposit=0, by_row=True),
    "piccoma": Statement(_piccoma),
    "piccoma_ads": Statement(_ads, ("title",), 3, 4),
    "piccoma_gaiakuhan": Statement(_gaiakuhan, ("title",), 0, 0),
    "renta": Statement(_renta, settle=2, deposit=2),
    "line_ebj": Statement(_plain, ("channel", "kind", "title"), later=("line",)),
    "line_ad": Statement(_line_ad, ("title",), 0, 0, by_row=True),
    "booklive": Statement(_booklive, ("channel", "title", "kind"), by_row=True, stated=(("before_tax_income", "pay_gross"), ("consumption_tax", "tax"))),
    "mechacomic": Statement(_mechacomic),
    "comico": Statement(_comico, ("title",), 0, 0),
    "comico_ads": Statement(_comico_ads, ("title",), 0, 0),
    "dmm": Statement(_dmm, settle=0, deposit=2),
    "u_next": Statement(_u_next, ("title",), 0, 0),
    "mediado": Statement(_plain, ("title",), 3, 3),
    "mbj": Statement(_plain, settle=0, deposit=1),
    "mangabang": Statement(_mangabang, ("title",), 1, 1),
    "kadokawa": Statement(_kadokawa, ("title",), 1, 1, by_row=True, summary=True),
    "lezhin_beltoon": Statement(_untaxed, ("title",), 0, 0, by_row=True),
    "beaglee": Statement(_beaglee),
    "invoice": Statement(_invoice, ("title",), 0, 0, by_row=True),
}


def settled(lines: DataFrame, platform: str) -> DataFrame:
    """(key..., sales_month, settlement_date, deposit_date, the AMOUNTS, row_count, is_summary) of statement lines.

    Lines of a platform that settles by row are records as they are, without a shuffle; others are added up by key.
    """
    kind = STATEMENTS[platform]
    month = F.trunc("month", "MM").alias("sales_month")
    texts = {f.name for f in lines.schema if f.dataType.typeName() == "string"}
    zero = lambda c: F.coalesce(F.col(c).try_cast("double") if c in texts else F.col(c).cast("double"), F.lit(0.0))
    stated = {a: c for a, c in kind.stated if c in lines.columns}
    parts = {"_s": zero("sales"), "_p": zero("pay"), **{f"_{a}": zero(c) for a, c in stated.items()}}
    if kind.by_row:
        summed = lines.select(*kind.key, month, *(c.alias(n) for n, c in parts.items()), F.lit(1).cast("long").alias("row_count"))
    else:
        summed = lines.groupBy(*kind.key, month).agg(*(F.sum(c).alias(n) for n, c in parts.items()), F.count("*").alias("row_count"))
    got = {**kind.amounts(F.col("_s"), F.col("_p")), **{a: R(F.col(f"_{a}")) for a in stated}}
    out = summed.withColumns({a: got.get(a, F.lit(None)).cast("long") for a in AMOUNTS})
    wait = F.when(F.col("channel").isin(*kind.later), 1).otherwise(0) if kind.later else F.lit(0)
    return out.select(
        *kind.key,
        "sales_month",
        dates.month_end_after(F.col("sales_month"), wait + kind.settle).alias("settlement_date"),
        dates.month_end_after(F.col("sales_month"), wait + kind.deposit).alias("deposit_date"),
        *AMOUNTS,
        "row_count",
        F.lit(kind.summary).alias("is_summary"),
    )


#: Each platform with its weight and the patterns of its files' names.
SIGNATURES = (
    ("cmoa", 10, (r"(?i)CD\d+_N\d+_\d{6}_.*(支払案内書|meisai|dl)", r"(?i)cmoa")),
    ("mbj", 10, (r"(?i)Apple Books", r"(?i)yodobashi\.com", r"アニメイトブックストア", r"[ほぼ]るコミ", r"PF_\d+_RIVERSE_\d+_支払通知書")),
    ("piccoma_ads", 10, (r"動画リワード.*RIVERSE", r"砂時計")),
    ("mediado", 10, (r"BR\d+_RIVERSE_コミック", r"BR\d+_RIVERSE_タテヨミ", r"BR\d+_RIVERSE_書籍")),
    ("beltoon", 10, (r"(?i)beltoon",)),
    ("lezhin", 10, (r"(?i)lezhin",)),
    ("beaglee", 10, (r"(?i)beaglee", r"まんが王国")),
    ("renta", 10, (r"PAS\d+-A-\d+rnt_jp", r"パピレス掲載料通知書")),
    ("booklive", 10, (r"株式会社ＲＩＶＥＲＳＥ.*売上報告書", r"A0698a_株式会社ＲＩＶＥＲＳＥ")),
    ("comico", 5, (r"^2026\d{2}\.xlsx$", r"(?i)comico", r"(?i)^statement_\d+\.xlsx$")),
    ("dmm", 10, (r"\d+_株式会社RIVERSE_支払通知書", r"(?i)DMM", r"ポイント上乗せ施策")),
    ("ebj_line", 10, (r"ExportCSV_PaymentReport_\d+_EpiVol", r"(?i)payment-report-\d+")),
    ("line_ad", 10, (r"\d+_N\d+_R\d+_N\d+_\(株\)RIVERSE様",)),
    ("mangabang", 10, (r"(?i)mangabang.*ticket", r"RIVERSE様_支払通知書")),
    ("sb_creative_m", 10, (r"\d+_株式会社RIVERSE様【\d+年\d+月】前払印税報告書", r"^SBクリエイティブ_株式会社RIVERSE様【\d+年\d+月】前払印税報告書", r"【請求書】SBクリエイティブ様")),
    ("shueisha", 10, (r"\d+_支払通知書（集英社）",)),
    ("u_next", 10, (r"hol\d+_株式会社RIVERSE御中_\d+",)),
    ("piccoma", 10, (r"取次report_株式会社RIVERSE", r"出版社report_株式会社RIVERSE")),
    ("piccoma_gaiakuhan", 10, (r"外販お支払報告書", r"ピッコマEPUB外販ロイヤリティー")),
    ("mechacomic", 10, (r"^RIVERSE_\d{6}\.xlsx$", r"【請求書】.*めちゃコミック")),
    ("ichijinsha", 5, (r"支払通知書\.pdf$", r"詳細別送の内訳", r"【請求書】一迅社様")),
    ("kadokawa", 10, (r"\d+_R\d+_\d+\.pdf$", r"支払通知書_\d{8}_\d+\.csv", r"【請求書】KADOKAWA様")),
    ("sb_creative_e", 10, (r"支払通知書_\d+年\d+月\d+日お支払い",)),
)
#: Words in a platform's header cells, and patterns of its sheets' names.
HEADER_WORDS = {"cmoa": ("作品ID", "サービス区分")}
SHEET_PATTERNS = {"comico": (r"プラットフォーム売上現況", r"精算書\(JP\)")}


def detected(files: DataFrame) -> DataFrame:
    """``files`` (file; where there: folder, header, sheets, the last as a list) with ``platform`` and ``confidence``.

    A pattern of the name counts ten times the weight, one of a sheet's name five times, the platform in the folder's
    name 3, a header word 2. The best score wins, of equals the first platform as listed; confidence sets it against
    the second. Without any score confidence is 0, and the platform is that whose code the file's name holds, else
    null. Scores are computed within the row.
    """
    has = lambda c: c in files.columns
    hit = lambda cond, points: F.when(F.coalesce(cond, F.lit(False)), points).otherwise(0)

    def in_a_sheet(pattern: str) -> Column:
        return F.exists("sheets", lambda s: s.rlike(pattern))

    def score(code: str, weight: int, patterns: tuple[str, ...]) -> Column:
        points = [hit(F.col("file").rlike(p), 10 * weight) for p in patterns]
        if has("folder"):
            points.append(hit(F.lower("folder").contains(code.replace("_", "")), 3))
        if has("header"):
            points += [hit(F.col("header").contains(w), 2) for w in HEADER_WORDS.get(code, ())]
        if has("sheets"):
            points += [hit(in_a_sheet(p), 5 * weight) for p in SHEET_PATTERNS.get(code, ())]
        return sum(points[1:], points[0])

    scores = F.array(*(F.struct((-score(*s)).alias("score"), F.lit(i).alias("place"), F.lit(s[0]).alias("platform")) for i, s in enumerate(SIGNATURES)))
    out = files.withColumn("_s", F.array_sort(scores))
    top, second = -F.col("_s")[0]["score"], -F.col("_s")[1]["score"]
    sure = F.when(top > 0, F.least(F.lit(1.0), top / (top + second + 5))).otherwise(0.0)
    codes = sorted((s[0] for s in SIGNATURES), key=lambda c: (-len(c), c))
    by_code = F.coalesce(*(F.when(F.lower("file").contains(c), F.lit(c)) for c in codes))
    return out.select(*files.columns, F.when(top > 0, F.col("_s")[0]["platform"]).otherwise(by_code).alias("platform"), sure.alias("confidence"))


#: Labels of amounts in notices and invoices, by what they state, in order of precedence.
LABELS = {
    "tax_incl": ("御請求金額", "お支払額合計", "支払額合計", "合計金額", "差引支払金額", "お支払額", "支払額", "版権支払額合計", "期間中売上合計"),
    "tax_excl": ("小計", "計上額合計", "総収入金額", "税抜き金額", "お取引先様ご負担額合計"),
    "consumption_tax": ("消費税", "消費税額"),
    "withholding_tax": ("源泉額合計", "源泉税", "所得税"),
}
#: Forms of a total that bear no label of the above.
TOTALS = (r"[¥￥\\\\]([\d,]+)\s+合計", r"[¥￥\\\\]([\d,]+)[^¥￥\\\\]{0,120}支払金額合計", r"支払金額\s+Payment amount[\s\S]{0,200}[¥￥\\\\]([\d,]+)", r"Total price[\s\S]{0,120}[¥￥\\\\]([\d,]+)")
NUMBER = r"[−▲-]?\d[\d,]*"
SUMMARY_KINDS = (("請求書", "invoice_summary_fallback"), ("支払通知|支払案内|掲載料通知", "payment_notice_summary_fallback"), ("(?i)report|レポート|明細|内訳", "detail_report_summary_fallback"))


def _number(text: Column) -> Column:
    plain = F.replace(F.translate(text, "−▲", "--"), F.lit(","), F.lit(""))
    return F.when(plain != "", plain.try_cast("double"))


def labelled_amount(text: Column, label: str) -> Column:
    """The number right before a label, else the first within 25 signs after it; null where there is none."""
    before = f"({NUMBER})\\s*円?\\s*{label}"
    after = f"{label}[^0-9¥￥\\\\−▲-]{{0,25}}[¥￥\\\\]?({NUMBER})"
    return F.coalesce(*(_number(F.regexp_extract(text, p, 1)) for p in (before, after)))


def file_month(file: Column) -> Column:
    """The month in a file's name: as 2024年5月, else the first as 202405 or 2405, else null.

    A number of four digits counts where no other digit is beside it. The first stands for the file where a running
    number behind it looks like a month too.
    """
    month = lambda year, number: F.concat(year, F.lit("-"), F.lpad(number, 2, "0"), F.lit("-01"))
    said, plain = r"(20\d{2})年\s*(\d{1,2})月", r"(?:(20\d{2})(0[1-9]|1[0-2])|(?<!\d)(\d{2})(0[1-9]|1[0-2])(?!\d))"
    part = lambda i: F.regexp_extract(file, plain, i)
    first = F.when(part(1) != "", month(part(1), part(2))).when(part(3) != "", month(F.concat(F.lit("20"), part(3)), part(4)))
    return F.when(file.rlike(said), month(F.regexp_extract(file, said, 1), F.regexp_extract(file, said, 2))).otherwise(first)


def summarised(files: DataFrame) -> DataFrame:
    """One row a file (file, text, platform) that no reader takes: what its labelled amounts state, as evidence only.

    The amounts are those of the first label of LABELS that has a number but 0. Of tax_incl, tax_excl and
    consumption_tax a missing one follows from the others, 10 % being supposed only where no tax is stated; an amount
    without tax that stands alone is both. The month is the text's, else the name's. ``needs_review``: no amount was found.
    """
    text = F.col("_text")
    out = files.withColumn("_text", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\s　]+", " ")))
    first = lambda labels: F.coalesce(*(F.nullif(labelled_amount(text, x), F.lit(0.0)) for x in labels))
    out = out.withColumns({f"_{k}": first(v) for k, v in LABELS.items()})
    total = F.coalesce("_tax_incl", *(_number(F.regexp_extract(text, p, 1)) for p in TOTALS), "_tax_excl")
    out = out.withColumn("_tax_incl", total)
    incl, excl, tax = F.col("_tax_incl"), F.col("_tax_excl"), F.col("_consumption_tax")
    whole = F.coalesce(incl, F.coalesce(excl + tax, R(excl * 1.1).cast("double")))
    net = F.coalesce(excl, F.coalesce(whole - tax, R(whole / 1.1).cast("double")))
    years = F.coalesce(*(F.when(text.rlike(p), F.concat(F.regexp_extract(text, p, 1), F.lit("-"), F.lpad(F.regexp_extract(text, p, 2), 2, "0"), F.lit("-01"))) for p in (r"(20\d{2})年\s*(\d{1,2})月", r"(20\d{2})[-/](\d{1,2})")))
    kind = F.lit("file_summary_fallback")
    for pattern, name in reversed(SUMMARY_KINDS):
        kind = F.when(F.col("file").rlike(pattern), name).otherwise(kind)
    subject = F.trim(F.regexp_extract(text, r"件名[：:]\s*(.+?)(?: 御請求金額| お支払期限| №| No|$)", 1))
    zero = F.lit(0.0)
    return out.select(
        "file",
        "platform",
        F.when(subject != "", subject).otherwise(F.regexp_replace("file", r"\.[^.]+$", "")).alias("raw_title"),
        kind.alias("source_file_kind"),
        F.coalesce(years, file_month(F.col("file"))).alias("sales_month"),
        F.coalesce(net, zero).alias("tax_excl"),
        F.coalesce(whole, zero).alias("tax_incl"),
        F.coalesce(tax, whole - net, zero).alias("consumption_tax"),
        F.coalesce("_withholding_tax", zero).alias("withholding_tax"),
        F.lit("SUMMARY_NON_AGGREGATED").alias("note2"),
        (incl.isNull() & excl.isNull()).alias("needs_review"),
    )
