"""Formats of daily sales files by their names and headers: an ordered table of rules, the first that fits holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``name``: a pattern of the name in small letters; ``tokens``: words that the header holds, one of each group.

    ``platform`` null: the one that the name says, if any; ``source`` null: the one that the name says.
    """

    format: str
    platform: str | None
    confidence: str
    source: str | None
    name: str | None = None
    tokens: tuple[tuple[str, ...], ...] = ()
    preliminary: bool = True


#: Platforms by what names hold, in order; and what a name says of the source.
PLATFORMS = (
    ("piccoma|ピッコマ|피코마", "Piccoma"),
    ("mechacomic|mecha|メチャ|めちゃ|메챠", "Mechacomic"),
    ("cmoa|シーモア|시모아", "cmoa"),
    ("line.*manga|manga.*line|lineマンガ|linemannga", "LINEマンガ"),
    ("ebookjapan|ebook", "ebookjapan"),
    ("fanza", "DMM(FANZA)"),
    ("renta", "Renta"),
    ("u-next|unext", "U-NEXT"),
    ("dmm", "DMM"),
    ("まんが王国|mangaoukoku|만화왕국", "まんが王国"),
)
SOURCES = (
    ("app_kan_daily", "sokuhochi_app_kan"),
    ("sp_kan_daily", "sokuhochi_sp_kan"),
    ("app_daily", "sokuhochi_app"),
    ("sp_daily", "sokuhochi_sp"),
    ("product_kpi", "sokuhochi_kpi"),
    ("cmoa|시모아|シーモア", "sokuhochi_cmoa"),
)
#: The formats, first by names, then by headers. A confidence of "named" is high if the name says the platform, else medium.
RULES = (
    Rule("weekly_report", "", "high", "weekly_report", name="weekly_report|weekly report", preliminary=False),
    Rule("ruikei_metadata", "", "high", "ruikei_metadata", name="ruikei|metadata|누계|累計", preliminary=False),
    Rule("piccoma_kpi", "Piccoma?", "high", None, name="product_kpi"),
    Rule("piccoma_sokuhochi", None, "named", None, name="daily_sales_log|sokuhochi|速報"),
    Rule("cmoa_sokuhochi", "cmoa", "high", "sokuhochi_cmoa?", name="cmoa|シーモア|시모아"),
    Rule("renta_sokuhochi", "Renta", "high", "sokuhochi_renta", name="renta"),
    Rule("linemanga_sokuhochi", "LINEマンガ", "high", "sokuhochi_line", name=r"line_sales_report|line.*\.csv|\.csv.*line"),
    Rule("ebookjapan_sokuhochi", "ebookjapan", "high", "sokuhochi_ebj", name="paymentreport|dailydetail|ebookjapan|ebj"),
    Rule("dmm_sokuhochi", "DMM", "high", "sokuhochi_dmm", name="fanza|dmm|商品別売上"),
    Rule("piccoma_sokuhochi", None, "named", None, tokens=(("日付",), ("ブック名",), ("購入ポイント数",))),
    Rule("piccoma_kpi", "Piccoma?", "high", "sokuhochi_kpi", tokens=(("作品名",), ("Total売上",))),
    Rule("cmoa_sokuhochi", "cmoa", "high", "sokuhochi_cmoa", tokens=(("コンテンツID",), ("タイトル名",))),
    Rule("renta_sokuhochi", "Renta", "high", "sokuhochi_renta", tokens=(("参照ID",), ("商品名",), ("売上金額",))),
    Rule("ebookjapan_sokuhochi", "ebookjapan", "high", "sokuhochi_ebj", tokens=(("書店名",), ("販売額計",))),
    Rule("linemanga_sokuhochi", "LINEマンガ", "high", "sokuhochi_line", tokens=(("作品ID",), ("取扱高",))),
    Rule("dmm_sokuhochi", "DMM", "high", "sokuhochi_dmm", tokens=(("商品タイトル",), ("売上金額",), ("集計期間", "カテゴリ"))),
    Rule("weekly_report", "", "medium", "weekly_report", tokens=(("Title",), ("Channel",), ("Date",)), preliminary=False),
)


def _first(text: Column, table: tuple[tuple[str, str], ...], otherwise: str) -> Column:
    return F.coalesce(*(F.when(text.rlike(p), F.lit(v)) for p, v in table), F.lit(otherwise))


def detect_daily(file: Column, header: Column | None = None, workbook: Column | None = None) -> Column:
    """struct(format, platform, is_preliminary, confidence, sub_source) of a daily file; ``workbook``: it is one.

    A workbook that no rule knows is a weekly report with low confidence, another file is unknown. A null name or header
    says nothing.
    """
    name = F.lower(F.coalesce(file, F.lit("")))
    head = F.coalesce(header, F.lit("")) if header is not None else F.lit("")
    is_book = F.coalesce(workbook, F.lit(False)) if workbook is not None else F.lit(False)
    platform, source = _first(name, PLATFORMS, ""), _first(name, SOURCES, "sokuhochi")

    def result(r: Rule) -> Column:
        own = platform if r.platform is None else F.when(platform != "", platform).otherwise("Piccoma") if r.platform == "Piccoma?" else F.lit(r.platform)
        sub = source if r.source is None else F.when(is_book, "sokuhochi_cmoa_excel").otherwise("sokuhochi_cmoa") if r.source == "sokuhochi_cmoa?" else F.lit(r.source)
        sure = F.when(platform != "", "high").otherwise("medium") if r.confidence == "named" else F.lit(r.confidence)
        return F.struct(F.lit(r.format).alias("format"), own.alias("platform"), F.lit(r.preliminary).alias("is_preliminary"), sure.alias("confidence"), sub.alias("sub_source"))

    def fits(r: Rule) -> Column:
        if r.name:
            return name.rlike(r.name)
        out = F.lit(True)
        for words in r.tokens:
            held = F.lit(False)
            for w in words:
                held = held | head.contains(w)
            out = out & held
        return out

    book = F.struct(F.lit("weekly_report").alias("format"), platform.alias("platform"), F.lit(False).alias("is_preliminary"), F.lit("low").alias("confidence"), F.lit("weekly_report").alias("sub_source"))
    unknown = F.struct(F.lit("unknown").alias("format"), F.lit("").alias("platform"), F.lit(False).alias("is_preliminary"), F.lit("low").alias("confidence"), F.lit("sokuhochi").alias("sub_source"))
    out = F.when(is_book, book).otherwise(unknown)
    for r in reversed(RULES):
        out = F.when(fits(r), result(r)).otherwise(out)
    return out
