"""Workbooks of known layout as tables, from rows of their sheets (``xlsx.read_xlsx``: file, sheet, row_index, cells).

Columns are places in the sheet, the first being 0, or follow from the header. Cells are strings as stored, dates serial
numbers; error cells are blank. A row's cells are all that is looked at, but for a header row a sheet, which is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money
from ledgerloom.functions import text as T
from ledgerloom.functions.joins import taken_once, with_group

ERRORS = r"^#(?:N/A|REF!|VALUE!|DIV/0!|NAME\?|NULL!|NUM!)$"


def cell(at: int) -> Column:
    """A trimmed cell, null where it is blank, an error, or beyond the row's end."""
    value = F.trim(F.get("cells", F.lit(at)))
    return F.when((value != "") & ~(value.startswith("#") & value.rlike(ERRORS)), value)


def any_day(text: Column) -> Column:
    """A date as a serial number above 10000, as 98.05.31 (from 50 on of the last century), 2026.05.31 or 2026-05-31."""
    short = r"^(\d{2})\.(\d{2})\.(\d{2})$"
    part = lambda i: F.regexp_extract(text, short, i)
    century = F.when(part(1) >= "50", "19").otherwise("20")
    long = F.when(text.rlike(short), F.concat(century, part(1), F.lit("-"), part(2), F.lit("-"), part(3))).when(text.rlike(r"^\d{4}([.-])\d{2}\1\d{2}$"), F.replace(text, F.lit("."), F.lit("-")))
    serial = F.when(text.rlike(r"^\d{5,6}(?:\.\d+)?$"), F.floor(text.try_cast("double")))
    return F.coalesce(F.when(serial > 10000, dates.excel_serial(serial)), F.try_to_timestamp(long, F.lit("yyyy-MM-dd")).cast("date"))


def below_header(cells: DataFrame, is_header: Column, otherwise: int) -> DataFrame:
    """The rows below the first header row of each sheet, or below row ``otherwise`` where a sheet has none."""
    first = cells.groupBy("file", "sheet").agg(F.coalesce(F.min(F.when(is_header, F.col("row_index"))), F.lit(otherwise)).alias("_head"), F.count("*").alias("_rows"))
    return with_group(cells, first, ["file", "sheet"], counted="_rows").where("row_index > _head").drop("_head")


def cumulative_sales(cells: DataFrame, sheets: str = "누계|메타데이터") -> DataFrame:
    """Monthly sales of the workbook of cumulative metadata: title_jp, title_kr, channel, sale_date (a first of month), sales_amount."""
    month = cell(8)
    head = (F.col("row_index") <= 10) & F.coalesce(month.rlike("판매월|Month"), F.lit(False))
    rows = below_header(cells.where(F.col("sheet").rlike(sheets)), head, 5)
    out = rows.select(cell(2).alias("title_jp"), F.coalesce(cell(1), F.lit("")).alias("title_kr"), cell(14).alias("channel"), month.alias("_month"), cell(22).alias("_amount"))
    month = F.col("_month")
    stated = F.when(month.rlike(r"^\d{4}-\d{2}"), F.concat(F.substring(month, 1, 7), F.lit("-01"))).try_cast("date")
    out = out.select("title_jp", "title_kr", "channel", F.trunc(F.coalesce(stated, any_day(month)), "MM").alias("sale_date"), money.half_up(T.amount(F.col("_amount"))).alias("sales_amount"))
    return taken_once(out).where("title_jp is not null and channel is not null and sale_date is not null and sales_amount > 0")


def four_column_sales(cells: DataFrame) -> DataFrame:
    """Daily sales of sheets of four columns: title_jp, channel, sale_date, sales_amount (whole, above 0)."""
    head = F.exists("cells", lambda c: F.coalesce(c.rlike("作品|タイトル|売上"), F.lit(False)))
    day = F.coalesce(any_day(cell(2)), F.try_to_timestamp(F.regexp_replace(cell(2), r"^(\d{4})\D(\d{1,2})\D(\d{1,2})\D?.*$", "$1-$2-$3"), F.lit("y-M-d")).cast("date"))
    out = below_header(cells, head, 1).select(cell(0).alias("title_jp"), F.coalesce(cell(1), F.lit("")).alias("channel"), day.alias("sale_date"), money.down(T.amount(cell(3))).alias("sales_amount"))
    return out.where("title_jp is not null and sale_date is not null and sales_amount > 0")


# ---------------------------------------------------------------- initial sales
#: Codes of the platforms that the sheets name.
PLATFORM_CODES = {
    "픽코마": "piccoma",
    "메챠코믹": "mechacomic",
    "코믹시모아": "cmoa",
    "라인망가(LDF)": "line_manga",
    "라인망가(NW)": "line_manga",
    "코미코": "comico",
    "레진": "lezhin",
    "EBJ": "ebookjapan",
    "벨툰": "belltoon",
}
DAYS, WEEKS = tuple(f"d{i}" for i in range(1, 9)), tuple(f"w{i}" for i in range(1, 13))
KEY = ["title_kr", "platform_code", "launch_date"]
FACTS = ("genre_kr", "pf_genre", "launch_type", "launch_episodes")


def _initial(cells: DataFrame, sheet: str, amounts: tuple[str, ...]) -> DataFrame:
    """A sheet's rows from the third on, one a key; of several the last of the sheet."""
    number = lambda at: F.coalesce(cell(at).try_cast("double"), F.lit(0.0))
    code = F.coalesce(*(F.when(cell(1) == k, v) for k, v in PLATFORM_CODES.items()), F.lower(F.coalesce(cell(1), F.lit(""))))
    facts = (cell(2), cell(3), F.coalesce(cell(5), F.lit("비독점")), number(6))
    rows = cells.where(F.col("sheet").contains(sheet) & (F.col("row_index") > 2)).select(
        "file", "row_index", cell(0).alias("title_kr"), code.alias("platform_code"), any_day(cell(4)).alias("launch_date"), *(c.alias(n) for n, c in zip(FACTS, facts, strict=True)), *(number(7 + i).alias(n) for i, n in enumerate(amounts))
    )
    own = F.struct("row_index", "file", *FACTS, *amounts)
    last = rows.where("title_kr is not null and launch_date is not null").groupBy(*KEY).agg(F.max_by(own, F.struct("row_index", "file")).alias("_own"))
    return last.select(*KEY, *(F.col(f"_own.{n}").alias(n) for n in (*FACTS, *amounts)))


def initial_sales(cells: DataFrame) -> DataFrame:
    """First sales of launches: days 1 to 8 of the daily sheet, weeks 1 to 12 of the weekly one, by title, platform and launch.

    A launch that one sheet lacks has 0 there; what both state of it is the daily sheet's. Rows without a title or a
    launch date are left out.
    """
    daily, weekly = _initial(cells, "일별", DAYS), _initial(cells, "주간", WEEKS)
    there = F.struct(*FACTS)
    both = daily.select(*KEY, there.alias("_d"), *DAYS).join(weekly.select(*KEY, there.alias("_w"), *WEEKS), KEY, "full")
    return both.select(*KEY, *(F.coalesce("_d", "_w")[n].alias(n) for n in FACTS), *(F.coalesce(n, F.lit(0.0)).alias(n) for n in (*DAYS, *WEEKS)))


# ---------------------------------------------------------------- content master
#: The sheets with the state of their works, and the headers of each field, lower case and without spaces.
CONTENT_SHEETS = {"日本(タテヨミ)": "service", "日本(版面)": "service", "日本(タテヨミ)準備作品": "prep", "日本(版面)準備作品": "prep"}
CONTENT_FIELDS = {
    "title_jp": ("作品名(jp)", "jpタイトル(仮)", "jpタイトル"),
    "title_kr": ("作品名(kr)",),
    "management_type": ("管理事項",),
    "production_company": ("制作会社",),
    "distribution_company": ("流通会社",),
    "format": ("形式",),
    "artist": ("作画",),
    "artist_reading": ("作画(ヨミ)",),
    "adaptation": ("脚色",),
    "adaptation_reading": ("脚色(ヨミ)",),
    "original_author": ("原作",),
    "original_author_reading": ("原作(ヨミ)",),
    "genre": ("ジャンル",),
    "label": ("レーベル",),
    "weekday": ("連載曜日", "(連載)曜日", "曜日"),
    "copyright": ("コピーライト", "コピーライト(奥付)"),
    "synopsis": ("作品紹介",),
    "distribution_scope": ("配信範囲", "提供範囲"),
    "non_exclusive_conversion_date": ("非独占転換日",),
    "service_planned_date": ("サービス予定",),
    "notes": ("備考",),
}


def content_master(cells: DataFrame) -> DataFrame:
    """Works of the content list: source_sheet, source_row, status, the fields of CONTENT_FIELDS, raw_data (a map by header).

    The second row of a sheet is its header; of several columns of a field the first counts; '-' is null. ``raw_data``
    holds all cells that are not blank; a header that occurs again bears its place. Rows without any title are left out.
    """
    rows = cells.where(F.col("sheet").isin(*CONTENT_SHEETS))
    head = rows.where("row_index = 2").groupBy("file", "sheet").agg(F.max("cells").alias("_head"))
    rows = with_group(rows.where("row_index > 2"), head, ["file", "sheet"])
    rows = rows.withColumn("_names", F.transform("_head", lambda h: F.lower(F.regexp_replace(F.coalesce(h, F.lit("")), r"[\s　]+", ""))))

    def field(names: tuple[str, ...]) -> Column:
        at = F.array_position(F.transform("_names", lambda h: h.isin(*names)), True).cast("int")
        value = F.trim(F.get("cells", at - 1))
        return F.when((at > 0) & ~value.isin("", "-"), value)

    told = F.transform("_head", lambda h, i: F.struct(F.trim(F.regexp_replace(F.coalesce(h, F.lit("")), r"[\r\n]+", " ")).alias("h"), i.alias("i"), F.get("cells", i).alias("v")))
    rows = rows.withColumn("_told", F.filter(told, lambda x: (x["h"] != "") & (F.coalesce(x["v"], F.lit("")) != "")))
    name = lambda x, i: F.when(F.array_position(F.transform("_told", lambda y: y["h"]), x["h"]) == i + 1, x["h"]).otherwise(F.concat(x["h"], F.lit(" ("), x["i"].cast("string"), F.lit(")")))
    rows = rows.withColumn("_keyed", F.transform("_told", lambda x, i: F.struct(name(x, i).alias("k"), x["v"].alias("v"))))
    once = F.filter("_keyed", lambda x, i: F.array_position(F.transform("_keyed", lambda y: y["k"]), x["k"]) == i + 1)
    status = F.coalesce(*(F.when(F.col("sheet") == k, v) for k, v in CONTENT_SHEETS.items()))
    out = rows.select(F.col("sheet").alias("source_sheet"), F.col("row_index").alias("source_row"), status.alias("status"), *(field(names).alias(n) for n, names in CONTENT_FIELDS.items()), F.map_from_entries(once).alias("raw_data"))
    return out.where("title_jp is not null or title_kr is not null")


# ---------------------------------------------------------------- the older workbook
#: The 62 columns of the older monthly sheet in order, each with the record's fields it may come from.
OLD_COLUMNS = {
    "unique_identifier": ("unique_identifier", "unique_id"),
    **{c: (c,) for c in ("channel_title_jp", "title_kr", "title_jp")},
    "updated": ("updated_at", "updated"),
    **{c: (c,) for c in ("recoder", "company", "launch_date", "sales_month", "settlement_month", "deposit_month", "country")},
    "clients": ("clients", "client_display_name", "client_code"),
    "channel": ("channel", "channel_code"),
    **{c: (c,) for c in ("type", "distribution_strategy", "settlement_currency", "vehicle_currency", "total_amount_jpy", "fee_jpy", "before_tax_jpy", "after_tax_jpy")},
    "rs": ("rs_label", "rs", "rs_rate"),
    **{c: (c,) for c in ("before_tax_income_jpy", "withholding_tax_jpy")},
    "tax_jpy": ("consumption_tax_jpy", "tax_jpy"),
    "after_tax_income_jpy_a": ("after_tax_income_jpy", "after_tax_income_jpy_a"),
    "after_tax_income_jpy_b": ("after_tax_income_jpy_b",),
    "exchange_rate": ("exchange_rate", "rate_jpy_krw"),
    "rate_krw_krw": ("rate_krw_krw",),
    "col31": (),
    **{c: (c,) for c in ("fee_krw", "before_tax_krw", "after_tax_krw", "after_tax_income_krw", "vat_krw", "withholding_tax_krw", "sales_krw", "mg_begin", "mg_increase", "mg_decrease", "mg_end", "note1", "note2")},
    **{f"extra_{i}": () for i in range(45, 63)},
}
OLD_DEFAULTS = {"company": "RJ", "country": "JP", "settlement_currency": "JPY", "vehicle_currency": "KRW", "fee_jpy": 0.0, "withholding_tax_jpy": 0.0, "rate_krw_krw": 1.0, "mg_begin": 0.0, "mg_increase": 0.0, "mg_decrease": 0.0, "mg_end": 0.0}
OLD_DATES = ("updated", "launch_date", "sales_month", "settlement_month", "deposit_month")


def old_workbook_rows(records: DataFrame) -> DataFrame:
    """Records under the 62 columns of the older sheet; of a column's fields the first that is no blank.

    Columns that the template computes (31, 45 to 62) are null. A share is text as the record labels or states it.
    """
    texts = {"unique_identifier", "channel_title_jp", "title_kr", "title_jp", "recoder", "company", "country", "clients", "channel", "type", "distribution_strategy", "settlement_currency", "vehicle_currency", "rs", "note1", "note2"}

    def value(name: str) -> Column:
        kind = "string" if name in texts else "date" if name in OLD_DATES else "double"
        told = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in OLD_COLUMNS[name] if c in records.columns]
        first = F.coalesce(*told) if told else F.lit(None).cast("string")
        typed = first if kind == "string" else first.try_cast(kind)
        return F.coalesce(typed, F.lit(OLD_DEFAULTS[name])) if name in OLD_DEFAULTS else typed

    return records.select(*(value(c).alias(c) for c in OLD_COLUMNS))


def month_sheet(month: str) -> str:
    """The name of the older workbook's sheet of a month (YYYYMM)."""
    return f"일본_신INPUT_{int(month[4:6])}월"
