"""Statement files of each platform as lines: which sheets, columns, months and kinds each platform's files have.

A reader is a declaration. ``sheet_table`` turns rows of sheets (``xlsx.read_xlsx``) into a table by the header row it
finds in each; text files are read by ``daily.read_table`` in the reader's ``encoding``. ``lines`` then gives (title,
kind, channel, sales, pay, rate, month, raw_title, file), which ``statements.settled`` adds up. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import dates
from ledgerloom.functions import text as T
from ledgerloom.functions import titles as N
from ledgerloom.functions.joins import taken_once, with_group
from ledgerloom.operators.settlement import GUESSED_NOTE

Get = Callable[[str], Column]

#: Titles that stand for sums, and marks of episodes.
TOTALS = r"(?i)合計|TOTAL"
#: More columns than any sheet has.
WIDEST = 1 << 20
SPLIT = "分冊|連載"


def _month_in(text: Column, pattern: str) -> Column:
    """The first of the month that ``pattern`` finds as (year, month); null where it finds none."""
    found = F.concat_ws("-", F.regexp_extract(text, pattern, 1), F.lpad(F.regexp_extract(text, pattern, 2), 2, "0"), F.lit("01"))
    return F.when(text.rlike(pattern), found).try_cast("date")


def _num(c: Column) -> Column:
    return T.amount(c)


def _rate(c: Column) -> Column:
    """As a fraction: 40, 40% and 0.4 alike; of several tiers the highest."""
    tiers = F.transform(F.regexp_extract_all(F.coalesce(c.cast("string"), F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))
    top = F.array_max(tiers)
    return F.when(top > 1, top / 100).otherwise(top)


def _suffix_kind(title: Column) -> Column:
    return F.when(title.contains("【タテヨミ】"), "WT").when(title.rlike(N.SPLIT_EDITIONS), "EP").otherwise("EB")


@dataclass(frozen=True)
class Reader:
    """How a platform's files are read.

    ``columns``: the names in the file by field; title, sales and pay, and what ``kind``, ``channel`` or ``where`` need.
    A number is a place, counted from the first column of the header row. ``skip``: rows above the first of the data,
    where columns are places. ``month``: from the row or, where that says nothing, from names of file and sheet.
    ``sums``: titles that stand for sums of other rows. ``sibling``: how another edition of a title is found in its file,
    where the kind hangs on one. ``guessed``: whether the kind is a guess that an earlier ledger may correct.
    """

    columns: dict[str, str | int]
    sales: Callable[[Get], Column] = lambda g: _num(g("sales"))
    pay: Callable[[Get], Column] = lambda g: _num(g("pay"))
    kind: Callable[[Get], Column] = lambda g: F.lit("WT")
    month: Callable[[Get], Column] = lambda g: _month_in(g("file"), r"(20\d{2})(0[1-9]|1[0-2])")
    channel: Callable[[Get], Column] | str = ""
    title: Callable[[Get], Column] = lambda g: F.trim(g("raw_title"))
    where: Callable[[Get], Column] | None = None
    sums: str | None = None
    sibling: Callable[[DataFrame, str, list[str]], DataFrame] | None = None
    guessed: Callable[[Get], Column] = lambda g: F.lit(False)
    sheets: str | None = None
    skip: int = 1
    optional: tuple[str, ...] = ()
    sep: str = ","
    encoding: str = "Shift_JIS"
    drop_lines: int = 0


def _ebj_channel(g: Get) -> Column:
    return F.when(g("store").contains("LINE"), "line").when(g("_kind").isin("WT", "WR", "WN"), "ebj_webtoon").otherwise("ebj")


#: A platform's shops, the kinds its forms stand for, and months' names in short.
BOOKLIVE_STORES = {"ブックライブ": "booklive", "ブッコミ": "bookcomi"}
BOOKLIVE_KINDS = {"WT": "WT", "版面": "EP"}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _named(c: Column, names: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(F.trim(c) == k, v) for k, v in names.items()))


def _lezhin_month(g: Get) -> Column:
    """A year and month, a short name such as Mar-26, else the first of the quarter that the file's name holds."""
    short = F.lower(F.regexp_extract(F.trim(g("month")), r"^([A-Za-z]{3})-\d{2}$", 1))
    place = F.array_position(F.array(*map(F.lit, MONTHS)), short).cast("int")
    year = (F.lit(2000) + F.regexp_extract(F.trim(g("month")), r"^[A-Za-z]{3}-(\d{2})$", 1).try_cast("int")).cast("int")
    quarter = r"(?i)(20\d{2}).*?Q([1-4])"
    start = F.make_date(F.regexp_extract(g("file"), quarter, 1).try_cast("int"), F.regexp_extract(g("file"), quarter, 2).try_cast("int") * 3 - 2, F.lit(1))
    return F.coalesce(_month_in(g("month"), r"(\d{4})[.\-/年]\s*(\d{1,2})"), F.when(place > 0, F.make_date(year, place, F.lit(1))), start)


def _comico_month(g: Get) -> Column:
    number = lambda n: _num(g(n)).cast("int")
    return F.when((number("year") > 0) & number("month").between(1, 12), F.make_date(number("year"), number("month"), F.lit(1)))


#: The files' sheets and columns.
READERS: dict[str, Reader] = {
    "cmoa": Reader(
        {"title": "タイトル名", "pay": "支払額"},
        sales=lambda g: F.lit(0.0),  # follows from the payment, or from ``with_detail``
        kind=lambda g: _suffix_kind(g("_title")),
        month=lambda g: _month_in(g("file"), r"_N\d+_(\d{4})(\d{2})_"),
        channel="cmoa",
        title=lambda g: N.CANONICAL["cmoa"](F.trim(g("raw_title"))),
        sums=TOTALS,
        sep="\t",
    ),
    "piccoma": Reader(
        {"title": 1, "rate": 2, "current_episodes": 7, "current_volumes": 8, "final_episodes": 11, "final_volumes": 12},
        sales=lambda g: F.lit(0.0),  # by ``piccoma_lines``
        pay=lambda g: F.lit(0.0),
        skip=3,
        channel="piccoma",
    ),
    "piccoma_detail": Reader(
        {"title": 2, "sales": 14, "rate": 15, "pay": 16},
        month=lambda g: _month_in(g("file"), r"株式会社RIVERSE_(\d{4})(\d{2})\d{2}"),
        kind=lambda g: N.piccoma_kind(g("_title"), F.lit("話")),
        channel="piccoma",
        sheets=r"<?話売>?.*精算対象使用件数",
    ),
    "piccoma_detail_volumes": Reader(
        {"title": 2, "sales": 12, "rate": 13, "pay": 14},
        month=lambda g: _month_in(g("file"), r"株式会社RIVERSE_(\d{4})(\d{2})\d{2}"),
        kind=lambda g: N.piccoma_kind(g("_title"), F.lit("巻")),
        channel="piccoma",
        sheets=r"<?巻売>?.*精算対象使用件数",
    ),
    "piccoma_ads": Reader(
        {"day": 0, "title": 3, "sales": 6, "rate": 7, "pay": 8},
        sales=lambda g: F.round(_num(g("sales")) * 100),  # in cents
        pay=lambda g: F.round(_num(g("pay")) * 100),
        kind=lambda g: F.lit("AD"),
        month=lambda g: dates.iso_month(g("day")),
        channel="piccoma_ads",
        sheets="動画リワード_株式会社RIVERSE",
    ),
    "piccoma_gaiakuhan": Reader(
        {"month": "対象年月", "title": "対象作品", "sales": "受領額", "rate": "分配料率", "pay": "分配金"},
        kind=lambda g: F.lit("EB"),
        month=lambda g: dates.iso_month(g("month")),
        channel="piccoma_gaiakuhan",
        sheets="外販お支払報告書",
    ),
    "renta": Reader(
        {"title": "書名", "price": "価格", "units": "売上冊数", "upgrades": "アップグレード冊数", "pay": "支払額"},
        sales=lambda g: _num(g("price")) * (_num(g("units")) + _num(g("upgrades"))),
        kind=lambda g: N.renta_kind(F.trim(g("raw_title")), g("has_sibling")),
        channel="renta",
        title=lambda g: N.CANONICAL["renta"](g("raw_title")),
        sibling=N.with_sibling,
    ),
    "line_ebj": Reader(
        {"title": "タイトル名", "store": "書店名", "unit": "販売単位区分", "service": "サービス区分", "sales": "販売額計", "pay": "許諾額計"},
        kind=lambda g: N.line_ebj_kind(g("_title"), F.trim(g("unit")), g("has_sibling"), g("service")),
        month=lambda g: F.add_months(_month_in(g("file"), r"(\d{4})(\d{2})\d{2}\d{6,}"), F.when(g("store").contains("LINE"), -2).otherwise(-1)),
        channel=_ebj_channel,
        title=lambda g: N.CANONICAL["line_ebj"](g("raw_title")),
        where=lambda g: F.trim(g("store")) != "",
        sibling=N.with_tall_sibling,
        guessed=lambda g: N.line_ebj_guessed(g("_title"), F.trim(g("unit")), g("service")),
        optional=("service", "unit"),
    ),
    "line_ad": Reader(
        {"title": "タイトル", "month": "報告年月", "sales": "売上額(基準額)", "rate": "配分料率", "pay": "支払額"},
        kind=lambda g: F.lit("AD"),
        month=lambda g: dates.iso_month(g("month")),
        channel="line_ad",
    ),
    "booklive": Reader(
        {"month": "配信月", "title": "タイトル名", "store": "書店名称", "form": "WT/版面", "sales": "BookLive売上", "pay": "権利元取分(税抜)", "pay_gross": "権利元取分(税込)", "tax": "消費税額"},
        kind=lambda g: _named(g("form"), BOOKLIVE_KINDS),
        month=lambda g: dates.iso_month(g("month")),
        channel=lambda g: _named(g("store"), BOOKLIVE_STORES),
        guessed=lambda g: F.lit(True),
        where=lambda g: _named(g("store"), BOOKLIVE_STORES).isNotNull() & _named(g("form"), BOOKLIVE_KINDS).isNotNull(),
    ),
    "mechacomic": Reader(
        {"title": "シリーズ名", "name": "書名", "sales": "売上金額", "rate": "率", "pay": "支払", "unit": "種別"},
        kind=lambda g: N.mechacomic_kind(g("_title"), F.trim(g("unit")), g("has_sibling")),
        guessed=lambda g: N.mechacomic_guessed(g("_title"), F.trim(g("unit")), g("has_sibling")),
        channel="mechacomic",
        sheets="^(スマートフォン明細|アプリ明細)$",
        sibling=N.with_sibling,
    ),
    "comico": Reader(
        {"year": 0, "month": 1, "content": 2, "title": 5, "paid": 10, "coins": 14, "rate": 20, "share": 21, "share_all": 30},
        sales=lambda g: F.lit(0.0),  # by ``comico_lines``
        pay=lambda g: F.lit(0.0),
        month=_comico_month,
        channel="comico jp",
        sheets="^プラットフォーム売上現況$",
        skip=2,
    ),
    "comico_ads": Reader(
        {"year": 0, "month": 1, "content": 3, "title": 8, "sales": 9, "rate": 10, "pay": 11},
        kind=lambda g: F.lit("AD"),
        month=_comico_month,
        channel="comico_ads",
        sheets="^広告売上$",
    ),
    "dmm": Reader(
        {"title": 4, "units": 8, "sales": 9},
        pay=lambda g: F.lit(0.0),  # a share of the sales
        kind=lambda g: N.dmm_series(g("raw_title"))["kind"],
        channel=lambda g: F.when(g("sheet") == "ﾌﾞｯｸｽ(ｱﾀﾞﾙﾄ)", "dmm_fanza").otherwise("dmm"),
        title=lambda g: N.CANONICAL["dmm"](N.dmm_series(g("raw_title"))["series"]),
        sheets=r"^ﾌﾞｯｸｽ\((ｱﾀﾞﾙﾄ|一般)\)$",
    ),
    "u_next": Reader({"title": "タイトル名", "sales": "売上", "pay": "分配額", "rate": "料率"}, channel="u-next", sums=TOTALS, sheets="コンテンツ", optional=("rate",)),
    "mediado": Reader(
        {"title": "タイトル名称", "form": "発行形態", "price": "販売価格", "units": "DL数", "rate": "料率", "pay": "税抜き金額"},
        sales=lambda g: _num(g("price")) * _num(g("units")),
        kind=lambda g: N.mediado_kind(g("_title"), F.coalesce(*(F.when(F.concat_ws(" ", g("form"), g("file")).contains(w), k) for w, k in (("タテヨミ", "TATE"), ("コミック", "COMIC"), ("書籍", "BOOK")))), g("has_sibling")),
        channel="mediado_sales",
        sibling=N.with_sibling,
        sep="\t",
    ),
    "mbj": Reader(
        {"title": "タイトル", "form": "フォーマット", "section": "区分", "rate": "分配料率", "sales": "売上金額", "pay": "支払金額"},
        kind=lambda g: N.mbj_kind(F.trim(g("raw_title")), F.coalesce(g("form"), F.lit("")), F.coalesce(g("section"), F.lit(""))),
        channel="mbj_sales",
        title=lambda g: N.mbj_title(g("raw_title"), N.mbj_kind(F.trim(g("raw_title")), F.coalesce(g("form"), F.lit("")), F.coalesce(g("section"), F.lit("")))),
        optional=("section",),
    ),
    "mangabang": Reader(
        {"month": "年月", "title": "タイトル名", "sales": "総収益（税抜）", "rate": "版権料率", "pay": "版権元収益（税込）"},
        month=lambda g: dates.iso_month(g("month")),
        channel="mangabang",
        title=lambda g: N.full_tilde(F.trim(g("raw_title"))),
        drop_lines=1,
    ),
    "kadokawa": Reader(
        {"title": "書名", "sales": "合計金額（明細）", "paid_on": "支払日", "booked_on": "計上日付"},
        pay=lambda g: _num(g("sales")),
        kind=lambda g: F.lit("EB"),
        month=lambda g: F.coalesce(F.add_months(dates.iso_month(g("paid_on")), -1), dates.iso_month(g("booked_on"))),
        channel="kadokawa",
        where=lambda g: _num(g("sales")) != 0,
        optional=("booked_on",),
    ),
    "lezhin_beltoon": Reader(
        {"title": "タイトル", "sales": "売上額(円)", "pay": "支払(円)", "rate": "料率", "month": "精算月"},
        kind=lambda g: F.when(g("_title").rlike(SPLIT), "EP").otherwise("WT"),
        month=_lezhin_month,
        channel=lambda g: F.when(g("file").rlike("(?i)beltoon"), "beltoon").otherwise("lezhin"),
        optional=("month",),
    ),
    "beaglee": Reader(
        {"title": "コミック名称", "sales": "課金額（税抜）", "pay": "ロイヤリティ(税抜)", "rate": "ロイヤリティ率"},
        kind=lambda g: F.when(g("_title").rlike(SPLIT), "EP").when(g("_title").rlike("タテヨミ|待ちコミ"), "WT").otherwise("EB"),
        month=lambda g: _month_in(g("sheet"), r"(20\d{2})(\d{2})"),
        channel="beaglee",
        sums="^合計$",
        sheets=r"20\d{4}",
        optional=("rate",),
    ),
    "invoice": Reader(
        {"title": "内容", "price": "単価", "rate": "印税率", "units": "数量", "sales": "金額"},
        pay=lambda g: _num(g("sales")),
        kind=lambda g: F.lit("OTHER"),
        month=lambda g: F.coalesce(_month_in(g("file"), r"(20\d{2})年\s*(\d{1,2})月"), _month_in(g("file"), r"(20\d{2})(0[1-9]|1[0-2])")),
        where=lambda g: (_num(g("sales")) != 0) & ~g("raw_title").rlike("振込手数料|振込先"),
        sheets="請求書",
        optional=("price", "rate", "units"),
    ),
}


def _cell(c: Column) -> Column:
    """A cell's text without space around it and line ends."""
    return _unbroken(F.trim(F.coalesce(c, F.lit(""))))


def _unbroken(text: Column) -> Column:
    """Without line ends, which few texts have."""
    return F.when(text.contains("\n") | text.contains("\r"), F.translate(text, "\r\n", "")).otherwise(text)


def _picked(body: DataFrame, places: dict[str, Column]) -> DataFrame:
    """(file, sheet, row_index, the cells at ``places``, null where blank), step by step, so that each is taken once."""
    own = lambda step: body.select("file", "sheet", "row_index", *(step(f).alias(f) for f in places))
    body = body.select("file", "sheet", "row_index", *(F.get("cells", at).alias(f) for f, at in places.items()))
    body = own(lambda f: _cell(F.col(f)))
    return taken_once(own(lambda f: F.nullif(F.col(f), F.lit(""))))


def sheet_table(cells: DataFrame, reader: Reader, until: Column | None = None) -> DataFrame:
    """(file, sheet, row_index, the reader's columns as strings) of rows (file, sheet, row_index, cells) of any sheets.

    The header row of a sheet is its first that holds all columns that are not optional, white space aside; a sheet
    without one gives no rows. Where columns are places, the rows after ``skip`` count, from the first column that a
    sheet uses in the rows above. One row a sheet is joined back; a sheet's rows are not gathered. ``until``: a sheet with
    a header ends before its first row of which this holds.
    """
    rows = cells if reader.sheets is None else cells.where(F.col("sheet").rlike(reader.sheets))
    names = {f: c for f, c in reader.columns.items() if isinstance(c, str)}
    if not names:
        used = F.array_position(F.transform("cells", lambda c: _cell(c) != ""), True)
        above = F.when(F.col("row_index") <= reader.skip, F.nullif(used, F.lit(0).cast("long")))
        first = rows.groupBy("file", "sheet").agg(F.min(above).cast("int").alias("_from"), F.count("*").alias("_rows")).where("_from is not null")
        body = with_group(rows.where(F.col("row_index") > reader.skip), first, ["file", "sheet"], counted="_rows")
        return _picked(body, {f: F.col("_from") - 1 + F.lit(at) for f, at in reader.columns.items()})
    needed = [c for f, c in names.items() if f not in reader.optional]
    is_header = F.array_size(F.array_intersect("cells", F.array(*map(F.lit, needed)))) == len(set(needed))
    # the names must be somewhere in the row's text; only then are all its cells looked at
    end = F.lit(None).cast("long") if until is None else F.when(until, F.col("row_index").cast("long"))
    near = rows.select("file", "sheet", "row_index", "cells", end.alias("_end"), F.array_join("cells", "\t").alias("_text")).withColumn("_text", _unbroken(F.col("_text")))
    some = reduce(lambda a, b: a & b, (F.col("_text").contains(c) for c in needed)) if needed else F.lit(True)
    near = near.select("file", "sheet", "row_index", "_end", F.when(some, F.transform("cells", _cell)).alias("cells"))
    near = near.select("file", "sheet", F.when(is_header, F.col("row_index").cast("long")).alias("_row"), "_end", "cells")
    # of the first header row the places of its columns, one number each, so that no row is sorted for them
    place = {f: F.when(F.col("_row").isNotNull(), F.col("_row") * WIDEST + F.array_position("cells", c)) for f, c in names.items()}
    head = near.groupBy("file", "sheet").agg(F.count("*").alias("_rows"), F.min("_row").alias("_head"), F.min("_end").alias("_end"), *(F.min(at).alias(f"_at_{f}") for f, at in place.items())).where("_head is not null")
    at = lambda f: F.nullif((F.col(f"_at_{f}") - F.col("_head") * WIDEST).cast("int"), F.lit(0)) - 1
    head = head.select("file", "sheet", "_rows", "_head", *([] if until is None else ["_end"]), *(at(f).alias(f"_at_{f}") for f in names))
    body = with_group(rows, head, ["file", "sheet"], counted="_rows").where("row_index > _head")
    body = body if until is None else body.where("_end is null or row_index < _end")
    return _picked(body, {f: F.col(f"_at_{f}") for f in names})


def text_table(table: DataFrame, reader: Reader, file: Column | None = None) -> DataFrame:
    """As ``sheet_table``, of a table whose columns bear the file's names; ``file`` is the rows' file, else Spark's."""
    have = {c.strip(): c for c in table.columns}
    missing = [c for f, c in reader.columns.items() if c not in have and f not in reader.optional]
    if missing:
        raise ValueError(f"no columns {missing} among {table.columns}")
    field = lambda c: F.nullif(F.trim(F.col(f"`{have[c]}`").cast("string")), F.lit("")) if c in have else F.lit(None).cast("string")
    return table.select((F.input_file_name() if file is None else file).alias("file"), F.lit("").alias("sheet"), F.lit(None).cast("int").alias("row_index"), *(field(c).alias(f) for f, c in reader.columns.items()))


def lines(table: DataFrame, platform: str, reader: Reader | None = None) -> DataFrame:
    """(file, sheet, raw_title, title, kind, channel, sales, pay, rate, month, note2, further fields of the file) of a reader's table.

    Rows without a title and rows of sums are left out. The month is null where neither row nor name says it. ``reader``:
    another than the platform's own.
    """
    reader = reader or READERS[platform]
    rows = table.withColumnRenamed("title", "raw_title").where(F.trim("raw_title") != "")
    if reader.sums:
        rows = rows.where(~F.trim("raw_title").rlike(reader.sums))
    get: Get = F.col
    if reader.where is not None:
        rows = rows.where(reader.where(get))
    rows = rows.withColumn("_title", reader.title(get))
    if reader.sibling:
        rows = reader.sibling(rows, "_title", ["file"])
    rows = rows.withColumn("_kind", reader.kind(get))
    channel = reader.channel(get) if callable(reader.channel) else F.lit(reader.channel)
    taken = {"file", "sheet", "row_index", "raw_title", "sales", "pay", "rate", "month", "title", "kind", "channel", "note2"}
    more = [c for c in reader.columns if c not in taken]
    rate = _rate(F.col("rate")) if "rate" in reader.columns else F.lit(None).cast("double")
    return rows.select("file", "sheet", "raw_title", F.col("_title").alias("title"), F.col("_kind").alias("kind"), channel.alias("channel"), reader.sales(get).alias("sales"), reader.pay(get).alias("pay"), rate.alias("rate"), reader.month(get).alias("month"), F.when(reader.guessed(get), GUESSED_NOTE).alias("note2"), *more)


def with_detail(own: DataFrame, detail: DataFrame) -> DataFrame:
    """cmoa's lines with the sales and rate of the detail table (タイトル名, 単価, 件数, 料率), by title; without one as they are."""
    of = lambda c: _num(F.col(c))
    # a rate above 0 is the effective one; of several the highest, as rows have no order
    sums = detail.groupBy(N.CANONICAL["cmoa"](F.trim("タイトル名")).alias("title")).agg(F.sum(of("単価") * of("件数")).alias("_sales"), F.max(F.when(of("料率") > 0, of("料率") / 100)).alias("_rate"))
    rest = [c for c in own.columns if c not in ("title", "sales", "rate")]
    return own.join(sums, "title", "left").select("title", *rest, F.coalesce("_sales", F.lit(0.0)).alias("sales"), F.coalesce("_rate", F.lit(0.4)).alias("rate"))


def piccoma_lines(summary: DataFrame, detail: DataFrame, month: Column, overrides: DataFrame | None = None) -> DataFrame:
    """Lines of episodes and of volumes of the summary's titles (``sheet_table``'s columns), with the detail's sales.

    ``detail``: lines of piccoma_detail and piccoma_detail_volumes. The greater of the current and the final settlement
    is paid; sales that the detail does not state follow from it by the rate. Titles with neither are left out.
    ``overrides`` (title, kind) are kinds that are known, a row a title; others but novels are guesses.
    """
    unit = lambda name, mark: F.struct(F.lit(mark).alias("unit"), F.greatest(_num(F.col(f"current_{name}")), _num(F.col(f"final_{name}"))).alias("pay"))
    rows = summary.where(~F.col("title").contains("合計") & (F.trim("title") != ""))
    share = _num(F.col("rate")) / 100
    rows = rows.select("file", F.trim("title").alias("title"), share.alias("rate"), F.explode(F.array(unit("episodes", "話"), unit("volumes", "巻"))).alias("u"))
    volume = F.col("kind") == "EB"
    sold = detail.groupBy("title", F.when(volume, "巻").otherwise("話").alias("unit")).agg(F.sum("sales").alias("_sales"))
    out = rows.select("file", "title", "rate", "u.unit", "u.pay").join(sold, ["title", "unit"], "left")
    sales = F.coalesce("_sales", F.when(F.col("rate") > 0, F.col("pay") / F.col("rate")), F.lit(0.0))
    out = out.withColumn("sales", sales).where("sales <> 0 or pay <> 0")
    out = out.join(overrides.select("title", F.col("kind").alias("_known")), "title", "left") if overrides is not None else out.withColumn("_known", F.lit(None).cast("string"))
    kind = N.piccoma_kind(F.col("title"), F.col("unit"))
    note = F.when(F.col("_known").isNotNull() | (kind == "WN"), None).when(F.col("unit") == "巻", f"{GUESSED_NOTE}:volume").otherwise(f"{GUESSED_NOTE}:chapter")
    return out.select("file", F.col("title").alias("raw_title"), "title", F.coalesce("_known", kind).alias("kind"), F.lit("piccoma").alias("channel"), "sales", "pay", "rate", month.alias("month"), note.alias("note2"))


def comico_lines(own: DataFrame) -> DataFrame:
    """Lines of comico's platform sheet (``lines``): of magazines the paid coins and the own share, else all coins and shares.

    A title counts as a magazine if any of its rows says so, by its content or by a share of 0.55.
    """
    magazine = F.coalesce(F.col("content") == "magazine_comic", F.lit(False)) | F.coalesce(F.col("rate") == 0.55, F.lit(False))
    by_title = own.groupBy("file", "title", "month").agg(
        F.max(magazine).alias("_magazine"),
        *(F.sum(_num(F.col(c))).alias(f"_{c}") for c in ("paid", "coins", "share", "share_all")),
        F.max("rate").alias("rate"),
        F.min("content").alias("content"),
    )
    out = N.with_sibling(by_title, "title", ["file"])
    kind = N.comico_kind(F.col("title"), F.when(F.col("_magazine"), "magazine_comic").otherwise(F.col("content")), F.lit(None).cast("double"), F.col("has_sibling"))
    pick = lambda a, b: F.when(F.col("_magazine"), F.col(a)).otherwise(F.col(b))
    return out.select("file", F.col("title").alias("raw_title"), "title", kind.alias("kind"), F.lit("comico jp").alias("channel"), pick("_paid", "_coins").alias("sales"), pick("_share", "_share_all").alias("pay"), "rate", "month")
