"""Statements that arrive as extracted text: ichijinsha's details and invoices, SB Creative's sales report, shueisha's scan.

Each function takes the texts or cells of many files at once and gives (records, problems). A file with a problem gives
no records at all: what is printed must add up to the yen, and nothing is guessed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import dates, money
from ledgerloom.functions.spellings import first_near
from ledgerloom.functions.text import SPACE, squeezed
from ledgerloom.functions.titles import WIDE_DIGITS, half_digits, ichijinsha_volume, sb_label, sb_plain, sb_volume, shueisha_title, without
from ledgerloom.operators.settlement import SCANNED_NOTE
from ledgerloom.sources.versioned import stored

Both = tuple[DataFrame, DataFrame]
#: Marks and words of ichijinsha's details and invoices.
DETAIL_MARK, PERIOD_MARK = "国内電子", r"集計期間\s*[：:]\s*"
PERIOD = r"(\d{4})年\s*(\d{1,2})月(?:\s*[～〜~\-－]\s*(?:(\d{4})年\s*)?(\d{1,2})月)?"
OFFSET_MARK = r"(?iu)[（(]\s*[MＭ][GＧ]\s*[）)]\s*$"
VOLUMES = r"第?\s*(\d+)\s*(?:[～〜~\-－―]\s*第?\s*(\d+)\s*)?巻"
ITEM_KINDS = (("素材費", "material_fee", "MF"), ("電子", "electronic", "EB"), ("単行本|紙", "paper_book", "PP"), ("原稿料", "manuscript_fee", "MF"))
ANNIVERSARY_FILES = "20周年記念|イラスト原稿料"
MANUSCRIPT_SUFFIX = "（20th色紙原稿料）"
#: Words of SB Creative's report.
SB_NOT_WORKS = r"配信分|電子書籍[/／]|小計|合計|\bGA\b"
SB_WORKS = r"コミック|分冊版|第\s*\d+\s*巻|\d+\s*話"
SB_CELLS = r"(?:[-−▲－]?[0-9０-９.．,，]+[%％]?|[①-⑳]|書名|価格|販売数|算出元|料率|区分|消費税率|ネット|グロス|電子書籍|ロイヤリティ[(（]税込[)）])"
SB_TOTALS = ("総合計額", "当期売上合計", "当期MG取崩額", "MG一覧シート参照")
SB_MONEY = r"[¥￥]\s*([-−▲]?[\d,]+)"
SB_ADVANCE = r"(?<![\d,¥￥.])(\d{3,6})\s+(.+?)\s+\d{4}年\d{1,2}月\s+((?:[¥￥]\s*[-−▲]?[\d,]+\s*){3,4})"
SB_DEPOSIT_MONTHS = 4
#: Words and kinds of shueisha's notice.
SHUEISHA_CUTS = ("単行本", "話配信", "EPUB", "フルカラー", "【")
SHUEISHA_HEADERS = "(?i)マンガMee|ジャンプ|原作使用料|WEB広告"
#: The share of the longer spelling, and the least number of edits, within which two spell one title.
NEAR = (0.45, 2)
#: Spellings of so many pages are taken together, so that numpy has much to do at a time; a page is never split.
TOGETHER = 64_000


def wide_volume(base: Column, volume: Column) -> Column:
    """Title with its volume as wide digits in wide brackets; without a volume the title alone."""
    return F.when(volume.isNull(), base).otherwise(F.concat(base, F.lit("（"), F.translate(volume.cast("string"), "0123456789", WIDE_DIGITS), F.lit("）")))


def signed_amount(text: Column) -> Column:
    """A printed amount with any of the minus signs; null where it is none."""
    return F.translate(F.regexp_replace(text, r"[¥￥\s,]", ""), "−▲", "--").try_cast("long")


def _month(year: Column, month: Column) -> Column:
    return F.to_date(F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-01")))


def _net_of_tax(rows: DataFrame, gross: str) -> DataFrame:
    """The record's amounts of a gross one: net, halves up, and the tax between them."""
    net = money.half_up(F.col(gross) / 1.1)
    return rows.withColumns({"before_tax_income": F.col(gross), "after_tax_income": net, "consumption_tax": F.col(gross) - net})


def _whole_files(rows: DataFrame, problems: DataFrame) -> DataFrame:
    return rows.join(problems.select("file").distinct(), "file", "left_anti")


# ---------------------------------------------------------------- ichijinsha
def folder_date(folder: Column) -> Column:
    """The date of eight digits in a folder's own name, else null."""
    own = F.regexp_extract(folder, r"([^/\\]*)[/\\]*$", 1)
    digits = F.regexp_extract(own, r"(?<!\d)(\d{8})(?!\d)", 1)
    return F.when(digits != "", F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date"))


def ichijinsha_details(files: DataFrame) -> Both:
    """Records and problems of detail statements (file, text; where there is one: folder, which names the deposit date).

    A row is a title, a period (of a range its last month) and an amount without tax. A row marked as the offset of an
    advance goes into the first row of the same title and volume in its file, wherever that stands; without one it is
    a problem, as are a row without month or amount and a file without rows.
    """
    flat = squeezed(half_digits(F.coalesce("text", F.lit(""))))
    parts = F.split(flat, DETAIL_MARK)
    folder = F.col("folder") if "folder" in files.columns else F.lit(None).cast("string")
    each = files.select("file", folder.alias("folder"), F.posexplode(F.slice(parts, F.lit(2), F.size(parts))).alias("place", "part"))
    title = F.trim(F.regexp_extract("part", f"^(.*?){PERIOD_MARK}", 1))
    after = F.regexp_extract("part", f"^.*?{PERIOD_MARK}(.*)$", 1)
    each = each.withColumns({"raw": title, "after": after}).where("raw <> ''")
    group = lambda i: F.regexp_extract("after", PERIOD, i)
    year = F.when((group(4) != "") & (group(3) != ""), group(3)).otherwise(group(1))
    month = F.when(group(4) != "", group(4)).otherwise(group(2))
    amount = F.regexp_extract(F.regexp_extract("after", f"^.*?{PERIOD}(.*)$", 5), r"-?\d[\d,]*", 0)
    offset = F.col("raw").rlike(OFFSET_MARK)
    each = each.withColumns({"year": year, "month": month, "number": F.replace(amount, F.lit(","), F.lit("")).try_cast("long"), "offset": offset})
    work = ichijinsha_volume(F.trim(F.regexp_replace("raw", OFFSET_MARK, "")))
    each = each.withColumn("work", work).withColumn("key", F.concat_ws("#", without(F.col("work.base"), f"{SPACE}+"), F.coalesce(F.col("work.volume").cast("string"), F.lit(""))))
    fault = F.when(F.col("year") == "", "no month").when(F.col("number").isNull(), "no amount")
    # read by what follows five times, while its expressions are dear: written once
    each = stored(each.select("file", "folder", "place", "raw", "year", "month", "number", "offset", "work", "key", fault.alias("problem")), "details")
    good = each.where("problem is null")
    met = good.groupBy("file", "key").agg(
        F.min(F.when(~F.col("offset"), F.col("place"))).alias("place"),
        F.sum(F.when(F.col("offset"), F.col("number"))).alias("advance"),
        F.min(F.when(F.col("offset"), F.col("raw"))).alias("raw"),
    )
    rows = good.where("not offset").join(met.where("place is not null").select("file", "place", "advance"), ["file", "place"], "left")
    rows = rows.withColumn("amount", F.col("number") + F.coalesce("advance", F.lit(0)))
    filled = good.where("not offset").select("file").distinct()
    problems = (
        each.where("problem is not null")
        .select("file", "problem", "raw")
        .unionByName(met.where("place is null").select("file", F.lit("offset without a row").alias("problem"), "raw"))
        .unionByName(files.select("file").distinct().join(filled, "file", "left_anti").select("file", F.lit("no rows").alias("problem"), F.lit(None).cast("string").alias("raw")))
    )
    gross = money.half_up(F.col("amount") * 1.1)
    records = _whole_files(rows, problems).select(
        "file",
        "place",
        wide_volume(F.col("work.base"), F.col("work.volume")).alias("title"),
        F.lit("EB").alias("kind"),
        _month(F.col("year"), F.col("month")).alias("sales_month"),
        folder_date(F.col("folder")).alias("deposit_date"),
        gross.alias("before_tax_income"),
        F.col("amount").alias("after_tax_income"),
        (gross - F.col("amount")).alias("consumption_tax"),
    )
    return records, problems.withColumnRenamed("raw", "title")


def ichijinsha_invoice(lines: DataFrame) -> DataFrame:
    """Invoice lines (file, place, title, quantity, unit_price, amount, sales_month, settlement_month) as records.

    Marks of a kind and of volumes are read outside the quoted title. A range of volumes becomes a row a volume: each
    has the unit price (else the whole part of the share), the last what is left, so that the rows add up to the line.
    A range that does not fit the quantity stays one row, with ``problem``. Manuscript fees have the sales month that is
    printed or none; all others that of the settlement.
    """
    raw = squeezed(half_digits(F.coalesce("title", F.lit(""))))
    quoted = F.regexp_extract("raw", "「([^」]+)」", 1)
    out = lines.withColumn("raw", raw).withColumn("quoted", F.trim(quoted))
    out = out.withColumn("outside", F.when(F.col("quoted") != "", F.regexp_replace("raw", "「[^」]+」", " ")).otherwise(F.col("raw")))
    volume = lambda i: F.regexp_extract("outside", VOLUMES, i).try_cast("int")
    kind, code = F.when(F.col("file").rlike(ANNIVERSARY_FILES), "manuscript_fee").otherwise("other"), F.lit("MF")
    for pattern, name, short in reversed(ITEM_KINDS):
        kind = F.when(F.col("outside").rlike(pattern), name).otherwise(kind)
        code = F.when(F.col("outside").rlike(pattern), short).otherwise(code)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("raw", VOLUMES, " "), r"[(（][^)）]*[)）]\s*$", " "), r"(?:イラスト)?原稿料$", " ")
    out = out.withColumns({"first": volume(1), "last": F.coalesce(volume(2), volume(1)), "item": kind, "kind": code, "base": F.when(F.col("quoted") != "", F.col("quoted")).otherwise(squeezed(bare))})
    count = F.col("last") - F.col("first") + 1
    ranged = F.coalesce(count > 1, F.lit(False))
    unfit = ranged & F.coalesce(F.col("quantity") != count, F.lit(False))
    unit = F.when(F.col("unit_price") > 0, F.col("unit_price")).otherwise(F.floor(F.col("amount") / count)).cast("long")
    each = F.when(ranged & ~unfit, F.sequence("first", "last")).otherwise(F.array("first"))
    out = out.withColumns({"unit": unit, "spread": ranged & ~unfit, "problem": F.when(unfit, "quantity differs from the volumes")})
    out = out.withColumn("volume", F.explode(each))
    rest = F.col("amount") - F.col("unit") * (F.col("last") - F.col("first"))
    share = F.when(~F.col("spread"), F.col("amount")).when(F.col("volume") == F.col("last"), rest).otherwise(F.col("unit")).cast("long")
    fee = F.col("item") == "manuscript_fee"
    named = F.when(F.col("problem").isNotNull(), F.col("title")).otherwise(wide_volume(F.col("base"), F.col("volume")))
    out = out.withColumns({"share": share, "named": named}).withColumn("gross", money.half_up(F.col("share") * 1.1))
    return out.select(
        "file",
        "place",
        F.col("named").alias("title"),
        F.when(fee & F.col("problem").isNull() & ~F.col("spread"), F.concat("base", F.lit(MANUSCRIPT_SUFFIX))).otherwise(F.col("named")).alias("channel_title"),
        "kind",
        F.col("item"),
        F.when(fee, F.col("sales_month")).otherwise(F.coalesce("settlement_month", "sales_month")).alias("sales_month"),
        F.col("gross").alias("before_tax_income"),
        F.col("share").alias("after_tax_income"),
        (F.col("gross") - F.col("share")).alias("consumption_tax"),
        "problem",
    )


# ---------------------------------------------------------------- SB Creative
def _in_text(files: DataFrame) -> DataFrame:
    """Each report's regions: the works' rows up to the channels or the list of advances, and that list."""
    text = F.coalesce("text", F.lit(""))
    out = files.select("file", text.alias("text"), F.regexp_extract(text, r"対象期間\s*(\d{4})\s*年", 1).alias("year"), F.regexp_extract(text, r"対象期間\s*\d{4}\s*年\s*(\d{1,2})\s*月", 1).alias("month"))
    end = lambda pattern: F.nullif(F.regexp_instr("text", F.lit(pattern)), F.lit(0))
    listed, channels = end("MG一覧(?!シート)"), end("チャネル別")
    out = out.withColumns({"listed": listed, "end": F.least(listed, channels)})
    head = F.when(F.col("end").isNull(), F.col("text")).otherwise(F.expr("substr(text, 1, end - 1)"))
    tail = F.when(F.col("listed").isNull(), "").otherwise(F.expr("substr(text, listed)"))
    month = F.when(F.col("year") != "", _month(F.col("year"), F.col("month")))
    return out.select("file", month.alias("sales_month"), head.alias("head"), tail.alias("tail"))


def _entries(reports: DataFrame) -> DataFrame:
    """All amounts of a report's first region with the words before each: place, title, amount, detail."""
    found = F.arrays_zip(
        F.regexp_extract_all("head", F.lit(f"(?s)(.*?){SB_MONEY}"), 1).alias("title"),
        F.regexp_extract_all("head", F.lit(f"(?s)(.*?){SB_MONEY}"), 2).alias("amount"),
    )
    each = reports.select("file", F.posexplode(found).alias("place", "x")).select("file", "place", signed_amount(F.col("x.amount")).alias("amount"), F.col("x.title").alias("title"))
    ends = (rf"^\s*(?:{SB_CELLS}(?:\s+|$))+", rf"(?:(?:^|\s+){SB_CELLS})+\s*$")
    each = each.where("amount is not null").withColumn("title", squeezed(without(F.col("title"), *ends)))
    each = each.withColumn("plain", sb_plain(F.col("title")))
    marked = F.col("title").rlike(SB_WORKS) | F.coalesce(F.length(sb_volume(F.col("plain"))) <= 3, F.lit(False))
    return each.withColumn("detail", (F.col("title") != "") & ~F.col("title").rlike(SB_NOT_WORKS) & marked).drop("plain")


def sb_report(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Details (file, place, title, royalty), draw-downs (file, place, title, draw) and problems of reports (file, text).

    The three printed totals (sales, draw-down, what is left) are those amounts behind their labels of which the first
    less the second is the third; there must be one such choice, and the rows read must add up to it.
    """
    reports = _in_text(files)
    entries = _entries(reports)
    listed = F.arrays_zip(F.regexp_extract_all("tail", F.lit(SB_ADVANCE), 2).alias("title"), F.regexp_extract_all("tail", F.lit(SB_ADVANCE), 3).alias("cells"))
    third = F.get(F.regexp_extract_all("x.cells", F.lit(SB_MONEY), 1), F.lit(2))
    draws = reports.select("file", F.posexplode(listed).alias("place", "x")).select("file", "place", F.trim("x.title").alias("title"), signed_amount(third).alias("draw")).where("draw is not null")
    number, first = r"[-−▲]?\d[\d,]*", F.regexp_instr("tail", F.lit(SB_ADVANCE))
    header = F.when(first > 0, F.expr("substr(tail, 1, row_at - 1)")).otherwise(F.col("tail"))
    places = [F.instr("head", label) for label in SB_TOTALS]
    ordered = (places[0] > 0) & (places[1] > places[0]) & (places[2] > places[1]) & (places[3] > places[2])
    printed = reports.withColumn("row_at", first).select(
        "file",
        signed_amount(F.regexp_extract(header, rf"(?:^|\s){number}\s+{number}\s+({number})\s+{number}(?=\s|$)", 1)).alias("printed_draw"),
        F.when(ordered, F.size(F.regexp_extract_all(F.expr(f"substr(head, 1, instr(head, '{SB_TOTALS[0]}') - 1)"), F.lit(SB_MONEY), 1))).alias("before"),
    )
    near = entries.where("not detail and amount >= 0").join(printed, "file").where("place >= before")
    pool = near.groupBy("file").agg(F.collect_list(F.struct("place", "amount")).alias("pool"))  # what is printed behind the labels
    sums = entries.where("detail").groupBy("file").agg(F.sum("amount").alias("royalties"))
    drawn = draws.groupBy("file").agg(F.sum("draw").alias("drawn"))
    out = printed.join(pool, "file", "left").join(sums, "file", "left").join(drawn, "file", "left")
    p = F.col("pool")

    def left(g: Column, d: Column) -> Column:
        apart = lambda f: (f["place"] != g["place"]) & (f["place"] != d["place"])
        return (d["place"] != g["place"]) & F.exists(p, lambda f: (f["amount"] == g["amount"] - d["amount"]) & apart(f))

    able = lambda d: F.coalesce(d["amount"] == F.col("printed_draw"), F.lit(True))
    triple = lambda g: F.transform(F.filter(p, lambda d: able(d) & left(g, d)), lambda d: F.struct(g["amount"].alias("sales"), d["amount"].alias("draw")))
    found = F.array_distinct(F.flatten(F.transform(F.filter(p, lambda g: g["amount"] > 0), triple)))
    out = out.withColumn("found", F.coalesce(found, F.array().cast("array<struct<sales:bigint,draw:bigint>>")))
    total = F.get("found", F.lit(0))
    checks = F.array(
        F.when(F.col("before").isNull(), "labels of the totals are missing or out of order"),
        F.when(F.col("before").isNotNull() & (F.size("found") == 0), "no totals that fit"),
        F.when(F.size("found") > 1, "several totals that fit"),
        F.when((F.size("found") == 1) & (total["sales"] != F.coalesce("royalties", F.lit(0))), "details do not add up"),
        F.when((F.size("found") == 1) & (total["draw"] != F.coalesce("drawn", F.lit(0))), "draw-downs do not add up"),
    )
    problems = out.select("file", F.explode(F.array_compact(checks)).alias("problem"))
    details = entries.where("detail").select("file", "place", "title", F.col("amount").alias("royalty"))
    return _whole_files(details, problems), _whole_files(draws, problems), problems


def sb_net(details: DataFrame, draws: DataFrame, months: DataFrame) -> Both:
    """Records a work and volume, royalties less draw-downs, and problems.

    ``details`` (file, place, title, royalty), ``draws`` (file, place, title, draw), ``months`` (file, sales_month).
    A row without a volume goes to the one volume that its series has among the details, or, where they have none,
    among the draw-downs; with several or none it is a problem. So is a draw-down without a volume. What is not
    positive is left out. The series is spelt as its first detail spells it, else as its first draw-down.
    """
    def work(rows: DataFrame, rank: int) -> DataFrame:
        out = rows.withColumn("plain", sb_plain(F.col("title"))).withColumns({"label": sb_label(F.col("plain")), "volume": sb_volume(F.col("plain"))})
        return out.withColumns({"series": F.lower("label"), "rank": F.lit(rank)}).where("series <> ''")

    # each is read several times below, and its titles are dear to take apart: written once
    sold = stored(work(details.where(~F.coalesce(F.col("title").rlike(SB_NOT_WORKS), F.lit(False))), 0).drop("plain"), "sb-details")
    drawn = stored(work(draws, 1).drop("plain"), "sb-draws")
    volumes = lambda d, name: d.where("volume is not null").groupBy("file", "series").agg(F.min("volume").alias(f"{name}_least"), F.max("volume").alias(f"{name}_most"))
    only = volumes(sold, "sold").join(volumes(drawn, "drawn"), ["file", "series"], "full")
    one = lambda name: F.when(F.col(f"{name}_least") == F.col(f"{name}_most"), F.col(f"{name}_least"))
    only = only.select("file", "series", F.when(F.col("sold_least").isNotNull(), one("sold")).otherwise(one("drawn")).alias("only"), F.lit(True).alias("known"))
    loose = sold.where("volume is null").drop("volume").join(only, ["file", "series"], "left").withColumnRenamed("only", "volume")
    part = lambda d, gross, draw: d.where("volume is not null").select("file", "series", "volume", F.struct("rank", "place", "label").alias("spelt"), gross.alias("gross"), draw.alias("draw"))
    none = F.lit(0).cast("long")
    every = part(sold, F.col("royalty"), none).unionByName(part(loose.withColumn("rank", F.lit(2)), F.col("royalty"), none)).unionByName(part(drawn, none, F.col("draw")))
    net = every.groupBy("file", "series", "volume").agg((F.sum("gross") - F.sum("draw")).alias("net"), F.min("spelt")["label"].alias("label")).where("net > 0")
    net = _net_of_tax(net.join(months.select("file", "sales_month"), "file", "left"), "net")
    records = net.select(
        "file",
        wide_volume(F.col("label"), F.col("volume")).alias("title"),
        F.lit("EB").alias("kind"),
        "sales_month",
        dates.month_end_after(F.col("sales_month"), SB_DEPOSIT_MONTHS).alias("deposit_date"),
        "before_tax_income",
        "after_tax_income",
        "consumption_tax",
    )
    unbound = loose.where("volume is null").select("file", F.when(F.col("known"), "several volumes").otherwise("no volume").alias("problem"), "title")
    return records, unbound.unionByName(drawn.where("volume is null").select("file", F.lit("draw-down without a volume").alias("problem"), "title"))


def sb_statement(files: DataFrame) -> Both:
    """``sb_report`` and ``sb_net`` of reports (file, text)."""
    details, draws, problems = sb_report(files)
    records, unbound = sb_net(details, draws, _in_text(files))
    return records, problems.withColumn("title", F.lit(None).cast("string")).unionByName(unbound)


# ---------------------------------------------------------------- shueisha
def payment_date(text: Column) -> Column:
    """The printed day of payment, signs that a scan garbles allowed for."""
    form, plain = r"[御お]?[支文]?\s*払\s*日\s*(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", half_digits(text)
    g = lambda i: F.regexp_extract(plain, form, i)
    return F.when(g(1) != "", F.try_to_timestamp(F.concat_ws("-", g(1), F.lpad(g(2), 2, "0"), F.lpad(g(3), 2, "0")), F.lit("yyyy-MM-dd")).cast("date"))


def source_month(text: Column) -> Column:
    """2026年02月発生分 as the first of that month."""
    form, plain = r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*発生分", half_digits(text)
    month = F.regexp_extract(plain, form, 2).try_cast("int")
    return F.when(month.between(1, 12), _month(F.regexp_extract(plain, form, 1), month.cast("string")))


def advert_month(remark: Column) -> Column:
    """The month in a remark such as マンガMee広告202602."""
    plain = without(half_digits(remark), r"\s+")
    forms = (r"広告(\d{4})(\d{2})", r"(20\d{2})(0[1-9]|1[0-2])")
    out = F.lit(None).cast("date")
    for form in reversed(forms):
        month = F.regexp_extract(plain, form, 2)
        out = F.when(plain.rlike(form), F.when(month.try_cast("int").between(1, 12), _month(F.regexp_extract(plain, form, 1), month))).otherwise(out)
    return out


def work_cell(text: Column) -> Column:
    """(title, kind) of a cell: the title ends at the first mark of an edition; null without one."""
    compact = without(shueisha_title(F.concat(text, F.lit(" "))), f"{SPACE}+")
    title = F.regexp_extract(compact, f"^(.*?)(?:{'|'.join(SHUEISHA_CUTS)}|$)", 1)
    return F.when(title != "", F.struct(title.alias("title"), F.when(compact.contains("話配信"), "話配信").otherwise("単行本").alias("kind")))


def title_line(cell: Column) -> Column:
    """The first line of a cell of the cover that is a work's title: no heading, no day, two signs at least."""
    compact = lambda x: F.regexp_replace(without(shueisha_title(F.concat(x, F.lit(" "))), f"{SPACE}+"), r"(?i)(?:マンガM(?:ee)?|Mee)?広告20\d{4}", "")
    lines = F.transform(F.split(cell, "\n"), compact)
    return F.get(F.filter(lines, lambda x: ~x.rlike(SHUEISHA_HEADERS) & ~x.rlike(r"^[\d.,/\s-]+$") & (F.char_length(x) >= 2)), F.lit(0))


def _choose(readings: list, total: int) -> list[int] | None:
    """The first choice of one reading a row, in the readings' order, that adds up to the total; no sum is tried twice."""
    lists = [[int(x) for x in r if x is not None and x > 0] for r in readings]
    reach: list[set[int]] = [{0}]
    for options in reversed(lists):
        reach.append({s + x for s in reach[-1] for x in options if s + x <= total})
    if total not in reach[-1]:
        return None
    chosen, rest = [], total
    for i, options in enumerate(lists):
        chosen.append(next(x for x in options if rest - x in reach[len(lists) - 1 - i]))
        rest -= chosen[-1]
    return chosen


def choose_amounts(cells: DataFrame) -> DataFrame:
    """``cells`` (file, place, readings array<long>, total, more) with ``payment``: the first readings, else a choice.

    Only where a file's first readings (positive ones) do not add up to its printed total, others are tried; where no
    choice does, the first stay and the file fails its check later. Rows of one scanned page are a small group.
    """
    schema = cells.withColumn("payment", F.lit(None).cast("long")).schema

    def choose(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("place")
        first = [int(r[0]) if r is not None and len(r) else 0 for r in page["readings"]]
        total = page["total"].iloc[0]
        found = None
        if pd.notna(total) and (sum(first) != total or min(first) <= 0):
            found = _choose([r if r is not None else [] for r in page["readings"]], int(total))
        return page.assign(payment=found or first)

    return cells.groupBy("file").applyInPandas(choose, schema)


def _differs(column: pa.ChunkedArray) -> np.ndarray:
    """Whether a row's value is another than the row's before, from the second on; null is a value."""
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.diff(coded) != 0


def spelling_groups(rows: DataFrame) -> DataFrame:
    """Sums of details (file, place, title, kind, payment) whose titles a scan spells alike: the first that is near enough.

    In order of place a title joins the first group of its file and kind whose first spelling is at most
    max(2, 45 % of the longer one's length) edits away, else it opens one. Equal spellings always meet the same group,
    so that they are added up first and the fold runs over the different spellings of a page; lengths that differ by more
    than the bound are told apart without a distance. The most frequent spelling names a group, of equals the first.
    """
    key = without(shueisha_title(F.col("title")), f"{SPACE}+")
    spelt = rows.withColumn("key", key).groupBy("file", "kind", "key").agg(F.min("place").alias("place"), F.count("*").alias("n"), F.sum("payment").alias("payment"))

    def headed(rows: pa.Table) -> pa.Table:
        page = np.cumsum(np.concatenate(([0], _differs(rows["file"]) | _differs(rows["kind"])))) if len(rows) else np.zeros(0, int)
        known, head = pc.is_valid(rows["key"]).to_numpy(), np.full(len(rows), -1)  # no key: a group of its own
        head[known] = first_near(rows["key"].drop_null().to_pylist(), page[known], *NEAR)
        return rows.append_column("head", pa.array(head, pa.int64()))

    def run(batches):
        held = None
        for b in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([b])]) if held else pa.Table.from_batches([b])
            ends = np.flatnonzero(_differs(held["file"]) | _differs(held["kind"]))
            if len(ends) and ends[-1] >= TOGETHER:
                yield from headed(held.slice(0, ends[-1] + 1)).to_batches()
                held = held.slice(ends[-1] + 1)
        if held:
            yield from headed(held).to_batches()

    pages = spelt.repartition("file", "kind").sortWithinPartitions("file", "kind", "place", "key")
    each = pages.mapInArrow(run, T.StructType([*spelt.schema, T.StructField("head", T.LongType())]))
    frequent = F.struct((-F.col("n")).alias("n"), "place", "key")
    return each.groupBy("file", "kind", "head").agg(F.min(frequent)["key"].alias("title"), F.sum("payment").alias("payment"), F.sum("n").alias("source_rows")).drop("head")


def shueisha_notice(pages: DataFrame, adverts: DataFrame, details: DataFrame) -> Both:
    """Records and problems of scanned notices.

    ``pages``: a row a file, with payment_date, second_date (of page 2), grand_total, summary_total, detail_total and
    detail_month; ``adverts`` (file, place, title, payment, sales_month) and ``details`` (file, place, title, kind,
    payment). The details must add up to the total of their page and to the cover's summary, and with the adverts to
    the grand total. Records carry the note by which scanned titles are set against the earlier ledger.
    """
    bad = lambda c: F.count_if(F.coalesce(c, F.lit(True)))
    of_adverts = adverts.groupBy("file").agg(F.sum("payment").alias("advert_sum"), bad(F.col("payment") <= 0).alias("bad_adverts"), F.count_if(F.col("sales_month").isNull()).alias("no_month"))
    of_details = details.groupBy("file").agg(F.sum("payment").alias("detail_sum"), bad(F.col("payment") <= 0).alias("bad_details"))
    out = pages.join(of_adverts, "file", "left").join(of_details, "file", "left")
    reads = {
        "no payment date": F.col("payment_date").isNull(),
        "payment dates differ": F.col("payment_date") != F.col("second_date"),
        "no adverts": F.col("bad_adverts").isNull(),
        "no details": F.col("bad_details").isNull(),
        "no grand total": F.col("grand_total").isNull(),
        "no summary": F.col("summary_total").isNull(),
        "no total of the details": F.col("detail_total").isNull(),
        "no month of the details": F.col("detail_month").isNull(),
        "an advert's amount": F.col("bad_adverts") > 0,
        "an advert's month": F.col("no_month") > 0,
        "a detail's amount": F.col("bad_details") > 0,
    }
    adds = {
        "details differ from their total": F.col("detail_sum") != F.col("detail_total"),
        "details differ from the summary": F.col("detail_sum") != F.col("summary_total"),
        "rows differ from the grand total": F.col("advert_sum") + F.col("detail_sum") != F.col("grand_total"),
    }
    listed = lambda faults: F.array_compact(F.array(*(F.when(c, name) for name, c in faults.items())))
    out = out.withColumn("unread", listed(reads)).withColumn("problems", F.when(F.size("unread") > 0, F.col("unread")).otherwise(listed(adds)))
    out = stored(out.select("file", "payment_date", "detail_month", "problems"), "notices")  # a row a file, read by all that follows
    good = out.where("size(problems) = 0").select("file", "payment_date", "detail_month")
    grouped = spelling_groups(details.join(good.select("file"), "file", "left_semi")).join(good, "file")
    plain = adverts.join(good, "file").withColumn("title", shueisha_title(F.col("title")))
    record = lambda d, suffix, kind, channel, month: _net_of_tax(d, "payment").select(
        "file", "title", F.concat("title", F.lit("("), suffix, F.lit(")")).alias("channel_title"), F.lit(kind).alias("kind"), F.lit(channel).alias("channel"), month.alias("sales_month"),
        F.col("payment_date").alias("deposit_date"), "before_tax_income", "after_tax_income", "consumption_tax", F.lit(SCANNED_NOTE).alias("note2"),
    )
    records = record(plain, F.lit("広告"), "AD", "manga mee", F.col("sales_month")).unionByName(record(grouped, F.col("kind"), "EB", "Jumptoon", F.col("detail_month")))
    return records, out.select("file", F.explode("problems").alias("problem"))
