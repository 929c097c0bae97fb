"""Sheets of XLSX files as rows of strings: Spark lists and reads the files, and each sheet is a task's own work.

A sheet is found by its relation, not by its file's number, and read as a stream, row by row. Of strings the written text
counts and not its reading (furigana). Numbers are as stored, but for those whose format is a date's: they become
2026-05-31, with the time where there is one. Truth values are true and false; an error is a blank cell.
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file string, sheet string, row_index int, cells array<string>, place int"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
BATCH_ROWS = 5000
#: The built-in number formats of dates and times, of which these are times alone.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
TIME_FORMATS = {18, 19, 20, 21, 32, 33, 45, 46, 47}


@dataclass(frozen=True)
class Sheet:
    place: int
    name: str
    part: str
    from_1904: bool


def _local(name: str) -> str:
    return name.rpartition("}")[2]


def sheet_list(z: zipfile.ZipFile) -> list[Sheet]:
    """The worksheets in the workbook's order. Without relations, files by number; what has no file is left out."""
    names = set(z.namelist())
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    rels = {}
    if "xl/_rels/workbook.xml.rels" in names:
        for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{PACKAGE}Relationship"):
            target = r.get("Target", "")
            rels[r.get("Id")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
    props = book.find(f"{MAIN}workbookPr")
    old = props is not None and props.get("date1904") in ("1", "true")
    numbered = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    out = []
    for place, s in enumerate(book.iterfind(f"{MAIN}sheets/{MAIN}sheet")):
        part = rels.get(s.get(REL)) if rels else numbered[place] if place < len(numbered) else None
        if part in names and not part.startswith("xl/chartsheets"):
            out.append(Sheet(place, s.get("name"), part, old))
    return out


def _written(node: ElementTree.Element) -> str:
    """A string's text: its own and that of its runs, without phonetic runs."""
    runs = (t for c in node for t in ([c] if _local(c.tag) == "t" else c.iterfind(f"{MAIN}t") if _local(c.tag) == "r" else ()))
    text = "".join(t.text or "" for t in runs)
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


def _nodes(z: zipfile.ZipFile, part: str, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a name below the root's children, one by one; what is read is let go."""
    with z.open(part) as f:
        path: list[ElementTree.Element] = []
        for event, node in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                path.append(node)
                continue
            path.pop()
            if _local(node.tag) == tag:
                yield node
                node.clear()
                if path:
                    path[-1].remove(node)


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    part = "xl/sharedStrings.xml"
    return [_written(si) for si in _nodes(z, part, "si")] if part in z.namelist() else []


def date_styles(z: zipfile.ZipFile) -> list[str]:
    """For each style of cells: date, time or nothing."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {}
    for f in root.iter(f"{MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\\.|\[(?![hms]+\])[^\]]*\]|_.|\*.', "", f.get("formatCode", "").split(";")[0]).lower()
        day, hour = re.search(r"[yd]|(?<![hs:])m(?!.*s)", code), re.search(r"[hs]", code)
        own[int(f.get("numFmtId"))] = "" if "general" in code or re.search(r"[0#?]/", code) else "date" if day else "time" if hour else ""

    def kind(number: int) -> str:
        return own.get(number, "time" if number in TIME_FORMATS else "date" if number in DATE_FORMATS else "")

    styles = root.find(f"{MAIN}cellXfs")
    return [kind(int(x.get("numFmtId", 0))) for x in styles] if styles is not None else []


def _moment(value: str, kind: str, from_1904: bool) -> str:
    """A serial number as text; days before March 1900 are counted as the sheets do, with a 29 February."""
    try:
        seconds = round(float(value) * 86400)
        if kind == "time" and seconds < 86400:
            return str(dt.timedelta(seconds=seconds)).zfill(8)
        days = seconds // 86400 + (1462 if from_1904 else 0)
        day = dt.datetime(1899, 12, 30 if days >= 60 else 31) + dt.timedelta(days=days, seconds=seconds % 86400)
    except (ValueError, OverflowError):
        return value
    return day.strftime("%Y-%m-%d %H:%M:%S") if seconds % 86400 else day.strftime("%Y-%m-%d")


def _column(ref: str | None, after: int) -> int:
    """The column of a reference such as AB12, counted from 1; without one, that after the cell before."""
    letters = re.match(r"[A-Z]+", ref or "")
    if not letters:
        return after + 1
    at = 0
    for c in letters[0]:
        at = at * 26 + ord(c) - 64
    return at


def sheet_rows(z: zipfile.ZipFile, sheet: Sheet, strings: list[str], styles: list[str]) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells) of a sheet, in its order."""
    number = 0
    for row in _nodes(z, sheet.part, "row"):
        number = int(row.get("r", number + 1))
        cells: list[str | None] = []
        for c in row.iterfind(f"{MAIN}c"):
            at = _column(c.get("r"), len(cells))
            kind, value = c.get("t", "n"), c.findtext(f"{MAIN}v")
            if kind == "inlineStr":
                node = c.find(f"{MAIN}is")
                text = _written(node) if node is not None else None
            elif value is None or kind == "e":
                text = None
            elif kind == "s":
                text = strings[int(value)]
            elif kind == "b":
                text = "true" if value == "1" else "false"
            else:
                style = int(c.get("s", 0))
                date = styles[style] if kind == "n" and style < len(styles) else ""
                text = _moment(value, date, sheet.from_1904) if date else value
            cells += [None] * (at - len(cells))
            cells[at - 1] = text
        yield number, cells


def sheets(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number, cells) of a workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        strings, styles = shared_strings(z), date_styles(z)
        for s in sheet_list(z):
            yield from ((s.name, n, cells) for n, cells in sheet_rows(z, s, strings, styles))


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row a sheet, with the file: as many copies as sheets travel, of files of some megabytes."""
    for b in batches:
        for path, content in zip(b["path"], b["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                places = [s.place for s in sheet_list(z)]
            for place in places:
                yield pd.DataFrame({"file": [path], "place": [place], "content": [content]})


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["file", "sheet", "row_index", "cells", "place"]
    for b in batches:
        for path, place, content in zip(b["file"], b["place"], b["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                sheet = next(s for s in sheet_list(z) if s.place == place)
                strings, styles, rows = shared_strings(z), date_styles(z), []
                for number, cells in sheet_rows(z, sheet, strings, styles):
                    rows.append((path, sheet.name, number, cells, place))
                    if len(rows) >= BATCH_ROWS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                yield pd.DataFrame(rows, columns=columns)


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """One row a sheet row of all files under ``path``: file, sheet, row_index, cells and the sheet's place in its file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_listed, "file string, place int, content binary").repartition("file", "place").mapInPandas(_read, SCHEMA)


# ---------------------------------------------------------------- the weekly report
#: Words of the weekly report's header, by what a column holds, in order of precedence.
WEEKLY_HEADER = ("Title", "Channel", "Date", "Sales")
WEEKLY_COLUMNS = (
    ("channel_title_jp", r"channel.*title|title.*channel", 2),
    ("channel", r"channel", 3),
    ("title_jp", r"^title[(_]jp\)?$|title.*jp|jp.*title", 0),
    ("title_kr", r"^title[(_]kr\)?$|title.*kr|kr.*title", 1),
    ("sale_date", r"date|날짜|日付", 4),
    ("amount", r"sales|매출|売上|amount", 5),
)


def weekly_rows(cells: DataFrame) -> DataFrame:
    """Daily rows of weekly workbooks, from ``read_xlsx``: title_jp, title_kr, channel_title_jp, channel, sale_date, sales_amount.

    Of each file the first sheet named daily counts, else its first. The header is its first row with one of the known
    words, else row 2; a column is known by its words, the last such cell holding, else by its usual place. Rows without
    title, channel or day, or of no positive amount, are left out.
    """
    from ledgerloom.functions import money
    from ledgerloom.functions import text as N
    from ledgerloom.functions.joins import with_group
    from ledgerloom.sources.workbooks import any_day

    named = F.lower("sheet").contains("daily")
    chosen = cells.groupBy("file").agg(F.min(F.struct((~named).alias("other"), "place"))["place"].alias("place"))
    own = with_group(cells, chosen.withColumnRenamed("place", "_chosen"), ["file"]).where("place = _chosen").drop("_chosen")
    is_header = F.exists("cells", lambda c: F.coalesce(c.rlike("|".join(WEEKLY_HEADER)), F.lit(False)))
    heads = own.where(is_header).groupBy("file").agg(F.min(F.struct("row_index", "cells")).alias("head"))
    lowered = F.transform("head.cells", lambda c: F.lower(F.trim(c)))

    def kind(word: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern, _ in reversed(WEEKLY_COLUMNS):
            out = F.when(word.rlike(pattern), name).otherwise(out)
        return out

    # the columns' places follow from the header alone, once a file
    heads = heads.withColumn("kinds", F.transform(lowered, kind))
    last = lambda name: F.nullif(F.size("kinds") - F.array_position(F.reverse("kinds"), name), F.size("kinds").cast("long"))
    heads = heads.select("file", F.col("head.row_index").alias("_head"), *(last(name).cast("int").alias(f"_at_{name}") for name, _, _ in WEEKLY_COLUMNS))
    rows = with_group(own, heads, ["file"], "left").where(F.col("row_index") > F.coalesce("_head", F.lit(2)))
    at = lambda name, place: F.coalesce(f"_at_{name}", F.lit(place))
    got = {name: F.trim(F.coalesce(F.get("cells", at(name, place)), F.lit(""))) for name, _, place in WEEKLY_COLUMNS}
    out = rows.select(*(c.alias(n) for n, c in got.items()))
    whole = F.coalesce(money.half_up(F.col("amount").try_cast("double")), N.amount(F.col("amount")).cast("long"))
    text_day = F.try_to_timestamp(F.regexp_replace("sale_date", r"^(\d{4})\D(\d{1,2})\D(\d{1,2}).*$", "$1-$2-$3"), F.lit("y-M-d")).cast("date")
    out = out.select("title_jp", "title_kr", "channel_title_jp", "channel", F.coalesce(any_day(F.col("sale_date")), text_day).alias("sale_date"), whole.alias("sales_amount"))
    return out.where("title_jp <> '' and channel <> '' and sale_date is not null and sales_amount > 0")
