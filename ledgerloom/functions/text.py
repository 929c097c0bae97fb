"""Titles, channels and numbers as text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FULL_WIDTH = "".join(chr(0xFF01 + i) for i in range(94))
HALF_WIDTH = "".join(chr(0x21 + i) for i in range(94))

SPACE = "[\\s\u3000\u00a0\ufeff]"

#: Editions and formats that a title may bear, by the brackets around them; the last also without brackets.
FORMAT_MARKS = ("ノベル", "版面", "LDF")
VOLUME_MARK = "巻"
SQUARE_MARKS = ("完全版", "分冊版", "特装版", "連載版", "改訂版")
LENS_MARKS = ("分冊版", "特装版", "連載版", "完全版", "改訂版", "タテヨミ")
BARE_MARKS = ("改訂版", "完全版", "分冊版", "特装版", "連載版")
#: Product types in order of precedence, with the brackets that count; the first that fits holds.
PRODUCT_TYPES = (("ノベル", "（） ()"), ("版面", "（） ()"), ("LDF", "（） ()"), ("分冊版", "【】"), ("特装版", "【】"), ("連載版", "【】"), ("完全版", "[] 【】"))
ORIGINAL = "オリジナル"
#: What a Korean title gets for an edition, in order; the first that fits holds.
KR_SUFFIXES = (("完全版", " 완전판"), ("改訂版", " 개정판"), ("分冊版", " 분권판"), ("特装版", " 특장판"), ("連載版", " 연재판"))


def _within(marks: tuple[str, ...], brackets: str) -> str:
    """A pattern for any of the marks within any of the pairs of brackets (pairs apart by a space)."""
    escaped = lambda c: "\\" + c if c in "()[]" else c
    return "|".join(f"{escaped(o)}(?:{'|'.join(marks)}){escaped(c)}" for o, c in brackets.split())


MARKED = "|".join((_within((*FORMAT_MARKS, VOLUME_MARK), "（） ()"), _within(SQUARE_MARKS, "[]"), _within(LENS_MARKS, "【】")))
BARE = f"{SPACE}*(?:{'|'.join(BARE_MARKS)})"


def squeezed(text: Column) -> Column:
    """White space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def base_title(title: Column) -> Column:
    """Without the marks of editions and formats; other words and brackets stay."""
    return squeezed(F.regexp_replace(F.regexp_replace(title, MARKED, ""), BARE, ""))


def product_type(title: Column) -> Column:
    kind = F.lit(ORIGINAL)
    for mark, brackets in reversed(PRODUCT_TYPES):
        kind = F.when(title.rlike(_within((mark,), brackets)), F.lit(mark)).otherwise(kind)
    return F.when(title.isNotNull(), kind)


def half_width(text: Column) -> Column:
    return F.translate(text, FULL_WIDTH, HALF_WIDTH)


def fold_wave_dash(text: Column) -> Column:
    return F.translate(text, "〜～", "~~")


#: Signs that loose matching takes as others.
CORE_SIGNS = ("～〜！？\u3000［］", "~~!? []")
WIDE_ALNUM = "".join(chr(0xFEE0 + ord(c)) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def core_title(title: Column) -> Column:
    """For loose matching: letters and digits at half width, without subtitles, bracketed parts, editions and spaces."""
    t = F.translate(title, WIDE_ALNUM + CORE_SIGNS[0], "".join(chr(ord(c) - 0xFEE0) for c in WIDE_ALNUM) + CORE_SIGNS[1])
    for pattern in (r"~[^~]*~", r"【[^】]*】", r"\[[^\]]*\]", r"（[^）]*）", r"\([^)]*\)", BARE, f"{SPACE}+"):
        t = F.regexp_replace(t, pattern, "")
    return t


def edition_suffix(title: Column) -> Column:
    out = F.lit("")
    for mark, suffix in reversed(KR_SUFFIXES):
        out = F.when(title.contains(mark), F.lit(suffix)).otherwise(out)
    return out


def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(text: Column) -> Column:
    """Spark has no Unicode normalisation of its own."""
    return F.pandas_udf(_nfkc, "string")(text)


def title_key(title: Column) -> Column:
    return F.lower(F.regexp_replace(nfkc(title), r"\s+", ""))


def carry_key(channel: Column, kind: Column, title: Column) -> Column:
    """Identity of a carried row; null where a part is blank."""
    parts = [F.trim(F.coalesce(c, F.lit(""))) for c in (channel, kind)] + [title_key(fold_wave_dash(F.coalesce(title, F.lit(""))))]
    return F.when((parts[0] != "") & (parts[1] != "") & (parts[2] != ""), F.concat_ws("\u0000", *parts))


def channel_name(channel: Column, aliases: dict[str, str]) -> Column:
    """By a table of aliases; unknown names stay."""
    known = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.coalesce(known[F.lower(F.trim(channel))], channel)


def amount(text: Column) -> Column:
    """A number from a statement's cell: currency signs, blanks and separators go, what is no number is 0."""
    plain = F.regexp_replace(F.translate(half_width(text), "−，", "-,"), r"[¥￥円,\s　]", "")
    # most cells are plain numbers, which lose nothing by that; a blank text is no number
    return F.coalesce(text.try_cast("double"), plain.try_cast("double"), F.lit(0.0))


def rate(text: Column) -> Column:
    """0.6 from '60%' or '50/60%': the first number with a percent sign; a plain number up to 1 is the rate itself."""
    share = F.regexp_extract(half_width(text), r"([0-9]+(?:\.[0-9]+)?)\s*%", 1)
    plain = F.trim(text).try_cast("double")
    return F.when(share != "", share.try_cast("double") / 100).otherwise(F.when(plain <= 1, plain).otherwise(plain / 100))


def like_escaped(text: str) -> str:
    """A pattern for ilike ... escape '\\' that finds ``text`` itself anywhere."""
    for sign in ("\\", "%", "_"):
        text = text.replace(sign, "\\" + sign)
    return f"%{text}%"


def inserted(short: Column, long: Column) -> Column:
    """How many signs must be put into ``short`` to give ``long``; null where it is no subsequence.

    A fold over the signs of ``long``: each that is the next of ``short`` takes it.
    """
    taken = F.aggregate(F.split(long, ""), F.lit(0), lambda n, c: F.when(F.substring(short, n + 1, F.lit(1)) == c, n + 1).otherwise(n))
    return F.when(F.coalesce(F.char_length(short) == 0, F.lit(False)), F.char_length(long)).when(taken == F.char_length(short), F.char_length(long) - taken)


def _semantic(column: Column, kind: str, normal: Callable[[Column], Column]) -> Column:
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.concat(F.lit("t:"), F.date_format(column, "yyyy-MM-dd"))
    if kind != "string":
        return F.concat(F.lit("n:" if kind != "boolean" else "t:"), column.cast("string"))
    plain = squeezed(normal(column))
    number = F.replace(plain, F.lit(","), F.lit(""))
    return F.when(number.rlike(r"^[+-]?\d+(\.\d+)?$"), F.concat(F.lit("n:"), number.try_cast("double").cast("string"))).otherwise(F.concat(F.lit("t:"), plain))


def semantic(column: Column, kind: str) -> Column:
    """A cell's meaning as text: ``n:`` and a number, ``t:`` and a text; null where it is null.

    Texts are normalised (NFKC), white space is one space; texts that are numbers, with signs between thousands, are
    numbers; days are texts in ISO form. A blank text is ``t:``.
    """
    return _semantic(column, kind, nfkc)


def semantic_plain(column: Column, kind: str) -> Column:
    """As ``semantic``, for texts of ASCII alone, which normalising leaves as they are."""
    return _semantic(column, kind, lambda c: c)


def meaning(text: str) -> str | None:
    """As ``semantic`` of a text, within a task."""
    plain = re.sub("[ \t\n\x0b\f\r\u3000\u00a0\ufeff]+", " ", unicodedata.normalize("NFKC", text)).strip(" ")
    number = re.fullmatch(r"([+-]?[0-9]+(?:\.[0-9]+)?)([\x85\u2028\u2029]?)", plain.replace(",", ""))
    if number is None:
        return f"t:{plain}"
    return None if number[2] else f"n:{float(number[1])}"  # Spark's pattern ends before a line's end, its cast does not
