"""Titles as each platform's statements write them: the form they are compared in, and the kind of edition they show.

Kinds: WT webtoon, WR webtoon revised, EP episode, EB e-book, WN web novel. Where a kind hangs on another edition of the
same title, ``with_sibling`` brings that in by one equi-join on the titles' keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import SPACE, WIDE_ALNUM, nfkc, squeezed

WIDE_DIGITS = "０１２３４５６７８９"
DIGIT = "[0-9０-９]"
ASCII_ALNUM = "".join(chr(ord(c) - 0xFEE0) for c in WIDE_ALNUM)

#: Words and marks of editions that settle a kind.
NOVEL_WORDS = r"(?iu)ノベル|小説|書籍|web\s*novel|ｗｅｂ\s*novel|WN"
NOVEL_IN_BRACKETS = r"(?iu)(?:^|[（(【\[\s])(?:ノベル|小説|web\s*novel|ｗｅｂ\s*novel|WN|ＷＮ)(?:$|[）)】\]\s])"
REVISED_WORDS = r"(?i)(?:^|[^A-Za-z])WR(?:[^A-Za-z]|$)|改訂版|revised|revision"
SPLIT_EDITIONS = "【分冊版】|【連載版】"
TALL = "【タテヨミ】"
COMPLETE_BRACKETS = r"［完全版］|\[完全版\]"
REVISED_BRACKETS = r"［改訂版］|\[改訂版\]"
COMPLETE_OR_REVISED = r"[\[［【](?:完全版|改訂版)[\]］】]"
MBJ_EPISODE = f"第{DIGIT}+(?:[．.]{DIGIT}+)?話"
MBJ_VOLUME = f"（{DIGIT}+(?:[～〜-]{DIGIT}+)?）"
SB_EPISODES = r"\(?\s*\d+\s*話\s*~\s*\d+\s*話\s*\)?"
#: Forms of a volume, in order of precedence.
SB_VOLUMES = (r"第\s*(\d+)\s*巻", r"\(\s*(\d+)\s*\)\s*$", r"(\d+)\s*$")
SB_EDITIONS = r"【[^】]*(?:分冊|単行本|合本)[^】]*】|\(\s*(?:分冊版|単行本|コミック)\s*\)"


def without(text: Column, *patterns: str) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, "")
    return text


def half_digits(text: Column) -> Column:
    return F.translate(text, WIDE_DIGITS, "0123456789")


def full_tilde(text: Column) -> Column:
    return F.translate(text, "〜", "～")


def booklive_title(t: Column) -> Column:
    plain = without(half_digits(F.translate(t, "〜～［］", "~~[]")), f"{SPACE}+")
    return F.replace(plain, F.lit("【完全版】"), F.lit("[完全版]"))


def dmm_title(t: Column) -> Column:
    wide = F.octet_length(t) > F.char_length(t)
    return F.translate(F.when(wide, half_digits(F.translate(t, "［］～", "[]〜"))).otherwise(t), " 　♥", "")


def shueisha_title(t: Column) -> Column:
    """Without the kind in brackets at the end."""
    plain = squeezed(F.translate(t, WIDE_ALNUM + "（）", ASCII_ALNUM + "()"))
    return F.trim(without(plain, r"\((?:広告|単行本|話配信)\)$"))


def mbj_title(t: Column, kind: Column) -> Column:
    """The work of a row: of webtoons everything from the episode on goes, of others a last episode; then a last volume."""
    webtoon = F.trim(without(F.trim(without(F.trim(t), f"(?s)\\s*{MBJ_EPISODE}.*$")), r"[\[［【]改訂版[\]］】]"))
    other = F.trim(without(F.trim(t), f"{MBJ_EPISODE}(?:外伝{DIGIT}+)?\\s*$"))
    return F.trim(without(F.when(kind == "WT", webtoon).otherwise(other), f"{MBJ_VOLUME}\\s*$"))


def dmm_series(t: Column) -> Column:
    """(series, kind) by the number at the end: volumes, episodes, or parts of a webtoon."""
    t = F.trim(t)
    rules = ((r"^(.*?)\s*(\d+)巻$", "EB", "巻"), (r"^(.*?)\s*(\d+)話(?:\s+外伝\d+)?$", "EP", "話"), (r"^(.*?[^\d])\s*(\d+)(?:\s+外伝\d+)?$", "WT", ""))
    out = F.struct(t.alias("series"), F.lit("WT").alias("kind"))
    for pattern, kind, sign in reversed(rules):  # the sign is looked for first, as the patterns try every start of a number
        out = F.when(t.contains(sign) & t.rlike(pattern), F.struct(F.trim(F.regexp_extract(t, pattern, 1)).alias("series"), F.lit(kind).alias("kind"))).otherwise(out)
    return out


def ichijinsha_volume(t: Column) -> Column:
    """(base, volume): a number at the end, in brackets or after a space; null where there is none."""
    t = squeezed(t)
    out = F.struct(t.alias("base"), F.lit(None).cast("int").alias("volume"))
    for pattern in (f"^(.*?)\\s+({DIGIT}+)$", f"^(.*?)\\s*[（(]\\s*({DIGIT}+)\\s*[）)]$"):
        number = half_digits(F.regexp_extract(t, pattern, 2)).try_cast("int")
        out = F.when(t.rlike(pattern), F.struct(F.trim(F.regexp_extract(t, pattern, 1)).alias("base"), number.alias("volume"))).otherwise(out)
    return out


def sb_plain(t: Column) -> Column:
    """Without the marks of editions and episodes."""
    plain = without(F.translate(nfkc(F.coalesce(t, F.lit(""))), "〜「」『』", "~"))
    return F.regexp_replace(F.regexp_replace(plain, SB_EPISODES, " "), SB_EDITIONS, " ")


def sb_label(plain: Column) -> Column:
    """The series of a plain title, as it is shown."""
    series = plain
    for pattern in reversed(SB_VOLUMES):
        series = F.when(plain.rlike(pattern), F.regexp_replace(plain, pattern, " ")).otherwise(series)
    return without(without(series, r"\(\s*\)"), f"{SPACE}+")


def sb_volume(plain: Column) -> Column:
    """The number of a plain title's volume, as text without leading zeros; null where it has none."""
    number = F.coalesce(*(F.nullif(F.regexp_extract(plain, p, 1), F.lit("")) for p in SB_VOLUMES))
    return number.try_cast("long").cast("string")


def sb_work(t: Column) -> Column:
    """(series, volume): the key of a series, and its volume."""
    plain = sb_plain(t)
    return F.struct(F.lower(sb_label(plain)).alias("series"), sb_volume(plain).alias("volume"))


#: The form in which titles of a platform are compared.
CANONICAL: dict[str, Callable[[Column], Column]] = {
    "cmoa": full_tilde,
    "line_ebj": lambda t: F.trim(full_tilde(t)),
    "renta": lambda t: squeezed(F.translate(full_tilde(t), "［］", "[]")),
    "booklive": booklive_title,
    "dmm": dmm_title,
    "shueisha": lambda t: without(shueisha_title(t), f"{SPACE}+"),
}


# ---------------------------------------------------------------- kinds
def piccoma_kind(title: Column, unit: Column) -> Column:
    return F.when(unit == "巻", "EB").when(title.rlike(r"(?:（ノベル）|\(ノベル\))$"), "WN").otherwise("WT")


def renta_kind(title: Column, has_sibling: Column) -> Column:
    tall = F.when(title.contains("改訂版"), "WR").when(title.contains("完全版"), "WT").otherwise(F.when(has_sibling, "WR").otherwise("WT"))
    return F.when(title.rlike(SPLIT_EDITIONS), "EP").when(title.contains("【特装版】"), "EB").when(title.contains("【タテコミ】"), tall).otherwise("EB")


def _novel(title: Column, unit: Column, evidence: Column | None) -> Column:
    return F.concat_ws(" ", title, unit, *([evidence] if evidence is not None else [])).rlike(NOVEL_IN_BRACKETS)


def line_ebj_kind(title: Column, unit: Column, has_sibling: Column, evidence: Column | None = None) -> Column:
    """``evidence``: further fields in which a novel may show."""
    tall = F.when(title.rlike(REVISED_BRACKETS) | has_sibling, "WR").otherwise("WT")
    plain = F.when(title.rlike(SPLIT_EDITIONS), "EP").when(unit == "単話", "WT").otherwise("EB")
    return F.when(_novel(title, unit, evidence), "WN").when(title.contains(TALL), tall).otherwise(plain)


def line_ebj_guessed(title: Column, unit: Column, evidence: Column | None = None) -> Column:
    """The kind follows from the unit or a split edition alone."""
    return ~_novel(title, unit, evidence) & ~title.contains(TALL)


def mechacomic_kind(title: Column, unit: Column, has_sibling: Column) -> Column:
    revised = F.when(title.contains("改訂版") | has_sibling, "WR")
    volume = F.when(title.contains("分冊版"), "EP").otherwise("EB")
    return F.when(F.concat_ws(" ", title, unit).rlike(NOVEL_WORDS), "WN").otherwise(F.coalesce(revised, F.when(unit.contains("話"), "WT").when(unit == "巻", volume).otherwise("WT")))


def mechacomic_guessed(title: Column, unit: Column, has_sibling: Column) -> Column:
    """The kind follows from a sibling, or from a unit that says little."""
    sure = F.concat_ws(" ", title, unit).rlike(NOVEL_WORDS) | title.contains("改訂版")
    told = F.coalesce(unit.contains("話") | ((unit == "巻") & title.contains("分冊版")), F.lit(False))
    return ~sure & (has_sibling | ~told)


def mediado_kind(title: Column, source: Column, has_sibling: Column) -> Column:
    """``source``: TATE (vertical), BOOK, COMIC or another."""
    tall = F.when(title.rlike(REVISED_BRACKETS) | has_sibling, "WR").otherwise("WT")
    return F.when(source.isin("BOOK", "COMIC"), F.when(title.rlike(SPLIT_EDITIONS), "EP").otherwise("EB")).otherwise(tall)


def comico_kind(title: Column, content: Column, share: Column, has_sibling: Column) -> Column:
    magazine = F.coalesce(content == "magazine_comic", F.lit(False)) | F.coalesce(share == 0.55, F.lit(False))
    return F.when(magazine, F.when(title.contains("【特装版】"), "EB").otherwise("EP")).when(title.contains("【全年齢版】"), "WR").when(~title.contains("【完全版】") & has_sibling, "WR").otherwise("WT")


def mbj_kind(title: Column, form: Column, more: Column) -> Column:
    marks = F.concat_ws(" ", form, more, title)
    return F.when(F.lower(form).contains("webtoon"), "WT").when(marks.rlike(REVISED_WORDS), "WR").when(title.contains("【分冊版】") | title.rlike(MBJ_EPISODE), "EP").otherwise("EB")


def with_sibling(rows: DataFrame, title: str = "title_jp", within: list[str] | None = None, key: Column | None = None, complete: Column | None = None) -> DataFrame:
    """``rows`` with ``has_sibling``: another row (of the same ``within``) bears the same title marked as complete edition.

    Titles are compared by ``key``, by default without white space and marks of complete or revised editions; a title
    that is ``complete`` has no sibling itself. One row a key on the looked-up side, so that repeated titles do not
    multiply rows.
    """
    within = within or []
    key = without(F.col(title), COMPLETE_OR_REVISED, f"{SPACE}+") if key is None else key
    complete = F.col(title).rlike(r"[\[［【]完全版[\]］】]") if complete is None else complete
    whole = rows.where(complete).select(*(F.col(c).alias(f"_{c}") for c in within), key.alias("_base")).distinct().withColumn("_hit", F.lit(True))
    on = F.col("_key") == F.col("_base")
    for c in within:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = rows.withColumn("_key", key).join(whole, on, "left").withColumn("has_sibling", F.coalesce("_hit", F.lit(False)) & ~F.coalesce(complete, F.lit(False)))
    return out.select(*rows.columns, "has_sibling")


def with_tall_sibling(rows: DataFrame, title: str = "title_jp", within: list[str] | None = None) -> DataFrame:
    """``with_sibling`` among the titles that are read downwards, by their names without the mark of that."""
    t = F.col(title)
    key = F.when(t.contains(TALL), F.trim(without(t, COMPLETE_BRACKETS, REVISED_BRACKETS, TALL)))
    return with_sibling(rows, title, within, key, t.contains(TALL) & t.rlike(COMPLETE_BRACKETS))
