"""The title master: its page and audit log, comparison with a workbook, genres filled in, names rewritten."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as T

#: Editions and numbers that a title loses before its genre is looked up.
EDITIONS = r"【分冊版】|【特装版】|【連載版】|【完全版】|\[完全版\]|（ノベル）|\(ノベル\)"
LAST_NUMBER = r"\s*[0-9]+$"
BRACKETED_NUMBER = r"（[0-9]+）|\([0-9]+\)"
SHORTEST_PREFIX, LONGEST_PREFIX = 4, 10


def where_equal(rows: DataFrame, **values) -> DataFrame:
    """Rows whose columns equal the values given; None and '' ask for nothing."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]) if kv[1] not in (None, "") else d, values.items(), rows)


def page_of(rows: DataFrame, order: list[Column], page: int = 1, size: int = 50, most: int = 200) -> DataFrame:
    """One page in ``order`` (which must be total), with the number of all rows in ``total_count``."""
    size = min(most, max(1, size))
    count = rows.agg(F.count("*").alias("total_count"))
    return rows.orderBy(*order).offset((max(1, page) - 1) * size).limit(size).crossJoin(F.broadcast(count))  # one row


def title_master(titles: DataFrame, companies: DataFrame, genres: DataFrame, active: Column) -> DataFrame:
    """Active titles with what is known of their company and genre; unknown ones stay null."""
    return titles.where(active).join(companies, "company", "left").join(genres, "genre", "left")


def stacked_matrix(sales: DataFrame, titles: DataFrame, channels: list[str]) -> DataFrame:
    """A row a genre, a column a channel; 0 where nothing was sold. ``channels`` is stated, so that no pass looks for it."""
    rows = sales.join(titles.where("genre is not null").select("title_jp", "genre"), "title_jp")
    return rows.groupBy("genre").pivot("channel", channels).sum("sales_amount").na.fill(0)


def reconcile(master: DataFrame, workbook: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, equal, different, only_in_master, only_in_workbook); a field that is blank or '-' in the workbook does not count.

    Both sides have one row a key. One full join, one pass.
    """
    stated = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")).isin("", "-") == F.lit(False)
    m, w = master.select(key, *(F.col(f).alias(f"m_{f}") for f in fields), F.lit(True).alias("in_m")), workbook.select(key, *(F.col(f).alias(f"w_{f}") for f in fields), F.lit(True).alias("in_w"))
    met = m.join(w, key, "full")
    both = F.col("in_m").isNotNull() & F.col("in_w").isNotNull()
    same = lambda f: F.coalesce(F.col(f"m_{f}"), F.lit("")) == F.col(f"w_{f}")
    each = F.array(*(F.struct(F.lit(f).alias("field"), (both & stated(f"w_{f}") & same(f)).alias("eq"), (both & stated(f"w_{f}") & ~same(f)).alias("ne")) for f in fields))
    rows = met.select("in_m", "in_w", F.explode(each).alias("x"))
    return rows.groupBy("x.field").agg(F.count_if("x.eq").alias("equal"), F.count_if("x.ne").alias("different"), F.count_if(F.col("in_w").isNull()).alias("only_in_master"), F.count_if(F.col("in_m").isNull()).alias("only_in_workbook"))


def lookup_title(title: Column) -> Column:
    """A title without editions and volume numbers."""
    plain = F.regexp_replace(title, EDITIONS, "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, LAST_NUMBER, ""), BRACKETED_NUMBER, ""))


def backfill_genre(titles: DataFrame, known: DataFrame, order: str = "place") -> DataFrame:
    """``titles`` with ``genre`` filled from ``known`` (title_jp, genre, ``order``): by the title, by its lookup title, by a prefix.

    A prefix is the lookup title's first ``LONGEST_PREFIX`` signs, where it has ``SHORTEST_PREFIX`` at least; of the
    known titles that begin so, the first in ``order`` holds. Known titles are put under their own prefixes, at most
    seven rows each, so that all three steps are equi-joins. ``filled_by`` says which step did it.
    """
    known = known.where("genre is not null")
    first = F.min_by("genre", F.struct(F.col(order), F.col("title_jp")))
    exact = known.groupBy(F.col("title_jp").alias("k")).agg(first.alias("g"))
    lengths = F.sequence(F.lit(SHORTEST_PREFIX), F.least(F.lit(LONGEST_PREFIX), F.char_length("title_jp")))
    long_enough = known.where(F.char_length("title_jp") >= SHORTEST_PREFIX)
    begins = long_enough.select("title_jp", "genre", order, F.explode(lengths).alias("n")).groupBy(F.substring("title_jp", F.lit(1), F.col("n")).alias("k")).agg(first.alias("g"))
    base = lookup_title(F.col("title_jp"))
    out = titles.withColumn("_base", base).withColumn("_prefix", F.when(F.char_length("_base") >= SHORTEST_PREFIX, F.substring("_base", 1, LONGEST_PREFIX)))
    for name, rows, key in (("_exact", exact, "title_jp"), ("_by_base", exact, "_base"), ("_by_prefix", begins, "_prefix")):
        out = out.join(rows.select(F.col("k").alias(key), F.col("g").alias(name)), key, "left")
    by = F.when(F.col("genre").isNotNull(), F.lit(None)).when(F.col("_exact").isNotNull(), "title").when(F.col("_by_base").isNotNull(), "base").when(F.col("_by_prefix").isNotNull(), "prefix")
    return out.select(*(F.coalesce("genre", "_exact", "_by_base", "_by_prefix").alias(c) if c == "genre" else c for c in titles.columns), by.alias("filled_by"))


def tidy_title(title: Column) -> Column:
    """White space as one space, none before a bracket, brackets at half width."""
    plain = F.regexp_replace(F.regexp_replace(title, r"[\s　]+", " "), r"\s+\[", "[")
    return F.trim(F.translate(plain, "［］", "[]"))


def normalise_names(rows: DataFrame, channels: dict[str, str]) -> DataFrame:
    """Channels by exact spelling from ``channels``, titles tidied; other columns as they are."""
    known = F.create_map(*(F.lit(x) for pair in channels.items() for x in pair))
    return rows.withColumns({"channel": F.coalesce(known[F.col("channel")], F.col("channel")), "title_jp": tidy_title(F.col("title_jp"))})


#: Spellings of channels, by the name they are kept under.
CHANNEL_ALIASES = {
    "Piccoma": ("Piccoma", "piccoma", "PICCOMA", "ピッコマ", "piccoma_ads", "piccoma_sales", "piccoma france", "piccoma무제한읽기(読み放題)"),
    "Mechacomic": ("Mechacomic", "mechacomic", "MECHACOMIC", "めちゃコミック", "めちゃコミ"),
    "cmoa": ("cmoa", "CMOA", "Cmoa", "コミックシーモア"),
    "Renta": ("renta", "Renta", "Renta!"),
    "DMM": ("dmm", "DMM", "DMMブックス"),
    "DMM(FANZA)": ("DMM（FANZA）", "DMM(FANZA)", "dmm_fanza"),
    "U-NEXT": ("u-next", "U-NEXT"),
    "LINEマンガ": ("LINEマンガ", "line_manga", "line", "LINE", "line_ads"),
    "ebookjapan": ("ebookjapan", "ebj", "ebj_webtoon"),
    "まんが王国": ("まんが王国", "manga_oukoku", "manga-kingdom"),
    "BookLive": ("booklive", "BookLive", "BOOKLIVE"),
    "comico": ("comico jp", "comico_jp", "comico", "comico_ads"),
    "BookCOMI": ("bookcomi", "BookCOMI"),
    "Beltoon": ("beltoon", "Beltoon"),
    "Lezhin": ("lezhin", "Lezhin"),
    "MangaBang": ("mangabang", "MangaBang"),
    "MediaDo": ("mediado_sales", "mediado", "MediaDo"),
}


def channel_kept(channel: Column) -> Column:
    """The name a channel is kept under; other spellings stay as they are."""
    known = F.create_map(*(F.lit(x) for name, spellings in CHANNEL_ALIASES.items() for s in spellings for x in (s, name)))
    return F.coalesce(F.try_element_at(known, channel), channel)


def match_korean(rows: DataFrame, master: DataFrame, order: str = "place") -> DataFrame:
    """``rows`` (title_jp, more) with ``matched_kr``: by the title, else by its base title, else by its core title, the
    last two with the Korean name of the title's edition; '' where none is known.

    ``master``: title_jp, title_kr, ``order``. Of master rows with one title or base title the last in ``order`` holds,
    of those with one core title the first; blank names do not count. Three equi-joins, one row a key each.
    """
    known = master.where("title_jp <> '' and title_kr <> ''").select("title_jp", "title_kr", order)
    at = F.struct(F.col(order), F.col("title_jp"))
    side = lambda key, pick, name: known.groupBy(key.alias(f"{name}_key")).agg(pick("title_kr", at).alias(name))
    core = T.core_title(F.col("title_jp"))
    sides = {"_exact": (F.col("title_jp"), F.max_by), "_base": (T.base_title(F.col("title_jp")), F.max_by), "_core": (F.nullif(core, F.lit("")), F.min_by)}
    out = rows
    for name, (key, pick) in sides.items():
        looked = side(key, pick, name).where(F.col(f"{name}_key").isNotNull())
        out = out.withColumn("_key", key).join(looked, F.col("_key") == F.col(f"{name}_key"), "left").drop("_key", f"{name}_key")
    loose = F.concat(F.coalesce("_base", "_core"), T.edition_suffix(F.col("title_jp")))
    return out.select(*rows.columns, F.coalesce("_exact", loose, F.lit("")).alias("matched_kr"))


def near_pairs(rows: DataFrame, text: str, most: int = 2) -> DataFrame:
    """(a, b, distance): pairs of different texts, a < b, that at most ``most`` edits tell apart.

    A text is cut into ``most`` + 1 even parts; of two such texts one holds a part of the other unchanged, shifted by no
    more than the edits allow. So the pairs meet by equi-joins on a text's length, the part's number and its signs, and
    only those that meet have their distance taken. Texts of ``most`` signs or fewer have empty parts and meet by length.
    """
    texts = rows.select(F.col(text).cast("string").alias("t")).where("t is not null").distinct().withColumn("n", F.char_length("t"))
    number = F.sequence(F.lit(0), F.lit(most))
    start = lambda n, i: F.floor(n * i / (most + 1)).cast("int")
    width = lambda n, i: start(n, i + 1) - start(n, i)
    own = texts.select("t", "n", F.explode(number).alias("i"))
    own = own.select(F.col("t").alias("a"), F.col("n").alias("len"), "i", F.substring("t", start(F.col("n"), F.col("i")) + 1, width(F.col("n"), F.col("i"))).alias("part"))
    # of a text the pieces that may be a part of one of another length
    lengths = F.sequence(F.greatest(F.lit(0), F.col("n") - most), F.col("n") + most)
    tried = texts.select("t", "n", F.explode(lengths).alias("len")).select("*", F.explode(number).alias("i"))
    shifts = F.sequence(F.lit(-most), F.lit(most))
    tried = tried.select("*", F.explode(shifts).alias("s")).withColumn("from", start(F.col("len"), F.col("i")) + F.col("s"))
    tried = tried.where("from >= 0").where(F.col("from") + width(F.col("len"), F.col("i")) <= F.col("n"))
    tried = tried.select(F.col("t").alias("b"), "len", "i", F.substring("t", F.col("from") + 1, width(F.col("len"), F.col("i"))).alias("part")).distinct()
    met = own.join(tried, ["len", "i", "part"]).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return met.withColumn("distance", F.levenshtein("a", "b", most).cast("long")).where("distance >= 0")
