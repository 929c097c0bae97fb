"""From statement lines to the settlement ledger and its export: lookups, months, suppression, carrying forward, routing.

Every lookup is a left join on one row a key, so that no line is lost or multiplied; what is not found stays null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money
from ledgerloom.functions import text as T
from ledgerloom.functions.joins import with_group
from ledgerloom.operators.ledger import draw_down, strict_key, suppress_existing

TAX = 0.1
DEFAULT_RATE = 0.5
SUMMARY_NOTE = "SUMMARY_NON_AGGREGATED"

#: Channels that keep zero amounts and move their months on where a month brings no statement; all others are emptied.
CADENCE_CHANNELS = ("mediado_sales", "renta", "bookcomi", "booklive", "dmm", "ebj_webtoon", "mbj_sales", "line", "mechacomic", "ebj", "mangabang", "piccoma")
#: Channels whose monthly documents replace all their earlier rows, and those that do so by series.
REPLACED_CHANNELS = ("kadokawa", "shueisha")
SERIES_CHANNELS = ("sb creative", "sbcreative", "sb_creative")
#: Clients whose rows go to the sheet of publications.
PUBLISHERS = r"(?i)kadokawa|角川|ichijinsha|一迅社|shueisha|集英社|sb\s*creative|sbクリエイティブ|ＳＢクリエイティブ"
PUBLICATION_SHEET = "input_出版"
MANIFEST_UPLOADS = 500


def _looked_up(rows: DataFrame, side: DataFrame, key: Column, name: str, value: str, out: str) -> DataFrame:
    """``rows`` with ``out``: ``value`` of the row of ``side`` whose ``name`` is ``key``; of several the least."""
    return _looked_up_all(rows, side, key, name, {out: value})


def _looked_up_all(rows: DataFrame, side: DataFrame, key: Column, name: str, values: dict[str, str]) -> DataFrame:
    """As ``_looked_up``, several values of one side by one join, each the least by itself."""
    one = side.groupBy(F.col(name).alias("_name")).agg(*(F.min(v).alias(f"_value_{o}") for o, v in values.items()))
    out = rows.withColumn("_key", key).join(one, F.col("_key") == F.col("_name"), "left")
    return out.withColumns({o: F.col(f"_value_{o}") for o in values}).drop("_key", "_name", *(f"_value_{o}" for o in values))


def settlement_records(lines: DataFrame, client_aliases: DataFrame, title_aliases: DataFrame, rules: DataFrame, defaults: DataFrame, balances: DataFrame, order: list[str], fx: float = 9.2) -> DataFrame:
    """Ledger rows of statement lines: ids, rate, tax, currency and the advance that each income draws down.

    ``lines``: title_jp, client_code, channel_code, gross_jpy, rate_hint and, where the statement prints them,
    before_tax_jpy, after_tax_jpy, before_tax_income_jpy, consumption_tax_jpy, after_tax_income_jpy (null: derived);
    lines without a title are left out. ``client_aliases`` (alias, client_code), ``title_aliases`` (alias in lower
    case, title_id), ``rules`` (client_code, title_id, channel_code or '*', rate), ``defaults`` (client_code, rate),
    ``balances`` (title_id, balance). The rate is the rule's of client, title and channel, else that of any channel,
    else the client's, else the line's hint, else one half. ``order`` is the order of lines for the draw-down.
    """
    own = lines.withColumn("title_jp", F.trim("title_jp")).where("title_jp <> ''")
    own = _looked_up(own, client_aliases, F.col("client_code"), "alias", "client_code", "_client").withColumn("client_code", F.coalesce("_client", "client_code", F.lit("unknown"))).drop("_client")
    own = _looked_up(own, title_aliases, F.lower("title_jp"), "alias", "title_id", "title_id")
    at = lambda channel: F.to_json(F.struct(F.col("client_code").alias("c"), F.col("title_id").alias("t"), channel.alias("h")))
    keyed = rules.select(at(F.col("channel_code")).alias("rule"), "rate")
    known = F.col("title_id").isNotNull()
    own = _looked_up(own, keyed, F.when(known, at(F.coalesce("channel_code", F.lit("")))), "rule", "rate", "_own")
    own = _looked_up(own, keyed, F.when(known, at(F.lit("*"))), "rule", "rate", "_any")
    own = _looked_up(own, defaults, F.col("client_code"), "client_code", "rate", "_default")
    gross = F.coalesce(F.col("gross_jpy").cast("double"), F.lit(0.0))
    stated = lambda c, other: F.coalesce(F.col(c).cast("double"), other)
    out = own.withColumns({"rate": F.coalesce("_own", "_any", "_default", F.col("rate_hint").cast("double"), F.lit(DEFAULT_RATE)), "_before": stated("before_tax_jpy", gross / (1 + TAX))})
    out = out.withColumns({"_after": stated("after_tax_jpy", gross - F.col("_before")), "_income": stated("before_tax_income_jpy", F.col("_before") * F.col("rate"))})
    out = out.withColumns({"_net": stated("after_tax_income_jpy", F.col("_income")), "_tax": stated("consumption_tax_jpy", money.half_up(F.col("_income") * TAX).cast("double"))})
    drawn = draw_down(out.withColumn("income", F.col("_income")), balances.withColumnRenamed("title_id", "_balance_id"), order, key="title_id", balance_key="_balance_id")
    r = money.half_up
    return drawn.select(
        *(c for c in ("title_jp", "title_id", "client_code", "channel_code", *order) if c in drawn.columns),
        "rate",
        gross.alias("total_amount_jpy"),
        r(F.col("_before")).alias("before_tax_jpy"),
        r(F.col("_after")).alias("after_tax_jpy"),
        r(F.col("_income")).alias("before_tax_income_jpy"),
        F.col("_tax").alias("consumption_tax_jpy"),
        r(F.col("_net")).alias("after_tax_income_jpy"),
        r(F.col("_before") * fx).alias("before_tax_krw"),
        r(F.col("_net") * fx).alias("sales_krw"),
        r(r(F.col("_net") * fx) * 0.1).alias("vat_krw"),
        F.col("begin").alias("mg_begin"),
        F.col("decrease").alias("mg_decrease"),
        (F.col("begin") - F.col("decrease")).alias("mg_end"),
    )


def resolved_months(files: DataFrame) -> DataFrame:
    """``files`` (active_month, parsed_month, fallback_month, has_records, more) with ``settlement_month`` and ``month_error``.

    A month set by hand holds as it is; else the parsed date's, as the first of the month; a file without records needs
    none; else the fallback's. A file with records and no month is an error.
    """
    stated = lambda c: F.when(F.trim(c) != "", F.col(c))
    iso = lambda c: F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(F.substring(c, 1, 7), F.lit("-01")))
    month = F.coalesce(stated("active_month"), iso("parsed_month"), F.when(F.col("has_records"), iso("fallback_month")))
    return files.withColumn("settlement_month", month).withColumn("month_error", F.col("settlement_month").isNull() & F.coalesce("has_records", F.lit(False)))


def ledger_lines(rows: DataFrame, note: str = "note2") -> DataFrame:
    """Without rows of payment notices, invoices and fallbacks, which are kept as evidence only."""
    return rows.where(~F.coalesce(F.col(note), F.lit("")).contains(SUMMARY_NOTE))


def named(rows: DataFrame, clients: DataFrame, channels: DataFrame, titles: DataFrame, raw: DataFrame, template: DataFrame, uploads: DataFrame) -> DataFrame:
    """``rows`` with the names of their client, channel and title.

    ``rows``: client_id, channel_id, title_id, title_kr, raw_id, upload_id. By id first (``clients`` client_id, name;
    ``channels`` channel_id, code; ``titles`` title_id, name); what stays blank comes from the template's row
    (``template``: channel, client) of the line's own channel code (``raw``: raw_id, channel_code, client_code), in any
    case of letters, then from the codes themselves, then from the upload's platform (``uploads``: upload_id, platform_code).
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    out = _looked_up(rows, clients, F.col("client_id"), "client_id", "name", "_client")
    out = _looked_up(out, channels, F.col("channel_id"), "channel_id", "code", "_channel")
    out = _looked_up(out, titles, F.col("title_id"), "title_id", "name", "_title")
    out = _looked_up_all(out, raw, F.col("raw_id"), "raw_id", {"_raw_channel": "channel_code", "_raw_client": "client_code"})
    out = _looked_up(out, uploads, F.col("upload_id"), "upload_id", "platform_code", "_platform")
    code = F.lower(F.coalesce(blank("_channel"), blank("_raw_channel"), blank("_platform")))
    keyed = template.select(F.lower(F.trim("channel")).alias("code"), "channel", "client")
    out = _looked_up_all(out, keyed, code, "code", {"_t_channel": "channel", "_t_client": "client"})
    return out.select(
        *(c for c in rows.columns if c != "title_kr"),
        F.coalesce(blank("_client"), blank("_t_client"), blank("_raw_client"), blank("_platform")).alias("client_name"),
        F.coalesce(blank("_channel"), blank("_t_channel"), blank("_raw_channel"), blank("_platform")).alias("channel_name"),
        F.coalesce(blank("title_kr"), blank("_title")).alias("title_kr"),
    )


def is_publication(client: Column) -> Column:
    return F.coalesce(F.trim(client).rlike(PUBLISHERS), F.lit(False))


def routed(rows: DataFrame, month: Column, *client: str) -> DataFrame:
    """``rows`` with ``sheet``: that of publications, or the electronic one of the month after ``month`` ('yyyyMM').

    The client is the first of the columns ``client`` that is not null."""
    electronic = F.concat(F.lit("input_電子_"), (F.substring(month, 5, 2).try_cast("int") % 12 + 1).cast("string"), F.lit("月"))
    return rows.withColumn("sheet", F.when(is_publication(F.coalesce(*client)), PUBLICATION_SHEET).otherwise(electronic))


def suppress_at_insert(incoming: DataFrame, existing: DataFrame, platform: str, strict: list[str], order: list[str], party: list[str], gated: bool = False) -> DataFrame:
    """Rows of an upload that are not in the settlement month yet, as multisets.

    piccoma sends a summary and a detail of one statement: behind the gate for exact sources all its rows stay, else
    rows of the same title, kind and month are the same, whatever their amounts, and rows without these stay. Other
    platforms go by the ``strict`` key.
    """
    if platform == "piccoma" and gated:
        return incoming
    if platform != "piccoma":
        return suppress_existing(incoming, existing, strict, order, party)
    stated = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""
    known = stated("title_jp") & stated("type") & stated("settlement_month")
    key = strict_key("client_id", "channel", "title_jp", "settlement_month", "type")
    kept = suppress_existing(incoming.where(known).withColumn("_key", key), existing.where(known).withColumn("_key", key), ["_key"], order)
    return kept.drop("_key").unionByName(incoming.where(~known))


def merge_carry(base: DataFrame, current: DataFrame, month: Column, keys: list[str], order: list[str], contract: list[str], amounts: list[str], series: str | None = None) -> DataFrame:
    """The roster of ``base`` with the statements of ``current``, as rows of ``month`` (a date), with ``provenance``.

    Rows of one key are paired by their place in ``order``. overlay: the statement's amounts alone, its other fields
    where not blank, the base's ``contract`` fields. carry: the base row without amounts; a channel of
    CADENCE_CHANNELS gets zeros and its own months one further, others none. append: the statement's row, with the
    month's defaults. Base rows of REPLACED_CHANNELS go first, and those of SERIES_CHANNELS whose ``series`` the
    statements hold. Both sides have keys, channel, sales_month, deposit_month, the contract and the amounts; more
    columns of ``base`` that ``current`` has too are overlaid.
    """
    channel = F.lower(F.trim("channel"))
    base = base.where(~F.coalesce(channel.isin(*REPLACED_CHANNELS), F.lit(False)))
    if series:
        seen = current.where(channel.isin(*SERIES_CHANNELS)).select(F.col(series).alias("_series")).distinct().withColumn("_seen", F.lit(True))
        base = base.join(seen, channel.isin(*SERIES_CHANNELS) & (F.col(series) == F.col("_series")), "left").where("_seen is null").drop("_series", "_seen")
    place = lambda d: d.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).withColumn("_has", F.lit(True))
    same = reduce(lambda a, b: a & b, (F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "_n"]))
    met = place(base).alias("b").join(place(current).alias("c"), same, "full")
    has_b, has_c = F.col("b._has").isNotNull(), F.col("c._has").isNotNull()
    cadence = F.coalesce(F.lower(F.trim("b.channel")).isin(*CADENCE_CHANNELS), F.lit(False))
    given = lambda c: F.when(F.coalesce(F.trim(F.col(f"c.{c}").cast("string")), F.lit("")) != "", F.col(f"c.{c}"))
    defaults = {"sales_month": F.trunc(month, "MM"), "deposit_month": dates.month_end_after(month, 2)}

    def cell(c: str) -> Column:
        if c in keys or c in contract:
            out = F.when(has_b, F.col(f"b.{c}")).otherwise(F.col(f"c.{c}"))
        elif c in amounts:
            out = F.when(has_c, F.col(f"c.{c}")).when(cadence, F.lit(0))
        elif c in defaults:
            carried = F.when(cadence, dates.shifted(F.col(f"b.{c}")))
            out = F.when(has_b & has_c, F.coalesce(f"c.{c}", f"b.{c}")).when(has_b, carried).otherwise(F.coalesce(F.col(f"c.{c}"), defaults[c]))
        else:
            out = F.coalesce(given(c), F.col(f"b.{c}"))
        return out.alias(c)

    provenance = F.when(has_b & has_c, "overlay").when(has_b, "carry").otherwise("append")
    both = [c for c in base.columns if c in current.columns]
    return met.select(*map(cell, both), F.trunc(month, "MM").alias("accounting_month"), dates.month_end_after(month, 1).alias("settlement_month"), provenance.alias("provenance"))


def source_manifest(uploads: DataFrame, order: list[str], most: int = MANIFEST_UPLOADS) -> DataFrame:
    """One row: the first ``most`` upload ids in ``order``, whether there are more, and how many were seen at least."""
    seen = uploads.orderBy(*order).limit(most + 1)  # the report is of this many rows by contract
    ids = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("upload_id").alias("_id")))), lambda x: x["_id"])
    return seen.agg(F.slice(ids, 1, most).alias("upload_ids"), (F.count("*") > most).alias("uploads_truncated"), F.count("*").alias("observed_at_least"))


def register_titles(rows: DataFrame, master: DataFrame, order: str = "place") -> DataFrame:
    """Titles of ``rows`` that ``master`` lacks, with genre, company and format of the first master title (in ``order``)
    of the same base title, else of the same core title; the format is WEBTOON where none is known.

    ``master``: title_jp, genre, company, content_format, ``order``.
    """
    new = rows.select("title_jp").distinct().join(master.select("title_jp"), "title_jp", "left_anti")
    info = F.struct("genre", "company", F.coalesce(F.nullif("content_format", F.lit("")), F.lit("WEBTOON")).alias("content_format"))
    first = lambda key, name: master.groupBy(key.alias(f"_{name}_key")).agg(F.min_by(info, F.struct(F.col(order), F.col("title_jp"))).alias(f"_{name}"))
    base, core = T.base_title(F.col("title_jp")), T.core_title(F.col("title_jp"))
    out = new.withColumns({"_b": base, "_c": F.nullif(core, F.lit(""))})
    out = out.join(first(base, "base"), F.col("_b") == F.col("_base_key"), "left").join(first(F.nullif(core, F.lit("")), "core").where("_core_key is not null"), F.col("_c") == F.col("_core_key"), "left")
    got = F.coalesce("_base", "_core")
    return out.select("title_jp", got["genre"].alias("genre"), got["company"].alias("company"), F.coalesce(got["content_format"], F.lit("WEBTOON")).alias("content_format"))


def import_master(stored: DataFrame, parsed: DataFrame, batch: str, fields: list[str]) -> DataFrame:
    """The content master after an import: rows of ``parsed`` replace those of the same sheet and row and are active,
    stored rows of an imported sheet that the batch lacks are not, rows of other sheets stay as they are.

    ``stored``: source_sheet, source_row, the fields, import_batch, is_active; ``parsed`` has one row a place.
    """
    place = ["source_sheet", "source_row"]
    sheets = parsed.select("source_sheet").distinct().withColumn("_imported", F.lit(True))  # as many rows as sheets
    new = parsed.select(*place, *(F.col(f).alias(f"_new_{f}") for f in fields), F.lit(True).alias("_new"))
    met = stored.join(new, place, "full").join(sheets, "source_sheet", "left")
    fresh = F.col("_new").isNotNull()
    value = lambda f: F.when(fresh, F.col(f"_new_{f}")).otherwise(F.col(f)).alias(f)
    active = F.when(fresh, F.lit(True)).when(F.col("_imported").isNotNull(), F.lit(False)).otherwise(F.col("is_active"))
    return met.select(*place, *map(value, fields), F.when(fresh, F.lit(batch)).otherwise(F.col("import_batch")).alias("import_batch"), active.alias("is_active"))


#: Channels whose guessed kinds follow the earlier ledger, and the kinds that piccoma's two markers allow.
RECONCILED_CHANNELS = ("line", "ebj", "ebj_webtoon", "mechacomic", "booklive", "bookcomi", "piccoma")
PICCOMA_KINDS = {"chapter": ("wt", "wr", "wn"), "volume": ("eb", "ep")}
GUESSED_NOTE, SCANNED_NOTE = "TYPE_HEURISTIC", "SHUEISHA_OCR_TITLE"
MOST_INSERTED, MARGIN = 3, 3
#: First halves of more titles than this are broadcast: one for as many titles at most.
COMMON_HALF = 10_000


def _title_key(title: str = "title_jp") -> Column:
    return T.title_key(T.fold_wave_dash(F.trim(F.coalesce(F.col(title), F.lit("")))))


def reconcile_kinds(current: DataFrame, base: DataFrame) -> DataFrame:
    """``current`` (channel, title_jp, type, note2, more) with guessed kinds taken from ``base`` (channel, title_jp, type).

    Only rows whose note says that the kind is a guess, of RECONCILED_CHANNELS. One earlier kind of the channel's title
    holds, without any the one that all channels have. Of several, that which no current row of the title bears, if it
    is one and the guess is none of them; else the row is ambiguous. For piccoma only kinds of the marker's family
    count, and a guess among them stays. ``raw_type`` keeps the guess; ``reconciliation`` is baseline, ambiguous or
    null. A title has few kinds, so that the lists are short.
    """
    part = lambda c: F.lower(F.trim(c))
    at = lambda d: d.withColumns({"_channel": part("channel"), "_title": _title_key(), "_kind": F.nullif(part("type"), F.lit(""))})
    old, now = at(base).where("_title <> '' and _kind is not null"), at(current)
    pair = F.collect_set(F.struct(F.col("_kind").alias("k"), F.col("_raw").alias("raw")))
    spelt = lambda *keys: old.groupBy(*keys, "_kind").agg(F.min("type").alias("_raw")).groupBy(*keys).agg(pair.alias("_kinds"))
    own = spelt("_channel", "_title").where(F.col("_channel").isin(*RECONCILED_CHANNELS))
    everywhere = spelt("_title").where(F.size("_kinds") == 1).withColumnRenamed("_kinds", "_global")
    claimed = now.where("_kind is not null").groupBy("_channel", "_title").agg(F.collect_set("_kind").alias("_claimed"))
    out = now.join(own, ["_channel", "_title"], "left").join(everywhere, "_title", "left").join(claimed, ["_channel", "_title"], "left")
    note = F.coalesce(F.col("note2"), F.lit(""))
    guessed = note.contains(GUESSED_NOTE) & F.col("_channel").isin(*RECONCILED_CHANNELS) & (F.col("_title") != "")
    family = F.lit(None).cast("array<string>")
    for name, kinds in PICCOMA_KINDS.items():
        family = F.when(note.contains(f"{GUESSED_NOTE}:{name}"), F.array(*map(F.lit, kinds))).otherwise(family)
    none = F.array().cast("array<struct<k:string,raw:string>>")
    free = lambda kinds: F.filter(kinds, lambda x: ~F.coalesce(F.array_contains("_claimed", x["k"]), F.lit(False)))
    has = lambda kinds: F.exists(kinds, lambda x: x["k"] == F.col("_kind"))
    kinds = F.coalesce("_kinds", none)
    fitting = F.filter(kinds, lambda x: F.coalesce(F.array_contains("_family", x["k"]), F.lit(False)))
    out = out.withColumns({"_family": family, "_guessed": F.coalesce(guessed, F.lit(False))})
    out = out.withColumns({"_fit": F.when(F.col("_channel") == "piccoma", fitting).otherwise(kinds)}).withColumn("_free", free(F.col("_fit")))
    piccoma = F.when(has("_fit"), none).otherwise(F.col("_free"))
    several = F.when(has("_fit") | (F.size("_free") != 1), F.lit(None)).otherwise(F.col("_free"))
    choice = F.when(F.col("_channel") == "piccoma", F.when(F.size(piccoma) <= 1, piccoma)).when(F.size("_fit") > 1, several).when(F.size("_fit") == 1, F.col("_fit")).otherwise(F.coalesce("_global", none))
    out = out.withColumn("_choice", F.when(F.col("_guessed"), choice).otherwise(none))
    taken = F.get("_choice", F.lit(0))
    changed = F.coalesce(taken["k"] != F.coalesce("_kind", F.lit("")), F.lit(False))
    return out.select(
        *(F.when(changed, taken["raw"]).otherwise(F.col("type")).alias(c) if c == "type" else c for c in current.columns),
        F.when(changed, F.col("type")).alias("raw_type"),
        F.when(F.col("_choice").isNull(), "ambiguous").when(changed, "baseline").alias("reconciliation"),
    )


def _without(text: Column, n: Column) -> Column:
    """All different texts that ``text`` gives without ``n`` (0 to MOST_INSERTED + MARGIN - 1) of its signs."""
    out, texts = F.when(n == 0, F.array(text)), F.array(text)
    cut = lambda t: F.transform(F.sequence(F.lit(1), F.char_length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.char_length(t))))
    for i in range(1, MOST_INSERTED + MARGIN):
        texts = F.array_distinct(F.flatten(F.transform(texts, cut)))
        out = out.when(n == i, texts)
    return out


def _shortened(titles: DataFrame, known: DataFrame) -> DataFrame:
    """``titles`` (_channel, _kind, _title, _rows, _from, _to) with each of ``known`` (_channel, _kind, _base, _spelling) that
    is the title without ``_more`` of its signs, from ``_from`` to ``_to``.

    In two steps, so that a title gives few texts: first the first halves of the known titles are sought among the
    shortened starts of the title, then for each one that is there the whole among the shortened rests. Both meet
    different texts by equality, so that what titles have in common multiplies nothing. Lengths that no known title of
    the channel and type has are not tried.
    """
    known = known.withColumns({"_length": F.char_length("_base")}).withColumn("_half", F.expr("substr(_base, 1, _length div 2)"))
    lengths = known.select("_channel", "_kind", "_length").distinct()  # as many as lengths of titles
    tried = titles.withColumn("_more", F.explode(F.sequence("_from", "_to"))).withColumn("_length", F.char_length("_title") - F.col("_more")).join(lengths, ["_channel", "_kind", "_length"])
    starts = tried.withColumn("_in_start", F.explode(F.sequence(F.lit(0), "_more"))).withColumn("_cut", F.expr("_length div 2 + _in_start"))
    starts = starts.withColumn("_half", F.explode(_without(F.expr("substr(_title, 1, _cut)"), F.col("_in_start"))))
    # a half of many titles is one of few: those are broadcast, so that its starts are dealt out; all else meets by sorting
    at = ["_channel", "_kind", "_length", "_half"]
    halves = known.groupBy(*at).agg(F.count("*").alias("_titles"), F.first(F.lit(True)).alias("_there"))
    seen = with_group(starts, halves, at, large=COMMON_HALF, counted="_titles", near_hint="merge").drop("_there")
    rests = seen.withColumn("_rest", F.explode(_without(F.expr("substr(_title, _cut + 1)"), F.col("_more") - F.col("_in_start"))))
    whole = rests.select("_channel", "_kind", "_title", "_rows", "_more", F.concat("_half", "_rest").alias("_base"))
    return whole.join(known.select("_channel", "_kind", "_base", "_spelling").hint("merge"), ["_channel", "_kind", "_base"]).distinct()


def reconcile_scanned(current: DataFrame, base: DataFrame) -> DataFrame:
    """``current`` (channel, type, title_jp, note2, more) with scanned titles as ``base`` (channel, type, title_jp) spells them.

    A scan puts signs in. A marked title that ``base`` lacks takes the base title that it holds as a subsequence, if it
    has at most MOST_INSERTED signs more, every other such base title needs MARGIN signs more than that, and no other
    marked row is as near to that base title. Base titles that a current row bears are no candidates. Titles meet by an
    equi-join on channel, type and what is left of a scanned title without the signs put in (``_shortened``). Titles
    are never broadcast: they shrink so much in a shuffle that Spark takes millions of them for a small table.
    """
    part = lambda c: F.lower(F.trim(c))
    at = lambda d: d.withColumns({"_channel": part("channel"), "_kind": part("type"), "_title": _title_key()})
    key = ["_channel", "_kind", "_title"]
    now, old = at(current), at(base)
    unmatched = old.where("_title <> ''").groupBy(*key).agg(F.min(F.trim("title_jp")).alias("_spelling")).join(now.select(*key).distinct().hint("merge"), key, "left_anti")
    marked = now.where(F.coalesce(F.col("note2"), F.lit("")).contains(SCANNED_NOTE)).groupBy(*key).agg(F.count("*").alias("_rows")).join(old.select(*key).distinct().hint("merge"), key, "left_anti")
    known = unmatched.select("_channel", "_kind", F.col("_title").alias("_base"), "_spelling")
    near = _shortened(marked.select("*", F.lit(1).alias("_from"), F.lit(MOST_INSERTED).alias("_to")), known)
    # a title's rivals need at most MARGIN - 1 signs more than its nearest; only those not looked for yet are
    open_ = near.groupBy(*key).agg(F.min("_more").alias("_least"), F.first("_rows").alias("_rows")).where(F.col("_least") + MARGIN - 1 > MOST_INSERTED)
    far = _shortened(open_.select(*key, "_rows", F.lit(MOST_INSERTED + 1).alias("_from"), (F.col("_least") + MARGIN - 1).alias("_to")), known)
    met = near.unionByName(far)
    by_title, by_base = Window.partitionBy(*key), Window.partitionBy("_channel", "_kind", "_base")
    met = met.withColumns({"_least": F.min("_more").over(by_title), "_nearest": F.min("_more").over(by_base)})
    close = F.when(F.col("_more") < F.col("_least") + MARGIN, 1)
    met = met.withColumns({"_close": F.count(close).over(by_title), "_rivals": F.sum(F.when(F.col("_more") == F.col("_nearest"), F.col("_rows"))).over(by_base)})
    best = met.where(f"_more = _least and _more <= {MOST_INSERTED} and _close = 1 and _more = _nearest and _rivals = 1").select(*key, "_spelling")
    out = now.join(best.hint("merge"), key, "left")
    mine = F.coalesce(F.col("note2"), F.lit("")).contains(SCANNED_NOTE) & F.col("_spelling").isNotNull()
    return out.select(*(F.when(mine, F.col("_spelling")).otherwise(F.col(c)).alias(c) if c == "title_jp" else c for c in current.columns), F.when(mine, F.col("title_jp")).alias("raw_title"))
