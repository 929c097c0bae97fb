"""Ledger records from three shapes of rows: parsed statement lines, aggregated rows, rows of the accountant's sheet.

The shape follows from the columns, so that a table is one projection and joins of one row a key; tables of several
shapes are put together with ``unionByName(allowMissingColumns=True)``. Amounts that a row leaves open stay null, which
is not 0; only fees, withheld tax and advances are 0 where nothing is stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ledgerloom.operators.settlement import SUMMARY_NOTE

#: What a record holds where its row has no text.
DEFAULTS = {"company": "RJ", "country": "JP", "type": "WT", "distribution_strategy": "non-ex", "settlement_currency": "JPY", "vehicle_currency": "KRW"}
RECORDER = "SYSTEM"

AMOUNTS = ("total_amount_jpy", "before_tax_jpy", "after_tax_jpy", "before_tax_income_jpy", "consumption_tax_jpy", "after_tax_income_jpy")
ZEROES = ("fee_jpy", "withholding_tax_jpy")
ADVANCES = ("mg_begin", "mg_increase", "mg_decrease", "mg_end")
FOREIGN = ("fee_krw", "before_tax_krw", "after_tax_krw", "after_tax_income_krw", "vat_krw", "withholding_tax_krw", "sales_krw")
SHEET_NUMBERS = ("after_tax_income_jpy_a", "after_tax_income_jpy_b", "rate_jpy_krw", "rate_krw_krw", "col31")
SHEET_TEXTS = ("extra_53", "extra_58")
SHEET_EXTRAS = tuple(f"extra_{i}" for i in range(45, 63))


def number(c: Column) -> Column:
    """A finite number, else null."""
    x = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def stated(c: Column) -> Column:
    """A trimmed text, null where nothing is left."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def iso_day(c: Column) -> Column:
    """The day in texts that begin as 2024-5-31 or 2024/05; without a day the first; null otherwise and for no real day."""
    part = lambda i: F.lpad(F.regexp_extract(F.trim(c.cast("string")), r"^(\d{4})[-/](\d{1,2})(?:[-/](\d{1,2}))?", i), 2, "0")
    year = F.regexp_extract(F.trim(c.cast("string")), r"^(\d{4})[-/]\d", 1)
    day = F.when(part(3) == "00", "01").otherwise(part(3))
    return F.try_to_timestamp(F.when(year != "", F.concat_ws("-", year, part(2), day)), F.lit("yyyy-MM-dd")).cast("date")


def iso_first(c: Column) -> Column:
    return F.trunc(iso_day(c), "MM")


def shape_of(rows: DataFrame) -> str:
    """'raw' (row_index, data), 'sales' (client_code and channel_code) or 'sheet' (clients, channel or rs)."""
    have = set(rows.columns)
    if {"row_index", "data"} <= have:
        return "raw"
    if {"client_code", "channel_code"} <= have:
        return "sales"
    if have & {"clients", "channel", "rs"}:
        return "sheet"
    raise ValueError(f"rows match no known shape: {sorted(have)}")


class _Row:
    """Fields of a row; null where the table has no such column. Of raw rows those of ``data``, a struct or a map."""

    def __init__(self, rows: DataFrame, shape: str):
        kind = rows.schema["data"].dataType if shape == "raw" else rows.schema
        self.map, self.names = isinstance(kind, t.MapType), None if isinstance(kind, t.MapType) else set(kind.names)
        self.at = "data." if shape == "raw" else ""

    def __getitem__(self, name: str) -> Column:
        if self.map:
            return F.get(F.array(F.element_at("data", F.lit(name))), 0)
        return F.col(f"{self.at}`{name}`") if name in self.names else F.lit(None).cast("string")

    def first(self, *names: str) -> Column:
        return F.coalesce(*(self[n].cast("string") for n in names))


def _looked_up(rows: DataFrame, side: DataFrame | None, key: str, name: Column, value: str, out: str) -> DataFrame:
    """``rows`` with ``out``, of several values for one name the least; null without a table."""
    if side is None:
        return rows.withColumn(out, F.lit(None).cast("string"))
    one = side.groupBy(name.alias("_name")).agg(F.min(value).alias(out))
    return rows.join(one, F.col(key) == F.col("_name"), "left").drop("_name")


def _client_names(clients: DataFrame) -> DataFrame:
    """A row a name in lower case: the least code that it is an alias of, that client's id, and the ids of the codes spelt so."""
    ids = clients.where("code is not null").groupBy("code").agg(F.min("client_id").alias("_id"))
    alias = F.explode(F.concat(F.array(F.lower("code")), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(F.trim(a)))))
    aliases = clients.select("code", alias.alias("_name")).groupBy("_name").agg(F.min("code").alias("code")).join(ids, "code").select("_name", F.col("code").alias("_alias_code"), F.col("_id").alias("_alias_id"))
    spelt = ids.groupBy(F.lower(F.trim("code")).alias("_name")).agg(F.map_from_entries(F.collect_list(F.struct("code", "_id"))).alias("_spelt"))
    return aliases.join(spelt, "_name", "full")


def _with_clients(rows: DataFrame, clients: DataFrame | None, said: str) -> DataFrame:
    """``rows`` with ``_code`` and ``client_id``: of the alias that ``_folded`` is, else of the code that ``said`` spells.

    A code and what spells it are one name in lower case, so that both are found by one join.
    """
    if clients is None:
        return rows.withColumns({"_code": F.col(said), "client_id": F.lit(None).cast("string")})
    out = rows.join(_client_names(clients), F.col("_folded") == F.col("_name"), "left")
    spelt = F.get(F.array(F.element_at("_spelt", F.col(said))), 0)
    own = F.when(F.col("_alias_code").isNotNull(), F.col("_alias_id")).otherwise(spelt)
    return out.withColumns({"_code": F.coalesce("_alias_code", said), "client_id": own}).drop("_name", "_alias_code", "_alias_id", "_spelt")


def sales_records(rows: DataFrame, uploads: DataFrame, clients: DataFrame | None = None, channels: DataFrame | None = None, titles: DataFrame | None = None) -> DataFrame:
    """Records of ``rows`` of any of the three shapes, and what of each could not be resolved.

    ``rows``: upload_id, row_index and the shape's fields; raw_record_id is passed on where there. ``uploads``
    (upload_id, settlement_month, sales_month, forced): the batch's month, the file's month or null, and whether the
    batch's month overrides the row's. Months come from the row, else the file, else the batch; raw rows keep exact
    days, others the month's first. ``clients`` (client_id, code, aliases), ``channels`` (channel_id, code), ``titles``
    (title_id, title_jp); a table that is None is not looked up, and nothing is then unresolved. Raw rows with
    is_summary are evidence: their amounts are null, their taxes and fees 0, and note2 says so. ``unresolved``: an array
    of (field, message, sample), empty for raw rows. Rows of an upload that is not known have null months.
    """
    shape = shape_of(rows)
    raw, sheet = shape == "raw", shape == "sheet"
    row = _Row(rows, shape)
    text = (lambda c: c.cast("string")) if shape == "sales" else stated  # aggregated rows keep their texts as they are
    of = {"raw": (("client_code", "clients"), ("channel_code", "channel")), "sales": (("client_code",), ("channel_code",)), "sheet": (("clients",), ("channel",))}[shape]
    client, channel = (F.coalesce(row.first(*names), F.lit("")) for names in of)
    summary = F.coalesce(row["is_summary"].try_cast("boolean"), F.lit(False)) if raw else F.lit(False)
    money = lambda *names: F.when(~summary, number(row.first(*names)))
    or_zero = lambda c: F.coalesce(c, F.lit(0.0))

    own = {
        "raw_record_id": F.col("raw_record_id").cast("string") if "raw_record_id" in rows.columns else F.lit(None).cast("string"),
        "unique_id": stated(row["unique_id"]) if sheet else F.lit(None).cast("string"),
        "unique_identifier": F.lit(None).cast("string") if raw else text(row["unique_id" if sheet else "unique_identifier"]),
        "channel_title_jp": text(row.first("channel_title_jp", "title_jp") if raw else row["channel_title_jp"]),
        **{c: text(row[c]) for c in ("title_kr", "title_jp")},
        "recoder": F.lit(RECORDER),
        **{c: F.coalesce(text(row[c]), F.lit(v)) for c, v in DEFAULTS.items()},
        "updated": iso_day(row["updated"]) if sheet else F.lit(None).cast("date"),
        **{c: iso_day(row[c]) for c in ("launch_date", "deposit_month")},
        "_sales": (iso_day if raw else iso_first)(row["sales_month"]),
        "_settled": (iso_day if raw else iso_first)(row["settlement_month"]),
    }
    names = {"total_amount_jpy": ("total_amount_jpy", "gross_jpy") if raw else ("total_amount_jpy",), "after_tax_income_jpy": ("after_tax_income_jpy_a", "after_tax_income_jpy_b") if sheet else ("after_tax_income_jpy",)}
    own |= {c: money(*names.get(c, (c,))) for c in AMOUNTS}
    if sheet:  # the first that is a number, not the first that is stated
        own["after_tax_income_jpy"] = F.coalesce(*(number(row[c]) for c in names["after_tax_income_jpy"]))
    if raw:
        own["consumption_tax_jpy"] = F.when(summary, F.lit(0.0)).otherwise(number(row["consumption_tax_jpy"]))
    own |= {c: or_zero(money(c)) for c in ZEROES}
    own["rs_label"] = F.lit(None).cast("string") if sheet else stated(row["rs_label"])
    own["rs_rate"] = money(*{"raw": ("rs_rate", "rs_rate_hint"), "sales": ("rs_rate",), "sheet": ("rs",)}[shape])
    nothing = F.lit(None).cast("double")
    own |= {c: nothing if raw else number(row[c]) for c in FOREIGN}
    own["exchange_rate"] = number(row["exchange_rate"]) if shape == "sales" else nothing
    own |= {c: nothing if raw else or_zero(number(row[c])) for c in ADVANCES}
    own |= {c: number(row[c]) if sheet else nothing for c in SHEET_NUMBERS}
    own |= {c: (stated if c in SHEET_TEXTS else number)(row[c]) if sheet else F.lit(None).cast("string" if c in SHEET_TEXTS else "double") for c in SHEET_EXTRAS}
    note = F.when(summary, F.concat_ws(":", F.lit(SUMMARY_NOTE), stated(row["source_file_kind"]))) if raw else F.lit(None).cast("string")
    own |= {"note1": stated(row["note1"]), "note2": F.nullif(F.concat_ws(" / ", stated(row["note2"]), note), F.lit(""))}

    folded = F.lower(F.trim(client))
    index = F.col("row_index").cast("long") if "row_index" in rows.columns else F.lit(None).cast("long")
    out = rows.select("upload_id", index.alias("row_index"), *(c.alias(n) for n, c in own.items()), folded.alias("_folded"), client.alias("_client"), F.trim(channel).alias("_channel"), channel.alias("_as_channel"), F.lower(row["title_jp"].cast("string")).alias("_title"))
    # joined in the order in which the least is carried on: a file's rows stay together for its client, and a name that
    # is found is dropped before the next join
    month = uploads.groupBy("upload_id").agg(F.max(F.struct(F.col("settlement_month").cast("date").alias("batch"), F.col("sales_month").cast("date").alias("file"), F.col("forced").alias("forced"))).alias("_of"))
    out = out.join(month, "upload_id", "left")
    batch, file = F.col("_of.batch"), F.col("_of.file")
    settled = F.when(F.coalesce("_of.forced", F.lit(False)), batch).otherwise(F.coalesce("_settled", batch))
    out = out.withColumns({"sales_month": F.coalesce("_sales", file if raw else F.trunc(file, "MM"), batch), "settlement_month": settled, "settlement_batch": batch}).drop("_of", "_sales", "_settled")
    missing = []

    def told(out: DataFrame, side: DataFrame | None, there: str, field: str, what: str, code: str, sample: str) -> DataFrame:
        if not raw and side is not None:
            missing.append(F.col(f"_no_{what}"))
            entry = F.struct(F.lit(field).alias("field"), F.concat(F.lit(f"unresolved {what}: "), F.col(code)).alias("message"), F.col(sample).alias("sample"))
            out = out.withColumn(f"_no_{what}", F.when(F.col(there).isNull(), entry))
        return out.drop(code, sample)

    out = told(_with_clients(out, clients, "_client" if raw else "_folded"), clients, "client_id", of[0][0], "client", "_code", "_client").drop("_folded")
    out = told(_looked_up(out, channels, "_channel", F.col("code"), "channel_id", "channel_id"), channels, "channel_id", of[1][0], "channel", "_channel", "_as_channel")
    out = _looked_up(out, titles, "_title", F.lower("title_jp"), "title_id", "title_id")
    unresolved = F.array_compact(F.array(*missing)) if missing else F.array().cast("array<struct<field:string,message:string,sample:string>>")
    return out.select(
        "upload_id",
        "row_index",
        "client_id",
        "channel_id",
        "title_id",
        "sales_month",
        "settlement_month",
        "settlement_batch",
        *(n for n in own if not n.startswith("_")),
        unresolved.alias("unresolved"),
    )


def unresolved_codes(records: DataFrame) -> DataFrame:
    """(upload_id, row_index, field, message, sample) of what ``sales_records`` did not find."""
    return records.select("upload_id", "row_index", F.explode("unresolved").alias("_e")).select("upload_id", "row_index", "_e.*")
