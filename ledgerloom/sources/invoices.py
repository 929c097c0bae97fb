"""Invoices that are written to platforms: the sheet's items set against its totals, and the printed twin's total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.functions import text as T
from ledgerloom.sources import readers
from ledgerloom.sources.versioned import stored

#: Labels of an invoice's cells, and what a printed one holds.
SUBJECT, ISSUED, DUE, TOTAL, SUBTOTAL, TAX = "件名：", "発行日", "お支払期限", "御請求金額", "小計", "消費税額"
FOOTER = "振込手数料|振込先"
PRINTED_SUBJECT = r"件名[：:]\s*(.+?)(?:\s{2,}|御請求金額|お支払期限|№|$)"
PRINTED_TOTAL = r"御請求金額[^¥￥\\]{0,40}[¥￥\\]([\d,]+)"
PRINTED_DUE = r"お支払期限[：:]?\s*(\d{4})年(\d{1,2})月"


def month_said(text: Column) -> Column:
    """The first of the month in a text as 2026年4月, 2026-04, 2026/4 or 202604; null where it says none."""
    plain = T.half_width(F.coalesce(text, F.lit("")))
    forms = (r"(20\d{2})年\s*(\d{1,2})月", r"(20\d{2})[-/](\d{1,2})", r"(20\d{2})(0[1-9]|1[0-2])")
    month = lambda p: F.try_to_timestamp(F.when(plain.rlike(p), F.concat_ws("-", F.regexp_extract(plain, p, 1), F.lpad(F.regexp_extract(plain, p, 2), 2, "0"), F.lit("01"))), F.lit("yyyy-MM-dd")).cast("date")
    return F.coalesce(*map(month, forms))


def invoice_totals(cells: DataFrame) -> DataFrame:
    """(file, subject, issued, due, total, subtotal, tax) of invoices' sheets (file, sheet, row_index, cells).

    What stands beside a label in its row; of several rows the last. A row is looked at by itself, and only if its text
    holds a label; of all others no more than the file is read.
    """
    sheets = cells.where(F.col("sheet").contains("請求書"))
    text = F.array_join("cells", "\n")
    own = sheets.where(text.rlike("|".join((SUBJECT, ISSUED, DUE, TOTAL, SUBTOTAL, TAX))))  # one pattern: a filter joins the cells again for each
    own = own.select("file", "row_index", text.alias("text"), F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))).alias("c"))
    if_said = lambda label, value: F.when(F.col("text").contains(label), value)
    place = lambda test: F.array_position(F.transform("c", test), True).cast("int")
    after = lambda test: F.when(place(test) > 0, F.slice("c", place(test) + 1, F.size("c")))
    first = lambda values, keep: F.get(F.filter(values, keep), F.lit(0))
    numbers = lambda values: F.filter(F.transform(values, T.amount), lambda n: n != 0)
    labelled = lambda label: F.when(place(lambda c: c.startswith(label)) > 0, F.element_at(F.concat(F.array(F.lit(None).cast("double")), numbers("c")), -1))
    rows = own.select(
        "file",
        "row_index",
        if_said(SUBJECT, F.substring(first("c", lambda c: c.startswith(SUBJECT)), len(SUBJECT) + 1, 1000)).alias("subject"),
        if_said(ISSUED, month_said(first(after(lambda c: c == ISSUED), lambda c: c != ""))).alias("issued"),
        if_said(DUE, first(F.transform(after(lambda c: c.startswith(DUE)), month_said), lambda m: m.isNotNull())).alias("due"),
        if_said(TOTAL, first(numbers(after(lambda c: c == TOTAL)), lambda n: n.isNotNull())).alias("total"),
        if_said(SUBTOTAL, labelled(SUBTOTAL)).alias("subtotal"),
        if_said(TAX, labelled(TAX)).alias("tax"),
    )
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("row_index"))).alias(c)
    said = rows.groupBy(F.col("file").alias("_file")).agg(*(last(c) for c in ("subject", "issued", "due", "total", "subtotal", "tax")))
    return sheets.select("file").distinct().join(said, F.col("file").eqNullSafe(F.col("_file")), "left").drop("_file")


def invoice_records(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records a line of invoices' sheets, and problems: lines that do not add up to the subtotal, files with nothing.

    Lines end at the transfer's footer. A file without lines but with a total gives one record, as evidence. The month
    of sales is the subject's, else that of the file's name, else that of issue; that of settlement the payment's. What
    several steps read (rows, lines, totals) is written once to the shared folder.
    """
    cells = stored(cells.withColumn("row_index", F.col("row_index").cast("int")), "invoice-cells")
    foot = F.array_join("cells", "\n").rlike(FOOTER)
    own = stored(readers.lines(readers.sheet_table(cells, readers.READERS["invoice"], until=foot), "invoice").select("file", F.col("raw_title").alias("title"), F.col("sales").cast("long").alias("amount"), "price", "units", "rate"), "invoice-lines")
    totals = stored(invoice_totals(cells), "invoice-totals")
    sums = own.groupBy("file").agg(F.sum("amount").alias("amount_sum"))
    met = totals.join(sums, "file", "left")
    problem = F.when(F.col("amount_sum").isNull() & F.coalesce("total", "subtotal").isNull(), "no lines and no totals").when(F.col("amount_sum") != F.col("subtotal"), "lines differ from the subtotal")
    month = F.coalesce(month_said(F.col("subject")), month_said(F.col("file")), F.col("issued"))
    net = F.coalesce(F.col("subtotal"), F.col("total") - F.col("tax"), money.half_up(F.col("total") / 1.1).cast("double"))
    alone = met.where(F.col("amount_sum").isNull() & F.coalesce("total", "subtotal").isNotNull())
    alone = alone.select("file", F.coalesce(F.nullif("subject", F.lit("")), F.regexp_replace("file", r"\.[^.]+$", "")).alias("title"), net.cast("long").alias("amount"), F.lit(None).cast("long").alias("unit_price"), F.lit(None).cast("int").alias("quantity"), F.lit(None).cast("double").alias("rate"), F.lit(True).alias("is_summary"))
    number = lambda c: F.nullif(T.amount(F.coalesce(F.col(c), F.lit(""))), F.lit(0.0))
    lines = own.select("file", "title", "amount", number("price").cast("long").alias("unit_price"), number("units").cast("int").alias("quantity"), "rate", F.lit(False).alias("is_summary"))
    gross = money.half_up(F.col("amount") * 1.1)
    out = lines.unionByName(alone).join(totals.select("file", month.alias("sales_month"), F.col("due").alias("settlement_month")), "file")
    out = out.withColumns({"before_tax_income": gross, "after_tax_income": F.col("amount"), "consumption_tax": gross - F.col("amount")})
    return out, met.select("file", problem.alias("problem")).where("problem is not null")


def printed_invoices(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, title, sales_month, settlement_month, total, net, tax) of printed invoices' texts, as evidence, and problems."""
    text = F.coalesce("text", F.lit(""))
    subject = F.nullif(F.trim(F.regexp_extract(text, PRINTED_SUBJECT, 1)), F.lit(""))
    total = F.replace(F.regexp_extract(text, PRINTED_TOTAL, 1), F.lit(","), F.lit("")).try_cast("long")
    due = F.to_date(F.when(text.rlike(PRINTED_DUE), F.concat_ws("-", F.regexp_extract(text, PRINTED_DUE, 1), F.lpad(F.regexp_extract(text, PRINTED_DUE, 2), 2, "0"), F.lit("01"))))
    rows = files.select("file", subject.alias("subject"), total.alias("total"), due.alias("settlement_month"), (F.trim(text) == "").alias("blank"))
    net = money.half_up(F.col("total") / 1.1)
    records = rows.where("total is not null").select(
        "file",
        F.coalesce("subject", F.regexp_replace("file", r"\.[^.]+$", "")).alias("title"),
        F.coalesce(month_said(F.col("subject")), month_said(F.col("file"))).alias("sales_month"),
        "settlement_month",
        "total",
        net.alias("net"),
        (F.col("total") - net).alias("tax"),
    )
    return records, rows.where("total is null").select("file", F.when(F.col("blank"), "no text").otherwise("no total").alias("problem"))
