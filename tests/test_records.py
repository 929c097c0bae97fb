import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.records import sales_records, shape_of, unresolved_codes
from ledgerloom.plans import views as V

DAY = dt.date


@pytest.fixture(scope="module")
def sides(spark):
    return {
        "uploads": spark.createDataFrame([(1, DAY(2026, 5, 1), DAY(2026, 4, 30), False), (2, DAY(2026, 5, 1), None, True)], "upload_id long, settlement_month date, sales_month date, forced boolean"),
        "clients": spark.createDataFrame([("u1", "nttsolmare", ["NTT  ", "Solmare"]), ("u2", "Kadokawa", None)], "client_id string, code string, aliases array<string>"),
        "channels": spark.createDataFrame([("h1", "cmoa"), ("h2", "comico jp")], "channel_id string, code string"),
        "titles": spark.createDataFrame([("t1", "Title A")], "title_id string, title_jp string"),
    }


DATA = "struct<client_code:string,channel:string,title_jp:string,sales_month:string,settlement_month:string,gross_jpy:string,fee_jpy:double,consumption_tax_jpy:double,rs_rate_hint:double,is_summary:boolean,source_file_kind:string,note2:string>"


def test_raw_rows_keep_days_and_summaries_hold_no_amounts(spark, sides):
    rows = spark.createDataFrame(
        [
            (1, 0, (" ntt ", "cmoa ", "TITLE A", "2026-03-31", None, "1100", None, 7.0, 0.4, None, None, " ")),
            (1, 1, ("Kadokawa", "cmoa", "B", None, "2026/6/30", "x", 3.0, 7.0, 0.4, True, "invoice", "seen")),
            (2, 2, (None, None, None, None, "2026-07-15", "NaN", 3.0, None, None, False, "k", None)),
            (9, 3, ("other", "none", "C", "2026-02", None, None, None, None, None, None, None, None)),
        ],
        f"upload_id long, row_index long, data {DATA}",
    )
    out = sales_records(rows, **sides)
    a, b, c, d = out.orderBy("row_index").collect()
    assert (a.client_id, a.channel_id, a.title_id, a.channel_title_jp) == ("u1", "h1", "t1", "TITLE A")
    assert (a.sales_month, a.settlement_month, a.settlement_batch) == (DAY(2026, 3, 31), DAY(2026, 5, 1), DAY(2026, 5, 1))
    assert (a.total_amount_jpy, a.before_tax_jpy, a.fee_jpy, a.withholding_tax_jpy, a.consumption_tax_jpy, a.rs_rate, a.note2) == (1100.0, None, 0.0, 0.0, 7.0, 0.4, None)
    assert (b.client_id, b.sales_month, b.settlement_month, b.note2) == ("u2", DAY(2026, 4, 30), DAY(2026, 6, 30), "seen / SUMMARY_NON_AGGREGATED:invoice")
    assert (b.total_amount_jpy, b.fee_jpy, b.consumption_tax_jpy, b.rs_rate) == (None, 0.0, 0.0, None)
    assert (c.total_amount_jpy, c.fee_jpy, c.sales_month, c.settlement_month, c.mg_begin, c.company) == (None, 3.0, DAY(2026, 5, 1), DAY(2026, 5, 1), None, "RJ")
    assert (d.client_id, d.sales_month, d.settlement_month) == (None, DAY(2026, 2, 1), None)
    assert unresolved_codes(out).count() == 0


def test_aggregated_rows_take_firsts_of_months_and_name_what_is_unknown(spark, sides):
    rows = spark.createDataFrame([(1, 0, "SOLMARE", "comico jp", "", "2026-03-31", 5.0, None, " "), (2, 1, "Nobody", "CMOA", None, None, None, 2.0, "n")], "upload_id long, row_index long, client_code string, channel_code string, company string, sales_month string, before_tax_jpy double, mg_end double, note1 string")
    out = sales_records(rows, **sides)
    a, b = out.orderBy("row_index").collect()
    assert (a.client_id, a.channel_id, a.company, a.sales_month, a.before_tax_jpy, a.mg_end, a.note1, a.unresolved) == ("u1", "h2", "", DAY(2026, 3, 1), 5.0, 0.0, None, [])
    assert (b.company, b.sales_month, b.mg_end) == ("RJ", DAY(2026, 5, 1), 2.0)
    assert sorted((r.row_index, r.field, r.message, r.sample) for r in unresolved_codes(out).collect()) == [(1, "channel_code", "unresolved channel: CMOA", "CMOA"), (1, "client_code", "unresolved client: nobody", "Nobody")]
    assert unresolved_codes(sales_records(rows, sides["uploads"])).count() == 0


def test_rows_of_the_sheet_fall_back_to_the_second_income(spark, sides):
    rows = spark.createDataFrame([(1, "ntt", "cmoa", "0.5", "x", "12", " 3 ", " t ", " u ")], "upload_id long, clients string, channel string, rs string, after_tax_income_jpy_a string, after_tax_income_jpy_b string, extra_45 string, extra_53 string, unique_id string")
    (a,) = sales_records(rows, **sides).collect()
    assert (a.client_id, a.rs_rate, a.after_tax_income_jpy, a.after_tax_income_jpy_a, a.extra_45, a.extra_53, a.unique_id, a.unique_identifier) == ("u1", 0.5, 12.0, None, 3.0, "t", "u", "u")
    with pytest.raises(ValueError):
        shape_of(rows.select("upload_id"))


def test_raw_rows_may_be_maps_and_tables_may_be_empty(spark, sides):
    rows = spark.createDataFrame([(1, 0, {"client_code": "ntt", "is_summary": "true"}), (1, 1, {"gross_jpy": "5"})], "upload_id long, row_index long, data map<string,string>")
    a, b = sales_records(rows, **sides).orderBy("row_index").collect()
    assert (a.client_id, a.note2, b.total_amount_jpy) == ("u1", "SUMMARY_NON_AGGREGATED", 5.0)
    assert sales_records(rows.where("false"), **{k: v.where("false") for k, v in sides.items()}).count() == 0


def test_a_client_is_found_by_one_join_and_by_its_code_as_spelt(spark):
    """Codes that differ in case or blanks alone, an alias of two codes, an alias without a code, and none."""
    clients = spark.createDataFrame(
        [("1", " Ab", ["x"]), ("2", "ab", ["x", " Y "]), ("3", "AB ", None), ("4", None, ["z"]), ("0", "ab", []), ("5", "w", ["q", None]), ("6", " Cd", None)],
        "client_id string, code string, aliases array<string>",
    )
    said = ["ab", " Ab", "AB ", "X", "y", "z", "W", " q ", "none", None, " Cd"]
    uploads = spark.createDataFrame([(1, "2024-05-01", None, False)], "upload_id long, settlement_month string, sales_month string, forced boolean")
    rows = spark.createDataFrame([(1, i, c, "ch") for i, c in enumerate(said)], "upload_id long, row_index long, client_code string, channel string")
    raw = rows.selectExpr("upload_id", "row_index", "struct(client_code, channel) AS data")
    sheet = rows.withColumnRenamed("client_code", "clients")
    ids = lambda r: [x.client_id for x in sales_records(r, uploads, clients).orderBy("row_index").collect()]
    assert ids(sheet) == ["0", "0", "0", "1", "0", None, "5", "5", None, None, None]
    assert ids(raw) == ["0", "0", "0", "1", "0", None, "5", "5", None, None, "6"]
    plan = sales_records(sheet, uploads, clients)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2  # the upload's month and the client


def test_channels_are_as_small_to_spark_as_the_suppliers(spark):
    plan = V.channels(spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan()
    assert plan.stats().sizeInBytes() < 50_000  # 100 suppliers; the product with the nations was more
    assert sorted(V.channels(spark, "/root/testdata/sf0.01").collect()) == sorted(
        V.table(spark, "/root/testdata/sf0.01", "supplier").join(V.table(spark, "/root/testdata/sf0.01", "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name").collect()
    )
