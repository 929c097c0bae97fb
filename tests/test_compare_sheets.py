import itertools
import random
from collections import Counter, defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators.ledger import compare_sheets
from ledgerloom.plans import registry
from ledgerloom.plans.views import ledger


def differ(a, b):
    """(pairs that differ, fields that differ, fields blank on a side) of two rows."""
    seen = [None if x is None or y is None else x == y for x, y in zip(a, b, strict=True)]
    return any(v is not True for v in seen), seen.count(False), seen.count(None)


def fewest(a, b):
    small, large = sorted((a, b), key=len)
    return min((tuple(map(sum, zip(*(differ(x, large[j]) for x, j in zip(small, p, strict=True)), strict=True))) or (0, 0, 0) for p in itertools.permutations(range(len(large)), len(small))), default=(0, 0, 0))


def test_query_against_brute_force_pairing_of_the_whole_ledger(spark, tmp_path):
    r = random.Random(7)
    orders = [(i, r.randrange(3), r.choice(["1-URGENT", "3-MEDIUM", "5-LOW"])) for i in range(40)]
    lines = [(i, r.randrange(3), r.randrange(2), n, float(r.randrange(3)), 0.1, r.choice([0.0, 0.5]), r.choice("FO"), datetime(1998, r.choice([1, 12]), 5)) for i, _, _ in orders for n in range(1, r.randrange(2, 4))]
    for name, rows, schema in (
        ("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_discount double, l_tax double, l_linestatus string, l_shipdate timestamp"),
        ("orders", orders, "o_orderkey long, o_custkey long, o_orderpriority string"),
        ("supplier", [(0, 0), (1, 1)], "s_suppkey long, s_nationkey int"),
        ("nation", [(0, "N0"), (1, "N1")], "n_nationkey int, n_name string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    ours, theirs = defaultdict(list), defaultdict(list)
    for x in ledger(spark, str(tmp_path)).collect():
        ours[str(x.client_id), x.channel, x.batch].append((x.title_jp, x.gross, x.fee))
        late = {"1998-01": "1998-02", "1998-12": "1999-01"}[x.batch] if x.type == "5-LOW" else x.batch
        theirs[str(x.client_id), x.channel, late].append((x.title_jp, x.gross + (x.status == "F"), None if x.type == "1-URGENT" else x.fee))
    want = Counter()
    for k in {*ours, *theirs}:
        want[k, "field"] = fewest(ours[k], theirs[k])[1]
        want[k, "extra"], want[k, "missing"] = max(0, len(ours[k]) - len(theirs[k])), max(0, len(theirs[k]) - len(ours[k]))
    got = registry.QUERIES["e18_compare_sheets"](spark, str(tmp_path)).collect()
    assert Counter((tuple(x[:3]), x.category) for x in got) == +want
    assert {c for _, c in +want} == {"field", "extra", "missing"} and max(map(len, ours.values())) > 2
    for x in got:
        if x.category == "field":
            at = ["title_jp", "gross", "fee"].index(x.field)
            assert x.ours in {str(v[at]) for v in ours[tuple(x[:3])]} and x.theirs in {str(v[at]) for v in theirs[tuple(x[:3])]}


def test_identities_with_nothing_to_pair_are_compared_as_the_others(spark):
    """Numbers, blanks and texts of one row a side, beside the same cells among several rows, which are paired."""
    cells = [("1,000", "1000"), ("１２", "12"), ("ｱ  b", "ア b"), ("a", "b"), (None, "a"), ("", None), ("é", "e"), ("1e3", "1000"), ("3.0", "3"), ("12 ", "12"), ("7", "7.0000001"), ("7", "7.1")]
    one = [(f"k{i}", a, float(i)) for i, (a, _) in enumerate(cells)], [(f"k{i}", b, float("nan") if i == 3 else i + 1e-9) for i, (_, b) in enumerate(cells)]
    many = [[(k.replace("k", "m"), *v) for k, *v in d for v in (v, ("same", 0.5))] for d in one]
    ours, key = (spark.createDataFrame([*a, *b], "k string, t string, n double") for a, b in zip(one, many, strict=True))
    # more rows on one side, rows of a side alone, an identity without a name
    ours = ours.union(spark.createDataFrame([("x", "a", 1.0), ("x", "b", 2.0), ("y", "a", 1.0), (None, "a", 1.0)], ours.schema))
    key = key.union(spark.createDataFrame([("x", "b", 2.0), ("z", "c", 1.0), (None, "b", 1.0)], ours.schema))
    got = compare_sheets(ours.repartition(3), key.repartition(2), ["k"], ["t", "n"]).collect()
    differ = {(0, "t"): 0, (3, "t"): 1, (3, "n"): 1, (6, "t"): 1, (7, "t"): 1, (11, "t"): 1}
    want = Counter((f"{p}{i}", "field", f) for (i, f), n in differ.items() if n for p in "km")
    want += Counter([("x", "extra", None), ("y", "extra", None), ("z", "missing", None), (None, "field", "t")])
    assert Counter((x.k, x.category, x.field) for x in got) == want
    assert ("k11", "7", "7.1") in {(x.k, x.ours, x.theirs) for x in got}


def test_meaning_within_a_task_is_the_columns(spark):
    texts = ["", " a　 b ", "１，２３４", "-3.50", "+7", "12 ", "12\n", "٣", "①", "ｶﾞ", "1e3", "a,b", "﻿5", "9" * 400]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", T.semantic(F.col("t"), "string").alias("m")).collect()
    number = lambda m: float(m[2:]) if m and m.startswith("n:") else m
    assert [number(T.meaning(x.t)) for x in rows] == [number(x.m) for x in rows]


def test_more_rows_of_an_identity_than_can_be_paired_are_an_error(spark):
    rows = spark.createDataFrame([("k", str(i)) for i in range(700)], "k string, t string")
    for a, b in ((rows, rows.limit(0)), (rows.limit(4), rows.limit(0))):
        run = compare_sheets(a, b, ["k"], ["t"], most=3)
        with pytest.raises(Exception, match="more than 3 rows of one identity"):
            run.collect()
