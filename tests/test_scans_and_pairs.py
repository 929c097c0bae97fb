import random
import re

import pytest

from ledgerloom.operators import analytics as A
from ledgerloom.operators import masters as M
from ledgerloom.plans import views as V

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["by_group", "title_sales", "launch_curve"])
def test_the_fact_is_scanned_once(spark, name):
    sales = V.daily_sales(spark, SF)
    out = A.by_group(sales, "channel") if name == "by_group" else getattr(A, name)(sales)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet \[[^\]]*l_partkey", final)) == 1


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_near_pairs_against_all_pairs(spark, most):
    r = random.Random(most)
    texts = {"".join(r.choice("abé") for _ in range(r.randrange(0, 9))) for _ in range(150)} | {"x" * 30, "x" * 29 + "y", "ab" * 12, "ba" * 12}
    rows = spark.createDataFrame([(t,) for t in [*texts, "abc", "abc", None]], "t string").repartition(5)
    texts |= {"abc"}
    want = {(a, b, d) for a in texts for b in texts if a < b and (d := distance(a, b)) <= most}
    assert {tuple(x) for x in M.near_pairs(rows, "t", most).collect()} == want
