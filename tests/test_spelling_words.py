import random

import numpy as np

from ledgerloom.functions.spellings import _signs, edits
from ledgerloom.plans import registry
from ledgerloom.plans import notice_queries  # noqa: F401  registers its queries
from tests.test_spellings import plain_distance


def test_heads_as_long_as_a_word_and_one_more():
    """Bits of 32 and 64 signs, filled and overfull, of one head and of several at once; texts of different lengths."""
    r = random.Random(2)
    texts = ["".join(r.choice("ab口") for _ in range(n)) for n in (1, 31, 32, 33, 63, 64, 65, 32, 64, 0, 40)]
    at, size = _signs(texts)
    want = np.array([[plain_distance(h, t) for t in texts] for h in texts])
    every = np.arange(len(texts))
    assert all(edits(at, size, every, np.full(len(texts), h)).tolist() == want[h].tolist() for h in every)
    heads, of = np.repeat(every, len(texts)), np.tile(every, len(texts))
    assert edits(at, size, of, heads).tolist() == want.ravel().tolist()
    assert at.dtype == np.uint8  # few different signs, so that they are read as bytes


def test_the_ledger_is_read_once_behind_the_notices_sums(spark):
    plan = registry.QUERIES["p19_shueisha_notice"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice") and sum("Relation" in x and "l_extendedprice" in x for x in plan.splitlines()) == 1
