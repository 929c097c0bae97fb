import random

import numpy as np

from ledgerloom.functions.spellings import _signs, edits, first_near
from ledgerloom.sources import notices as N


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_heads_against_a_plain_walk():
    r = random.Random(1)
    for signs, most in (("ab", 12), ("abcdé漢口😀", 30), ("abc", 90)):
        texts = list({"".join(r.choice(signs) for _ in range(r.randrange(most))) for _ in range(60)})
        heads, want = [], []
        for i, t in enumerate(texts):
            near = [h for h in heads if plain_distance(texts[h], t) <= max(2, int(max(len(texts[h]), len(t)) * 0.45))]
            heads += [] if near else [i]
            want.append(near[0] if near else i)
        at, size = _signs(texts)
        for g in range(0, len(texts), 9):
            assert edits(at, size, np.arange(len(texts)), np.full(len(texts), g)).tolist() == [plain_distance(texts[g], t) for t in texts]
        assert first_near(texts + texts, np.arange(2 * len(texts)) // max(1, len(texts)), 0.45, 2).tolist() == want + [len(texts) + w for w in want]
    assert first_near([], np.zeros(0, int), 0.45, 2).tolist() == []


def test_spellings_of_many_pages_are_taken_together(spark):
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 > 0 THEN concat('f', id % 7) END AS file", "id AS place", "repeat(concat('T', pmod(hash(id), 900)), 3) AS title", "CASE WHEN id % 2 = 0 THEN '単行本' END AS kind", "1L AS payment")
    out = N.spelling_groups(rows)
    apart = [N.spelling_groups(rows.where(f"file <=> {f} and kind <=> {k}")) for f in ("null", "'f1'") for k in ("null", "'単行本'")]
    found = [str(r) for r in out.where("file is null or file = 'f1'").collect()]
    assert sorted(found) == sorted(str(r) for d in apart for r in d.collect()) and out.agg({"payment": "sum"}).first()[0] == 3000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "levenshtein" not in plan


def test_a_detail_without_a_title_stands_alone(spark):
    rows = spark.createDataFrame([("f", 1, None, "k", 1), ("f", 2, "abcd", "k", 2), ("f", 3, "abxy", "k", 3), ("f", 4, None, "k", 4)], "file string, place int, title string, kind string, payment long")
    assert sorted((str(g.title), g.payment) for g in N.spelling_groups(rows).collect()) == [("None", 5), ("abcd", 5)]
