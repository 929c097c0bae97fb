import hashlib
import random
import re

from pyspark.sql import functions as F

from ledgerloom.llm.substring_dedup import dedup_substrings


def brute(rows, window):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p : p + window]), i)
    out = set()
    for i, w in words.items():
        drop = {q for p in range(len(w) - window + 1) if first[tuple(w[p : p + window])] < i for q in range(p, p + window)}
        kept = " ".join(x for q, x in enumerate(w) if q not in drop)
        out.add((i, len(w), len(drop), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(seed, window):
    r, rows = random.Random(seed), []
    word = lambda: r.choice(["a", "b", "é", "Z", "w" + str(r.randrange(50))])
    passages = [[word() for _ in range(r.choice([window - 1, window, window + 1, 3 * window]))] for _ in range(6)]
    for _ in range(60):
        w = []
        for _ in range(r.randrange(4)):
            w += r.choice(passages) if r.random() < 0.6 else [word() for _ in range(r.randrange(2 * window))]
        rows.append(r.choice([" ", "\n", "  "]).join(w))
    rows += [None, "", " ", rows[0], rows[1], rows[1]]
    return list(enumerate(rows))


def test_against_brute_force(spark):
    for seed, window, gram, batches in ((1, 50, 10, 2), (2, 8, 3, 1), (3, 6, 2, 6)):
        rows = corpus(seed, window)
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("marks", F.lit(1)).repartition(5)
        assert {tuple(x) for x in dedup_substrings(docs, window, gram, batches).collect()} == brute(rows, window)


def test_empty_table_and_text(spark):
    docs = spark.createDataFrame([(1, "x y"), (2, "q x y")], "doc_id long, text string")
    assert dedup_substrings(docs.where("doc_id > 5")).count() == 0
    assert {tuple(x) for x in dedup_substrings(docs, 2, 1, with_text=True).select("doc_id", "kept").collect()} == {(1, None), (2, "q")}
