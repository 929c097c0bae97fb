import hashlib
import math
import random
import re
from collections import Counter

import corpus_pipeline
from tests.llm.test_jaccard_join import brute
from tests.llm.test_native_operators import brute_leaks, brute_targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    """(doc_id, text, lang, source): good texts, near copies, leaks, short and repetitive texts, repeated rows, nulls."""
    r = random.Random(5)
    word = lambda: r.choice("abcdefghij") + str(r.randrange(900))
    items = [(i, " ".join(word() for _ in range(r.randrange(20, 40)))) for i in range(6)]
    rows, base = [], []
    for i in range(120):
        w = [word() for _ in range(r.randrange(60, 140))]
        if i % 5 == 0 and base:  # a near copy
            w = list(r.choice(base))
            w[r.randrange(len(w))] = "changed"
        if i % 9 == 0:
            at = r.randrange(len(w))
            w[at:at] = items[i % 6][1].split()
        if i % 13 == 0:
            w = w[:20]
        if i % 17 == 0:
            w = ["same", "three", "words"] * 40
        base.append(w)
        rows.append((i, " ".join(w), r.choice(["en", "de"]), "hot" if i % 3 else f"s{i % 4}"))
    rows += [(500, None, None, None), (501, "", "en", "hot"), (502, " ".join(base[1]), None, None)]
    return rows, items


def brute_kept(rows, items):
    """The documents left by the base rules (the labels are too few for cutoffs), by near copies and by the benchmark."""

    def good(text):
        w = WORD.findall(text or "")
        grams = [tuple(w[p : p + 3]) for p in range(len(w) - 2)]
        c = Counter(grams)
        repeated = len({p + o for p, g in enumerate(grams) if c[g] > 1 for o in range(3)})
        return len(w) >= 50 and 100 * repeated <= 50 * len(w)

    rows = [x for x in rows if good(x[1])]
    group = {i: g for i, _, g in brute([x[:2] for x in rows], 5, 80)}
    rows = [x for x in rows if group[x[0]] == x[0]]
    leaked = {x[0] for x in brute_leaks([x[:2] for x in rows], items)}
    return [x for x in rows if x[0] not in leaked]


def test_run_against_brute_force(spark, tmp_path):
    rows, items = corpus()
    put = lambda name, data, schema: spark.createDataFrame(data, schema).withColumn("extra", spark_lit(7)).write.parquet(f"{tmp_path}/{name}.parquet")
    from pyspark.sql.functions import lit as spark_lit

    put("documents", rows, "doc_id long, text string, lang string, source string")
    put("labels", [(i, 1, 0) for i in range(0, 30)], "doc_id long, quality int, toxic int")
    put("benchmark", items, "item_id long, text string")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = brute_kept(rows, items)
    assert 20 < len(kept) < 110
    sizes = Counter()
    for _, t, _, s in kept:
        sizes[s] += len(WORD.findall(t))
    target, want = brute_targets(sizes), Counter()
    for i, _, _, s in kept:
        rate = target[s] / sizes[s]
        draw = int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:13], 16) / 2**52
        want[i] = math.floor(rate) + (draw < rate - math.floor(rate))
    assert Counter(x.doc_id for x in got) == +want
    text = {i: t for i, t, _, _ in rows}
    assert all(x.size == len(text[x.doc_id].encode()) + 1 for x in got)
    shards = Counter(x.shard for x in got)
    assert max(shards.values()) - min(shards[s] for s in range(16)) <= 1
    assert all(sorted(x.slot for x in got if x.shard == s) == list(range(n)) for s, n in shards.items())
    order = sorted(got, key=lambda x: (x.shard, x.slot))
    assert [x.h for x in order] == sorted(x.h for x in got)


def test_stages_handle_empty_tables(spark, tmp_path):
    schemas = {"documents": "doc_id long, text string, lang string, source string", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
