"""The cutoffs of the quality rules against a plain walk over plain counts."""

import random
from math import comb

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.quality_rules import GRIDS, base_failed, quality_verdicts, thresholds, with_features


def tail(k, n, p):
    return sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) if k < n * p else 1.0


def values(r):
    n = max(r.q_n, 1)
    return {"symbols_per_word": r.q_symbols / n, "dup_line_share": r.q_dup_lines / r.q_n_lines, "repeat_word_share": r.q_repeated / n, "shouts_per_word": r.q_shouts / n, "mean_word_chars": r.q_chars / n}


def walked(rows, labelled, alpha, delta):
    """{stratum: {feature: cutoff}}"""
    strata = {r.stratum for r in rows}
    out = {}
    for s in strata:
        good = [values(r) for r in rows if r.stratum == s and not r.failed and r.doc_id in labelled]
        if not good:
            continue
        out[s] = {}
        for f, grid in GRIDS.items():
            passed = None
            for cut in grid:
                k = sum(v[f] > cut for v in good)
                if tail(k, len(good), alpha / len(GRIDS)) > delta / (len(GRIDS) * len(strata)):
                    break
                passed = cut
            out[s][f] = passed
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(7)
    rows = []
    for i in range(900):
        lang = draw.choice(["en", "en", "en", "de", None])
        good = draw.random() < 0.8
        words = [f"w{draw.randrange(5000)}" + ("%" * 3 if draw.random() < (0.02 if good else 0.6) else "") for _ in range(draw.randrange(45, 90))]
        if draw.random() < (0.01 if good else 0.4):
            words = words[:40] + words[:12] + ["WOW!!"] * draw.randrange(6)
        text = " ".join(words[:30]) + "\n" + " ".join(words[30:])
        if draw.random() < (0.005 if good else 0.5):
            text += "\n" + "\n".join(["one line again"] * 3)
        rows.append((i, text, lang, int(good if draw.random() < 0.97 else not good)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")


def test_cutoffs_are_those_of_a_plain_walk(spark, corpus):
    alpha, delta = 0.2, 0.1
    scored = with_features(corpus.select("doc_id", "text", F.coalesce("lang", F.lit("(none)")).alias("stratum"))).withColumn("failed", base_failed())
    labels = corpus.select("doc_id", "quality").union(corpus.select("doc_id", "quality").where("doc_id < 300"))  # repeated labels count once
    got = {r.stratum: {f: r[f"cut_{f}"] for f in GRIDS} for r in thresholds(scored, labels, alpha, delta).collect()}
    rows, quality = scored.collect(), {r.doc_id: r.quality for r in corpus.select("doc_id", "quality").collect()}
    want = walked(rows, {d for d, q in quality.items() if q == 1}, alpha, delta)
    assert got == want and any(c is not None for cuts in want.values() for c in cuts.values())
    kept = {r.doc_id: r.kept for r in quality_verdicts(corpus, labels, ["doc_id"], alpha, delta).collect()}
    lost = dict.fromkeys(want, 0)
    for r in rows:
        over = any(c is not None and values(r)[f] > c for f, c in want.get(r.stratum, {}).items())
        assert kept[r.doc_id] == (not r.failed and not over)
        lost[r.stratum] += quality[r.doc_id] == 1 and not r.failed and over
    good = {s: sum(quality[r.doc_id] == 1 and not r.failed for r in rows if r.stratum == s) for s in want}
    assert all(lost[s] <= alpha * good[s] for s in want)
