"""Quality rules with risk-controlled thresholds; DataFrame functions only.

Features of each text are array expressions within its row, so that no text is shuffled. For each stratum (language)
and feature, cutoffs of a fixed grid are tested from lenient to strict on the labelled holdout: a cutoff passes if the
exact binomial tail P(Bin(n, alpha) <= k) is at most delta, k being the good documents it would reject among the n
good ones of the stratum. The walk stops at the first cutoff that fails (a fixed sequence needs no correction along
it); delta is divided by the number of walks (Bonferroni over strata and features), alpha by the number of features.
With probability 1 - delta, then, no stratum loses more than alpha of its good documents. A stratum with too few
labels gets no cutoff and loses only what the base rules reject.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import SPACES, WORD, materialize

#: Fixed grids, lenient to strict: a document is rejected when the feature is above the cutoff.
GRIDS: dict[str, list[float]] = {
    "symbols_per_word": [8.0, 4.0, 3.0, 2.5, 2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "repeat_word_share": [0.49, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "shouts_per_word": [4.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1],
    "mean_word_chars": [40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 14.0, 13.0, 12.0, 11.0, 10.0],
}
STRATUM_NULL = "(none)"


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``q_`` names; each is referred to more than once, so that Spark computes it once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.withColumn("q_words", F.array_remove(F.split(text, SPACES), ""))
    i = F.sequence(F.lit(1), F.size("q_words") - 2)
    triples = F.transform(i, lambda i: F.xxhash64(F.get("q_words", i - 1), F.get("q_words", i), F.get("q_words", i + 1)))
    empty = F.array().cast("array<bigint>")
    docs = docs.withColumns({"q_n": F.size("q_words").cast("long"), "q_chars": F.length(F.array_join("q_words", "")).cast("long"), "q_triples": F.when(F.size("q_words") >= 3, triples).otherwise(empty)})
    lines = F.when(F.contains(text, F.lit("\n")), F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))
    docs = docs.withColumns({"q_lines": lines, "q_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"), "q_shouts": F.regexp_count(text, F.lit(r"[!?]|[A-Z]{3,}")).cast("long"), "q_repeats": F.size(F.array_distinct("q_triples")) < F.size("q_triples")})
    pairs = F.sort_array(F.transform("q_triples", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    docs = docs.withColumn("q_pairs", F.when(F.col("q_repeats"), pairs)).drop("q_triples", "q_repeats", "q_words")
    same = F.filter("q_pairs", lambda x, i: F.coalesce(x["h"] == F.get("q_pairs", i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("q_pairs", i + 1)["h"], F.lit(False)))
    starts = F.sort_array(F.transform(same, lambda x: x["i"]))
    zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(starts, zero, lambda s, x: F.struct(x.alias("last"), (s["n"] + F.least(F.lit(3), x - s["last"])).alias("n")))["n"]
    docs = docs.withColumns({"q_repeated": F.coalesce(covered, F.lit(0)).cast("long"), "q_dup_lines": F.coalesce(F.size("q_lines") - F.size(F.array_distinct("q_lines")), F.lit(0)).cast("long"), "q_n_lines": F.greatest(F.coalesce(F.size("q_lines"), F.lit(1)), F.lit(1))})
    return docs.drop("q_lines", "q_pairs")


def base_failed(least: int = 50, percent: int = 50) -> Column:
    return (F.col("q_n") < least) | (100 * F.col("q_repeated") > percent * F.col("q_n"))


def _features() -> dict[str, Column]:
    words = F.greatest("q_n", F.lit(1)).cast("double")
    return {
        "symbols_per_word": F.col("q_symbols") / words,
        "dup_line_share": F.col("q_dup_lines") / F.col("q_n_lines"),
        "repeat_word_share": F.col("q_repeated") / words,
        "shouts_per_word": F.col("q_shouts") / words,
        "mean_word_chars": F.col("q_chars") / words,
    }


def _ln_gamma(z: Column) -> Column:
    """Stirling's series from z + 8, with the factors below taken off."""
    y = z + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    for i in range(8):
        series = series - F.log(z + i)
    return series


def binomial_tail(k: Column, n: Column, p: float, terms: int = 4000) -> Column:
    """P(Bin(n, p) <= k), from the term at k downwards; beyond ``terms`` terms the rest is bounded by a geometric series, so that the value is never too small. 1 where k >= n * p."""
    k, n = k.cast("double"), n.cast("double")
    top = _ln_gamma(n + 1) - _ln_gamma(k + 1) - _ln_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    ratio = lambda j: j * (1 - p) / ((n - j + 1) * p)  # noqa: E731  of the term at j - 1 to that at j
    steps = F.sequence(F.lit(0), F.least(k, F.lit(float(terms))).cast("int"))
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    added = F.aggregate(steps, zero, lambda s, i: F.struct((s["term"] * ratio(k - i)).alias("term"), (s["sum"] + s["term"]).alias("sum")))
    rest = F.when(k > terms, added["term"] / (1 - ratio(k - terms))).otherwise(0.0)
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * (added["sum"] + rest)))


def thresholds(scored: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(stratum, one column a feature): the strictest cutoff that the walk certifies, null where none is.

    ``scored``: doc_id, stratum, failed and the q_ columns; ``labels``: doc_id, quality. All labelled rows count, repeated
    ones each; a doc_id with labels of either quality counts as good.
    """
    good = scored.where("not failed").join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    names = list(GRIDS)
    # of each feature, how many cutoffs are exceeded: a cutoff of index j is exceeded by levels of at least size - j
    level = lambda f, c: sum((F.when(c > cut, 1).otherwise(0) for cut in GRIDS[f]), F.lit(0))
    each = good.select("stratum", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(len(GRIDS[f])).alias("size"), level(f, c).alias("level")) for f, c in _features().items()))).alias("x"))
    counted = each.groupBy("stratum", "x.feature", "x.size", "x.level").agg(F.count("*").alias("n"))
    walks = counted.groupBy("stratum", "feature", "size").agg(F.sum("n").alias("n"), F.collect_list(F.struct("level", "n")).alias("levels"))
    walks = walks.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    k = F.aggregate(F.filter("levels", lambda x: x["level"] >= F.col("size") - F.col("j")), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    strata = scored.select("stratum").distinct().agg(F.count("*").alias("strata"))
    tested = walks.withColumn("k", k).crossJoin(F.broadcast(strata))  # one row
    tested = tested.withColumn("p", binomial_tail(F.col("k"), F.col("n"), alpha / len(names)))
    failed = tested.p > delta / (len(names) * F.greatest(F.col("strata"), F.lit(1)))
    last = tested.groupBy("stratum", "feature", "size").agg(F.coalesce(F.min(F.when(failed, F.col("j"))), F.col("size")).alias("passed"))
    cut = {f: F.max(F.when((F.col("feature") == f) & (F.col("passed") > 0), F.get(F.array(*map(F.lit, GRIDS[f])), F.col("passed") - 1))).alias(f"cut_{f}") for f in names}
    return last.groupBy("stratum").agg(*cut.values())


def quality_verdicts(docs: DataFrame, labels: DataFrame, carry: list[str], alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The columns ``carry`` of each row, with q_n, q_chars, q_symbols, q_dup_lines, q_repeated, base_failed and kept.

    ``docs``: doc_id, text, lang. Null texts have no words and fail the base rules; a null language is a stratum of
    its own. Repeated rows are judged alike. ``labels`` may be empty: then the base rules decide.
    """
    base = docs.select(F.struct(*carry).alias("q_row"), "doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit(STRATUM_NULL)).alias("stratum"))
    scored = with_features(base).drop("text").withColumn("failed", base_failed())
    scored = materialize(scored, "quality-features")
    cuts = materialize(thresholds(scored, labels, alpha, delta), "quality-cutoffs")
    over = F.lit(False)
    for f, c in _features().items():
        over = over | F.coalesce(c > F.col(f"cut_{f}"), F.lit(False))
    judged = scored.join(cuts, "stratum", "left").withColumn("kept", ~F.col("failed") & ~over)
    return judged.select("q_row.*", "q_n", "q_chars", "q_symbols", "q_dup_lines", "q_repeated", F.col("failed").alias("base_failed"), "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    judged = quality_verdicts(docs.select("doc_id", "text", "lang", F.struct(*(F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True))).alias("all")), labels, ["all"])
    return judged.where("kept").select(*(F.col(f"all.{n}").alias(c) for c, n in zip(docs.columns, names, strict=True)))
