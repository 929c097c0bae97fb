"""Trains the boosted trees of ``pii.py`` on generated candidates and calibrates the thresholds on others.

python -m ledgerloom.llm.pii_training writes pii_trees.json. Examples (at most ``EXAMPLES`` a set) are made from a
seed: spans of each kind in the formats that people use, with words beside them, against look-alikes (order numbers,
versions, dates, sums) and against real spans of every other kind. Thresholds are calibrated on texts of another
``style``: words, labels and look-alikes that the trees were not trained on. Features are computed by the operator's
own expressions.
"""

from __future__ import annotations

import json
import random
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.pii import CONTEXT, FEATURES, KINDS, MORE, features, find_spans

EXAMPLES = 6000
#: Words around spans, labels of each kind, labels that speak against, by style: 0 to train, 1 to calibrate, 2 to test.
NEUTRAL = (
    "the of and to in that was for with est une los der die und para dans".split(),
    "by from as are or an at which les des que por con ein eine auf nicht".split(),
    "then here about over all some has had les pour sur mit von zu como sin".split(),
)
HINTS = (
    (["mail me at", "contact", "write to"], ["ip address", "server at", "login from host"], ["card number", "visa", "credit card"], ["call", "phone:", "tel", "mobile"]),
    (["my address is", "reach us by mail", "e-mail"], ["client", "ping", "the host"], ["paid by card", "mastercard", "debit card"], ["telefon", "cell", "fax"]),
    (["kontakt", "write:"], ["our server", "address"], ["amex", "payment card"], ["ring", "whatsapp", "call me on"]),
)
AGAINST = (
    ["order", "invoice no", "version", "isbn", "item", "ref", "ticket #", "$"],
    ["serial", "release", "page", "account", "sku"],
    ["chapter", "part no", "issn", "order no"],
)


def _luhn(r: random.Random, n: int = 16) -> str:
    d = [r.choice([4, 5, 3, 6])] + [r.randrange(10) for _ in range(n - 2)]
    total = sum(x if (n - 1 - i) % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d))
    return "".join(map(str, d)) + str(-total % 10)


def _base_like(r: random.Random, k: int) -> str:
    """A span of the kind as the base patterns have it."""
    d = lambda n: "".join(str(r.randrange(10)) for _ in range(n))
    word = "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    return [f"{word}.{d(2)}@{word}.example.com", ".".join(str(r.randrange(256)) for _ in range(4)), _luhn(r), f"+1 ({d(3)}) 555-{d(4)}"][k]


def example(r: random.Random, style: int = 0) -> tuple[str, int, str, int]:
    """(text, index of kind, span, 1 if personal)."""
    k, good = r.randrange(4), int(r.random() < 0.5)
    d = lambda n: "".join(str(r.randrange(10)) for _ in range(n))
    name = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9)))
    hint = HINTS[style][k]
    if k == 0:
        at, dot = r.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), ("{at}", "{dot}")])
        span = f"{name()}{at}{name()}{dot}{r.choice(['com', 'org', 'net', 'de'])}"
        good = int(good or r.random() < 0.7)
        if not good:
            span = f"{name()} @ {name()}. {name()}"
    elif k == 1:
        span = "[.]".join(str(r.randrange(256)) for _ in range(4)) if good else ".".join(str(r.choice([r.randrange(10), r.randrange(256, 999)])) for _ in range(4))
    elif k == 2:
        number = _luhn(r) if good else d(16)
        cut = r.choice(["", " ", "-"])
        span = cut.join(number[i : i + 4] for i in range(0, 16, 4))
    else:
        formats = [f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"0049 {d(3)} {d(3)} {d(3)}"]
        quad = ".".join(str(r.choice([r.randrange(10, 256), r.randrange(256, 999)])) for _ in range(4))
        long = d(16)
        alike = [f"{r.randrange(1990, 2030)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(3)} {d(3)} {d(3)}", f"{d(4)}-{d(4)}-{d(4)}", f"{d(2)}.{d(2)}.{d(4)}", quad, quad, " ".join(long[i : i + 4] for i in range(0, 16, 4))]
        span = r.choice(formats if good else alike)
    if not good and r.random() < 0.3:
        span = _base_like(r, r.choice([x for x in range(4) if x != k]))
    if good:
        lead = r.choice(hint) if k == 3 or r.random() < 0.7 else r.choice(NEUTRAL[style])
    else:
        # look-alikes are also found beside labels of their own kinds, and beside the kind's own
        lead = r.choice(AGAINST[style]) if r.random() < 0.4 else r.choice(r.choice(HINTS[style])) if r.random() < 0.3 and k != 3 else r.choice(NEUTRAL[style])
    words = lambda n: " ".join(r.choice(NEUTRAL[style]) for _ in range(n))
    return f"{words(4)} {lead} {span} {words(3)}", k, span, good


def dataset(spark: SparkSession, seed: int, n: int = EXAMPLES, style: int = 0) -> tuple[np.ndarray, np.ndarray]:
    r = random.Random(seed)
    rows = [example(r, style) for _ in range(n)]
    df = spark.createDataFrame(rows, "text string, k int, span string, y int")
    df = find_spans(df, "text", {f"x{k}": (p, F.col("text").rlike(test)) for k, (p, test) in MORE.items()})
    xs, ys = [], []
    for i, k in enumerate(KINDS):
        c = df.where(f"k = {i}").select("text", "span", "y", F.explode(f"x{k}").alias("x"))
        left = F.substring(F.col("text"), F.greatest(F.lit(1), F.col("x.start") + 1 - CONTEXT), F.least(F.col("x.start"), F.lit(CONTEXT)))
        got = c.select(((F.col("y") == 1) & (F.col("x.s") == F.col("span"))).cast("int"), F.array(*features(i, F.col("x.s"), left, F.substring(F.col("text"), F.col("x.end") + 1, F.lit(2))))).collect()
        xs += [g[1] for g in got]
        ys += [g[0] for g in got]
    return np.array(xs), np.array(ys)


def _tree(x, g, h, depth):
    leaf = lambda m: round(float(0.3 * g[m].sum() / (h[m].sum() + 1.0)), 5)
    every = np.ones(len(g), bool)
    if not depth or len(g) < 20:
        return leaf(every)
    best, cut = 1e-6, None
    own = g.sum() ** 2 / (h.sum() + 1)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for v in (values[:-1] + values[1:]) / 2 if len(values) < 40 else np.quantile(values, np.linspace(0.05, 0.95, 19)):
            m = x[:, f] <= v
            gl, hl = g[m].sum(), h[m].sum()
            gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - own
            if gain > best and 5 <= m.sum() <= len(g) - 5:
                best, cut = gain, (f, float(v))
    if cut is None:
        return leaf(every)
    m = x[:, cut[0]] <= cut[1]
    return [cut[0], cut[1], _tree(x[m], g[m], h[m], depth - 1), _tree(x[~m], g[~m], h[~m], depth - 1)]


def predict(trees, x) -> np.ndarray:
    def value(node, m, out):
        if not isinstance(node, list):
            out[m] += node
            return
        low = x[:, node[0]] <= node[1]
        value(node[2], m & low, out), value(node[3], m & ~low, out)

    out = np.zeros(len(x))
    for t in trees:
        value(t, np.ones(len(x), bool), out)
    return out


def train(spark: SparkSession, rounds: int = 24, depth: int = 4, precision: float = 0.99) -> dict:
    """Gradient boosting on logistic loss; each kind's threshold is the least that has the precision on texts of another style."""
    x, y = dataset(spark, 1)
    trees, at = [], np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-at))
        trees.append(_tree(x, y - p, p * (1 - p), depth))
        at = predict(trees, x)
    x, y = dataset(spark, 2, style=1)
    at, cut = predict(trees, x), {}
    for i, k in enumerate(KINDS):
        m = x[:, 0] == i
        s, t = at[m], y[m]
        order = np.argsort(-s, kind="stable")
        right = np.cumsum(t[order]) / np.arange(1, len(t) + 1)
        ok = np.flatnonzero((right >= precision) & (np.append(np.diff(s[order]), -1) < 0))
        cut[k] = round(float(s[order][ok[-1]]) - 1e-6, 6) if len(ok) else 1e9
    return {"features": list(FEATURES), "trees": trees, "cut": cut}


if __name__ == "__main__":
    session = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
    Path(__file__).with_name("pii_trees.json").write_text(json.dumps(train(session)) + "\n")
