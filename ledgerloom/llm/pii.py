"""Personal data: candidate spans, scored by boosted trees; DataFrame functions only.

Four base patterns give spans that always stay. High-recall generators propose more, overlapping spans; each is
described by its format and by the words beside it, scored by boosted trees (``pii_trees.json``, trained by
``pii_training.py`` on generated examples), and kept above its kind's calibrated threshold. Everything is an
expression over a text's own row: no shuffle. Patterns are written so that a search is linear in the text: possessive
runs, starting at the beginning of a run or at the end of the last match.
"""

from __future__ import annotations

import json
from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

#: The base patterns of the contract, and what a text must hold for a search to be worth its while.
BASE = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
#: Generators of further candidates, by kind, with a test that the text must pass.
MORE = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|[(\[{]\x20?(?:at|AT)\x20?[)\]}])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[{]\x20?(?:dot|DOT)\x20?[)\]}])\x20?[A-Za-z0-9-]++){1,6}", r"@|[(\[{]\x20?(?:at|AT)\x20?[)\]}]"),
    "ip": (r"(?<![0-9A-Za-z])[0-9]{1,3}+(?:\[?\.\]?[0-9]{1,3}+){3}", r"[0-9]\[?\.\]?[0-9]"),
    "card": (r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{1,7}", r"[0-9]{4}[\x20-]?[0-9]{4}"),
    "phone": (r"(?<![0-9A-Za-z+.-])(?:00[0-9]{1,3}[\x20.-])?\(?[0-9]{2,4}\)?(?:[\x20./-]\(?[0-9]{2,4}\)?){2,4}", r"[0-9][)\x20./-]"),
}
#: Words that speak for or against a kind when they stand beside a span.
FOR = {
    "email": r"(?i)mail|contact|write|reach|address|kontakt|correo|courriel",
    "ip": r"(?i)\bip\b|\b(?:host|server|address|ping|login|client|adresse)",
    "card": r"(?i)card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|payment",
    "phone": r"(?i)\b(?:telephone|phone|tel\b|call|mobile|fax|cell|telefon|tél|teléfono|whatsapp|ring\b)",
}
AGAINST = r"(?i)order|invoice|version|isbn|issn|serial|item|sku|ticket|page|chapter|release|part no|account|ref|id\b|#|\$|€"
CONTEXT = 32


def _before(lengths: Column, block: int = 256) -> Column:
    """The sum of the values before each, in two levels, so that long arrays aren't built value by value."""
    n = F.size(lengths)
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: F.slice(lengths, b * block + 1, F.lit(block)))).otherwise(F.array().cast("array<array<int>>"))
    none = F.array().cast("array<int>")
    fold = lambda xs: F.aggregate(xs, F.struct(F.lit(0).alias("t"), none.alias("p")), lambda s, x: F.struct((s["t"] + x).alias("t"), F.array_append(s["p"], s["t"]).alias("p")))
    zero = F.struct(F.lit(0).alias("t"), F.array().cast("array<array<int>>").alias("p"))
    sums = F.aggregate(F.transform(blocks, fold), zero, lambda s, x: F.struct((s["t"] + x["t"]).alias("t"), F.array_append(s["p"], F.transform(x["p"], lambda v: v + s["t"])).alias("p")))
    return F.flatten(sums["p"])


def find_spans(rows: DataFrame, text: str, patterns: dict[str, tuple[str, Column]], beside: frozenset[str] = frozenset()) -> DataFrame:
    """``rows`` with one column for each name: array<struct<start, end, s>> of the leftmost matches that don't overlap.

    Offsets are code points. A pattern is searched where its condition holds. Those of ``beside`` have two more fields:
    what stands before a match, back to the match before it (``CONTEXT`` code points), and the two that follow. Steps
    are columns of their own, each referred to more than once, so that none is computed anew for each element.
    """
    none = F.array().cast("array<string>")
    t = F.col(text)
    rows = rows.withColumns({f"{k}_m": F.when(c, F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none) for k, (p, c) in patterns.items()})
    rows = rows.withColumns({f"{k}_s": F.when(F.size(f"{k}_m") > 0, F.split(t, p)).otherwise(F.slice(f"{k}_m", 1, 0)) for k, (p, _) in patterns.items()})
    rows = rows.withColumns({f"{k}_g": F.slice(f"{k}_s", 1, F.size(f"{k}_m")) for k in patterns} | {f"{k}_n": F.slice(f"{k}_s", 2, F.size(f"{k}_m")) for k in beside})
    rows = rows.withColumns({f"{k}_l": F.zip_with(f"{k}_g", f"{k}_m", lambda g, m: F.length(g) + F.length(m)) for k in patterns})
    rows = rows.withColumns({f"{k}_b": F.when(F.size(f"{k}_l") > 0, _before(F.col(f"{k}_l"))).otherwise(F.slice(f"{k}_l", 1, 0)) for k in patterns})

    def spans(k):
        def one(z, i):
            start = z[f"{k}_b"] + F.length(z[f"{k}_g"])
            fields = [start.alias("start"), (start + F.length(z[f"{k}_m"])).alias("end"), z[f"{k}_m"].alias("s")]
            if k in beside:
                last, next_ = (F.coalesce(F.get(f"{k}_m", j), F.lit("")) for j in (i - 1, i + 1))
                fields += [F.substring(F.concat(last, z[f"{k}_g"]), -CONTEXT, CONTEXT).alias("left"), F.substring(F.concat(z[f"{k}_n"], next_), 1, 2).alias("right")]
            return F.struct(*fields)

        return F.transform(F.arrays_zip(f"{k}_b", f"{k}_g", f"{k}_m", *([f"{k}_n"] if k in beside else [])), one)

    rows = rows.withColumns({k: spans(k) for k in patterns})
    return rows.drop(*(f"{k}_{x}" for k in patterns for x in "msglbn"))


def clear_of(base: str, more: str) -> Column:
    """The spans of ``more`` that overlap none of ``base``; neither overlaps itself. In order of start, the place of a
    span in both less its place in ``more`` is the number of base spans that start no later, which gives its neighbours."""
    fields = ("start", "kind", "end", "s", "left", "right")
    tag = lambda spans, kind, of: F.transform(spans, lambda x: F.struct(*((F.lit(kind) if f == "kind" else x[f] if f in of else F.lit("")).alias(f) for f in fields)))
    both = F.sort_array(F.concat(tag(base, 0, ("start", "end", "s")), tag(more, 1, fields)))
    placed = F.filter(F.transform(both, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: y["x"]["kind"] == 1)
    at = F.transform(placed, lambda y, j: F.struct(y["x"].alias("x"), (y["i"] - j).alias("n")))
    hit = lambda z: F.coalesce(F.get(base, z["n"] - 1)["end"] > z["x"]["start"], F.lit(False)) | F.coalesce(F.get(base, z["n"])["start"] < z["x"]["end"], F.lit(False))
    return F.transform(F.filter(at, lambda z: ~hit(z)), lambda z: z["x"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _ip_ok(s: Column) -> Column:
    return F.forall(F.split(s, r"[^0-9]+"), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("decimal(38,0)") <= 255, F.lit(False)))


def _base_ok(kind: str, s: Column) -> Column:
    digits = F.length(_digits(s))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: _ip_ok(s),
        "card": lambda: digits.between(13, 19) & F.call_function("luhn_check", _digits(s)),
        "phone": lambda: digits.between(9, 15),
    }[kind]()


FEATURES = ("kind", "n_digits", "n_chars", "n_groups", "luhn", "octets", "for_before", "against_before", "glued_before", "glued_after", "distinct", "dotted", "obfuscated", "longest")


def features(kind: int, s: Column, left: Column, right: Column) -> list[Column]:
    """Numbers on a candidate's format and context, in the order of FEATURES; null counts as 0."""
    name = KINDS[kind]
    digits = _digits(s)
    parts = F.filter(F.split(s, r"[^0-9A-Za-z]+"), lambda x: x != "")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    plain = [
        F.lit(float(kind)),
        F.length(digits),
        F.length(s),
        F.size(parts),
        flag(F.call_function("luhn_check", digits) & (F.length(digits) > 11)),
        flag(_ip_ok(s) & (F.size(parts) == 4)),
        flag(left.rlike(FOR[name])),
        flag(left.rlike(AGAINST)),
        flag(left.rlike(r"[0-9A-Za-z][-.:/]?$")),
        flag(right.rlike(r"^[-.:/]?[0-9A-Za-z]")),
        F.size(F.array_distinct(F.split(digits, ""))),
        flag(s.contains(".")),
        flag(s.rlike(r"[(\[{]\x20?(?:at|AT|\.)|\[\.\]")),
        F.array_max(F.transform(parts, F.length)),
    ]
    return [F.coalesce(c.cast("double"), F.lit(0.0)) for c in plain]


def model() -> dict:
    return json.loads(files("ledgerloom.llm").joinpath("pii_trees.json").read_text())


def score(x: Column, trees: list) -> Column:
    """The sum of the trees' leaves; a tree is [feature, cut, left, right], left being at most the cut, or a number."""

    def value(node):
        if not isinstance(node, list):
            return F.lit(float(node))
        f, cut, low, high = node
        return F.when(x[f] <= cut, value(low)).otherwise(value(high))

    total = F.lit(0.0)
    for tree in trees:
        total = total + value(tree)
    return total


def find_pii(docs: DataFrame, trained: dict | None = None) -> DataFrame:
    """``docs`` with ``pii_base`` and ``pii_spans``: struct of KINDS, each array<struct<start, end, s>> in order of start.

    ``docs``: any columns with ``text``, but none that begins with ``pii_``. Null and empty texts have no spans.
    pii_spans holds all base spans and those candidates that the model selects and no base span of any kind overlaps, nor
    one selected as an earlier kind.
    Repeated rows are found alike, rows are never joined, and an empty table gives an empty result.
    """
    trained = trained or model()
    rows = docs.withColumn("pii_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = rows.withColumn("pii_num", F.col("pii_text").rlike("[0-9]"))
    t, num = F.col("pii_text"), F.col("pii_num")
    asked = {f"pii_{k}": (p, num if guard is None else (num & t.contains(guard)) if k != "email" else t.contains(guard)) for k, (p, guard) in BASE.items()}
    asked |= {f"pii_x{k}": (p, (num if k != "email" else F.lit(True)) & t.rlike(test)) for k, (p, test) in MORE.items()}
    rows = find_spans(rows, "pii_text", asked, frozenset(f"pii_x{k}" for k in KINDS))
    passing = lambda k: F.filter(f"pii_{k}", lambda x: _base_ok(k, x["s"]))
    rows = rows.withColumns({f"pii_{k}": passing(k) for k in KINDS})
    for base_kind in KINDS:  # what is a base span of any kind is settled, and no candidate of another
        rows = rows.withColumns({f"pii_x{k}": F.when(F.size(f"pii_x{k}") > 0, clear_of(f"pii_{base_kind}", f"pii_x{k}")) for k in KINDS})

    def chosen_of(i, k):
        def chosen(x):
            described = F.array(F.array(*features(i, x["s"], x["left"], x["right"])))  # bound to a name by the lambda, so computed once
            return F.exists(described, lambda f: score(f, trained["trees"]) >= trained["cut"][k])

        kept = F.transform(F.filter(f"pii_x{k}", chosen), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s")))
        return F.coalesce(kept, F.slice(f"pii_{k}", 1, 0))

    for i, k in enumerate(KINDS):  # what is selected as an earlier kind is no candidate of a later one
        rows = rows.withColumn(f"pii_x{k}", chosen_of(i, k))
        rows = rows.withColumns({f"pii_x{later}": F.when(F.size(f"pii_x{later}") > 0, clear_of(f"pii_x{k}", f"pii_x{later}")) for later in KINDS[i + 1 :]})
    base = F.struct(*(F.col(f"pii_{k}").alias(k) for k in KINDS)).alias("pii_base")
    every = F.struct(*(F.sort_array(F.concat(f"pii_{k}", f"pii_x{k}")).alias(k) for k in KINDS)).alias("pii_spans")
    return rows.select(*docs.columns, base, every)


def listed(spans: str) -> Column:
    """kind:start:end of all spans, by kind and then start, joined by commas."""
    one = lambda k: F.transform(F.col(f"{spans}.{k}"), lambda x: F.concat_ws(":", F.lit(k), x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(F.concat(*map(one, KINDS)), ",")


def redact(docs: DataFrame, mark: str = "[{}]") -> DataFrame:
    """``docs`` with the spans of each text replaced by their kind; overlapping spans become one, of the first's kind."""
    found = find_pii(docs.withColumn("text", F.col("text")))
    tagged = lambda k: F.transform(F.col(f"pii_spans.{k}"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(k).alias("kind")))
    spans = F.sort_array(F.concat(*map(tagged, KINDS)))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, x: F.when(x["start"] < s["at"], F.struct(s["out"].alias("out"), F.greatest(s["at"], x["end"]).alias("at"))).otherwise(
        F.struct(F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), F.format_string(mark.replace("{}", "%s"), x["kind"])).alias("out"), x["end"].alias("at"))
    )
    text = F.aggregate(spans, zero, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    return found.withColumn("text", F.when(F.col("text").isNotNull(), text)).select(*docs.columns)
