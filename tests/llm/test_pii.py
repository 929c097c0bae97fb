import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import pii, pii_training
from ledgerloom.llm.queries import op5_digest

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = {}
    for k, p in PATTERNS.items():
        out[k] = []
        for m in re.finditer(p, text or "", re.A):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if k == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]
            if ok:
                out[k].append((m.start(), m.end()))
    return out


def texts():
    r = random.Random(9)
    bits = ["a@b.co", "x.y+z%1@d-e.f.g", "@", "a@b", "@@", ".", "..", "-", " ", "1", "23", "456", "1.2.3.4", "255.256.0.1", "0000255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (743) 555-3824", "+", "+12", "(", ")", "é", "𝄞", "\n", "token", "4012888888881881"]
    made = ["".join(r.choice(bits) for _ in range(r.randrange(12))) for _ in range(300)]
    return [None, "", *made, "a@b.c" * 5, "a@b.c_x@d.e@f.g", "1.2.3.4.5.6.7.8", "x " * 3000 + "a@b.cc", "1 " * 700 + "9.9.9.9 " * 700]


def test_base_spans_against_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = {r.doc_id: r for r in op5_digest(docs).collect()}
    for i, t in rows:
        want = brute(t)
        base = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in want[k])
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [len(want[k]) for k in pii.KINDS], t
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), t
        assert set(filter(None, base.split(","))) <= set(got[i].spans.split(","))
    assert op5_digest(docs.where("false")).count() == 0


def test_hard_texts_take_linear_time(spark):
    import time

    docs = spark.createDataFrame([(1, "a" * 400_000), (2, "1" * 400_000), (3, "a@" + "b." * 100_000 + "c"), (4, "+1" + " " * 300_000), (5, "1." * 200_000), (6, "a.b-" * 100_000 + "@")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in op5_digest(docs).collect()}
    assert time.time() - began < 90 and got[3].n_email == 1 and got[1].spans == ""


def test_model_on_held_out_examples(spark):
    trained = pii.model()
    x, y = pii_training.dataset(spark, 77, 1500)
    at = pii_training.predict(trained["trees"], x)
    chosen = at >= np.array([trained["cut"][pii.KINDS[int(k)]] for k in x[:, 0]])
    assert y[chosen].mean() > 0.97 and chosen[y == 1].mean() > 0.5


def test_added_spans_and_redaction(spark):
    rows = [(1, "please call (415) 555-0133 now"), (2, "mail me at jane [at] site [dot] org today"), (3, "visa 12 4012888888881881 x"), (4, "on 2021-03-04 and 1999/10/12 the version 10.2.3"), (5, "a@b.co and +1 (743) 555-3824, ok"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in op5_digest(docs).collect()}
    assert got[1] == "phone:12:26" and got[2].startswith("email:") and got[4] == "" and got[6] == ""
    out = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert out[5] == "[email] and [phone], ok" and out[1] == "please call [phone] now" and out[6] is None and out[4] == rows[3][1]
