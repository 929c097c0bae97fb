"""Forms planted into whole documents by a generator of their own: other names, hosts, labels and look-alikes than the
trainer's. Several formats occur in both, and the operator was mended after looking at this set: it guards, and is not held out."""

import random

import pytest

from ledgerloom.llm import pii
from tests.llm.test_pii import brute

DOCS = "/root/testdata/sf0.01/documents.parquet"
NAMES = "Anna Bertram Chiara Dmitri Elif Farouk Greta Hugo Ines Jonas Keiko Liam Mara Nils Olga Pavel Quinn Rosa Sven Tara Ugo Vera Wim Xenia Yann Zoe".split()
HOSTS = "kiosk-nord.de weber-co.at nuvola.it posta.pl rivage.fr fjord.no tienda.es acme.co.uk lab.edu".split()
LABELS = {
    "email": ["Mail:", "please write to", "contact", "E-Mail", "reach her under the address"],
    "ip": ["the host", "IP", "ping", "login from", "server"],
    "card": ["card", "Visa", "paid by credit card", "Mastercard no.", "debit card"],
    "phone": ["phone", "Tel.", "call", "Fax:", "mobile", "telefon"],
}


def luhn(r):
    d = [4, *(r.randrange(10) for _ in range(14))]
    total = sum(x if i % 2 else x * 2 - 9 * (x > 4) for i, x in enumerate(d))
    return "".join(map(str, d)) + str(-total % 10)


def digits(r, n):
    return str(r.randrange(2, 10)) + "".join(str(r.randrange(10)) for _ in range(n - 1))


def form(r, kind):
    """(what stands in the text, the span within it)."""
    if kind == "email":
        user, host = f"{r.choice(NAMES)}{r.choice(['', '.', '_'])}{r.choice(NAMES)}", r.choice(HOSTS)
        at, dot = r.choice([("(at)", "(dot)"), (" (at) ", " (dot) "), ("[at]", "."), (" [AT] ", " [DOT] "), ("{at}", "{dot}"), (" (at) ", ".")])
        span = f"{user}{at}{host.replace('.', dot)}"
        return span, span
    if kind == "ip":
        parts = [str(r.randrange(1, 256)) for _ in range(4)]
        span = r.choice(["[.]".join(parts), f"{parts[0]}.{parts[1]}[.]{parts[2]}.{parts[3]}", f"{parts[0]}[.]{parts[1]}.{parts[2]}.{parts[3]}"])
        return span, span
    if kind == "card":
        n, cut = luhn(r), r.choice(["", " ", "-"])
        span = cut.join(n[i : i + 4] for i in range(0, 16, 4))
        return f"{r.choice(['2', '17', '3'])} {span}", span  # digits before it keep it from the base pattern
    span = r.choice([f"({digits(r, 3)}) {digits(r, 3)}-{digits(r, 4)}", f"{digits(r, 3)}-{digits(r, 3)}-{digits(r, 4)}", f"0{digits(r, 2)} {digits(r, 4)} {digits(r, 4)}", f"0{digits(r, 3)}/{digits(r, 3)} {digits(r, 3)}", f"0{digits(r, 1)} {digits(r, 2)} {digits(r, 2)} {digits(r, 2)} {digits(r, 2)}"])
    return span, span


def alike(r):
    return r.choice(
        [
            f"Rechnung {digits(r, 4)}-{digits(r, 4)}-{digits(r, 4)}", f"on {r.randrange(1, 29)}.{r.randrange(1, 13)}.{r.randrange(1950, 2030)}", f"{r.randrange(1950, 2030)}-0{r.randrange(1, 10)}-1{r.randrange(10)}",
            f"build {r.randrange(300, 999)}.{r.randrange(300, 999)}.{r.randrange(10)}.{r.randrange(10)}", f"ISBN 978-{digits(r, 1)}-{digits(r, 4)}-{digits(r, 4)}-{digits(r, 1)}", f"{digits(r, 3)} {digits(r, 3)} {digits(r, 3)} people", f"pages {digits(r, 3)}-{digits(r, 3)}",
            f"order {digits(r, 4)} {digits(r, 4)} {digits(r, 4)} {digits(r, 4)}", f"won {digits(r, 2)}-{digits(r, 2)}, {digits(r, 2)}-{digits(r, 2)}",
        ]
    )


@pytest.fixture(scope="module")
def found(spark):
    """By kind: planted spans found, planted spans, spans that the trees add in all."""
    r = random.Random(41)
    texts = [x.text for x in spark.read.parquet(DOCS).orderBy("doc_id").select("text").collect() if x.text and 20 < len(x.text.split()) < 400][:400]
    rows, want = [], {}
    for i, t in enumerate(texts):
        words, planted = t.split(" "), []
        for _ in range(4):
            kind = r.choice(pii.KINDS)
            shown, span = form(r, kind)
            planted.append((kind, span, f"{r.choice(LABELS[kind])} {shown}"))
        pieces = [p[2] for p in planted] + [alike(r) for _ in range(3)]
        r.shuffle(pieces)
        for piece in pieces:
            words.insert(r.randrange(len(words)), f"{piece} {r.choice(NAMES)}")
        text = " ".join(words)
        rows.append((i, text))
        want[i] = {(k, text.find(s), text.find(s) + len(s)) for k, s, _ in planted}
    out = {k: [0, 0, 0] for k in pii.KINDS}
    for x in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        base = brute(x.text)
        for k in pii.KINDS:
            added = {(s.start, s.end) for s in x.pii_spans[k]} - set(base[k])
            mine = {(a, b) for kind, a, b in want[x.doc_id] if kind == k} - set(base[k])
            out[k][0] += len(added & mine)
            out[k][1] += len(mine)
            out[k][2] += len(added)
    return out


@pytest.mark.parametrize("kind", pii.KINDS)
def test_planted_forms_are_found_and_little_else(found, kind):
    hit, planted, added = found[kind]
    print(kind, hit, planted, added)
    assert planted > 200 and hit >= 0.9 * planted and hit >= 0.9 * added
