import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import token_files, warc
from ledgerloom.llm.html_text import extract_pages, lcs, page_lines


def test_code_is_a_shortest_prefix_code_within_its_limit():
    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89])
    for most in (4, 5, 18):
        lengths = token_files.code_lengths(counts, most)
        used = lengths[lengths > 0].astype(int)
        assert len(used) == 11 and used.max() <= most and sum(2.0**-n for n in used) <= 1
    import heapq

    heap, total = counts[counts > 0].tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    assert int((counts * token_files.code_lengths(counts)).sum()) == total


def test_bits_round_trip():
    r = np.random.default_rng(1)
    for symbols in (1, 2, 300, 50_000):
        sizes = np.array([1, 5, 1024, 1025, 3000, 1])
        ids = np.minimum(r.zipf(1.3, int(sizes.sum())) - 1, symbols - 1).astype(np.int64)
        lengths = token_files.code_lengths(np.bincount(ids, minlength=symbols))
        data, taken, within = token_files.encode_bits(ids, sizes, token_files.canonical(lengths), lengths)
        first, starts, lanes = 0, [], []
        for n, at in zip(sizes, np.concatenate(([0], np.cumsum(taken)[:-1])), strict=True):
            for i in range(0, n, token_files.STEP):
                starts.append(at * 8 + within[first + i]), lanes.append(min(token_files.STEP, n - i))
            first += n
        got = token_files.decode_bits(np.frombuffer(data, np.uint8), np.array(starts), np.array(lanes), token_files.decode_table(lengths))
        assert (got == ids).all()


def test_token_files(spark):
    texts = [None, "", " ", "  ", "a  b", "a\n b", "a \nb", "it's  <|endoftext|> x", "É 𝄞 ﷺ  x", "x " * 3000, "y" * 3000, "a.\nB c\n\nd", "\n", " lead", "trail ", "tab\t x", "same", "same"]
    r = random.Random(2)
    texts += ["".join(r.choice(["ab", "c", " ", "\n", "9", ".", "'s", "ñ"]) for _ in range(r.randrange(200))) for _ in range(80)]
    rows = [(3 * i + 7, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1)).repartition(5)
    tok, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    files = token_files.write_tokens(docs, block_ids=2000)
    got = {x.doc_id: x for x in token_files.read_tokens(files, with_ids=True).collect()}
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        x = got[i]
        assert x.ids == ids and (x.start, x.n_tokens, x.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)
    assert len(got) == len(rows)
    assert token_files.read_tokens(token_files.write_tokens(docs.where("false"))).count() == 0
    twice = spark.createDataFrame([(None, "b"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted(x.start for x in token_files.read_tokens(token_files.write_tokens(twice)).collect()) == [0, 2, 4]


def test_warc(spark):
    import hashlib

    big, other = "é<p>" * 400, "z" * 1000
    rows = [(1, "http://a/x", big), (5, None, big), (3, "http://a/%0Ay\n", big), (2, "u", "small"), (4, "u", "small"), (6, "v", None), (7, "w", other), (8, "w", "z" * 999), (9, "w", other + "\r\n\r\n"), (5, "again", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    index = warc.write_archives(pages)
    got = warc.read_records(index).collect()
    want = []
    for i, u, h in rows:
        raw = (h or "").encode()
        to = max(j for j, _, g in rows if g == h) if len(raw) >= 1000 else i
        kind = "response" if to == i else "revisit"
        want.append((i, u, len(raw), hashlib.sha1(raw).hexdigest(), kind, None if to == i else to, raw if to == i else None))
    assert sorted(map(str, ((*x[:6], None if x[6] is None else bytes(x[6])) for x in got))) == sorted(map(str, want))
    assert [x.page_id for x in warc.read_records(index, F.col("page_id") == 7, gap=0).collect()] == [7]
    assert warc.read_records(warc.write_archives(pages.where("false"))).count() == 0
    spans = {}
    for x in index.collect():
        spans.setdefault(x.archive, []).append((x.offset, x.length))
    assert all(o == sum(n for _, n in sorted(s)[:i]) for s in spans.values() for i, (o, _) in enumerate(sorted(s)))


def test_lcs_against_dynamic_programming():
    r = random.Random(4)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = lcs(a, b)
        assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header><p>Site</p></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy</div>
<div id="cookie-notice"><p>We use cookies</p></div><article><h1>Head&nbsp;line</h1><p><b>One  &amp;&lt;p&gt; two<br>three
<p data-x="a>b">Four<aside>Side</aside><form><input><p>Form</p></form><div class="comments"><p>First!</p></div></p></article>
<footer>&copy; me</footer></body></html>"""


def test_pages(spark):
    two = "<body><div><p>Shared top</p><p>{}</p><p>More {}</p><p>Shared end</p></div>"
    rows = [(1, "http://a/1", PAGE), (2, "http://b/x/1", two.format("A", 1)), (3, "https://b/x/2?q", two.format("B", 2)), (4, "http://c/", two.format("A", 1)), (5, None, None), (6, "http://[bad", ""), (7, "http://d/1", two.format("Z", 1)), (8, "http://d/2", two.format("Z", 1)), (9, "http://a/1", PAGE), (10, "http://e", "no tags < at all & <b>bold</b>"), (11, "http://f", "<article><p>cut off<p title='open")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lines", F.lit("clash")).coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {x.page_id: x for x in extract_pages(pages).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    whole = lambda a, n: f"Shared top\n{a}\nMore {n}\nShared end"
    want = {1: "Head line\nOne &<p> two three\nFour", 2: "A\nMore 1", 3: "B\nMore 2", 4: whole("A", 1), 5: "", 6: "", 7: whole("Z", 1), 8: whole("Z", 1), 9: "Head line\nOne &<p> two three\nFour", 10: "no tags < at all & bold"}
    for i, t in want.items():
        assert got[i].text == t and got[i].n_chars == len(t), i
    assert len(got) == len(rows) and got[11].text.startswith("cut off")
    assert extract_pages(pages.where("false")).count() == 0


def test_lines_beside_an_article_are_differenced(spark):
    page = "<body><div><p>Site line</p></div><div><p>Body {0}</p></div><article><p>Teaser {0}</p><p>Quoted alike</p></article><div><p>Site end</p></div>"
    rows = [(i, f"http://a/{i}", page.format(i)) for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {x.page_id: x.text for x in extract_pages(pages).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {i: f"Body {i}\nTeaser {i}\nQuoted alike" for i in range(2)}


def test_pages_meet_their_nearest_differing_neighbours_at_any_partition_count(spark):
    r, rows = random.Random(3), []
    for n in range(60):
        host, body = r.choice(["a", "a", "a", "b", "c"]), [r.choice(["Top", "Mid", "End", f"Own {n}"]) for _ in range(4)]
        for copy in range(r.choice([1, 1, 2, 3, 9])):
            rows.append((f"http://{host}/{n:03}/{copy}", body))
    rows += [("http://z/1", ["Only", "Top"]), ("http://b/000/x", ["Top", "Z"])]
    rows.sort()
    want = []
    for i, (url, body) in enumerate(rows):
        shared, host = set(), url.split("/")[2]
        for side in (reversed(rows[:i]), rows[i + 1 :]):
            there, near = next(((u.split("/")[2], b) for u, b in side if u.split("/")[2] != host or b != body), (None, None))
            if there == host:
                shared |= {p for p, _ in lcs(body, near)}
        own = [x for p, x in enumerate(body) if p not in shared]
        want.append((i, "\n".join(own or body)))
    pages = spark.createDataFrame([(i, u, "".join(f"<p>{x}</p>" for x in b)) for i, (u, b) in enumerate(rows)], "page_id long, url string, html string").repartition(3)
    try:
        for parts in ("1", "3", "17", "90"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert sorted((x.page_id, x.text) for x in extract_pages(pages).collect()) == want, parts
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_long_and_odd_pages_are_parsed_in_linear_time():
    import time

    began = time.time()
    for page in ("<" * 200_000, "<div>" * 100_000, "<p title=\"" * 30_000, "<!--" * 100_000, "</div>" * 100_000, "&amp;" * 200_000, "<a b='" + "x" * 500_000):
        page_lines(page)
    assert time.time() - began < 60
