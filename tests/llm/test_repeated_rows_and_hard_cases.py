import random
import time

import pytest

from ledgerloom.llm import html_text
from ledgerloom.llm.decontamination import leaks, without_leaks
from ledgerloom.llm.html_text import extract_pages, lcs, page_lines, settle
from ledgerloom.llm.jaccard_join import jaccard_components
from ledgerloom.llm.substring_dedup import FingerprintIndex, dedup_substrings


def changed(r, text, share):
    w = text.split()
    for at in r.sample(range(len(w)), max(1, int(len(w) * share))):
        w[at] = f"q{r.randrange(10**6)}"
    return " ".join(w)


def test_rows_of_one_doc_id_are_linked_one_by_one(spark):
    r = random.Random(1)
    x, y = (" ".join(f"{c}{r.randrange(10**5)}" for _ in range(100)) for c in "xy")
    rows = [(3, changed(r, y, 0.01)), (4, changed(r, x, 0.01)), (5, x), (5, y), (6, "alone"), (6, "alone"), (7, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((v.doc_id, v.component_id) for v in jaccard_components(docs, 4, 85).collect())
    assert got == [(3, 3), (4, 4), (5, 3), (5, 4), (6, 6), (6, 6), (7, 7), (7, 7)]


def test_large_groups_of_chains_and_strangers(spark):
    """Sets that share a passage but do not link, and chains of copies, in groups of many chunks."""
    r = random.Random(2)
    passage = [f"p{i}" for i in range(40)]
    rows = [passage + [f"w{r.randrange(10**6)}" for _ in range(r.choice([20, 30, 60]))] for _ in range(60)]
    chain = [f"c{i}" for i in range(80)]
    for i in range(30):
        chain = [*chain[:i], f"n{i}", *chain[i + 1 :]]
        rows.append(list(chain))
    r.shuffle(rows)
    from tests.llm.test_jaccard_join import brute

    rows = list(enumerate(" ".join(w) for w in rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(x) for x in jaccard_components(docs, 4, 85, block=4).collect()} == brute(rows, 4, 85)


def test_repeated_rows_are_cut_one_by_one(spark):
    text = " ".join(f"w{i}" for i in range(70))
    other = " ".join(f"v{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (5, text), (5, text), (5, other), (None, text), (9, None)], "doc_id long, text string").repartition(4)
    got = sorted((x.doc_id is None, x.doc_id or 0, x.n_words, x.n_removed) for x in dedup_substrings(docs).collect())
    assert got == [(False, 1, 70, 0), (False, 5, 60, 0), (False, 5, 70, 70), (False, 5, 70, 70), (False, 9, 0, 0), (True, 0, 70, 0)]


def test_another_process_goes_on_with_the_index(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    batch = lambda rows: spark.createDataFrame(rows, "mark long, doc_id long")
    one = FingerprintIndex(spark, path, most_runs=2, buckets=3)
    assert [x.mark for x in one.add(batch([(7, 1), (8, 1), (9, 2), (9, 3)])).collect()] == [9]
    two = FingerprintIndex(spark, path, most_runs=2)  # knows what the manifest says, and nothing else
    assert (two.buckets, two.runs) == (3, one.runs)
    assert [x.mark for x in two.add(batch([(8, 4), (5, 4)])).collect()] == [8]
    three = FingerprintIndex(spark, path, most_runs=2)
    joined = three.read(three.runs[0]).hint("merge").join(three.read(three.runs[1]).hint("merge"), "mark")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(x.mark for x in three.add(batch([(7, 6), (5, 6), (1, 6)])).collect()) == [5, 7]
    assert len(three.runs) == 1  # compacted
    assert {tuple(x) for x in three.read(three.runs[0]).collect()} == {(1, 6, 6), (5, 4, 6), (7, 1, 6), (8, 1, 4), (9, 2, 3)}
    three.remove_old()
    assert [x.mark for x in FingerprintIndex(spark, path).add(batch([(1, 9)])).collect()] == [1]


def test_recall_of_the_hamming_search(spark):
    """Of copies at a similarity of 0.8 or more, the share found by radius, against the exact answer."""
    r = random.Random(4)
    items = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(r.randrange(20, 60)))) for i in range(60)]
    docs = []
    for n in range(300):
        w = [f"x{r.randrange(10**6)}" for _ in range(40)]
        leak = items[n % 60][1].split()
        at = r.randrange(len(leak))
        leak = leak if n % 3 == 0 else [*leak[:at], f"z{n}", *leak[at + 1 :]] if n % 3 == 1 else leak[: len(leak) - max(1, len(leak) // 12)]
        docs.append((n, " ".join([*w[:20], *leak, *w[20:]])))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {radius: {(x.doc_id, x.item_id) for x in leaks(d, b, radius=radius).collect()} for radius in (64, 24)}
    assert len(found[64]) > 150 and found[24] <= found[64]
    assert len(found[24]) >= 0.98 * len(found[64])


def test_leaks_of_rows_without_an_id_and_of_one_id(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(None, f"a {item} b"), (None, "clean text"), (1, "clean"), (1, f"c {item}"), (1, f"c {item}"), (2, None)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted((x.doc_id is None, x.doc_id, x.item_id) for x in leaks(docs, bench).collect()) == [(False, 1, 7), (True, None, 7)]
    assert sorted((x.doc_id or 0, x.text or "") for x in without_leaks(docs, bench).collect()) == [(0, "clean text"), (1, "clean"), (2, "")]


def test_pages_of_many_tags_take_linear_time():
    for page in ("<div>" * 100_000 + "</span>" * 100_000, "<p title=\"" * 60_000, "<p title='x" * 60_000 + ">", "<!x" * 100_000, "<script>" * 50_000, "</script" * 50_000, "<b>" * 100_000 + "</b>" * 100_000):
        began = time.time()
        page_lines(page)
        assert time.time() - began < 10


def test_alignment_in_halves(monkeypatch):
    r = random.Random(6)
    cases = [([r.choice("abcdef") for _ in range(r.randrange(40))], [r.choice("abcdef") for _ in range(r.randrange(40))]) for _ in range(200)]
    want = [len(lcs(a, b)) for a, b in cases]
    monkeypatch.setattr(html_text, "MOST_BITS", 16)
    for (a, b), n in zip(cases, want, strict=True):
        got = lcs(a, b)
        assert len(got) == n and all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))


def test_edges_of_articles_that_both_neighbours_share_go():
    page = lambda n: [(0, "By the staff"), (0, f"Text {n} of some length"), (0, "Quoted"), (0, f"More {n} text"), (0, "Subscribe"), (1, "Site end")]
    shared, gone = settle(page(1), [page(0), page(2)])
    assert shared == {0, 2, 4, 5} and gone == {0, 4, 5}
    assert settle(page(1), [page(0)])[1] == {5}  # one neighbour decides only beside the article
    assert settle(page(1), [page(1)[:-1], page(2)])[1] == {5}  # a copy of the article decides nothing within it


@pytest.mark.parametrize("parts", ["1", "7", "40"])
def test_pages_of_one_host_lose_shared_lines_at_any_partition_count(spark, parts):
    rows = [(i, f"http://a/{i:03}", f"<p>Top</p><p>Own {i}</p><p>End</p>") for i in range(40)] + [(90, "http://a/090", "<p>Top</p><p>Own</p>")] * 2
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {x.text for x in got} == {*(f"Own {i}" for i in range(40)), "Own"} and len(got) == 42
    assert all(x.n_deleted == x.n_shared > 0 for x in got)
