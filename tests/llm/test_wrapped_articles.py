import time

import pytest

from ledgerloom.llm.html_text import extract_pages, main_text, page_lines, settle

LONG = "Words of a paragraph that go on for quite a while, as those of an article do. " * 4
FURNITURE = "<nav>Menu</nav>{}<footer>Foot</footer>"


def text(page):
    return main_text(page_lines(page), set())


@pytest.mark.parametrize(
    "wrap",
    [
        '<form id="aspnetForm"><input>{}</form>',
        '<div class="layout has-sidebar">{}</div>',
        '<div class="content side">{}</div>',
        '<div class="sidebar"><section id="related">{}</section></div>',
        "<aside>{}</aside>",
        '<div role="search"><form>{}</form></div>',
        '<header class="banner">{}</header>',
        '<div class="page-comments-on">{}</div>',
    ],
)
def test_what_is_around_an_article_does_not_decide_over_it(wrap):
    article = "<article><h1>Head</h1><p>One</p><p>Two</p></article>"
    assert text(FURNITURE.format(wrap.format(article))) == "Head\nOne\nTwo"
    assert text(FURNITURE.format("<main><p>Real</p></main>" + wrap.format(article))) == "Real"
    assert text(FURNITURE.format(wrap.format(f"<nav>More</nav>{article}<p>Beside</p>"))) in ("Head\nOne\nTwo", "Head\nOne\nTwo\nBeside")


def test_hints_within_an_article_count_by_what_they_hold():
    page = "<article><p>One</p>{}<p>Two</p></article>"
    long = LONG.strip()
    for name in ("related-work", "share-quote", "notice-of-death"):
        assert text(page.format(f'<section id="{name}"><p>{LONG}</p></section>')) == f"One\n{long}\nTwo"
        assert text(page.format(f'<section id="{name}"><p>Short</p></section>')) == "One\nTwo"
        assert text(page.format(f'<section id="{name}"><a href="x">{LONG}</a></section>')) == "One\nTwo"
    for name in ("related", "ad", "cookie-banner", "comments", "article-comments", "widget"):
        assert text(page.format(f'<div class="x {name}"><p>{LONG}</p><article>Reply</article></div>')) == "One\nTwo"
    assert text(page.format('<div class="share-quote"><div class="x ad">' + LONG + "</div>" + LONG + "</div>")) == f"One\n{long}\nTwo"
    assert text(page.format("<aside>" + LONG + "</aside><header><h2>Part</h2></header>")) == "One\nPart\nTwo"


def test_forms_by_their_text_and_controls():
    body = "".join(f"<p>{LONG}{i}</p>" for i in range(3))
    assert text(FURNITURE.format(f'<form><input type="hidden">{body}<nav>x</nav></form>')).count("\n") == 2
    assert text("<p>Body</p><form>" + "".join(f"<label>A label of a field {i}</label><input>" for i in range(30)) + "</form>") == "Body"
    assert text("<p>Body</p><form>Search <input><button>Go</button></form>") == "Body"


def test_unclosed_and_crossed_elements():
    assert text('<div class="layout has-sidebar"><article><p>One<p>Two') == "One\nTwo"
    assert text('<article><p>One</p><div class="ad">Buy</article><p>After</p>') == "One\nAfter"
    assert text("<article><p>One</p></article></form></div><form><p>F</form><p>Beside</p>") == "One\nBeside"
    began = time.time()
    for page in ('<div class="share-x">' * 60_000 + "<p>x" * 60_000, '<div class="ad"><article>' * 50_000 + "x", "<form><a>" * 60_000, "<a>x" * 100_000):
        page_lines(page)
    assert time.time() - began < 30


def test_lines_of_articles_stay_and_mirrors_delete_nothing():
    page = lambda *own: [(1, "Top"), *((0, x) for x in own), (1, "End")]
    near = [page("Alike", x * 50, "Alike too") for x in "ac"]
    assert settle(page("Alike", "b" * 50, "Alike too"), near, inside=False)[1] == {0, 4}
    assert settle(page("Alike", "b" * 50, "Alike too"), near)[1] == {0, 1, 3, 4}
    plain = [(1, x) for x in ("Top", LONG, LONG + "2", "5 May")]
    assert settle(plain, [[*plain[:3], (1, "6 May")]])[1] == set()
    assert settle(plain, [[plain[0], (1, "Other"), (1, "6 May")]])[1] == {0}


@pytest.mark.parametrize("parts", ["1", "8", "200"])
def test_pages_with_and_without_articles_at_any_partition_count(spark, parts):
    body = '<div class="layout has-sidebar"><p>Site</p><{0}><p>Same</p><p>Own {1}</p><p>Same end</p></{0}><p>Imprint</p></div>'
    rows = [(i, f"http://h/{i:03}", body.format("article" if i % 2 else "div", i)) for i in range(30)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {i: f"Same\nOwn {i}\nSame end" if i % 2 else f"Own {i}" for i in range(30)}
