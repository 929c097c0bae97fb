"""Main text of web pages by differencing against the pages of nearest URL.

Pages are parsed to text lines (one a block element), each marked: within an article or main element, within a menu,
footer, advert or the like, or neither. Pages are ordered by (host, URL path); each is aligned, all its lines, with its
neighbours of the same host by longest common subsequence: lines beside the article are deleted where a neighbour on
either side shares them, unless nearly all of both pages is shared, as of mirrors. Lines within an article that two
pages share are its text and stay; ``inside`` deletes those too that both neighbours share in one run from the head or
the end of the article (a byline, a call to subscribe), unless a neighbour's article is a copy of this one.

Lines within menus, footers and the like go by their markup, though no neighbour may share them. What an element's class
or id says never decides over an article within it, and words that only hint (share-quote, has-sidebar) count where the
element's text is short or mostly links. A form goes unless it holds much text for its controls.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from functools import partial
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize, range_parts

MAIN, PLAIN, ASIDE = 0, 1, 2

#: Elements that end a line, elements whose content is no article text, words of class or id that say so.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noframes ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Of these the first can only be furniture; the others are left out unless an article opens within.
DROPPED = frozenset("nav footer menu head select button template noscript iframe object svg canvas".split())
BESIDE = frozenset("aside header dialog".split())
RAW = frozenset("script style textarea xmp noembed noframes title".split())
CONTROLS = frozenset("input select textarea button".split())
#: Words of class or id that say so wherever they stand, and those that say so alone and hint within a longer name.
FIRM = r"ads?|advert\w*|adslot|sponsor\w*|cookies?|consent|gdpr|popup|modal|overlay|nav\w*|menu\w*|breadcrumbs?|footer\w*|masthead|comments?|commentlist|discussion|replies|respond|disqus\w*|newsletter|login|signup|pagination|pager"
HINTS = r"promo\w*|banner\w*|notice\w*|alert|sidebar\w*|side|widgets?|header|toolbar|related|recommend\w*|share|sharing|social|subscribe|search"
SIGNS = re.compile(rf"(?:^|[\s_-])(?:{FIRM})(?:$|[\s_-])|(?:^|\s)(?:{HINTS})(?:$|\s)", re.I)
HINTED = re.compile(rf"(?:^|[\s_-])(?:{HINTS})(?:$|[\s_-])", re.I)
#: A hinted element is text from so many characters on, if under half of them are links'; a form, from so many a control.
PROSE, FORM_PROSE, A_CONTROL = 200, 500, 100
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HELD = frozenset("div section ul ol table span a".split())  # elements kept on the stack though they say nothing, so that ends match
#: A tag's parts; each alternative runs forward only. Where attributes are cut off by an open quote, the first '>' ends the tag.
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
ATTRS = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""", re.S)
COMMENT_END = re.compile(r"--!?>")
ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())


ARTICLE, GONE, BOX, HINT, FORM = "article", "gone", "box", "hint", "form"


def _says(tag: str, attrs: str) -> str | None:
    """What an element's start says of its content: ARTICLE, GONE (for good), BOX, HINT or FORM; None: nothing."""
    if tag in DROPPED:
        return GONE
    hint = FORM if tag == "form" else None
    if tag in BESIDE:
        return BOX
    for name, *values in ATTR.findall(attrs):
        value = "".join(values)
        if name.lower() == "role":
            if value.lower() in ROLES:
                return BOX
            if value.lower() in ("main", "article"):
                return ARTICLE
        elif tag not in ("html", "body", "article", "main"):
            if SIGNS.search(value):
                return BOX
            if HINTED.search(value):
                hint = hint or HINT
    return ARTICLE if tag in ("article", "main") else hint


class _Tags:
    """(start, end, name, is an end tag, attributes) of a page's tags and comments, name '' for those without.

    What a search from one place did not find is not there from any later place either, and is not looked for again.
    """

    def __init__(self, text: str):
        self.text, self.bare, self.dash, self.quotes, self.raw = text, True, True, True, {}

    def next(self, at: int):
        text = self.text
        while (start := text.find("<", at)) >= 0:
            at = start + 1
            if text.startswith("<!--", start):
                end = COMMENT_END.search(text, start + 4) if self.dash else None
                self.dash = end is not None
                return start, end.end() if end else len(text), "", False, ""
            if m := NAME.match(text, start):
                body = ATTRS.match(text, m.end()) if self.quotes else None
                if body:
                    return start, body.end(), m[2].lower(), bool(m[1]), text[m.end() : body.end() - 1]
                # a quote that nothing closes, or no '>': neither comes later, so the first '>' ends this and all later tags
                self.quotes = False
                end = text.find(">", m.end()) if self.bare else -1
                self.bare = end >= 0
                if end >= 0:
                    return start, end + 1, m[2].lower(), bool(m[1]), text[m.end() : end]
            elif text[start + 1 : start + 2] in ("!", "?", "/") and self.bare:
                end = text.find(">", start + 2)
                self.bare = end >= 0
                if end >= 0:
                    return start, end + 1, "", False, ""
        return None

    def raw_end(self, tag: str, at: int) -> int:
        """Where the content of a raw element that begins at ``at`` and its end tag are over."""
        if self.raw.get(tag, at) is None:
            return len(self.text)
        m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(self.text, at)
        self.raw[tag] = m and at
        return m.end() if m else len(self.text)


class _Box:
    """A marked element within others: the characters of its text and of its links, and its controls."""

    __slots__ = ("outer", "says", "chars", "links", "controls", "stays")

    def __init__(self, outer: "_Box | None", says: str):
        self.outer, self.says, self.chars, self.links, self.controls, self.stays = outer, says, 0, 0, 0, None

    def close(self) -> None:
        """Once its end is known; what it holds counts for those around it."""
        prose = 2 * self.links < self.chars
        if self.says == FORM:
            self.stays = prose and self.chars >= max(FORM_PROSE, A_CONTROL * self.controls)
        else:
            self.stays = self.says == HINT and prose and self.chars >= PROSE
        if self.outer:
            self.outer.chars += self.chars
            self.outer.links += self.links
            self.outer.controls += self.controls


def _within(box: _Box | None, known: dict) -> bool:
    """Whether a box and all around it stay; each is asked once."""
    path = []
    while box is not None and box not in known:
        path.append(box)
        box = box.outer
    stays = True if box is None else known[box]
    for b in reversed(path):
        stays = known[b] = stays and b.stays
    return stays


def page_lines(text: str) -> list[tuple[int, str]]:
    """(MAIN, PLAIN or ASIDE; text) of the lines of a page.

    An article within a marked element counts if the page has none outside of such. Time is linear in the text: no
    search starts again over what an earlier one has passed, open elements are counted, and a box is measured once.
    """
    # where a line stands: within something gone for good, within an article, the boxes around it and those around its article
    gone, article, box, around = False, False, None, None
    out, parts, stack, held, at, tags, anchors = [], [], [], {}, 0, _Tags(text), 0

    def flush():
        line = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if line:
            out.append((gone, article, box, around, line))
            if box is not None and not gone:
                box.chars += len(line)

    def take(part: str):
        parts.append(part)
        if anchors and box is not None:
            box.links += len(part.strip())

    def leave():
        """Back to where the top of the stack was opened."""
        nonlocal gone, article, box, around, anchors
        tag, was, opened = stack.pop()
        held[tag] -= 1
        anchors -= tag == "a"
        if was != (gone, article, box, around):
            flush()
            gone, article, box, around = was
        if opened:
            opened.close()
        return tag

    while found := tags.next(at):
        start, end, tag, closing, attrs = found
        take(text[at:start])
        at = end
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
        if not closing and tag in CONTROLS and box is not None:
            box.controls += 1
        if not closing and tag in RAW:
            flush()
            at = tags.raw_end(tag, at)
            continue
        if tag in BLOCKS or tag in DROPPED:
            flush()
        if closing:
            if held.get(tag):
                while leave() != tag:
                    pass
        elif tag not in VOID:
            says = _says(tag, attrs)
            if says is None and tag not in HELD and tag != "form":
                continue
            was, opened = (gone, article, box, around), None
            if says == GONE:
                state = (True, article, box, around)
            elif says == ARTICLE and not article and not gone:
                state = (gone, True, None, box)
            elif says in (BOX, HINT, FORM) and not gone and not (tag == "header" and article):
                opened = _Box(box, says)
                state = (gone, article, opened, around)
            else:
                state = was
            if state != was:
                flush()
                gone, article, box, around = state
            stack.append((tag, was, opened))
            held[tag] = held.get(tag, 0) + 1
            anchors += tag == "a"
    take(text[at:])
    flush()
    while stack:
        leave()

    known: dict = {}
    if not any(art or _within(box, known) for gone, art, box, _, _ in out if not gone):
        for _, _, box, _, _ in out:  # nothing else is left: what is only hinted at stays
            while box is not None and box.stays is False and box.says in (HINT, FORM):
                box.stays, box = True, box.outer
        known = {}
    # an article outside of boxes counts alone; else those within boxes do
    open_ = any(art and not gone and around is None and _within(box, known) for gone, art, box, around, _ in out)

    def kind(gone: bool, article: bool, box: _Box | None, around: _Box | None) -> int:
        if gone or not _within(box, known):
            return ASIDE
        if article and around is not None and open_:
            return PLAIN if _within(around, known) else ASIDE
        return MAIN if article else PLAIN

    return [(kind(*place), line) for *place, line in out]


MOST_BITS = 1 << 28  # of rows that an alignment keeps at a time, 32 MB


def _rows(a: list, b: list) -> list[int]:
    """Bit-parallel rows of the alignment of ``a`` with each prefix of ``b``; a 0 bit is a step of the common length."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    rows = []
    for y in b:
        match = row & where.get(y, 0)
        row = ((row + match) | (row - match)) & full
        rows.append(row)
    return rows


def _last_row(a: list, b: list) -> list[int]:
    """Of each prefix of ``a``, the length in common with ``b``, keeping one row."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for y in b:
        match = row & where.get(y, 0)
        row = ((row + match) | (row - match)) & full
    out = [0]
    for bit in format(row, f"0{len(a)}b")[::-1] if a else "":
        out.append(out[-1] + (bit == "0"))
    return out


def lcs(a: list, b: list) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence. Lines that only one side has are left out first; what needs more than
    ``MOST_BITS`` is halved where the two halves' common lengths add up to most."""
    both = set(a) & set(b)
    ai, bi = ([i for i, x in enumerate(s) if x in both] for s in (a, b))
    out, todo = [], [(0, len(ai), 0, len(bi))]
    while todo:
        p, q, r, s = todo.pop()
        while p < q and r < s and a[ai[p]] == b[bi[r]]:
            out.append((ai[p], bi[r]))
            p, r = p + 1, r + 1
        while p < q and r < s and a[ai[q - 1]] == b[bi[s - 1]]:
            q, s = q - 1, s - 1
            out.append((ai[q], bi[s]))
        if p == q or r == s:
            continue
        x, y = [a[i] for i in ai[p:q]], [b[j] for j in bi[r:s]]
        if len(x) * len(y) > MOST_BITS and len(y) > 1:
            half = len(y) // 2
            head, tail = _last_row(x, y[:half]), _last_row(x[::-1], y[half:][::-1])[::-1]
            cut = max(range(len(x) + 1), key=lambda i: head[i] + tail[i])
            todo += [(p, p + cut, r, r + half), (p + cut, q, r + half, s)]
            continue
        rows, i, j = _rows(x, y), len(x), len(y)
        while i and j:
            if rows[j - 1] >> (i - 1) & 1:
                i -= 1
            else:
                j -= 1
                if not j or rows[j - 1] >> (i - 1) & 1:
                    out.append((ai[p + i - 1], bi[r + j]))
                    i -= 1
    return sorted(out)


MIRROR = 0.9  # of the characters of both pages


def settle(lines: list[tuple[int, str]], neighbours: list[list[tuple[int, str]]], inside: bool = True) -> tuple[set[int], set[int]]:
    """(positions shared with any of the neighbours, positions among these that are deleted); see the module."""
    shared, beside, edges = set(), set(), []
    own = [i for i, (k, _) in enumerate(lines) if k == MAIN]
    texts = [t for _, t in lines]
    size, whole = sum(len(texts[i]) for i in own), sum(map(len, texts))
    for other in neighbours:
        pairs = {i for i, _ in lcs(texts, [t for _, t in other])}
        shared |= pairs
        if own or sum(len(texts[i]) for i in pairs) < MIRROR * max(whole, sum(len(t) for _, t in other)):
            beside |= pairs
        its = sum(len(t) for k, t in other if k == MAIN)
        if inside and own and 2 * sum(len(texts[i]) for i in own if i in pairs) < min(size, its or size):
            edges.append(pairs)
    gone = {i for i in beside if lines[i][0] == PLAIN}
    if len(edges) == 2:
        for run in (own, own[::-1]):
            for i in run:
                if i not in edges[0] or i not in edges[1]:
                    break
                gone.add(i)
    return shared, gone


def main_text(lines: list[tuple[int, str]], gone: set[int]) -> str:
    """The lines that are neither in menus and the like nor deleted; all outside menus if none would stay."""
    text = [i for i, (k, _) in enumerate(lines) if k != ASIDE]
    own = [i for i in text if i not in gone]
    return "\n".join(lines[i][1] for i in (own or text))


def _packed(lines: list[tuple[int, str]]) -> bytes:
    """Lines in few bytes, equal where they are; white space within a line is one space, so none has a line's end."""
    return zlib.compress("\n".join(f"{k}{t}" for k, t in lines).encode(), 1)


def _unpacked(body: bytes) -> list[tuple[int, str]]:
    return [(int(x[0]), x[1:]) for x in zlib.decompress(body).decode().split("\n") if x]


def place_of(url: Column) -> tuple[Column, Column]:
    """Host (lower case, '' where there is none) and path of a URL."""
    url = F.trim(F.coalesce(url, F.lit("")))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1))
    return host, F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def _parse(batches):
    for b in batches:
        bodies = [_packed(page_lines(x.as_py() or "")) for x in b.column("html")]
        keep = [b.column(c) for c in ("part", "page_id", "url", "host", "path")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(bodies, pa.binary())], names=["part", "page_id", "url", "host", "path", "body"])


#: What a task says of its range: pages (id, URL, text, lines shared and deleted), pages of its first and last run (text
#: still null), and the two runs at either edge (host, packed lines) by their number in the range. A run is pages in a
#: row of one host and equal lines.
RANGES = "part int, run long, page_id long, url string, text string, n_shared long, n_deleted long, runs long, host string, body binary, digest string"


def _text(own, neighbours, inside: bool) -> tuple[str, int, int]:
    """Text, lines shared and lines deleted of a run (host, packed lines) by the neighbours there are of its host."""
    host, lines = own[0], _unpacked(own[1])
    near = [_unpacked(other[1]) for other in neighbours if other is not None and other[0] == host]
    shared, gone = settle(lines, near, inside)
    return main_text(lines, gone), len(shared), len(gone)


def _difference(batches, inside: bool):
    """Rows in order of (host, path): the texts of all runs but the first and last, whose neighbours are in other ranges."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in RANGES.split(", "))])
    part = TaskContext.get().partitionId()

    def rows():
        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("page_id", "url", "host", "body"))
            for page_id, url, host, body in zip(*columns, strict=True):
                yield (page_id, url), (host, body)

    def pages(number, members, told):
        return [(part, number, page_id, url, *told, None, None, None, None) for page_id, url in members]

    def found():
        first, last, n, members = [], [], 0, []  # the two runs at either edge, the number of runs, the pages of the last one
        for own, run in groupby(rows(), lambda r: r[1]):
            if n == 1:
                yield pages(0, members, (None, None, None))
            elif n:
                yield pages(n - 1, members, _text(last[-1][1], (last[-2][1], own), inside))
            if n < 2:
                first.append((n, own))
            last = [*last[-1:], (n, own)]
            n, members = n + 1, [r[0] for r in run]
        if n:
            yield pages(n - 1, members, (None, None, None))
            edges = {number: own for number, own in (*first, *last)}
            yield [(part, i, *[None] * 5, n, host, body, hashlib.sha256(repr((host, body)).encode()).hexdigest()) for i, (host, body) in edges.items()]

    held = []
    for some in found():
        held += some
        if len(held) >= 500:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _beyond(ends: DataFrame, after: bool) -> Column:
    """Of rows (part, runs, first, last), one a range: (part, run) of the nearest run before the range, or after it, that
    differs from the range's first run, or last; ranges that are wholly one more piece of that run are passed over."""
    order = Window.orderBy(F.desc("part") if after else F.asc("part"))
    near, own = ("first", "last") if after else ("last", "first")
    place = lambda part, run: F.struct(F.col(part).alias("part"), run.cast("long").alias("run"))
    lag = lambda c: F.lag(c).over(order)
    beside = F.when(lag("part").isNotNull(), F.struct(lag("part").alias("part"), (F.lit(0).cast("long") if after else lag("runs") - 1).alias("run")))
    # a range that is not wholly a piece of the run next to it: what lies beyond the run that ends in it
    beyond = F.when(F.col("runs") > 1, place("part", F.lit(1) if after else F.col("runs") - 2)).when(~lag(near).eqNullSafe(F.col(near)), beside)
    known = ends.select("part", own, lag(near).alias("near"), beside.alias("beside"), beyond.alias("beyond"))
    passed = F.last("beyond", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return known.select("part", F.when(F.col("near") == F.col(own), passed).otherwise(F.col("beside")).alias("after" if after else "before"))


def _settle(batches, inside: bool):
    for b in batches:
        sides = []
        for side in ("own", "before", "after"):
            sides.append([None if host is None else (host, body) for host, body in zip(*(b.column(f"{side}_{c}").to_pylist() for c in ("host", "body")), strict=True)])
        told = [_text(own, near, inside) for own, *near in zip(*sides, strict=True)]
        columns = [pa.array([t[i] for t in told], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([b.column("part"), b.column("run"), *columns], names=["part", "run", "text", "n_shared", "n_deleted"])


TOLD = ["page_id", "url", "text", "n_shared", "n_deleted"]


def extract_pages(pages: DataFrame, inside: bool = False) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared, n_deleted) of each row of ``pages`` (page_id, url, html; no more are read).

    Blocks are joined by one newline, white space within them is one space, character references are decoded. Null
    and empty html give an empty text. n_shared: lines of the page, in or out of its article, that an alignment with a
    neighbour found in common; n_deleted: those of them that were deleted for it. Pages are dealt to ranges of (host,
    path), so that a host of any size is spread; the pages at the edges of a range meet those of the adjoining ranges, a
    few rows a range, so that the result is the same for any number of ranges. A neighbour is the nearest page on a side
    whose lines differ, so that copies in a row are one, and repeated rows are treated alike. A URL without a host
    counts to the host ''; a page whose every line is shared keeps its lines. ``inside``: see the module. Pages are parsed in linear time, and an
    alignment keeps a bounded number of bits.
    """
    host, path = place_of(F.col("url"))
    body = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    body = body.withColumns({"host": host, "path": path})
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranges are found from the URLs alone, so that no page is parsed twice
    dealt = range_parts(body, ["host", "path", "page_id"], parts).select("part", "page_id", "url", "host", "path", "html")
    parsed = dealt.mapInArrow(_parse, "part int, page_id long, url string, host string, path string, body binary")
    ranged = parsed.repartitionById(parts, F.col("part")).sortWithinPartitions("host", "path", "page_id")
    dealt = materialize(ranged.select("page_id", "url", "host", "body").mapInArrow(partial(_difference, inside=inside), RANGES), "html-ranges")

    edges = dealt.where("runs is not null").select("part", "run", "runs", "host", "body", "digest")
    ends = edges.groupBy("part").agg(F.first("runs").alias("runs"), F.max(F.when(F.col("run") == 0, F.col("digest"))).alias("first"), F.max(F.when(F.col("run") == F.col("runs") - 1, F.col("digest"))).alias("last"))
    # one row a range, whose number is the setting's: small
    ends = ends.join(_beyond(ends, False), "part").join(_beyond(ends, True), "part")
    in_range = lambda run: F.struct(F.col("part"), run.cast("long").alias("run"))
    open_runs = [(F.lit(0), F.col("before"), F.when(F.col("runs") > 1, in_range(F.lit(1))).otherwise(F.col("after"))), (F.col("runs") - 1, F.when(F.col("runs") > 1, in_range(F.col("runs") - 2)).otherwise(F.col("before")), F.col("after"))]
    met = ends.select("part", F.explode(F.array(*(F.struct(run.cast("long").alias("run"), before.alias("before"), after.alias("after")) for run, before, after in open_runs))).alias("o")).select("part", "o.*").distinct()
    side = lambda name: edges.select(F.struct("part", "run").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("host", "body")))
    met = met.withColumn("own", F.struct("part", "run"))
    for name, how in (("own", "inner"), ("before", "left"), ("after", "left")):
        met = met.join(side(name), name, how)
    settled = met.drop("own", "before", "after").mapInArrow(partial(_settle, inside=inside), "part int, run long, text string, n_shared long, n_deleted long")
    pages_of = dealt.where("runs is null")
    waiting = pages_of.where("text is null").select("part", "run", "page_id", "url").join(settled, ["part", "run"]).select(*TOLD)
    whole = pages_of.where("text is not null").select(*TOLD).union(waiting)
    return whole.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_shared", "n_deleted")
