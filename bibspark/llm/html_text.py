"""Main text of web pages.

The standard library's parser streams its events into lines: a line is the text between two block
tags, with the tags and the link characters met in it. The text-to-tag ratio of each line is smoothed
by a Gaussian along the page; lines above the standard deviation of the smoothed ratios form the
content clusters (Weninger et al., 2010). Lines in menus, headers, footers, sidebars, notices, adverts,
forms and comments, told by tag, role, class and id, have ratio 0 and are never taken. The clusters
choose the element that holds the main text, and all its other lines are taken, short ones too, for
an article's short paragraphs lie below any threshold.

A page is parsed alone, in time linear in its length; nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Smoothing: reach in lines and width of the Gaussian.
RADIUS, SIGMA = 2, 1.0
#: Threshold in standard deviations of the smoothed ratios.
DEVIATIONS = 1.0
#: Share of the clusters' text that one element must hold to be their container.
SHARE = 0.9
#: Least share of a page's text that makes an article element or a main element the container.
MARKED_SHARE = 0.2
#: Of several articles, one with this share of their text is the article, else all are.
LEADING_SHARE = 0.65

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = frozenset("title meta link style script base noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset head header hgroup hr html legend li main menu nav "
    "noframes ol optgroup option p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
#: Start tags of these end an open paragraph.
ENDS_P = HEADINGS | frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr main menu nav ol p pre section table ul".split())
#: A start tag ends an open element of these names, unless one of the others stands between.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "option": (("option",), ("select",)),
}
#: Elements that never hold main text.
NEVER = frozenset(
    "applet aside audio button canvas datalist dialog embed fieldset frameset head iframe input label legend map menu meter nav noframes noscript object option progress script select style "
    "svg template textarea title video".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id that mark what is not the article.
COMMENTS = frozenset("comment comments commenter commentary disqus respond replies reply discussion discussions".split())
MARKS = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle adslot sponsor sponsored sponsors promo promos promotion outbrain taboola "
    "aside breadcrumb breadcrumbs colophon consent cookie cookies copyright dropdown footer form gdpr hamburger lightbox login masthead menu menus modal nav navbar navigation "
    "newsletter notice notices notification notifications announcement overlay pager pagination paywall popup rail recommended recommendations related search share sharing sidebar sidebars "
    "signin signup skip social submenu subscribe subscription toast toc toolbar topbar banner".split()
)
#: Names that mark only as a whole.
WHOLE = frozenset("widget widgets widget-area header page-header site-header site-top alert side".split())
TITLES = frozenset("article-header entry-header post-header story-header content-header".split())
#: Names that only describe the layout, as in has-sidebar.
LAYOUT = re.compile(r"(?:has|no|with|without|is|not|hide|show)[-_]|.*[-_](?:wrapper|container|layout|page)$")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
BARE_START, BARE_END = re.compile(r"<([a-zA-Z][a-zA-Z0-9]*)>"), re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)>")
CONTAINERS = frozenset("div section body html td center #".split())

#: What an element is.
PLAIN, HARD, MARKED, TITLE_BAR = 0, 1, 2, 3


def marked_by_name(names: str, allowed: frozenset = MARKS) -> int:
    """What the names of a class or id attribute say."""
    for name in names.split():
        low = name.lower()
        if low in TITLES:
            return TITLE_BAR
        if LAYOUT.match(low):
            continue
        if (low in WHOLE and allowed is MARKS) or any(w.lower() in allowed for w in WORD.findall(name)):
            return MARKED
    return PLAIN


class _Page(HTMLParser):
    """Lines and elements of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.kind, self.role = ["#"], [-1], [PLAIN], [""]  # by element; 0 is the page
        self.stack = [0]
        self.open: dict[str, int] = {}  # open elements of each name
        self.lines: list[tuple[str, int, int, int]] = []  # text, tags, link characters, element
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.link_depth = 0  # length of the stack at an open link, 0: none

    # ---- what the parser itself would read slowly, or stop at
    def parse_comment(self, i, report=1):
        end = re.compile(r"--!?>").search(self.rawdata, i + 2)
        return end.end() if end else len(self.rawdata)

    def parse_html_declaration(self, i):
        return self.rawdata.find(">", i + 2) + 1 or len(self.rawdata)

    parse_pi = parse_html_declaration

    def parse_starttag(self, i):
        bare = BARE_START.match(self.rawdata, i)
        if bare and (tag := bare[1].lower()) not in self.CDATA_CONTENT_ELEMENTS:
            self.handle_starttag(tag, ())
            return bare.end()
        return super().parse_starttag(i) if i < self.last_end else len(self.rawdata)

    def parse_endtag(self, i):
        bare = BARE_END.match(self.rawdata, i)
        if bare and not self.cdata_elem:
            self.handle_endtag(bare[1].lower())
            return bare.end()
        return super().parse_endtag(i) if i < self.last_end else len(self.rawdata)

    def updatepos(self, i, j):
        return j  # positions are of no use here

    def read(self, html: str) -> None:
        self.last_end = html.rfind(">")
        self.feed(html)
        self.close()
        self.line()

    # ---- lines
    def line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.tags, self.linked, self.stack[-1]))
                self.tags = self.linked = 0
            self.parts = []

    def handle_data(self, data):
        self.parts.append(data)
        if self.link_depth:
            self.linked += len("".join(data.split()))

    # ---- elements
    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.open[self.tag[self.stack.pop()]] -= 1
        if self.link_depth > depth:
            self.link_depth = 0

    def end_open(self, names: tuple, until: tuple) -> None:
        if any(self.open.get(n) for n in names):
            for depth in range(len(self.stack) - 1, 0, -1):
                tag = self.tag[self.stack[depth]]
                if tag in names:
                    self.pop_to(depth)
                    return
                if tag in until:
                    return

    def kind_of(self, tag: str, attrs: dict) -> int:
        if tag in NEVER:
            return HARD
        if attrs and ("hidden" in attrs or attrs.get("aria-hidden") == "true" or HIDDEN.search(attrs.get("style") or "")):
            return HARD
        if tag == "footer":
            return PLAIN if self.open.get("blockquote") else HARD
        if tag == "header":
            return TITLE_BAR
        if tag == "form":
            return MARKED
        if not attrs or tag in ("html", "body", "main"):
            return PLAIN
        if (attrs.get("role") or "").lower() in ROLES:
            return HARD
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
        return marked_by_name(names, COMMENTS if tag == "article" else MARKS) if len(names) > 1 else PLAIN

    def handle_starttag(self, tag, attrs):
        block = tag in BLOCKS
        if self.open.get("head") and tag not in IN_HEAD and tag != "head":
            self.line()
            self.end_open(("head",), ())
        if block:
            self.line()
            if tag in ENDS_P:
                self.end_open(("p",), ("td", "th", "table", "button"))
            if tag in ENDS:
                self.end_open(*ENDS[tag])
            if tag in HEADINGS and self.tag[self.stack[-1]] in HEADINGS:
                self.pop_to(len(self.stack) - 1)
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        attrs = dict(attrs)
        kind = self.kind_of(tag, attrs)
        if not block and kind == PLAIN and tag != "a":
            return  # other inline tags change no line
        if kind != PLAIN and not block:
            self.line()
        role = (attrs.get("role") or "").lower() if attrs else ""
        if tag in ("article", "main"):
            role = tag
        elif role != "main" and attrs:
            role = "article" if role == "article" or "articlebody" in (attrs.get("itemprop") or "").lower() else ""
        self.tag.append(tag)
        self.role.append(role if role in ("article", "main") else "")
        self.parent.append(self.stack[-1])
        self.kind.append(kind)
        self.stack.append(len(self.tag) - 1)
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag == "a":
            self.link_depth = len(self.stack)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag):
        block = tag in BLOCKS
        if block:
            self.line()
        self.tags += 1
        if not self.open.get(tag):
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.tag[self.stack[depth]] == tag:
                if not block and self.kind[self.stack[depth]] != PLAIN:
                    self.line()
                self.pop_to(depth)
                return
            if not block and self.tag[self.stack[depth]] in BLOCKS and tag != "a":
                return


def smooth(values: list[float]) -> list[float]:
    """Gaussian means over RADIUS lines on both sides; at the ends over what there is."""
    sums, weights = np.array(values, float), np.ones(len(values))
    for d in range(1, min(RADIUS, len(values) - 1) + 1):
        k = math.exp(-(d * d) / (2 * SIGMA * SIGMA))
        sums[d:] += k * np.asarray(values[:-d], float)
        sums[:-d] += k * np.asarray(values[d:], float)
        weights[d:] += k
        weights[:-d] += k
    return (sums / weights).tolist()


def ratio_clusters(ratios: list[float]) -> list[int]:
    """1 for the lines of content clusters, whose smoothed ratio reaches the threshold, 2 if their own
    ratio does too, else 0."""
    if not ratios:
        return []
    s = smooth(ratios)
    mean = sum(s) / len(s)
    threshold = DEVIATIONS * math.sqrt(sum((x - mean) ** 2 for x in s) / len(s))
    return [(1 + (r >= threshold)) * (x >= threshold and r > 0) for x, r in zip(s, ratios, strict=True)]


def main_text(html: str | None) -> str:
    """The main text of a page, blocks parted by two line feeds; empty if there is none."""
    if not html:
        return ""
    page = _Page()
    page.read(html)
    tag, parent, kind, role, lines = page.tag, page.parent, page.kind, page.role, page.lines
    n = len(tag)
    chars = [len(text) for text, *_ in lines]

    # what each element holds; an element stands after its parent
    mass, titles, marked = [0] * n, [0] * n, [0] * n
    for (_, _, _, e), c in zip(lines, chars, strict=True):
        mass[e] += c
    for e in range(n - 1, 0, -1):
        mass[parent[e]] += mass[e]
        titles[parent[e]] += titles[e] + (tag[e] == "h1")
        marked[parent[e]] += marked[e] + (role[e] != "" and kind[e] == PLAIN)
    out, bar, block, head = [False] * n, [False] * n, [""] * n, [False] * n
    inside = [False] * n  # in an article or main element
    for e in range(1, n):
        p, k = parent[e], kind[e]
        out[e], bar[e], inside[e] = out[p], bar[p], inside[p] or role[e] != ""
        block[e] = tag[e] if tag[e] in BLOCKS else block[p]
        head[e] = head[p] or tag[e] in HEADINGS
        if role[e] and k == PLAIN and out[p] and all(tag[x] in ("nav", "header", "form", "head") for x in _outs(p, kind, parent)):
            out[e] = bar[e] = False  # the menu, header or form before it was not closed, or goes round the page
        elif k == HARD:
            out[e] = True
        elif k == MARKED:
            keeps = marked[e] or (titles[e] and 2 * mass[e] >= mass[0])
            out[e] = out[e] or not keeps
        elif k == TITLE_BAR:
            if not marked[e]:
                out[e] = out[e] or not (inside[p] or tag[e] != "header")
                bar[e] = True
    live = [not out[e] and (not bar[e] or head[e]) for _, _, _, e in lines]
    if not any(live):
        return ""

    ratios = [c / max(1, tags) if ok else 0.0 for c, (_, tags, _, _), ok in zip(chars, lines, live, strict=True)]
    seeds = ratio_clusters(ratios)
    votes, held = [0] * n, [0] * n
    for (_, _, _, e), c, s, ok in zip(lines, chars, seeds, live, strict=True):
        votes[e] += c * (s > 0)
        held[e] += c * ok
    for e in range(n - 1, 0, -1):
        votes[parent[e]] += votes[e]
        held[parent[e]] += held[e]
    chosen = _containers(tag, role, parent, kind, out, votes, held)
    within = [False] * n
    for e in range(n):
        within[e] = e in chosen or (e > 0 and within[parent[e]])
    picked = [ok and within[e] for ok, (_, _, _, e) in zip(live, lines, strict=True)]
    if not all(role[e] for e in chosen):
        _trim(picked, lines, chars, seeds, block)
        above = set(_up(next(iter(chosen)), parent))
        before = [k for k, (_, _, _, e) in enumerate(lines) if live[k] and block[e] == "h1"]
        if len(before) == 1 and not picked[before[0]] and any(picked[before[0] :]) and parent[_heading(lines[before[0]][3], tag, parent)] in above:
            picked[before[0]] = True
    return "\n\n".join(text for (text, *_), ok in zip(lines, picked, strict=True) if ok)


def _up(e: int, parent: list[int]):
    while e >= 0:
        yield e
        e = parent[e]


def _outs(e: int, kind: list[int], parent: list[int]):
    return [x for x in _up(e, parent) if kind[x] != PLAIN]


def _heading(e: int, tag: list[str], parent: list[int]) -> int:
    return next(x for x in _up(e, parent) if tag[x] == "h1")


def _containers(tag, role, parent, kind, out, votes, held) -> set[int]:
    """The elements that hold the main text: marked ones that the clusters vote for, else the
    smallest element that holds SHARE of the clusters' text."""
    n = len(tag)
    for name in ("article", "main"):
        covered = [False] * n
        tops = []
        for e in range(1, n):
            here = role[e] == name and kind[e] == PLAIN and not out[e]
            if here and not covered[parent[e]] and held[e]:
                tops.append(e)
            covered[e] = covered[parent[e]] or here
        by = votes if any(votes[e] for e in tops) else held
        whole = sum(by[e] for e in tops)
        if tops and sum(held[e] for e in tops) >= MARKED_SHARE * held[0]:
            best = max(tops, key=lambda e: (by[e], -e))
            return {best} if by[best] >= LEADING_SHARE * whole else set(tops)
    by = votes if votes[0] else held
    best = max(e for e in range(n) if by[e] >= SHARE * by[0])  # such elements hold each other
    while tag[best] not in CONTAINERS:
        best = parent[best]
    return {best}


def _trim(picked, lines, chars, seeds, block) -> None:
    """In an element that is not marked as the article: lines of links go, and so does what stands
    before the first or after the last cluster and is no paragraph, heading, item or cell."""
    at = [k for k, s in enumerate(seeds) if s == 2 and picked[k]]
    prose = HEADINGS | {"p", "li", "blockquote", "pre", "td", "th", "dd", "dt", "figcaption", "caption"}
    for k, (_, _, linked, e) in enumerate(lines):
        if picked[k]:
            outside = bool(at) and not at[0] <= k <= at[-1]
            if 2 * linked > chars[k] and (block[e] not in HEADINGS) or (outside and block[e] not in prose):
                picked[k] = False


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages (html, more) -> the same rows and columns but html, with text string (never null) and
    n_chars long (its code points) after them.

    A null or empty page, and one without main text, has an empty text. Rows are independent: repeats
    give repeats, an empty table an empty result; columns named text or n_chars are replaced. Tags that
    are never closed, closed twice or cut off at the page's end are read as browsers read them."""
    keep = [f for f in pages.schema if f.name not in (html, "text", "n_chars")]
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    rows = pages.select(F.col(quoted(html)).cast("string").alias("html"), F.struct(*[F.col(quoted(f.name)) for f in keep]).alias("keep") if keep else F.lit(None).cast("struct<x:int>").alias("keep"))

    def parse(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["keep", "text", "n_chars"])

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([rows.schema["keep"], StructField("text", StringType()), StructField("n_chars", LongType())])
    done = rows.mapInArrow(parse, schema)
    return done.select(*[F.col("keep." + quoted(f.name)).alias(f.name) for f in keep], "text", "n_chars")


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
