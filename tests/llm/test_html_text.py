"""Main text of pages against a reader by regular expressions, layouts without an article element, and
odd pages and tables."""

import html
import re
import time

import pytest

from bibspark.llm import html_text
from bibspark.llm.html_text import main_text, op13_html_extraction

DATA = "/root/testdata/sf0.001"
LONG = "Words of a sentence that says something about the subject. "


def by_patterns(page: str) -> str:
    """The blocks of the article element of a page without attributes, by patterns."""
    article = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", page, re.S)[1]).replace("<br>", " ")
    blocks = (" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", article))
    return "\n\n".join(x for x in blocks if x)


def test_whole_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = op13_html_extraction(spark, DATA).collect()
    assert len(got) == len(pages)
    for r in got:
        want = by_patterns(pages[r.page_id].html)
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))


DIVS = (
    f"<html><body class='has-sidebar'><div id=header><a href=/>Site</a></div><div class=menu><ul><li><a href=1>A</a><li><a href=2>B</a></ul></div><div id=wrap><div id=content><h1>Title</h1><p>{LONG * 6}"
    f"<p>Short.<p>{LONG * 4}<ul><li>one<li>two</ul></div><div class=sidebar><p>{LONG * 5}</div></div><div id=comments><h3>2 comments</h3><p>{LONG * 9}</div>"
    f"<div class='cookie-notice'>{LONG}</div><form><p>{LONG}<button>Send</button></form><footer>(c)</footer>"
)


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        (DIVS, ["Title", (LONG * 6).strip(), "Short.", (LONG * 4).strip(), "one", "two"]),
        (f"<body><div><a href=1>Home</a> | <a href=2>News</a></div><p>{LONG * 4}</p><p>Tiny.</p><p>{LONG * 5}</p><div>Copyright</div>", [(LONG * 4).strip(), "Tiny.", (LONG * 5).strip()]),
        ("<body><form id=aspnet><main><h1>X</h1><p>Hello</p></main></form>", ["X", "Hello"]),
        (f"<article><header><h1>T</h1><p>by me</p></header><p>Text.</p><aside>rel</aside><section class=comments><article class=comment><p>{LONG * 9}</article></section><footer>f</footer></article>", ["T", "Text."]),
        ("<nav><a href=x>menu</a><article><p>Text.</p></article>", ["Text."]),
        (f"<div role=navigation>{LONG * 3}</div><div role=main><p>a</p><table><tr><td>b<td>c</table><pre> x\n  y</pre><div style='display: none'>z</div></div>", ["a", "b", "c", "x y"]),
        (f"<article><p>{LONG * 5}</p></article><div class=more><article><p>Teaser of one.</p></article><article><p>Teaser of two.</p></article></div>", [(LONG * 5).strip()]),
        (f"<article class=post><p>{LONG * 3}</p></article><article class=post><p>{LONG * 2}</p></article>", [(LONG * 3).strip(), (LONG * 2).strip()]),
        ("a<!-- x > y --> b <![foo[ z ]]> &amp;&nbsp;c&#x41; &am <!-- never closed <p>x", ["a b & cA &am"]),
        ("<script>var a = '<p>no</p>';</script><style>p{}</style><p>yes<script>document.write('never closed')", ["yes"]),
        ("<p>one <b>two</b>three<br>four</p>five", ["one twothree four", "five"]),
        ("just text", ["just text"]),
        ("<nav>only a menu</nav>", []),
        ("", []),
        (None, []),
    ],
)
def test_layouts(page, blocks):
    assert main_text(page) == "\n\n".join(blocks)


def test_clusters_by_hand():
    ratios = [0.0, 0.0, 0.0, 100.0, 4.0, 120.0, 0.0, 0.0, 0.0, 0.0]
    kernel = [2.718281828459045 ** (-d * d / 2) for d in range(-2, 3)]
    smooth = []
    for i in range(len(ratios)):
        near = [(kernel[d + 2], ratios[i + d]) for d in range(-2, 3) if 0 <= i + d < len(ratios)]
        smooth.append(sum(k * x for k, x in near) / sum(k for k, _ in near))
    assert html_text.smooth(ratios) == pytest.approx(smooth)
    mean = sum(smooth) / 10
    cut = (sum((x - mean) ** 2 for x in smooth) / 10) ** 0.5
    assert html_text.ratio_clusters(ratios) == [(1 + (r >= cut)) * (s >= cut and r > 0) for s, r in zip(smooth, ratios, strict=True)]
    assert html_text.ratio_clusters([]) == []


@pytest.mark.parametrize("piece", ["</a", "<a ", "<!--", "<![x[", "<p>x", "<div>", "<li>", '<a b="', "<span class=ad>", "<table><tr><td>", "&", "<b><i>"])
def test_long_and_broken_pages_take_linear_time(piece):
    began = time.time()
    main_text(piece * (2_000_000 // len(piece)))
    assert time.time() - began < 30


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars int, keep int, `a b` string, `c.d` string"
    rows = [(1, "u", "<p>x</p>", "old", 9, 5, "s", "t"), (None, None, None, None, None, None, None, None), (1, "u", "<p>x</p>", "old", 9, 5, "s", "t")]
    got = html_text.extract(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "keep", "a b", "c.d", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", 5, "s", "t", "x", 1), (None,) * 5 + ("", 0), (1, "u", 5, "s", "t", "x", 1)], key=str)
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0
    assert html_text.extract(spark.createDataFrame([("<p>x",)], "html string")).collect()[0].text == "x"


def test_page_of_several_megabytes(spark):
    page = "<article>" + f"<p>{LONG}</p>" * 60_000 + "</article>"
    got = html_text.extract(spark.createDataFrame([(1, page)], "page_id long, html string")).first()
    assert got.text == "\n\n".join([LONG.strip()] * 60_000) and got.n_chars == len(got.text)
