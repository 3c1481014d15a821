"""Main text of pages: layouts with known articles, broken markup, the whole table against its template, edge cases."""

import re
import time
from html import unescape

import pytest

from mnemospark.llm import queries
from mnemospark.llm.html_extract import extract_main_text, main_text

LONG = "A paragraph of the article, with some words in it, long enough to count for something, and a few commas more."
PAGES = {
    "named parts around divs": (
        f"""<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><div id="site-header"><a href="/">Home</a> My Site</div>
        <div class="cookie-notice"><p>We use cookies, and so on, to make the site better, faster, and nicer for you, always.</p></div><ul class="menu"><li><a href=1>One</a><li><a href=2>Two</a></ul>
        <div id="wrapper"><div id="content"><h1>Head &amp; line</h1><div class="entry"><p>{LONG} <b>Bold</b>ly.</p><p>Short.</p><ul><li>one<li>two <a href=x>link</a></ul><pre>x
          y</pre><table><tr><td>a<td>b</table><h2>Sub</h2><p>Second&nbsp;one<br>here.</p><div class="related"><a href=a>Rel one</a> <a href=b>Rel two</a></div>
        <form><input><p>Subscribe now, to get, all, the, news, daily, weekly, {LONG}</p></form></div></div>
        <div id="comments"><h3>3 comments</h3><article class="comment"><p>Great article, thanks, I really, really, really enjoyed it, all of it, so much so. {LONG} {LONG}</p></article></div></div>
        <div class="sidebar"><p>About the author, who writes, {LONG}</p></div><div id="footer">(c) 2020</div></body></html>""",
        ["Head & line", f"{LONG} Boldly.", "Short.", "one", "two link", "x y", "a", "b", "Sub", "Second one here."],
    ),
    "main part with its own header": (f"<header><h1>Site</h1></header><main><header><h1>Title</h1></header><p>One.<p>Two.<section><p>{LONG}</section><footer>posted</footer></main><p>Stray.", ["Title", "One.", "Two.", LONG]),
    "unnamed divs, links around": (f"<div><a href=1>One link here</a> <a href=2>Another link, with, commas</a></div><div><p>{LONG}</p><p>Yes.</p></div><div><a href=3>Third, link, list</a><a href=4>x</a></div>", [LONG, "Yes."]),
    "table layout": (f"<table><tr><td><a href=1>x</a><a href=2>y</a></td><td><p>{LONG}<p>Another.</td></tr></table>", [LONG, "Another."]),
    "headline before the article": (f"<main><h1>Head</h1><article><p>{LONG}</article><aside>{LONG} {LONG}</aside></main>", ["Head", LONG]),
    "page inside a form": (f"<form id=f><input><div class=content><p>{LONG}</p></div></form>", [LONG]),
    "broken markup": (
        """<article><p>a <a href="x>y">q</a> <img alt="a>b"> c</p><script>if(a<b){document.write("<p>no</p>")}</script><p><b>d<p>e</b></i><!-- <p>no</p> --><p title=don't>f</p><p>&lt;tag&gt; &#x41; &hellip; &am</p></article><footer <a href=\"""",
        ["a q c", "d", "e", "f", "<tag> A … &am"],
    ),
    "hidden text": (f"<article><p>{LONG}</p><p hidden>no</p><div style='display: none'>no</div><span aria-hidden=true>no</span><template><p>no</template><noscript><p>no</noscript><p>end</p></article>", [LONG, "end"]),
    "list of links in the article": (f"<article><p>{LONG}</p><ul><li><a href=1>More of this</a><li><a href=2>More of that</a></ul><p><a href=3>Source</a></p></article>", [LONG, "Source"]),
    "only a heading": ("<nav>m</nav><article><h1>x</h1></article>", ["x"]),
    "no article": ("<nav><a href=1>m</a></nav><footer>f</footer>", []),
    "a fragment": ("<p>Only a fragment", ["Only a fragment"]),
    "no markup": ("Only text", ["Only text"]),
    "comments that are articles": (f"<main><article><h1>H</h1><p>{LONG}</article><section id=comments><h2>2 comments</h2><article><p>{LONG} {LONG}</article><article><p>Yes.</article></section></main>", ["H", LONG]),
    "a frame called by its sidebar": (f"<div class=with-sidebar><div class=sidebar><p>{LONG}</p></div><div class=content><h1>H</h1><p>{LONG}<p>{LONG} {LONG}</div></div>", ["H", LONG, f"{LONG} {LONG}"]),
    "a frame called by its sidebar around an article": (f"<div class=with-sidebar><article><h1>H</h1><p>{LONG}</article><div class=sidebar><p>{LONG} {LONG}</div></div>", ["H", LONG]),
    "notices inside the article": (f"<article><h1>H</h1><div class=notice>Sign up, please, now.</div><p>{LONG}</p><div role=alert>{LONG}</div><p>end<div class='reader-comments'><p>{LONG} {LONG}</div></article>", ["H", LONG, "end"]),
    "comment without end": ("<p>a</p><!-- <p>b</p>", ["a"]),
}


@pytest.mark.parametrize("name", PAGES)
def test_layouts(name):
    html, blocks = PAGES[name]
    assert main_text(html) == "\n\n".join(blocks)


@pytest.mark.parametrize("html", ["<a =" * 200_000, "<p>" * 50_000, "<div>" * 5_000 + "x", "\"<a b='\"" * 100_000, "<" * 300_000, "<a>" * 50_000, "<b>" * 20_000 + "</i>" * 5_000, "<!--" * 100_000, "<table>" * 5_000])
def test_bad_pages_take_linear_time(html):
    began = time.process_time()
    main_text(html)
    assert time.process_time() - began < 5


def test_edges(spark):
    rows = [(None, None), (1, ""), (2, "<p>"), (3, f"<p>{LONG}</p>" * 20_000), (4, "<p>two</p>"), (4, "<p>two</p>")]
    df = spark.createDataFrame([(i, h, "t", "n", "_") for i, h in rows], "page_id long, HTML string, Text string, n_chars string, _text string")
    got = extract_main_text(df)
    assert got.columns == ["page_id", "_text", "text", "n_chars"]
    want = [(None, "", 0), (1, "", 0), (2, "", 0), (3, "\n\n".join([LONG] * 20_000), 20_000 * len(LONG) + 39_998), (4, "two", 3), (4, "two", 3)]
    assert sorted(map(repr, ((r.page_id, r.text, r.n_chars) for r in got.collect()))) == sorted(map(repr, want))
    assert "HTML" in extract_main_text(df, keep=["HTML"]).columns and extract_main_text(df.limit(0)).collect() == []


def test_query_on_the_table(spark, data):
    """Pages of this table hold one article of headings and paragraphs, which a pattern can cut out."""
    want = []
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        inner = r.html[r.html.index("<article>") : r.html.index("</article>")]
        blocks = (" ".join(unescape(re.sub("</?b>|<article>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:h1|p)>", inner))
        text = "\n\n".join(b for b in blocks if b)
        want.append((r.page_id, r.url, text, len(text)))
    assert sorted(map(tuple, queries.op13_html_extract(spark, data).collect())) == sorted(want)
