"""Operator 13: main text of web pages."""
import html
import re
import time

import pyarrow.parquet as pq
import pytest

from stocksmith.llm import line_blocks
from stocksmith.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"
A = "The harbour froze over in the winter of that year, and nobody in the town could remember the like of it."
B = "Boats stood in the ice, and children walked to the island, which had never been reached on foot before."
C = "In March the thaw came at night; by morning the water was open again & the first ferry left."
TEXT = "\n".join(["A frozen harbour", A, B, C])
BODY = f"<h1>A frozen harbour</h1><p>{A}</p><p>{B}</p><p>{C.replace('&', '&amp;')}</p>"

MENU = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li><li><a href="/c">Contact us today</a></li></ul>'
LONG = "This reader did not like the story at all, and says so here in very many words, more than any paragraph of the text itself has, to be sure of it. " * 6

PAGES = {
    "semantic": f"<html><body><header><h1>The Daily Page</h1></header><nav>{MENU}</nav><main><article>{BODY}<footer>Filed under news</footer></article><aside><p>{LONG}</p></aside></main><footer>&copy; 2024</footer></body></html>",
    "div soup": f'<body><div id="header"><div class="logo">The Daily Page, all the news since 1850</div>{MENU}</div><div id="wrapper" class="has-sidebar"><div class="post-content">{BODY}</div><div id="sidebar"><h3>About us</h3><p>{LONG}</p></div></div><div id="footer"><p>The Daily Page is a paper of the harbour towns.</p></div></body>',
    "no names": f"<body><div>{MENU}</div><div>{BODY}</div><div>{MENU}</div><div>© 2024 The Daily Page. All rights reserved.</div></body>",
    "comments": f'<body><nav>{MENU}</nav><div class="entry">{BODY}</div><section id="comments"><h2>2 comments</h2><article class="comment"><p>{LONG}</p></article><article class="comment"><p>{LONG}</p></article></section></body>',
    "comments without a name": f"<body><div>{BODY}</div><div>{MENU}</div><div><h3>3 Comments</h3><p>{LONG}</p><p>{LONG}</p></div></body>",
    "comments in the article": f'<article class="post has-comments">{BODY}<div class="post-comments"><p>{LONG}</p></div></article>',
    "notices": f'<body><div class="cookie-notice" role="dialog"><p>We use cookies to make this page better for you and our partners.</p><button>Accept</button></div><div class="siteNotice">Read this first, it is important to us.</div><article>{BODY}</article><form action="/s"><label>Your mail</label><input name="m"><p>Get our letter each morning.</p></form></body>',
    "adverts inside": f'<article><h1>A frozen harbour</h1><p>{A}</p><div class="ad">Buy ice skates now, only today!</div><p>{B}</p><div class="advert-box"><p>And a sledge.</p></div><aside>More on ice</aside><ul class="share-buttons"><li>Share this</li></ul><p>{C.replace("&", "&amp;")}</p></article>',
    "form around all": f'<body><form id="aspnetForm"><div class="menu">{MENU}</div><div id="content"><main>{BODY}</main></div></form></body>',
    "frame with a bad name": f'<body><div class="sidebar-layout"><article>{BODY}</article></div></body>',
    "links in the text": "<article>" + BODY.replace("the island", '<a href="/i">the island</a>').replace("harbour froze", "<b>harbour</b> <i>froze</i>") + "</article>",
    "broken": f"<body><nav>{MENU}<nav></nav></nav><article><h1>A frozen harbour<p>{A}<p>{B}<br></div><p><b>{C}</article><footer>Late<body>",
    "script and style": f'<article><script>if (a < b) document.write("<p>no</p>")</script><style>p > a {{}}</style>{BODY}<script>x</article>',
    "comment and attributes": f'<!-- <p>gone</p> --><article data-x="a > b" title=\'<p>\'>{BODY}</article>',
    "white space": "<ARTICLE>\n" + BODY.replace(" ", " \t\r\n ").replace("<p>", "<P CLASS=x>") + "&nbsp;\n</ARTICLE>",
    "title beside the article": f"<main><h1>A frozen harbour</h1><article>{BODY.split('</h1>')[1]}</article><nav>{MENU}</nav></main>",
    "dead part in a line": "<article>" + BODY.replace("by morning", 'by <span class="share-link">Share</span> <button>Like</button> morning') + "</article>",
    "teasers": f"<body><article>{BODY}</article><article><h2>Other news</h2><p>{A[:60]}</p></article></body>",
    "table layout": f"<table><tr><td>{MENU}</td><td>{BODY}</td></tr></table>",
    "hidden": f'<article>{BODY}<p hidden>Not seen.</p><p style="display: none">Nor this.</p><div aria-hidden="true">Nor that.</div></article>',
}


@pytest.mark.parametrize("name", PAGES)
def test_templates(name):
    assert line_blocks.main_text(PAGES[name]) == TEXT


def test_short_paragraphs_stay():
    page = f"<body><nav>{MENU}</nav><div class=ad>Buy.</div><article><h1>On it.</h1><p>Of.</p><p>{A}</p><p>By.</p></article><footer>All of it.</footer>"
    assert line_blocks.main_text(page) == f"On it.\nOf.\n{A}\nBy."
    assert line_blocks.main_text("<article><h1>All rights reserved.</h1><p>Of.") == "All rights reserved.\nOf."


def test_runs():
    import numpy as np
    assert line_blocks.runs(np.array([0, 5, 0, 0, 7, 0, 0, 0, 9, 9])) == [(1, 5), (8, 10)]
    assert line_blocks.runs(np.array([3])) == [(0, 1)]
    assert line_blocks.runs(np.array([0, 0])) == [] == line_blocks.runs(np.zeros(0, np.int64))


def article(page):
    """The article of the given pages' one template."""
    inner = re.sub("<br>|</?b>", " ", re.search("<article>(.*)</article>", page, re.S)[1])
    blocks = (" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_query(spark):
    rows = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    got = {r.page_id: r for r in QUERIES["op13_line_blocks"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        want = article(r["html"]) if r["html"] else ""
        assert (got[r["page_id"]].text, got[r["page_id"]].n_chars, got[r["page_id"]].url) == (want, len(want), r["url"])


def test_rows_pass_through(spark):
    df = spark.createDataFrame([(1, None, "old", "u"), (None, "", "old", None), (2, PAGES["broken"], "x", "u"), (2, PAGES["broken"], "x", "u"), (3, "plain words only", None, None), (4, "< <3 &lt;b&gt; &#0; </p", None, "")],
                               "page_id bigint, html string, text string, _page string")
    out = line_blocks.extract(df)
    assert sorted(out.columns) == sorted(df.columns)
    got = sorted((r.page_id or 0, r.text) for r in out.collect())
    assert got == [(0, ""), (1, ""), (2, TEXT), (2, TEXT), (3, "plain words only"), (4, "< <3 <b> �")]
    assert line_blocks.extract(df.limit(0)).collect() == []


@pytest.mark.parametrize("page", ["<" * 300_000, "<p " * 200_000, "<!--" * 200_000, '<a class="' * 100_000, "<script>" * 100_000, "<div>" * 100_000, "</b>" * 200_000, "<li>" * 100_000, "<p>word</p>" * 100_000, "<div class=ad>" * 50_000, "&amp" * 300_000])
def test_time_grows_with_length(page):
    t0 = time.time()
    line_blocks.main_text(page)
    assert time.time() - t0 < 5
