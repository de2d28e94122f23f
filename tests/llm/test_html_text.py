import html
import random
import re

import pytest

from quarry.llm import html_text
from quarry.llm.html_text import main_text

FURNITURE = [
    '<header class="site"><h2>Site name</h2><a href="/">Home</a></header>', '<div id="cookie-notice">We use cookies, accept them all, please, now, thank you, dear reader of this page.</div>',
    '<aside>Related, more, and more things, to read, at length, in this column of the page.</aside>', '<div class="sidebar-left"><p>Latest posts, all of them, here, in a long list of words, with commas, too.</p></div>',
    '<form action="/s"><label>Name, please</label><input name=q><button>Send</button></form>', '<script>document.write("<p>not, this, one</p>")</script>', "<style>p > a { color: red }</style>", "<noscript>Turn it on</noscript>",
    '<div class="ad">Buy, buy, buy, now, cheap, today only, at the shop of shops, everything must go.</div>', '<ul class="menu"><li><a href="/a">A menu</a><li><a href="/b">Another</a></ul>', "<!-- <p>a comment, of the markup</p> -->",
]
AFTER = ['<section id="comments"><p>First, great post, I read it all, twice, and liked it, very much, thanks a lot!</p></section>', "<footer>&copy; 2020, All rights</footer>"]


def page(paragraphs, seed, wrapper="article", close=True):
    rnd = random.Random(seed)
    end = "</p>" if close else ""
    body = "".join(f"<p>{html.escape(p)}{end}" for p in paragraphs)
    open_, shut = {"article": ("<article>", "</article>"), "div": ('<div class="post-content">', "</div>"), "plain": ("<div>", "</div>")}[wrapper]
    before = rnd.sample(FURNITURE, 6)
    return "<!DOCTYPE html><html><head><title>T, t</title></head><body>" + "".join(before) + open_ + body + shut + "".join(AFTER) + ("</body></html>" if seed % 2 else "")


@pytest.mark.parametrize("wrapper", ["article", "div", "plain"])
@pytest.mark.parametrize("close", [True, False])
def test_planted_articles_come_back_whole(wrapper, close):
    for seed in range(40):
        rnd = random.Random(seed)
        text = [" ".join(rnd.choice(["alpha", "beta,", "R&D", "<x>", "é", "“q”", "end."]) for _ in range(rnd.randint(12, 90))) for _ in range(rnd.randint(1, 12))]
        assert main_text(page(text, seed, wrapper, close)) == "\n".join(text)


def test_blocks_references_and_white_space():
    got = main_text("<article><h1> A&nbsp;&amp; B </h1><p>One\n  <b>bold</b>&#233;&#x41;<br><br> <br>next<br/>line &am &lt;p&gt;<ul><li>x<li>y</ul>tail<table><tr><td>1<td>2</table></article>")
    assert got == "A & B\nOne boldéA\nnext line &am <p>\nx\ny\ntail\n1\n2"


@pytest.mark.parametrize("text", [None, "", "   ", "<html><body></body></html>", "<div", "<p", "<script>never closed"])
def test_nothing(text):
    assert main_text(text).strip() == ""


def test_odd_pages():
    assert main_text("just words") == "just words"
    assert main_text("<p>" * 3000 + "deep" + "</div>" * 10) == "deep"
    assert main_text("<div>" * 5000 + "deep words, many of them, in here, to be sure") == "deep words, many of them, in here, to be sure"
    assert len(main_text("<article>" + "<p>long, text</p>" * 50_000 + "</article>").split("\n")) == 50_000


def test_query(spark, tmp_path):
    rows = [(1, "u", "<article><p>é, ok</article>", 9), (2, None, None, 9), (1, "u", "<article><p>é, ok</article>", 9)]
    spark.createDataFrame(rows, "page_id long, url string, html string, text int").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(html_text.op2_html_extraction(spark, str(tmp_path)).collect())
    assert [tuple(r) for r in got] == [(1, "u", "é, ok", 5)] * 2 + [(2, None, "", 0)]


def test_plain_tables_against_regular_expressions(spark):
    """The small table's pages have one article each: what a plain expression finds there is the answer."""
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|br|h1)>", inner)]
        assert main_text(r.html) == "\n".join(p for p in parts if p)


LONG, SHORT = "Many words, of the text, with commas, go here, " + "and more follow " * 22, "A shorter part, of the same text, " + "goes on " * 20


def paragraphs(text, n):
    return "".join(f"<p>{text.strip()}</p>" for _ in range(n))


def test_all_parts_of_an_article_are_kept():
    got = main_text(f"<body><article><h1>Title</h1><section>{paragraphs(LONG, 10)}</section><section>{paragraphs(SHORT, 2)}</section></article></body>")
    assert got.split("\n") == ["Title"] + [LONG.strip()] * 10 + [SHORT.strip()] * 2
    got = main_text(f"<body><article><div><div class=body>{paragraphs(LONG, 5)}</div><h4>Steps</h4></div><ul><li>one<li>two</ul><pre>x = 1</pre><table><tr><td>3</table>loose <b>text</b>.</article></body>")
    assert got.split("\n") == [LONG.strip()] * 5 + ["Steps", "one", "two", "x = 1", "3", "loose text."]


def test_lists_of_links_beside_the_text_are_not():
    got = main_text(f"<body><div>{paragraphs(LONG, 5)}</div><ul><li><a href=/a>One page</a><li><a href=/b>Another page</a></ul><dl><dt>Term<dd>meaning</dl></body>")
    assert got.split("\n") == [LONG.strip()] * 5 + ["Term", "meaning"]


@pytest.mark.parametrize("wrapper", ['div class="has-sidebar"', 'div class="content-with-sidebar"', 'div class="no-header"', 'div id="col-search"', "form id=aspnetForm", 'div class="no-comments"'])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_wrappers_named_after_furniture(wrapper, inner):
    aside = f'<div class="sidebar"><p>{SHORT}</p></div><div id="comments">{paragraphs(LONG, 9)}</div>'
    got = main_text(f"<body><{wrapper}><div class='no-menu'><{inner}>{paragraphs(LONG, 3)}</{inner}></div>{aside}</{wrapper.split()[0]}></body>")
    assert got.split("\n") == [LONG.strip()] * 3


@pytest.mark.parametrize("mark", ["article-comments", "entry-footer", "main-menu", "story-related"])
def test_furniture_inside_the_article(mark):
    got = main_text(f'<article><header class="entry-header"><h2>Title</h2></header>{paragraphs(LONG, 3)}<div class="{mark}"><p>{SHORT}</p></div></article>')
    assert got.split("\n") == ["Title"] + [LONG.strip()] * 3


@pytest.mark.parametrize("wrapper", ["no-sidebar", "content-sidebar-wrap", "layout-with-sidebar", "has-header", "page-wrap ad-free", "single comments-open", "tagged search-result", "search-page"])
def test_wrappers_of_themes_keep_the_article(wrapper):
    inner = "".join(f"<p>{LONG}</p>" for _ in range(4))
    for body in (f"<article>{inner}</article>", f"<div>{inner}</div>"):
        assert main_text(f'<body><div class="menu"><a href="/">Home</a></div><div class="{wrapper}">{body}</div></body>').count("Many words") == 4


@pytest.mark.parametrize("broken", ["<b>{x}</i>", "<i><div>{x}</i>", "<b><h1>{x}", "<b><li>{x}", "<table><td><b>{x}</tr></p>", "<blockquote>{x}", "<p><b>{x}</div>", "<a><td>{x}<tr></u>"])
def test_broken_markup_costs_no_more_than_good(broken):
    import time

    def seconds(n):
        took = []
        for page in ("".join(broken.format(x="w, ") for _ in range(n)), broken.partition("{x}")[0] * n + "words, " + broken.partition("{x}")[2] * n):
            began = time.thread_time()
            main_text(page)
            took.append(time.thread_time() - began)
        return max(took)

    seconds(500)
    assert seconds(32_000) < 16 * seconds(4000) + 0.2
