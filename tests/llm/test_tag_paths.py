import html as H
import re

import pytest

from skuloom.llm.queries import QUERIES
from skuloom.llm.tag_paths import extract, main_text
from llm_cases import SF

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><div class="cookie-notice">We use</div>
<nav><ul><li><a href=1>home</a><li><a href=2>news</a></ul></nav><main><article><h1>Title</h1><p>One.  <a href=x>link</a>
two &amp; three&hellip;</p><aside>side</aside><ul><li>a<li>b</ul><div class="ad">buy</div><script>var a="</p>";</script>
<form><p>mail</p></form><blockquote>Said <b>so</b>.</blockquote><section id="comments"><article class=comment><p>me too</p></article></section>
</article></main><div class="sidebar">more</div><footer>&copy; us</footer></body></html>"""


def test_article():
    assert main_text(PAGE) == "Title\n\nOne. link two & three…\n\na\n\nb\n\nSaid so."


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("plain  text", "plain text"),
        ("<div", ""),
        ("<p>one<p>two<br>three", "one\n\ntwo three"),
        ("<div id=c><p>Long enough text, with marks. And more of it, indeed.</p><p>x</p></div><div class=menu><a>q</a></div>", "Long enough text, with marks. And more of it, indeed.\n\nx"),
        ("<script>while(1){}", ""),
        ("<article><p>&lt;b&gt; &#233;&#x1F642;</p></article>", "<b> é🙂"),
    ],
)
def test_small_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        ('<div><p class="text-[18px]">A</p><p>B</p><p>C</p></div>', "A\n\nB\n\nC"),
        ('<div class="w-[90%]"><p>around it</p><article><p>Long enough.</p></article><p>after it</p></div>', "Long enough."),
    ],
)
def test_brackets_in_classes(page, text):
    assert main_text(page) == text


LONG = "A long paragraph, with marks; and more of it, said at length. " * 6
PARTS = [f"{k} {LONG.strip()}" for k in range(10)]
SECTION = "<div class=section>" + "".join(f"<p>{p}</p>" for p in PARTS) + "</div>"


@pytest.mark.parametrize(
    "page,blocks",
    [
        (f"<div class=content><h1>Title</h1><p>The lead.</p>{SECTION}</div>", ["Title", "The lead.", *PARTS]),
        (f"<body>{SECTION}<ul><li>one</li><li>two</li></ul><div><blockquote>Said so</blockquote></div></body>", [*PARTS, "one", "two", "Said so"]),
        (f"<div>{SECTION}</div><div class=second><h2>Second</h2><p>Short text.</p></div>", [*PARTS, "Second", "Short text."]),
        (f"<article><h2>One</h2><p>Short.</p></article>{SECTION.replace('div', 'article')}<div>beside</div>", ["One", "Short.", *PARTS]),
        (f"<div>{SECTION}<div class=l>" + "".join(f"<p><a href=x>go {k}</a></p>" for k in range(9)) + "</div></div>", PARTS),
        (f"<nav><p>menu</p></nav><div>{SECTION}<p>End.</p></div><footer>foot</footer>", [*PARTS, "End."]),
    ],
)
def test_blocks_beside_the_heaviest(page, blocks):
    assert main_text(page) == "\n\n".join(blocks)


def test_query_against_the_article_element(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op9_tag_path_ratios"](spark, SF).collect():
        inner = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]).replace("<br>", " ")
        blocks = (" ".join(H.unescape(x).split()) for x in re.split(r"</?(?:p|h\d|ul|li|div|blockquote)>", inner))
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_frames(spark):
    df = spark.createDataFrame([(1, None, "old"), (None, "<p>" + "word, " * 50_000 + "</p>", None), (1, "<p>a", "b")], "page_id int, html string, text string")
    got = extract(df).collect()
    assert [len(r.text) for r in got] == [0, 6 * 50_000 - 1, 1]
    assert extract(df.limit(0)).collect() == []


SENTENCES = "This is a long paragraph of the article, with commas, and sentences. It goes on and on, as they do. " * 5
STORY = f"<h1>The title</h1><p>{SENTENCES}</p><p>Second. {SENTENCES}</p>"
NAV = "<nav><a href=a>Home</a> <a href=b>News</a></nav><ul class=menu><li><a href=c>One</a></li><li><a href=d>Two</a></li></ul>"
LAYOUTS = {
    "class of the article": f"<article class='post comments-open'>{STORY}</article>",
    "class of the wrapper": f"<div class='layout no-sidebar'>{NAV}<article>{STORY}</article></div>",
    "page in a form": f"<form id=aspnetForm>{NAV}<div>{STORY}</div></form>",
    "plain divisions": f"{NAV}<div><div>{STORY}</div></div>",
    "body alone": f"{NAV}{STORY}",
    "table": f"{NAV}<table><tr><td>{STORY}</td></tr></table>",
    "section with a search id": f"{NAV}<section id=search-results>{STORY}</section>",
    "role of the page": f"{NAV}<div role=dialog>{STORY}</div>",
    "social wrapper": f"<div class='social share'><div class=sidebar><a href=x>Elsewhere</a></div><div>{STORY}</div></div>",
    "cards beside it": f"{NAV}<div class=content>{STORY}</div><article><a href=q>Card one</a></article><article><a href=r>Card two</a></article>",
    "comments below": f"{NAV}<div>{STORY}</div><div id=comments><p>First! {SENTENCES}</p></div><div class=cookie-notice>We use cookies.</div>",
    "header of the article": f"<article><header><h1>The title</h1></header><p>{SENTENCES}</p><p>Second. {SENTENCES}</p></article><footer>Foot</footer>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_the_whole_article_comes_out_of_any_layout(name):
    want = "\n\n".join(["The title", SENTENCES.strip(), "Second. " + SENTENCES.strip()])
    assert main_text(f"<html><body>{LAYOUTS[name]}</body></html>") == want


def test_deep_pages_take_time_in_proportion():
    deep = "<div>" * 4000 + "<p>Deep. text</p>" * 50 + "</div>" * 4000
    assert main_text(deep) == "\n\n".join(["Deep. text"] * 50)
