import pytest

from corpuskit.llm.html_extract import DEPTH, extracted, main_text, parse

LAYOUT = """<html><head><title>Not this</title></head><body><div id="wrap"><div class="site-header"><a href=/>Home</a></div>
<ul class=menu><li><a href=1>One</a><li><a href=2>Two</a></ul>
<div id=content><h1>Title &amp; more</h1><p>First paragraph, with commas, and text that is long
 enough to score &eacute; well.</p><div class="ad">Buy now, cheap, best</div><ul><li>item one, is good</li><li>item two</li></ul>
<pre>code   x
 y</pre><table><tr><td>cell a<td>cell b<tr><td>c</table><blockquote>Quote text, is here too</blockquote></div>
<div id="sidebar"><p>Some sidebar text, that has, commas.</p></div><div class="cookie-notice">We use cookies, sorry, yes</div>
<div class="comments"><div class="comment"><p>I, think, this is, great, and a long comment, indeed.</p></div></div>
<form><label>Name</label><input></form><footer>&copy; x</footer></div><script>var t = "<p>no</p>"</script></body></html>"""


def test_layout():
    assert main_text(LAYOUT).split("\n") == [
        "Title & more", "First paragraph, with commas, and text that is long enough to score é well.", "item one, is good", "item two",
        "code x y", "cell a", "cell b", "c", "Quote text, is here too"]


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("   ", ""), ("plain  text &amp;\n more", "plain text & more"), ("<script>x</script>", ""),
    ("<p>a<p>b<br>c", "a\nb c"), ("<p><b>a<br><p>b</b>", "a\nb"), ("<![foo[x]]>a", "a"), ("<!-- <p>no</p> -->a", "a"), ("<!-- open", ""),
    ("a < b <c", "a < b"), ("<p>x&nbsp; y&#233;</p>", "x yé"), ("<P CLASS='x>y'>t</P>", "t"), ("<article><p>a</p></article><aside><p>b</p></aside>", "a"),
    ("<article><header><h1>t</h1></header><p>b, c</p><footer>f</footer></article>", "t\nb, c"), ("<nav><a>x</a></nav>", ""),
    ("<article><p>one, two</p></article><section id=comments><article><p>no, no, no, no, no, no</p></article></section>", "one, two"),
])
def test_cases(html, text):
    assert main_text(html) == text


P = "Paragraph {}, with commas, and enough words, to read like a part of the article that it is in."
MENU = "<ul class=nav><li><a href=1>One</a><li><a href=2>Two</a></ul>"


def post(*numbers):
    return "".join(f"<p>{P.format(i)}</p>" for i in numbers)


def lines(*numbers):
    return [P.format(i) for i in numbers]


@pytest.mark.parametrize(("html", "want"), [
    # a form around the whole page: its fields and buttons go, its article stays
    (f"<body><form action=/x><input name=state>{MENU}<div><h2>Title</h2>{post(1, 2, 3)}</div><button>Send</button></form></body>", ["Title", *lines(1, 2, 3)]),
    (f"<form><article><p>Short, yes.</p></article><select><option>no</select></form><form><p>Search, here.</p></form>", ["Short, yes."]),
    (f"<div>{post(1, 2, 3)}</div><form class=contact><p>{P.format('in a form')}</p><input></form>", lines(1, 2, 3)),
    (f"<article>{post(1)}<form><p>{P.format('in a form')}</p><input></form></article>", lines(1)),
    # names that blocks of an article have as well
    (f"<article>{post(1)}<div class='social history'>{post(2)}</div><div class=legal>{post(3)}</div></article>", lines(1, 2, 3)),
    (f"<div id=c>{post(1, 2)}<div class='social history'>{post(3)}</div><div class='social'><a href=1>Share</a></div></div>", lines(1, 2, 3)),
    (f"<div id=c>{post(1, 2)}<div class=legal>Terms apply.</div><div class=sidebar>{post(3)}</div><div class=comments>{post(4)}</div></div>", lines(1, 2)),
    (f"<div class=widget><div class=widget-content>{post(1, 2)}</div></div><div class=widget><p>Tags, tags.</p></div>", lines(1, 2)),
    (f"<div id=c>{post(1, 2)}<div class=search>{post(3)}<input></div></div>", lines(1, 2)),
    # short parts beside the container
    (f"<div id=c><div>{post(1, 2, 3)}</div><p>The end.</p><ul><li>one<li>two</ul>Bare <b>text</b>, too<ul><li><a href=1>Other</a></ul></div>",
     [*lines(1, 2, 3), "The end.", "one", "two", "Bare text, too"]),
    (f"<body>Before it.<div>{post(1, 2, 3)}</div><p>The end.</p>|<p>Menu</p><p>© 2020 Me.</p><p>Copyright me.</p></body>", ["Before it.", *lines(1, 2, 3), "The end."]),
    (f"<body>Before it.<article>{post(1, 2, 3)}</article><p>Powered by x.</p></body>", lines(1, 2, 3)),
    (f"<div>text <x-part>{post(1, 2, 3)}</x-part> more</div>", ["text", *lines(1, 2, 3), "more"]),
    # a second article
    (f"<main><article>{post(1, 2)}</article><article>{post(3, 4)}</article><article><a href=1>Read this, too</a></article></main>", lines(1, 2, 3, 4)),
    (f"<div><section><article>{post(1)}</article></section></div><section><article>{post(2, 3)}</article></section><aside><article>{post(4)}</article></aside>",
     lines(1, 2, 3)),
])
def test_parts_of_an_article(html, want):
    assert main_text(html).split("\n") == want


def test_depth_and_width():
    assert main_text("<div>" * 50000 + "deep, text") == "deep, text"
    assert max(_depth(n) for n in parse("<div>" * 3000)) <= DEPTH
    assert main_text("<li>x" * 3000).count("x") == 3000
    assert main_text("<form>" * 400 + post(1, 2, 3)).split("\n") == lines(1, 2, 3)
    assert main_text("<div class=social>" * 400 + post(1)).split("\n") == lines(1)
    assert main_text("<p>" + "word, " * 200000).startswith("word, word,")


def _depth(n):
    d = 0
    while n.parent is not None:
        n, d = n.parent, d + 1
    return d


def test_pages(spark, sf):
    """The generated pages hold their article in one element: all its blocks and nothing else."""
    import re
    from html import unescape
    got = extracted(spark.read.parquet(f"{sf}/pages.parquet"), ("page_id", "url", "html")).collect()
    assert got
    for r in got:
        inner = re.sub(r"</?(?:p|h1)>", "\0", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        want = [" ".join(unescape(re.sub(r"<[^>]*>", " " if "<br" in x else "", x)).split()) for x in inner.split("\0")]
        assert r.text.split("\n") == [x for x in want if x]


def test_frame(spark):
    rows = [(1, "u", LAYOUT, "t"), (1, "u", LAYOUT, "t"), (None, None, None, None), (2, "v", "", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extracted(df).collect()
    assert sorted(len(r.text) for r in got)[:2] == [0, 0] and len(got) == 4 and got[0].asDict().keys() == {"page_id", "url", "text"}
    assert extracted(df.limit(0)).count() == 0
