"""Nested pages: the tag scan against trees of the standard library's parser."""
from html.parser import HTMLParser

from hypothesis import given, settings
from hypothesis import strategies as st

from corpuskit.functions.html import SITE_DROP
from corpuskit.functions.page_tree import VOID, Page, faq_pairs, site_text
from corpuskit.operators import text as D


class Tree(HTMLParser):
    """Nested lists [tag, attrs, child ...] with the same rule for end tags."""

    def __init__(self, html):
        super().__init__()
        self.root = ["", {}]
        self.open = [self.root]
        self.more = False       # the last thing read was text
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.more = False
        node = [tag, dict(attrs)]
        self.open[-1].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.more = False
        self.open[-1].append([tag, dict(attrs)])

    def handle_endtag(self, tag):
        self.more = False
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        if self.more:
            self.open[-1][-1] += data
        else:
            self.open[-1].append(data)
        self.more = True


def pieces(node):
    for x in node[2:]:
        if isinstance(x, str):
            if x.strip():
                yield x.strip()
        elif x[0] not in SITE_DROP:
            yield from pieces(x)


def elements(node):
    for x in node[2:]:
        if not isinstance(x, str) and x[0] not in SITE_DROP:
            yield x
            yield from elements(x)


names = st.sampled_from(["div", "nav", "p", "header", "ul", "li", "b", "br", "footer", "section", "style"])
bits = st.one_of(
    names.map(lambda t: f"<{t}>"), names.map(lambda t: f"</{t}>"), names.map(lambda t: f'<{t.upper()} class="a>{t}" id=x>'),
    names.map(lambda t: f"<{t}/>"), st.sampled_from(["one ", " two", "&lt;x&gt;", "a < b", "\n"]))


@settings(max_examples=400, deadline=None)
@given(st.lists(bits, max_size=30))
def test_scan_is_the_tree_of_a_parser(parts):
    # raw text up to its own end tag: an open style element swallows what follows in both
    html = "".join(parts).replace("<style/>", "")
    page, tree = Page(html), Tree(html)
    assert page.pieces == list(pieces(tree.root))
    nodes = list(elements(tree.root))
    assert page.tags == [n[0] for n in nodes] and page.attrs == [n[1] for n in nodes]
    assert [page.text(i) for i in range(len(nodes))] == ["".join(pieces(n)) for n in nodes]
    assert [page.last[i] - i - 1 for i in range(len(nodes))] == [len(list(elements(n))) for n in nodes]


def test_cut_ends_at_its_own_end_tag():
    assert site_text("a<nav>x<nav>y</nav>z</nav>b<header>h<header>i</header>j</header>c") == "a\nb\nc"
    assert site_text("a<nav>x</header>y</nav>b") == "a\nb"
    assert site_text("<div>a<nav>open</div>b") == "a\nb"            # the outer end closes it
    assert site_text("a<footer>open") == "a" and site_text("</nav>a</div>") == "a"
    assert site_text("<script>'</div><nav>'</script>a<style>nav{}</style>") == "a"
    assert site_text(None) == "" and site_text("") == "" and site_text("no markup") == "no markup"


def test_hostile_pages_take_one_scan():
    n = 60_000
    assert site_text("<div>" * n + "x") == "x"
    assert site_text("<nav>" * n + "x" + "</nav>" * n + "y") == "y"
    assert site_text("</div>" * n + "y") == "y"
    assert site_text('y<a b="' * n).startswith("y")
    assert site_text("y" + "<!--" * n) == "y"
    assert len(faq_pairs("<h2>Why?</h2><p>a</p>" * n)) == n
    assert len(faq_pairs('<div class="faq"><b class="title">q</b><b class="body">a</b></div>' * n)) == n


def test_faq_of_nested_markup():
    one = '<div class="faq-row"><div><span class="q-title">Q{0}</span></div><div class="x-body"><div><div>A{0}</div></div> tail{0}</div></div>'
    h = f'<section class="accordion">{one.format(1)}{one.format(2)}</section>'
    # the list itself fits and gives its first pair, as the rule has it
    assert faq_pairs(h) == [("Q1", "A1tail1", "accordion")] * 2 + [("Q2", "A2tail2", "accordion")]
    h = '<div itemtype="x/Question"><b itemprop="name">N</b></div><i itemprop="acceptedAnswer">outside</i>'
    assert faq_pairs(h) == []
    h = "<div><h3>How?</h3></div><p>not a sibling</p><h2>What</h2><div><p>deep</p></div><p>a</p><ul><li>x</ul><p>b</p><h4>end</h4><p>c</p>"
    assert faq_pairs(h) == [("What", "a b", "heading")]
    assert faq_pairs("<nav><h2>How?</h2><p>menu</p></nav><h2>Why?</h2>") == []


def test_faq_of_a_table(spark):
    rows = [(1, '<nav><nav></nav><h2>How?</h2><p>no</p></nav><h2>How so?</h2><p>Like this.</p>'), (1, "<h2>Why?</h2><p>x"), (None, None), (2, "")]
    got = D.faq_mine(spark.createDataFrame(rows, "page_id long, html string")).collect()
    assert sorted((r.page_id, r.input, r.output, r.pattern) for r in got) == [(1, "How so?", "Like this.", "heading"), (1, "Why?", "x", "heading")]
    assert D.faq_mine(spark.createDataFrame([], "page_id long, html string")).count() == 0
