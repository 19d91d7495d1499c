"""Main text of web pages by tree scoring.

A page becomes a tree of elements. What is never article (menus, page headers and footers, sidebars,
forms, scripts, notices, adverts, reader comments) is cut off by element, role and name, unless it holds
the prose of the article: a form around the page, or a block of the article with an ambiguous name. Every
paragraph that is left scores points for its commas and its length, and passes them on to its
ancestors, less with every level; an element's sum is discounted by its share of link text. The best
container is kept together with those siblings that read like a part of the same article, and with other
articles of the page that score.

One page is one row: no page needs another, so the work is a map over rows, in Arrow batches.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[a-zA-Z/!?][^>]*(?:>|\Z)|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]*))?""")
WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")

# HTML element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template svg math".split())
BLOCK = frozenset("""address article aside blockquote body button center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre
section select summary table caption tbody td tfoot th thead tr ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the key ends open elements of the first set, up to one of the second.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup"}),
}
# What is never article.
NEVER = frozenset("""head nav footer aside form button select option input label fieldset dialog menu object embed
canvas audio video""".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
NAMES = frozenset("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo
promos promotion banner menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars sidenav aside widget widgets
footer masthead topbar toolbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe
subscription signup login share sharing shares social related recommended recommendations comment comments commentlist
disqus discussion respond reply replies pagination pager paging search skip outbrain taboola paywall copyright legal
disclaimer alert tracking""".split())
# Of these names, the ones that blocks of an article have as well: they are cut only where little prose is inside.
AMBIGUOUS = frozenset("alert legal overlay paging promotion search skip social subscription tracking widget widgets".split())
OWN = frozenset("article entry post story content".split())
ARTICLES = frozenset("article main".split())
SCORED = frozenset("p pre td blockquote li dd figcaption".split())
DEPTH = 512  #: deeper elements become siblings, as in browsers
LINKS = 0.25  #: most link text of a sibling that joins the container
PROSE = 80  #: least characters of a paragraph that reads like a part of an article
PROSE_TAGS = frozenset("p pre blockquote li dd td".split())
SHORT = frozenset("p pre blockquote ul ol dl table figure details".split())  # siblings kept at any length if free of links
SENTENCE = tuple(".!?:…。！？\"'”’»)")
RIGHTS = re.compile(r"\s*(?:©|\(c\)|copyright\b)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "parent", "inner", "size", "links", "score", "holds", "wraps", "prose", "beside", "asks")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.inner: list = []  # text and elements in order
        self.size = self.links = 0  # characters, those in links
        self.score = 0.0
        self.holds = False  # the first article, main or h1
        self.wraps = False  # the first article or main
        self.prose = self.beside = 0  # characters of paragraphs inside, of the longest one directly inside
        self.asks = False  # an input field


def parse(html: str) -> list[Node]:
    """All elements in the order in which they begin; the first is the root."""
    root = Node("html", "", None)
    nodes, stack, at, end = [root], [root], 0, len(html)
    while at < end:
        m = TOKEN.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                stack[-1].inner.append(m[0])
            continue
        tag = tag.lower()
        if m[1]:
            _close(stack, tag)
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                stop = re.compile(f"</{tag}[^>]*(?:>|\\Z)", re.I).search(html, at)
                at = stop.end() if stop else end
            continue
        if tag == "html":
            continue
        if tag in BLOCK:
            _close_paragraph(stack)
        if tag in ENDS:
            ended, scope = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ended:
                    del stack[k:]
                    if tag != "tr":
                        break
                elif stack[k].tag in scope:
                    break
        node = Node(tag, m[3], stack[-1])
        stack[-1].inner.append(node)
        nodes.append(node)
        if tag not in VOID and not m[3].rstrip().endswith("/") and len(stack) < DEPTH:
            stack.append(node)
    return nodes


def _close_paragraph(stack: list[Node]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == "p":
            del stack[k:]
            return
        if stack[k].tag in BLOCK:
            return


def _close(stack: list[Node], tag: str) -> None:
    inline = tag not in BLOCK
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if inline and stack[k].tag in BLOCK:
            return


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in ATTRIBUTE.findall(raw):
        out.setdefault(k.lower(), unescape(v[1:-1] if v[:1] in ("'", '"') else v))
    return out


def never_article(node: Node, prose: int = 0) -> bool:
    """Whether the element is cut off with all it holds. ``prose``: characters of all paragraphs of the page."""
    if node.tag in ("html", "body") or node.tag in ARTICLES and not node.attrs:
        return False
    if node.tag == "form" and (node.wraps or node.prose >= 200 and 2 * node.prose >= prose):
        return False
    if node.tag in NEVER:
        return True
    a = _attributes(node.attrs) if node.attrs.strip() else {}
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
        return True
    if node.tag == "header":
        return not (node.holds and _inside_article(node))
    if a.get("role", "").lower() in ROLES:
        return True
    names = {w.lower() for w in WORDS.findall(a.get("class", "") + " " + a.get("id", ""))}
    if node.holds or not names:
        return False
    found = names & NAMES
    if found and found <= AMBIGUOUS and node.prose >= PROSE and not node.asks and _density(node) < LINKS and (
            2 * node.prose >= prose or _inside_article(node) or node.parent.tag != "body" and node.parent.beside >= PROSE):
        return False
    return bool(found) or "header" in names and not names & OWN


def _inside_article(node: Node) -> bool:
    up = node.parent
    while up is not None:
        if up.tag in ARTICLES:
            return True
        up = up.parent
    return False


def _squeezed(parts: list[str]) -> str:
    return " ".join(unescape("".join(parts)).split())


def _cut(nodes: list[Node]) -> None:
    """Take out what is never article. The first article, main and h1 elements mark what is around
    them as more than a sidebar, whatever its name."""
    for tag in ("article", "main", "h1"):
        up = next((n for n in nodes if n.tag == tag), None)
        while up is not None and not (up.holds and (up.wraps or tag == "h1")):
            up.holds, up.wraps = True, up.wraps or tag != "h1"
            up = up.parent
    _weigh(nodes)
    gone = {id(n) for n in nodes[1:] if never_article(n, nodes[0].prose)}
    for n in nodes if gone else ():
        n.inner = [x for x in n.inner if id(x) not in gone]


def _weigh(nodes: list[Node]) -> None:
    """Prose of every element before anything is cut; what counts then starts again from nothing."""
    if not any(n.tag == "form" or n.attrs and AMBIGUOUS & {w.lower() for w in WORDS.findall(n.attrs)} for n in nodes):
        return
    for n in reversed(_measure(nodes[0])):
        if n.tag in PROSE_TAGS:
            n.prose = max(n.prose, n.size - n.links)
        n.asks |= n.tag in ("input", "select")
        if n.parent is not None:
            n.parent.prose += n.prose
            n.parent.asks |= n.asks
            if n.tag in PROSE_TAGS:
                n.parent.beside = max(n.parent.beside, n.size - n.links)


def _measure(root: Node) -> list[Node]:
    """Characters and link characters of every element below ``root``; elements in page order."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        n.size = n.links = 0
        todo.extend(x for x in reversed(n.inner) if type(x) is Node)
    for n in reversed(order):
        n.size += sum(len(x.strip()) for x in n.inner if type(x) is str)
        if n.tag == "a":
            n.links = n.size
        if n.parent is not None and n is not root:
            n.parent.size += n.size
            n.parent.links += n.links
    return order


def _density(n: Node) -> float:
    return n.links / n.size if n.size else 0.0


def _score(order: list[Node]) -> None:
    for n in order:
        own = n.tag in SCORED or any(type(x) is str and x.strip() for x in n.inner) and n.tag in BLOCK
        if not own or n.parent is None:
            continue
        text = "".join(x if type(x) is str else _flat(x) for x in n.inner)
        length = len(text.strip())
        if not length:
            continue
        points = 1 + text.count(",") + text.count("，") + min(length / 100, 3)
        up, level = n.parent, 0
        while up is not None:
            up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.parent, level + 1
    for n in order:
        n.score *= 1 - _density(n)


def _flat(node: Node) -> str:
    """Text of the inline elements of a paragraph; blocks inside score for themselves."""
    parts, todo = [], [node]
    while todo:
        n = todo.pop()
        if type(n) is str:
            parts.append(n)
        elif n.tag not in BLOCK:
            todo.extend(reversed(n.inner))
    return "".join(parts)


def _container(order: list[Node]) -> list[Node]:
    """The best container, grown to the article around it, with the siblings that belong to it and the
    other articles of the page, in page order. A container that is no article element may be a part of
    the text only: then short paragraphs, lists and bare text beside it belong to it if they hold no link
    and, right below the body, end like a sentence."""
    best = max(order, key=lambda n: n.score)
    up = best
    while up is not None and up.tag not in ARTICLES:
        up = up.parent
    if up is not None:
        best = up
    if best.parent is None or best.tag in ("html", "body"):
        return [best]
    least, partial = max(2.0, 0.2 * best.score), best.tag not in ARTICLES
    around, up = set(), best
    while up is not None:
        around.add(id(up))
        up = up.parent

    def belongs(n: Node) -> bool:
        if n is best:
            return True
        if _density(n) >= LINKS or n.tag == "article":
            return False
        return n.score >= least or n.tag in HEADINGS or n.tag in SCORED and n.size >= PROSE or (
            partial and n.tag in SHORT and n.size > 0 and not n.links and _sentence(_all(n), best.parent))

    out, todo = [], [order[0]]
    while todo:
        n = todo.pop()
        if n.parent is best.parent and belongs(n) or (
                n.tag == "article" and id(n) not in around and _density(n) < LINKS and n.score >= least):
            out.append(n)
        elif n is best.parent:
            todo.extend(reversed(_with_bare_text(n, best) if partial else [x for x in n.inner if type(x) is Node]))
        else:
            todo.extend(x for x in reversed(n.inner) if type(x) is Node)
    return out


def _sentence(text: str, parent: Node) -> bool:
    text = unescape(text).strip()
    return any(c.isalnum() for c in text) and not RIGHTS.match(text) and (parent.tag not in ("html", "body") or text.endswith(SENTENCE))


def _all(node: Node) -> str:
    """All text of an element."""
    parts, todo = [], [node]
    while todo:
        n = todo.pop()
        if type(n) is str:
            parts.append(n)
        else:
            todo.extend(reversed(n.inner))
    return "".join(parts)


def _with_bare_text(parent: Node, best: Node) -> list[Node]:
    """The elements in ``parent``; text between them and the inline elements in it are put into paragraphs."""
    out, run = [], []

    def end():
        line = Node("p", "", parent)
        line.inner = run[:]
        line.size = sum(x.size if type(x) is Node else len(x.strip()) for x in run)
        line.links = sum(x.links for x in run if type(x) is Node)
        out.extend([line] if any(type(x) is str and x.strip() for x in run) else [x for x in run if type(x) is Node])
        run.clear()

    for x in parent.inner:
        if type(x) is Node and (x.tag in BLOCK or x is best or x.score > 0):
            end()
            out.append(x)
        else:
            run.append(x)
    end()
    return out


def blocks(roots: list[Node]) -> list[str]:
    """Texts of the blocks below ``roots`` in page order, white space squeezed, empty ones left out."""
    out, parts, todo = [], [], list(reversed(roots))

    def end():
        if parts and (text := _squeezed(parts)):
            out.append(text)
        parts.clear()

    while todo:
        n = todo.pop()
        if type(n) is str:
            parts.append(n)
        elif n is None:
            end()
        elif n.tag == "br":
            parts.append(" ")
        elif n.tag in BLOCK:
            end()
            todo.append(None)
            todo.extend(reversed(n.inner))
        else:
            todo.extend(reversed(n.inner))
    end()
    return out


def main_text(html: str | None) -> str:
    """Main text of one page; NULL, empty, and pages without an article give the empty string.

    Blocks are joined by a line break; unclosed and misplaced tags are read as browsers mostly do;
    a page without markup is one block. Nesting of any depth is walked without recursion.
    """
    if not html:
        return ""
    nodes = parse(html)
    _cut(nodes)
    order = _measure(nodes[0])
    _score(order)
    return "\n".join(blocks(_container(order)))


def extracted(pages: DataFrame, keep: tuple = ("page_id", "url")) -> DataFrame:
    """``keep`` columns of every row plus ``text``, the main text of its whole ``html``. Repeated
    rows stay, an empty table gives an empty result, other columns are not read."""
    rows = pages.select(*keep, F.col("html").cast("string").alias("__html"))

    def run(batches):
        for whole in batches:
            for b in slices(whole, "__html", 1 << 22):
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:-1], pa.array([main_text(x.as_py()) for x in b.column("__html")], pa.string())],
                    [*b.schema.names[:-1], "text"])

    return rows.mapInArrow(run, pages.select(*keep).schema.add("text", "string"))
