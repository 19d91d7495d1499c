from pyspark.sql import functions as F

from corpuskit.functions.chunking import chunk_text
from corpuskit.operators import text as D


def test_chunk_index_profile_rules():
    text = ("Alpha beta gamma. " * 40).strip()
    chunks = chunk_text(text, "index", 100, 10)
    assert all(len(c) <= 100 for c in chunks)
    assert all(c.endswith(".") for c in chunks[:-1])  # cut after ". " then stripped
    # every character of the text is inside some chunk (overlapping cover)
    joined = "".join(chunks)
    assert set(text.split()) <= set(joined.split())


def test_chunk_knowledge_short_and_paragraph():
    assert chunk_text("  short text  ", "knowledge") == ["short text"]
    t = "a" * 300 + "\n\n" + "b" * 300
    c = chunk_text(t, "knowledge", 500, 50)
    assert c[0] == "a" * 300


def test_chunk_rejects_large_overlap():
    import pytest
    with pytest.raises(ValueError):
        chunk_text("x", "index", 100, 50)


def test_chunk_documents_ids(spark):
    d = spark.createDataFrame([(1, "Hello world. " * 100)], "doc_id long, text string")
    c = D.chunk_documents(d, "doc_id", "text", "index", 200, 20).orderBy("chunk_index").collect()
    import hashlib
    first = c[0]
    assert first.chunk_id == hashlib.md5(f"1:0:{first.content[:50]}".encode()).hexdigest()[:12]
    assert {r.total_chunks for r in c} == {len(c)}


def _html(spark, h, profile):
    return D.html_text(spark.createDataFrame([(1, h)], "page_id long, html string"), profile=profile).first()


def test_html_profiles(spark):
    h = "<html><head><title>T</title><style>x{}</style></head><body><nav>menu</nav><p>One &amp; two</p><div>three</div><script>bad()</script><footer>f</footer></body></html>"
    wiki = _html(spark, h, "wiki").text
    assert "bad()" not in wiki and "x{}" not in wiki and "One & two" in wiki and "menu" in wiki
    site = _html(spark, h, "site")
    assert site.text.split("\n") == ["T", "One & two", "three"] and site.title == "T"
    assert _html(spark, "<b>a</b> <i>b</i>", "strip").text == "a b"


def test_html_references_and_broken_pages(spark):
    assert _html(spark, "&#233;&#x1F600;&lt;b&gt; &amp;lt; &#xD800; & &#0; &unknown;", "strip").text == "é😀<b> &lt; &#xD800; & &#0; &unknown;"
    assert _html(spark, "<li>" * 1500 + "x" + "<div>" * 3000 + "y<![foo[x]]>", "wiki").text.split() == ["x", "y"]
    assert _html(spark, "a<script>open", "wiki").text == "a" and _html(spark, "a<!-- open", "site").text == "a"


def test_faq_structure_rules(spark):
    h = """<div itemscope itemtype="https://schema.org/Question"><span itemprop="name">What is X?</span>
    <div itemprop="acceptedAnswer"><p>X is a thing.</p></div></div>
    <div class="faq-item"><div class="question">Q one</div><div class="answer">A one</div></div>
    <h2>How do I start?</h2><p>Open the app.</p><p>Then click.</p><h2>Other</h2><p>no</p>"""
    got = {(r.input, r.output, r.pattern) for r in D.faq_structure(spark.createDataFrame([(1, h)], "page_id long, html string")).collect()}
    assert got == {("What is X?", "X is a thing.", "schema"), ("Q one", "A one", "accordion"), ("How do I start?", "Open the app. Then click.", "heading")}


def test_faq_text_pattern(spark):
    d = spark.createDataFrame([(1, "Q: How long does it take? A: About ten minutes usually. Q: x A: y")],
                              "page_id long, text string")
    r = D.faq_text(d, "page_id", "text").collect()
    assert [(x.input, x.output) for x in r] == [("How long does it take?", "About ten minutes usually.")]


def test_paragraph_section_markdown(spark):
    t = "# Intro\nThis is the introduction text that is long enough.\n\n## Setup?\nInstall things carefully, then run them."
    d = spark.createDataFrame([("Doc", t)], "title string, text string")
    p = D.paragraph_samples(d, "title", "text", 10).collect()
    assert [x.input for x in p] == ["Doc - Paragraph 1", "Doc - Paragraph 2"]
    s = D.section_samples(d, "title", "text", 10).collect()
    assert [x.input for x in s] == ["Intro", "Setup?"]
    m = D.markdown_samples(d.withColumn("id", F.lit(1)), "id", "text").collect()
    assert [x.input for x in m] == ["What is Intro?", "Setup?"]


def test_content_to_samples_pairs(spark):
    t = "What is the plan for today?\n\nWe will ship the release and test it.\n\nlower start here\n\nanother answer here"
    d = spark.createDataFrame([(1, t)], "doc_id long, text string")
    r = D.content_to_samples(d, "doc_id", "text").collect()
    assert [(x.input, x.output) for x in r] == [("What is the plan for today?", "We will ship the release and test it.")]


def test_line_qa_and_markdown_qa(spark):
    t = "Q: first?\nQ: second?\nA: answer two\nA: orphan\nQ: third Q: x?\nA: answer three\nQ: four?\nQ:\nA: lost"
    d = spark.createDataFrame([(1, t)], "doc_id long, text string")
    r = sorted((x.input, x.output) for x in D.line_qa(d, "doc_id", "text").collect())
    assert r == [("second?", "answer two"), ("third  x?", "answer three")]
    md = "Intro\nQuestion: What is it?\nAnswer: A tool.\n\n## How do I use it?\n\nRun the command.\n## Notes\n\nplain"
    d2 = spark.createDataFrame([(1, md)], "doc_id long, text string")
    got = {(x.input, x.output, x.pattern) for x in D.markdown_qa(d2, "doc_id", "text").collect()}
    # the Q/A body runs to the next "Q:" or the end (as the reference pattern does)
    assert ("What is it?", "A tool.\n\n## How do I use it?\n\nRun the command.\n## Notes\n\nplain", "qa") in got
    assert ("How do I use it?", "Run the command.", "heading") in got
    assert not any(x[0] == "Notes" for x in got)


TITLE_RULES = [("install", ["Setting up?", "First run?", "Later?"]), ("trouble|fault", ["Broken?", "Stuck?"])]
GENERIC = ["About {a}?", "More on {a}?", "{t}, again?"]
CUES = [(r"(?i)step|\d+\.\s", "Steps of {t}?"), (r"(?i)command|```", "Commands?")]


def test_manual_sections_and_questions(spark):
    t = ("preface dropped\nINSTALLATION\nrun the installer now\nTroubleshooting\n===\nif it fails, restart\n"
         "2. Safety rules\nwear gloves\n## Empty\nLAST\n\n")
    d = spark.createDataFrame([(1, t)], "doc_id long, text string")
    s = {x.title: x.content for x in D.manual_sections(d, "doc_id", "text").collect()}
    # numbered headers are titled by their number; a header needs at least one body line
    assert s == {"INSTALLATION": "run the installer now", "Troubleshooting": "if it fails, restart", "2.": "wear gloves",
                 "LAST": ""}
    secs = D.manual_sections(d, "doc_id", "text")
    q = D.questions_for_sections(secs, TITLE_RULES, GENERIC, CUES, k=2, min_len=5).collect()
    by = {}
    for r in q:
        by.setdefault(r.title, []).append((r.q, r.input))
    assert [x for _, x in sorted(by["INSTALLATION"])] == ["Setting up?", "First run?"]
    assert [x for _, x in sorted(by["Troubleshooting"])] == ["Broken?", "Stuck?"]
    q4 = D.questions_for_sections(secs, TITLE_RULES, GENERIC, CUES, k=4, min_len=5).collect()
    assert "Commands?" not in {r.input for r in q4}
    cmd = spark.createDataFrame([(1, 1, "Usage", "run the command now")], "doc_id long, sec int, title string, content string")
    got = [r.input for r in D.questions_for_sections(cmd, TITLE_RULES, GENERIC, CUES, k=4, min_len=5).orderBy("q").collect()]
    assert got == ["About usage?", "More on usage?", "usage, again?", "Commands?"]


def test_markdown_recipe(spark):
    t = "# Setup\nInstall it.\n#Usage guide #\nRun it.\n## Empty\n"
    d = spark.createDataFrame([(1, t)], "doc_id long, text string")
    got = [(r.input, r.output) for r in D.markdown_recipe(d, "doc_id", "text").orderBy("k").collect()]
    assert got == [("What is Setup?", "Install it."), ("What is Usage guide?", "Run it.")]


def test_best_snippet_scores_every_window(spark):
    """All windows are scored; the winner is the first in (most tokens, earliest start)."""
    texts = [("lorem ipsum " * 30) + "alpha beta gamma " + ("dolor sit " * 30), "alpha " * 20, "x" * 900, ("gamma " + "y" * 190) * 4, "a" * 200]
    d = spark.createDataFrame([(t, "alpha gamma") for t in texts], "text string, q string")
    for r in D.best_snippet(d, "text", "q").collect():
        t = r.text
        windows = {s: sum(k in t[s:s + 200].lower() for k in ("alpha", "gamma")) for s in range(0, max(len(t) - 200, 0), 50)}
        start = min(windows, key=lambda s: (-windows[s], s), default=0)
        assert r.snippet == "..." * (start > 0) + t[start:start + 200] + "..." * (start + 200 < len(t))


def test_url_kinds(spark):
    urls = [("https://www.notion.so/x",), ("https://docs.google.com/document/d/abc/edit",),
            ("https://github.com/o/r",), ("https://github.com/o/r/blob/main/a.md",), ("https://x.com/data.jsonl",),
            ("https://example.com",)]
    d = spark.createDataFrame(urls, "url string")
    got = [r.k for r in d.select(D.url_kind("url").alias("k")).collect()]
    assert got == ["notion", "google_docs", "github_readme", "github", "raw_json", "website"]
    ids = D.url_ids(d).collect()
    assert ids[1].doc_id == "abc" and ids[3].raw_url == "https://raw.githubusercontent.com/o/r/main/a.md"
    assert ids[2].readme_url == "https://raw.githubusercontent.com/o/r/main/README.md" and ids[5].owner is None
    n = spark.createDataFrame([("https://www.notion.so/ws/My-Page-0123456789abcdef0123456789ABCDEF",),
                               ("https://notion.site/ws/plainid",)], "url string")
    assert [r.notion_page_id for r in D.url_ids(n).collect()] == ["0123456789abcdef0123456789ABCDEF", "plainid"]


def test_blocks_to_text_profiles(spark):
    import json
    blocks = [{"type": "heading_1", "heading_1": {"rich_text": [{"plain_text": "Title"}]}},
              {"type": "paragraph", "paragraph": {"rich_text": [{"plain_text": "Hello "}, {"plain_text": "world"}]}},
              {"type": "bulleted_list_item", "bulleted_list_item": {"rich_text": [{"plain_text": "item"}]}},
              {"type": "code", "code": {"rich_text": [{"plain_text": "x = 1"}], "language": "python"}},
              {"type": "divider", "divider": {}}, {"type": "image", "image": {}},
              {"type": "paragraph", "paragraph": {"rich_text": []}}]
    d = spark.createDataFrame([(json.dumps(blocks),)], "b string")
    c = D.blocks_to_text(d, "b", "connector").first().text
    assert c == "# Title\n\nHello world\n\n- item\n\n```python\nx = 1\n```\n\n---"
    u = D.blocks_to_text(d, "b", "url").first().text
    assert u == "Title\nHello world\n• item"


def test_document_structure_text(spark):
    import json
    doc = {"title": "Doc", "body": {"content": [
        {"paragraph": {"elements": [{"textRun": {"content": "Intro text\n"}}]}},
        {"paragraph": {"elements": [{"textRun": {"content": "point"}}], "bullet": {"nestingLevel": 1}}},
        {"paragraph": {"elements": [{"inlineObjectElement": {"id": "i"}}]}},
        {"table": {"tableRows": [{"tableCells": [{"content": [{"paragraph": {"elements": [{"textRun": {"content": "a"}}]}}]},
                                                 {"content": [{"paragraph": {"elements": [{"textRun": {"content": "b"}}]}}]}]}]}},
        {"sectionBreak": {}}]}}
    d = spark.createDataFrame([(json.dumps(doc),)], "j string")
    t = D.document_structure_text(d, "j").first().text
    assert t == "Doc\n\n\n\nIntro text\n\n• point\n\n[Image]\n\na | b"


def test_chunk_metadata_merge(spark):
    d = spark.createDataFrame([(1, "Hello world. " * 60, "en")], "doc_id long, text string, lang string")
    r = D.chunk_documents(d, "doc_id", "text", "index", 200, 20, metadata_cols=["lang"]).first()
    assert r.metadata.lang == "en" and r.metadata.total_chunks == r.total_chunks and "lang" not in r.asDict()


def _sections_of(text):
    """Definition of D-15, line by line."""
    import re
    raws = text.split("\n")
    ul = [bool(re.fullmatch("[=-]{3,}", x)) for x in raws]
    ulh = [i + 1 < len(raws) and ul[i + 1] and not ul[i] for i in range(len(raws))]
    out = []
    for i, raw in enumerate(raws):
        if i and ulh[i - 1]:
            continue
        t = raw.strip()
        h, n = re.search(r"^#{1,3}\s+(.+)$", t), re.search(r"^(\d+\.)\s+(.+)$", t)
        title = t if ulh[i] else h[1].strip() if h else t if re.search(r"^([A-Z][A-Z\s]+)$", t) else n[1] if n else None
        if title is not None:
            out.append((title, []))
        elif out:
            out[-1][1].append(raw)
    return [(k + 1, title, "\n".join(body).strip()) for k, (title, body) in enumerate(out) if title and body]


def test_manual_sections_leave_lines_in_their_row(spark):
    """Equal to the definition on random texts, and no line is shuffled."""
    import random
    r = random.Random(4)
    lines = ["", "body", " a, b ", "===", "-----", "--", "# one", "### two words ", "####", "UPPER CASE", "A", "3. step", "3.step", "  UP", "# "]
    texts = [None, "", "===", "# a", "# a\n", "x\n===\n"] + ["\n".join(r.choice(lines) for _ in range(r.randrange(1, 30))) for _ in range(200)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    s = D.manual_sections(d, "doc_id", "text")
    got = sorted((x.doc_id, x.sec, x.title, x.content) for x in s.collect())
    assert got == sorted((i, *x) for i, t in enumerate(texts) if t is not None for x in _sections_of(t))
    assert "Exchange" not in s._jdf.queryExecution().executedPlan().toString()
