"""Document and page queries: chunking, extraction, URL rules (D family)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.text import normalize_text
from ..operators import text as D
from ..operators.ordered import lead_split, positional_index
from ..operators.relate import with_one_row
from ..session import table
from .catalog import register


def sql_strip(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def _rfind(w: str, sep: str) -> str:
    rs = sep[::-1].replace("\n", "' || chr(10) || '")
    return (f"CASE WHEN strpos(reverse({w}), '{rs}') = 0 THEN -1 "
            f"ELSE length({w}) - {len(sep)} - strpos(reverse({w}), '{rs}') + 1 END")


def _end_expr(size: int, seps) -> str:
    w = f"substr(text, start + 1, {size})"
    half = size // 2
    cases = " ".join(f"WHEN {_rfind(w, s)} > {half} THEN start + {_rfind(w, s)} + {len(s)}" for s in seps)
    return f"CASE WHEN start + {size} >= n THEN start + {size} ELSE CASE {cases} ELSE start + {size} END END"


CHUNK_SIZE, CHUNK_OVERLAP = 512, 50
INDEX_SEPS = [". ", ".\n", "! ", "? ", "\n\n"]

CHUNKS_SQL = f"""
WITH RECURSIVE s(doc_id, text, n, start, step, piece) AS (
  SELECT doc_id, text, length(text), 0, 0, CAST(NULL AS VARCHAR) FROM documents WHERE text IS NOT NULL AND length(text) > 0
  UNION ALL
  SELECT doc_id, text, n, e - {CHUNK_OVERLAP}, step + 1, {sql_strip('substr(text, start + 1, e - start)')}
  FROM (SELECT *, {_end_expr(CHUNK_SIZE, INDEX_SEPS)} AS e FROM s WHERE start < n) x
),
c AS (SELECT doc_id, step, piece FROM s WHERE step > 0 AND piece <> ''),
k AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS INTEGER) AS chunk_index,
             count(*) OVER (PARTITION BY doc_id) AS total_chunks, piece FROM c)
SELECT doc_id, chunk_index, CAST(total_chunks AS INTEGER) AS total_chunks,
  substr(md5(CAST(doc_id AS VARCHAR) || ':' || CAST(chunk_index AS VARCHAR) || ':' || substr(piece, 1, 50)), 1, 12) AS chunk_id,
  CAST(length(piece) AS INTEGER) AS n_chars, md5(piece) AS content_md5 FROM k"""


@register("document_chunks", CHUNKS_SQL)
def document_chunks(spark, sf):
    """D-01 (profile index, 512 / 50) + D-02 chunk identity over every document."""
    c = D.chunk_documents(table(spark, sf, "documents"), "doc_id", "text", "index", CHUNK_SIZE, CHUNK_OVERLAP)
    return c.select("doc_id", "chunk_index", "total_chunks", "chunk_id", F.length("content").alias("n_chars"),
                    F.md5("content").alias("content_md5"))


def _knowledge_end(size: int) -> str:
    w = f"substr(text, start + 1, {size})"
    half = size // 2
    seps = [". ", "! ", "? ", "\n"]
    cases = " ".join(f"WHEN {_rfind(w, x)} > {half} THEN start + {_rfind(w, x)} + {len(x)}" for x in seps)
    return (f"CASE WHEN start + {size} >= n THEN start + {size} "
            f"WHEN {_rfind(w, chr(10) * 2)} > {half} THEN start + {_rfind(w, chr(10) * 2)} + 2 "
            f"ELSE CASE {cases} ELSE start + {size} END END")


KNOWLEDGE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {sql_strip('text')} AS text FROM documents WHERE text IS NOT NULL),
s(doc_id, text, n, start, step, piece) AS (
  SELECT doc_id, text, length(text), 0, 0, CAST(NULL AS VARCHAR) FROM d WHERE length(text) > 500
  UNION ALL
  SELECT doc_id, text, n, e - 50, step + 1, {sql_strip('substr(text, start + 1, e - start)')}
  FROM (SELECT *, {_knowledge_end(500)} AS e FROM s WHERE start < n) x),
c AS (SELECT doc_id, piece FROM s WHERE step > 0 AND piece <> ''
      UNION ALL SELECT doc_id, text FROM d WHERE length(text) <= 500)
SELECT doc_id, count(*) AS n_chunks, sum(length(piece)) AS chars FROM c WHERE length(piece) >= 50 GROUP BY doc_id"""


@register("chunk_counts_knowledge", KNOWLEDGE_SQL)
def chunk_counts_knowledge(spark, sf):
    """D-01 profile knowledge (500 / 50): chunks of at least 50 chars (F-07) per document."""
    from ..operators.mapping import min_length
    c = min_length(D.chunk_documents(table(spark, sf, "documents"), "doc_id", "text", "knowledge"), 50, "content")
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("content")).cast("bigint").alias("chars"))


FIXED_SIZE = 1000
FIXED_SQL = f"""
WITH d AS (SELECT doc_id, text, 'doc-' || CAST(doc_id AS VARCHAR) AS name FROM documents WHERE length(text) > 0),
s AS (SELECT d.*, unnest(range(1, length(text) + 1, {FIXED_SIZE})) AS st FROM d)
SELECT 'Document: ' || name || ' (chunk ' || CAST(CAST((st - 1) / {FIXED_SIZE} AS INTEGER) + 1 AS VARCHAR) || ')' AS input,
  substr(text, st, {FIXED_SIZE}) AS output, name, CAST((st - 1) / {FIXED_SIZE} AS INTEGER) AS chunk_index,
  CAST(ceil(length(text) / {FIXED_SIZE}) AS INTEGER) AS total_chunks FROM s"""


def _named_docs(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", "text", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"))


@register("fixed_chunks", FIXED_SQL)
def fixed_chunks(spark, sf):
    """D-03 fixed 1000-char chunks, "Document: name (chunk i)"."""
    return D.fixed_chunks(_named_docs(spark, sf), "name", "text", FIXED_SIZE)


@register("chunk_first_sentence", f"""
SELECT {sql_strip("split_part(output, '.', 1) || '?'")} AS input, name, chunk_index FROM ({FIXED_SQL})""")
def chunk_first_sentence(spark, sf):
    """D-21: first sentence of each fixed chunk + "?" as the question."""
    c = D.fixed_chunks(_named_docs(spark, sf), "name", "text", FIXED_SIZE)
    return D.first_sentence_questions(c, "output").select("input", "name", "chunk_index")


@register("document_samples", """
SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS input, md5(text) AS output_md5 FROM documents WHERE length(text) >= 50""")
def document_samples(spark, sf):
    """D-06 whole-document samples (>= 50 chars)."""
    s = D.document_samples(_named_docs(spark, sf), "name", "text", 50)
    return s.select("input", F.md5("output").alias("output_md5"))


@register("normalized_documents", """
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'),
  '[^\\S\\n]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS text_md5 FROM documents""")
def normalized_documents(spark, sf):
    """D-07 whitespace / control normaliser."""
    return table(spark, sf, "documents").select("doc_id", F.md5(normalize_text("text")).alias("text_md5"))


def _spaced(spark, sf):
    """Documents with a blank line after each line: their lines are paragraphs."""
    return table(spark, sf, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


SPACED_SQL = "(SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents)"


@register("document_paragraph_samples", f"""
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS ps FROM {SPACED_SQL}),
e AS (SELECT doc_id, ps, unnest(range(0, len(ps))) AS i FROM p),
q AS (SELECT doc_id, i, ps[i + 1] AS q, ps[i + 2] AS a FROM e),
pairs AS (SELECT doc_id, i AS k, substr(q, 1, 500) AS input, substr(a, 1, 1000) AS output FROM q
  WHERE i % 2 = 0 AND a IS NOT NULL AND length(q) BETWEEN 10 AND 500 AND length(a) >= 10
    AND (contains(q, '?') OR (substr(q, 1, 1) = upper(substr(q, 1, 1)) AND substr(q, 1, 1) <> lower(substr(q, 1, 1))))),
fb AS (SELECT doc_id, i AS k, 'What is ' || lower(substr(split_part(q, '.', 1), 1, 50)) || '?' AS input, substr(q, 1, 1000) AS output
  FROM q WHERE doc_id NOT IN (SELECT doc_id FROM pairs) AND length(q) > 50 AND length(split_part(q, '.', 1)) > 20)
SELECT doc_id, k, input, md5(output) AS output_md5 FROM pairs UNION ALL SELECT doc_id, k, input, md5(output) FROM fb""")
def document_paragraph_samples(spark, sf):
    """D-10 plain text -> Q/A pairs with the "What is ...?" fallback."""
    s = D.content_to_samples(_spaced(spark, sf), "doc_id", "text")
    return s.select("doc_id", F.col("k").cast("bigint").alias("k"), "input", F.md5("output").alias("output_md5"))


@register("long_paragraphs", f"""
WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 AS k FROM {SPACED_SQL})
SELECT doc_id, CAST(k AS INTEGER) AS k, md5({sql_strip('p')}) AS p_md5, 'What does the document say about this topic?' AS input
FROM d WHERE length({sql_strip('p')}) > 50""")
def long_paragraphs(spark, sf):
    """D-21 txt recipe: paragraphs longer than 50 chars."""
    p = D.long_paragraphs(_spaced(spark, sf), "doc_id", "text", 50)
    return p.select("doc_id", "k", F.md5("p").alias("p_md5"), "input")


def _without_sql(e, tags):
    e = f"regexp_replace({e}, '(?s)<!--.*?(?:-->|\\z)', '', 'g')"
    for t in tags:
        e = f"regexp_replace({e}, '(?is)<{t}\\b[^>]*>.*?(?:</{t}\\s*>|\\z)', '', 'g')"
    return e


def _decoded_sql(e):
    for name, char in H.REFERENCES:
        e = f"replace({e}, '&{name};', {sql_char(char)})"
    return e


def sql_char(c):
    return f"chr({ord(c)})"


TAG_SQL = "'" + H.TAG + "'"


@register("page_text_wiki", f"""
WITH t AS (SELECT page_id, {_without_sql("coalesce(html, '')", H.WIKI_SKIP)} AS h FROM pages),
b AS (SELECT page_id, regexp_replace(h, '(?i)<(?:{"|".join(H.WIKI_BREAK)})\\b[^>]*>', chr(10), 'g') AS h FROM t),
d AS (SELECT page_id, {_decoded_sql(f"regexp_replace(h, {TAG_SQL}, '', 'g')")} AS h FROM b),
s AS (SELECT page_id, {sql_strip("regexp_replace(h, '\\n\\s*\\n', chr(10) || chr(10), 'g')")} AS text FROM d)
SELECT page_id, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS text_md5 FROM s""")
def page_text_wiki(spark, sf):
    """D-09 wiki profile over every page."""
    t = D.html_text(table(spark, sf, "pages"), profile="wiki")
    return t.select("page_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@register("page_text_site", f"""
WITH t AS (SELECT page_id, url, html, {_without_sql("coalesce(html, '')", H.SITE_DROP)} AS h FROM pages),
p AS (SELECT page_id, url, html, list_filter(list_transform(string_split_regex(h, {TAG_SQL}), lambda x: {sql_strip(_decoded_sql('x'))}), lambda x: x <> '') AS ps FROM t),
s AS (SELECT page_id, array_to_string(ps, chr(10)) AS text, CASE WHEN regexp_matches(html, '(?is)<title\\b[^>]*>')
  THEN {_decoded_sql("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)(?:</title\\s*>|\\z)', 1)")} ELSE url END AS title FROM p)
SELECT page_id, title, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS text_md5 FROM s""")
def page_text_site(spark, sf):
    """D-09 site profile (nav/header/footer/script/style dropped) with title else URL."""
    t = D.html_text(table(spark, sf, "pages"), profile="site", url_col="url")
    return t.select("page_id", "title", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


# Every page behind nested site chrome: page_id % 5 + 1 navigations in each other with text between their
# ends, a header in a header, an element left open and an end tag without a start; one line is article.
NESTED_SQL = """(SELECT page_id, '<html><body>' || repeat('<nav class="a>b"><ul><li>menu', CAST(page_id % 5 + 1 AS INTEGER))
  || repeat('</ul></nav>still menu', CAST(page_id % 5 AS INTEGER)) || '</nav><HEADER>top<header>inner</header>outer</Header>'
  || '<div><section></p>kept &lt;' || page_id || '&gt;</div></section><footer><p>foot' || repeat('<footer>', CAST(page_id % 3 AS INTEGER))
  || repeat('</footer>', CAST(page_id % 3 AS INTEGER)) || 'note</footer>' || coalesce(html, '') AS html FROM pages)"""


@register("page_text_nested", f"""
WITH t AS (SELECT page_id, {_without_sql("coalesce(html, '')", H.SITE_DROP)} AS h FROM pages),
p AS (SELECT page_id, list_filter(list_transform(string_split_regex(h, {TAG_SQL}), lambda x: {sql_strip(_decoded_sql('x'))}), lambda x: x <> '') AS ps FROM t),
s AS (SELECT page_id, array_to_string(list_prepend('kept <' || page_id || '>', ps), chr(10)) AS text FROM p)
SELECT page_id, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS text_md5 FROM s""")
def page_text_nested(spark, sf):
    """D-09 site profile over every page behind nested, unclosed and misplaced elements (see ``NESTED_SQL``):
    the text is that of the page after the one line that lies outside."""
    nested = spark.sql(f"SELECT * FROM {NESTED_SQL.replace('FROM pages', 'FROM {pages}')}", pages=table(spark, sf, "pages"))
    t = D.html_text(nested, profile="site")
    return t.select("page_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


# Questions and answers of the conversations: each turn with the next one, without words that a rule of the
# miner reads and without line breaks.
TURNS_SQL = """(SELECT conv_id, turn, trim(regexp_replace(translate(q, 'wWqQ:?<>&', 'vVkK....+'), '\\s+', ' ', 'g')) AS q,
  trim(regexp_replace(translate(a, 'wWqQ:?<>&', 'vVkK....+'), '\\s+', ' ', 'g')) AS a
  FROM (SELECT conv_id, turn, text AS q, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations) WHERE turn % 2 = 0 AND a IS NOT NULL)"""


@register("conversation_page_faq", f"""
WITH t AS (SELECT conv_id * 1000 + turn AS page_id, CAST(conv_id + turn / 2 AS BIGINT) % 4 AS form, 'About ' || q AS q, a FROM {TURNS_SQL}),
r AS (
  SELECT page_id, 'schema' AS pattern, q, a || 'and more' AS a FROM t WHERE form = 0
  UNION ALL SELECT page_id, 'accordion', q, a || 'and more' FROM t WHERE form = 1
  UNION ALL SELECT page_id, 'heading', q || '?', substr(a || ' and more', 1, 1000) FROM t WHERE form = 2
  UNION ALL SELECT page_id, 'qa_text', substr(q, 1, 500), substr(a || chr(10) || 'and more', 1, 1000) FROM t WHERE form = 3)
SELECT page_id, pattern, md5(q) AS input_md5, md5(a) AS output_md5 FROM r""")
def conversation_page_faq(spark, sf):
    """D-12 over pages built from every question turn and its answer, in turn as schema markup, accordion,
    heading and "Q: / A:" text, among nested elements and a decoy in the navigation: each page gives back
    its own pair and nothing else."""
    c = table(spark, sf, "conversations")
    clean = lambda e: F.trim(F.regexp_replace(F.translate(e, "wWqQ:?<>&", "vVkK....+"), r"\s+", " "))
    t = lead_split(c.select("conv_id", "turn", F.col("text").alias("q")), ["conv_id"], ["turn"], ["q"], F.floor(F.col("turn") / 1024), "a_")
    t = t.withColumnRenamed("a_q", "a").filter((F.col("turn") % 2 == 0) & F.col("a").isNotNull())
    q, a = F.concat(F.lit("About "), clean("q")), clean("a")
    form = (F.col("conv_id") + F.floor(F.col("turn") / 2)) % 4
    markup = F.when(form == 0, F.concat(
        F.lit("<div itemscope itemtype='https://schema.org/Question'><div><h5 itemprop=name>"), q,
        F.lit("</h5></div><div itemprop=acceptedAnswer><div><div><p>"), a, F.lit("</div></div><p>and more</div></div>"))) \
        .when(form == 1, F.concat(
            F.lit('<li class="toggle x"><div><b class="item-title">'), q, F.lit('</b></div><div class="item-body"><div><div>'), a,
            F.lit("</div></div>and more</div></li>"))) \
        .when(form == 2, F.concat(
            F.lit("<section><h3><b>"), q, F.lit("?</b></h3><div>aside</div><p><i>"), a, F.lit("</i></p><p>and more</p><h1>End</h1><p>no</p></section>"))) \
        .otherwise(F.concat(F.lit("<p>Q: "), q, F.lit("</p><p>A: "), a, F.lit("</p><div>and more</div>")))
    decoy = "<nav><nav></nav><div class=faq><p class=title>decoy</p><p class=body>decoy</p></div><h2>How?</h2><p>decoy</p></nav>"
    pages = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("page_id"),
                     F.concat(F.lit("<html><body>" + decoy + "<main>"), markup, F.lit("</main></body></html>")).alias("html"))
    return D.faq_mine(pages).select("page_id", "pattern", F.md5("input").alias("input_md5"), F.md5("output").alias("output_md5"))


@register("page_faq")
def page_faq(spark, sf):
    """D-12 FAQ mining over every page (all four sources)."""
    return D.faq_mine(table(spark, sf, "pages"))


URL_SQL_CASE = "CASE " + " ".join(
    f"WHEN regexp_matches(url, '(?i){p}') THEN '{k}'" for k, p in D.URL_KINDS) + " ELSE 'website' END"


@register("page_url_kinds", f"SELECT page_id, {URL_SQL_CASE} AS kind FROM pages")
def page_url_kinds(spark, sf):
    """D-19 URL classification."""
    return table(spark, sf, "pages").select("page_id", D.url_kind("url").alias("kind"))


@register("page_url_ids", f"""
WITH k AS (SELECT page_id, url, {URL_SQL_CASE} AS kind,
                  regexp_replace(coalesce(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '^/+|/+$', '', 'g') AS path FROM pages),
p AS (SELECT *, string_split(path, '/') AS parts, split_part(path, '-', -1) AS tail FROM k)
SELECT page_id,
  CASE WHEN kind = 'notion' THEN CASE WHEN contains(path, '-') AND regexp_full_match(tail, '[0-9a-fA-F]{{32}}') THEN tail
       ELSE split_part(path, '/', -1) END END AS notion_page_id,
  CASE WHEN kind = 'google_docs' THEN regexp_extract(url, '/document/d/([a-zA-Z0-9_-]+)', 1) END AS doc_id,
  CASE WHEN kind = 'google_sheets' THEN regexp_extract(url, '/spreadsheets/d/([a-zA-Z0-9_-]+)', 1) END AS sheet_id,
  CASE WHEN kind IN ('github', 'github_readme') THEN replace(replace(url, 'github.com', 'raw.githubusercontent.com'), '/blob/', '/') END AS raw_url,
  CASE WHEN kind IN ('github', 'github_readme') AND len(parts) >= 2 THEN parts[1] END AS owner,
  CASE WHEN kind IN ('github', 'github_readme') AND len(parts) >= 2 THEN parts[2] END AS repo,
  CASE WHEN kind IN ('github', 'github_readme') AND len(parts) >= 2
       THEN 'https://raw.githubusercontent.com/' || parts[1] || '/' || parts[2] || '/main/README.md' END AS readme_url,
  split_part(split_part(url, '://', 2), '/', 1) AS host FROM p""")
def page_url_ids(spark, sf):
    """D-20 ids and derived URLs per page URL (plus host via ``parse_url``)."""
    u = D.url_ids(table(spark, sf, "pages").select("page_id", "url"))
    return u.select("page_id", "notion_page_id", "doc_id", "sheet_id", "raw_url", "owner", "repo", "readme_url",
                    F.expr("parse_url(url, 'HOST')").alias("host"))


@register("document_snippets", """
WITH b AS (SELECT item_id, text AS q, row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS nb FROM benchmark),
d AS (SELECT doc_id, d.text, length(d.text) AS n,
  list_filter(string_split_regex(trim(regexp_replace(trim(lower(coalesce(b.q, ''))), '[^\\p{L}\\p{N}_\\s'']', ' ', 'g')), '\\s+'), lambda t: t <> '') AS qt
  FROM documents d JOIN b ON d.doc_id % b.nb = b.k),
w AS (SELECT doc_id, text, n, list_filter(list_transform(CASE WHEN n - 200 > 0 THEN range(0, n - 200, 50) ELSE [] END,
        lambda s: struct_pack(c := len(list_filter(qt, lambda k: contains(lower(substr(text, s + 1, 200)), k))), ns := -s, s := s)),
        lambda x: x.c > 0) AS scored FROM d),
b2 AS (SELECT doc_id, text, n, coalesce(list_max(scored).s, 0) AS st FROM w)
SELECT doc_id, CAST(length(snip) AS INTEGER) AS snippet_len, md5(snip) AS snippet_md5 FROM (
  SELECT doc_id, CASE WHEN st > 0 THEN '...' ELSE '' END || substr(text, st + 1, 200) || CASE WHEN st + 200 < n THEN '...' ELSE '' END AS snip FROM b2)""")
def document_snippets(spark, sf):
    """D-22 best 200-char snippet per document for a whole benchmark text (dealt round by doc_id)."""
    bench = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("q"))
    b = positional_index(bench, "item_id", "k")
    n = bench.agg(F.count(F.lit(1)).alias("nb"))
    d = with_one_row(table(spark, sf, "documents").select("doc_id", "text"), n).withColumn("k", F.col("doc_id") % F.col("nb"))
    s = D.best_snippet(d.join(b, "k"), "text", "q")
    return s.select("doc_id", F.length("snippet").alias("snippet_len"), F.md5("snippet").alias("snippet_md5"))


@register("document_paragraphs", f"""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p,
                  generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i FROM {SPACED_SQL})
SELECT 'doc-' || CAST(doc_id AS VARCHAR) || ' - Paragraph ' || CAST(i AS VARCHAR) AS input, md5({sql_strip('p')}) AS output_md5
FROM p WHERE length({sql_strip('p')}) >= 50""")
def document_paragraphs(spark, sf):
    """D-04 paragraph samples "title - Paragraph i" (>= 50 chars)."""
    s = D.paragraph_samples(_spaced(spark, sf).withColumn("name", F.format_string("doc-%d", "doc_id")), "name", "text", 50)
    return s.select("input", F.md5("output").alias("output_md5"))


def _headed(spark, sf):
    """Documents whose lines are sections: each later line becomes a header, its sentences a body."""
    t = F.replace(F.replace("text", F.lit("\n"), F.lit("\n## ")), F.lit(". "), F.lit(".\n"))
    return table(spark, sf, "documents").select("doc_id", F.format_string("doc-%d", "doc_id").alias("name"), t.alias("text"))


HEADED_SQL = "(SELECT doc_id, replace(replace(text, chr(10), chr(10) || '## '), '. ', '.' || chr(10)) AS text FROM documents)"


@register("document_sections", f"""
WITH h AS (SELECT doc_id, string_split(text, chr(10) || '## ') AS ps FROM {HEADED_SQL}),
e AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM h),
s AS (SELECT doc_id, i, {sql_strip("CASE WHEN i > 1 THEN '## ' || p ELSE p END")} AS s FROM e)
SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS title, {sql_strip("regexp_replace(split_part(s, chr(10), 1), '^#+', '')")} AS input,
  md5(CASE WHEN contains(s, chr(10)) THEN {sql_strip("substr(s, strpos(s, chr(10)) + 1)")} ELSE s END) AS output_md5
FROM s WHERE length(s) >= 50""")
def document_sections(spark, sf):
    """D-05 section samples of documents with headers (see ``_headed``)."""
    s = D.section_samples(_headed(spark, sf), "name", "text", 50)
    return s.select("title", "input", F.md5("output").alias("output_md5"))


def _doc_blocks(spark, sf):
    d = table(spark, sf, "documents")
    lines = F.split(F.col("text"), "\\n")
    blk = F.transform(lines, lambda l, i: F.when(i == 0, F.to_json(F.struct(
        F.lit("heading_1").alias("type"), F.struct(F.array(F.struct(l.alias("plain_text"))).alias("rich_text")).alias("heading_1"))))
        .otherwise(F.to_json(F.struct(F.lit("paragraph").alias("type"),
                                      F.struct(F.array(F.struct(l.alias("plain_text"))).alias("rich_text")).alias("paragraph")))))
    return d.select("doc_id", F.concat(F.lit("["), F.array_join(blk, ","), F.lit("]")).alias("blocks"))


@register("document_blocks_text", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, md5(string_agg(CASE WHEN i = 1 THEN '# ' || line ELSE line END, chr(10) || chr(10) ORDER BY i)
  FILTER (WHERE i = 1 OR line <> '')) AS text_md5 FROM l GROUP BY doc_id""")
def document_blocks_text(spark, sf):
    """D-17 (connector profile): each document landed as a block list (first line a heading,
    the rest paragraphs) and turned back into text."""
    t = D.blocks_to_text(_doc_blocks(spark, sf), "blocks", "connector")
    return t.select("doc_id", F.md5("text").alias("text_md5"))


@register("document_markdown_recipe", f"""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || '#')) AS sec,
                  generate_subscripts(string_split(text, chr(10) || '#'), 1) - 1 AS k FROM {HEADED_SQL}),
s AS (SELECT doc_id, k, {sql_strip('sec')} AS sec FROM p),
t AS (SELECT doc_id, k, regexp_replace(split_part(sec, chr(10), 1), '^[# ]+|[# ]+$', '', 'g') AS title,
             CASE WHEN contains(sec, chr(10)) THEN {sql_strip("substr(sec, strpos(sec, chr(10)) + 1)")} ELSE '' END AS body
      FROM s WHERE sec <> '')
SELECT doc_id, CAST(k AS INTEGER) AS k, 'What is ' || title || '?' AS input, md5(body) AS output_md5 FROM t WHERE body <> ''""")
def document_markdown_recipe(spark, sf):
    """D-21 md recipe: sections split at "\\\\n#", "What is <title>?" -> body."""
    r = D.markdown_recipe(_headed(spark, sf), "doc_id", "text")
    return r.select("doc_id", "k", "input", F.md5("output").alias("output_md5"))
