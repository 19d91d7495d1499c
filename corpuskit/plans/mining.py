"""Rules of the D family over texts that every document's own lines are laid out in: each layout makes the
rules fire, and its oracle builds the expected rows from the lines, not from the layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_chat_text
from ..operators import experiments as X
from ..operators import stats as A
from ..operators import text as D
from ..session import table
from .catalog import register, sql_squeeze, sql_tokens
from .experiments import VARIANTS_SQL, variants
from .text import sql_strip

# Lines of the documents (from 0) without the marks that the rules read.
LINES_SQL = r"""(SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS i FROM (
  SELECT doc_id, string_split(translate(text, '#:', '--'), chr(10)) AS ls FROM documents WHERE text IS NOT NULL))"""


def _laid_out(spark, sf, layout):
    """(doc_id, text): ``layout`` (line, number) of every line, joined by line breaks."""
    ls = F.split(F.translate("text", "#:", "--"), "\n", -1)
    return table(spark, sf, "documents").filter("text IS NOT NULL") \
        .select("doc_id", F.array_join(F.transform(ls, layout), "\n").alias("text"))


@register("document_markdown_samples", f"""
WITH l AS {LINES_SQL},
s AS (SELECT doc_id, i // 3 AS k, max(CASE WHEN i % 3 = 0 THEN 'Part ' || l END) AS h,
        {sql_strip("coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE i % 3 > 0), '')")} AS b FROM l GROUP BY doc_id, i // 3)
SELECT doc_id, CAST(k AS INTEGER) AS k, CASE WHEN contains(h, '?') THEN h ELSE 'What is ' || h || '?' END AS input, md5(substr(b, 1, 1000)) AS output_md5
FROM s WHERE length(b) > 20""")
def document_markdown_samples(spark, sf):
    """D-11: every third line is a heading of one to four marks."""
    d = _laid_out(spark, sf, lambda l, i: F.when(i % 3 == 0, F.concat(F.repeat(F.lit("#"), i % 4 + 1), F.lit(" Part "), l)).otherwise(l))
    return D.markdown_samples(d, "doc_id", "text").select("doc_id", "k", "input", F.md5("output").alias("output_md5"))


@register("document_markdown_qa", f"""
WITH l AS {LINES_SQL},
g AS (SELECT doc_id, i // 2 AS g, max(CASE WHEN i % 2 = 0 THEN l END) AS a, max(CASE WHEN i % 2 = 1 THEN l END) AS b FROM l GROUP BY doc_id, i // 2),
t AS (SELECT *, CASE WHEN g % 2 = 0 THEN '## Topic ' || a || chr(10) || chr(10) || 'Body ' || b ELSE 'Q: Ask ' || a || chr(10) || 'A: Reply ' || b END AS own
      FROM g WHERE b IS NOT NULL),
n AS (SELECT *, coalesce(chr(10) || lead(own) OVER (PARTITION BY doc_id ORDER BY g), '') AS rest FROM t)
SELECT doc_id, CAST(g // 2 AS INTEGER) AS k, 'heading' AS pattern, md5({sql_strip("'Topic ' || a")}) AS input_md5, md5({sql_strip("'Body ' || b || rest")}) AS output_md5
FROM n WHERE g % 2 = 0 AND (contains(a, '?') OR regexp_matches(lower(a), 'how|what|why|when|where|can|do'))
UNION ALL
SELECT doc_id, CAST(g // 2 AS INTEGER), 'qa', md5({sql_strip("'Ask ' || a")}), md5({sql_strip("'Reply ' || b || rest")}) FROM n WHERE g % 2 = 1""")
def document_markdown_qa(spark, sf):
    """D-13: pairs of lines are in turn a heading with its body and a question with its answer; both run on to
    the next of their kind. A last line without a partner is left out."""
    ls = F.split(F.translate("text", "#:", "--"), "\n", -1)
    line = lambda i: F.get("ls", i)
    groups = F.transform(F.expr("sequence(0, size(ls) div 2)"), lambda g: F.when(2 * g + 1 >= F.size("ls"), F.lit(None).cast("string")).when(
        g % 2 == 0, F.concat(F.lit("## Topic "), line(2 * g), F.lit("\n\nBody "), line(2 * g + 1)))
        .otherwise(F.concat(F.lit("Q: Ask "), line(2 * g), F.lit("\nA: Reply "), line(2 * g + 1))))
    d = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", ls.alias("ls")) \
        .select("doc_id", F.array_join(groups, "\n").alias("text"))
    r = D.markdown_qa(d, "doc_id", "text")
    return r.select("doc_id", "k", "pattern", F.md5("input").alias("input_md5"), F.md5("output").alias("output_md5"))


@register("document_line_qa", f"""
WITH l AS {LINES_SQL}
SELECT a.doc_id, CAST(a.i AS INTEGER) AS k, md5({sql_strip('q.l')}) AS input_md5, md5({sql_strip('a.l')}) AS output_md5
FROM l a JOIN l q ON a.doc_id = q.doc_id AND a.i = q.i + 1 WHERE a.i % 6 IN (1, 5) AND {sql_strip('q.l')} <> ''""")
def document_line_qa(spark, sf):
    """D-14: lines in turn a question, its answer, an answer to nothing, a question that is replaced, a question, its answer."""
    d = _laid_out(spark, sf, lambda l, i: F.concat(F.when((i % 6).isin(0, 3, 4), F.lit("  Q: ")).otherwise(F.lit("A: ")), l))
    r = D.line_qa(d, "doc_id", "text")
    return r.select("doc_id", "k", F.md5("input").alias("input_md5"), F.md5("output").alias("output_md5"))


def _manual(l, i):
    at = i % 8
    return F.when(at == 0, F.concat(F.lit("head "), l, F.lit("\n====="))).when(at == 3, F.concat(F.lit("## "), F.lit("part "), l)) \
        .when(at == 5, F.concat(F.lit("2. step "), l)).when(at == 7, F.lit("SECTION")).otherwise(F.concat(F.lit("b "), l))


MANUAL_SQL = f"""
WITH l AS {LINES_SQL},
b AS (SELECT *, CASE WHEN i % 8 < 3 THEN 0 WHEN i % 8 < 5 THEN 3 WHEN i % 8 < 7 THEN 5 ELSE 7 END AS pos FROM l),
s AS (SELECT doc_id, (i // 8) * 4 + CASE pos WHEN 0 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS sec,
        max(CASE WHEN i % 8 = pos THEN CASE pos WHEN 0 THEN {sql_strip("'head ' || l")} WHEN 3 THEN {sql_strip("'part ' || l")} ELSE '2.' END END) AS title,
        {sql_strip("string_agg('b ' || l, chr(10) ORDER BY i) FILTER (WHERE i % 8 <> pos)")} AS content
      FROM b WHERE pos < 7 GROUP BY doc_id, i // 8, pos HAVING count(*) > 1)"""


@register("document_manual_sections", f"{MANUAL_SQL} SELECT doc_id, CAST(sec AS BIGINT) AS sec, title, md5(content) AS content_md5 FROM s")
def document_manual_sections(spark, sf):
    """D-15: underlined, marked, numbered and upper-case headers; the last kind has no body and is dropped."""
    s = D.manual_sections(_laid_out(spark, sf, _manual), "doc_id", "text")
    return s.select("doc_id", F.col("sec").cast("bigint").alias("sec"), "title", F.md5("content").alias("content_md5"))


@register("document_section_questions", f"""{MANUAL_SQL},
q AS (SELECT doc_id, sec, content, regexp_replace(lower(title), '[_-]', ' ', 'g') AS a, lower(title) AS t FROM s WHERE length(content) >= 50),
r AS (SELECT *, (CASE WHEN contains(t, 'head') THEN ['How do I ' || a || '?', 'Where is ' || t || '?'] WHEN regexp_matches(t, 'un|th') THEN ['Why ' || a || '?']
        ELSE ['What is ' || a || '?'] END || list_filter([CASE WHEN regexp_matches(content, '[A-Z]') THEN 'Which names of ' || t || '?' END,
        CASE WHEN contains(content, ',') THEN 'Parts?' END], lambda x: x IS NOT NULL))[1:3] AS qs FROM q)
SELECT doc_id, CAST(sec AS BIGINT) AS sec, CAST(generate_subscripts(qs, 1) - 1 AS INTEGER) AS q, unnest(qs) AS input, md5(content) AS output_md5 FROM r""")
def document_section_questions(spark, sf):
    """D-16: questions of the sections by title class, else the generic one, then by content."""
    s = D.manual_sections(_laid_out(spark, sf, _manual), "doc_id", "text")
    r = D.questions_for_sections(s, [("head", ["How do I {a}?", "Where is {t}?"]), ("un|th", ["Why {a}?"])], ["What is {a}?"],
                                 [("[A-Z]", "Which names of {t}?"), (",", "Parts?")])
    return r.select("doc_id", F.col("sec").cast("bigint").alias("sec"), "q", "input", F.md5("output").alias("output_md5"))


@register("document_structure_texts", f"""
WITH l AS {LINES_SQL},
p AS (SELECT doc_id, i, CASE i % 4 WHEN 0 THEN {sql_strip('l')} WHEN 1 THEN {sql_strip("'• ' || " + sql_strip('l'))}
        WHEN 2 THEN {sql_strip("l || '[Image]'")} ELSE {sql_strip('l')} || ' | cell ' || i END AS t FROM l)
SELECT doc_id, md5('doc-' || doc_id || chr(10) || chr(10) || coalesce(chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY i) FILTER (WHERE t <> ''), '')) AS text_md5 FROM p GROUP BY doc_id""")
def document_structure_texts(spark, sf):
    """D-18: title and a blank part, then every line a body element, in turn a paragraph, a bullet, a run with an image and a table row."""
    run = lambda l: F.struct(F.struct(l.alias("content")).alias("textRun"))
    para = lambda *e: F.concat(F.lit('{"paragraph":{"elements":['), F.concat_ws(",", *e), F.lit("]"))
    element = lambda l, i: F.when(i % 4 == 0, F.concat(para(F.to_json(run(l))), F.lit("}}"))) \
        .when(i % 4 == 1, F.concat(para(F.to_json(run(l))), F.lit(',"bullet":{"nestingLevel":1}}}'))) \
        .when(i % 4 == 2, F.concat(para(F.to_json(run(l)), F.lit('{"inlineObjectElement":"x"}')), F.lit("}}"))) \
        .otherwise(F.concat(F.lit('{"table":{"tableRows":[{"tableCells":[{"content":['), para(F.to_json(run(l))), F.lit('}}]},{"content":['),
                            para(F.to_json(run(F.format_string("cell %d", i)))), F.lit("}}]}]}]}}")))
    body = F.array_join(F.transform(F.split(F.translate("text", "#:", "--"), "\n", -1), element), ",")
    d = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.concat(
        F.lit('{"title":"doc-'), F.col("doc_id").cast("string"), F.lit('","body":{"content":['), body, F.lit("]}}")).alias("j"))
    return D.document_structure_text(d, "j").select("doc_id", F.md5("text").alias("text_md5"))


@register("chat_markup_cleaned", f"""
SELECT conv_id, turn, md5({sql_squeeze("coalesce(text, '') || ' #general label ' || turn || ' https://a.b/c?d=' || conv_id || ' end'")}) AS text_md5 FROM conversations""")
def chat_markup_cleaned(spark, sf):
    """D-08: every turn among user mentions, a channel, a labelled and a bare link and broadcasts."""
    c, n = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    t = F.concat(F.lit("<@U"), c, F.lit("> <!here>"), F.coalesce("text", F.lit("")), F.lit(" <#C0|general> <https://x.y/"), n, F.lit("|label "), n,
                 F.lit("> <!channel|all> <https://a.b/c?d="), c, F.lit(">  <@W1>\n<!everyone>end"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(clean_chat_text(t)).alias("text_md5"))


# A link of every kind for each page in turn.
LINKS_SQL = """(SELECT page_id, page_id % 8 AS m, CASE page_id % 8
  WHEN 0 THEN concat('https://www.notion.so/team/Page-of-', page_id, '-', md5(CAST(page_id AS VARCHAR(20))))
  WHEN 1 THEN concat('https://docs.google.com/document/d/D-', page_id, '_x/edit?tab=1')
  WHEN 2 THEN concat('https://docs.google.com/spreadsheets/d/S', page_id, '/edit')
  WHEN 3 THEN concat('https://github.com/o', page_id, '/r', page_id, '/blob/main/a/b.md')
  WHEN 4 THEN concat('https://github.com/o', page_id, '/r', page_id, '/')
  WHEN 5 THEN concat('https://x', page_id, '.atlassian.net/wiki/spaces/S')
  WHEN 6 THEN concat('https://x.org/', page_id, '/data.JSONL')
  ELSE concat('https://x.org/', page_id, '/notion') END AS url FROM pages)"""


@register("page_link_ids", f"""
SELECT page_id, ['notion', 'google_docs', 'google_sheets', 'github', 'github_readme', 'confluence', 'raw_json', 'website'][m + 1] AS kind,
  CASE WHEN m = 0 THEN md5(CAST(page_id AS VARCHAR(20))) END AS notion_page_id,
  CASE WHEN m = 1 THEN concat('D-', page_id, '_x') END AS doc_id, CASE WHEN m = 2 THEN concat('S', page_id) END AS sheet_id,
  CASE m WHEN 3 THEN concat('https://raw.githubusercontent.com/o', page_id, '/r', page_id, '/main/a/b.md')
         WHEN 4 THEN concat('https://raw.githubusercontent.com/o', page_id, '/r', page_id, '/') END AS raw_url,
  CASE WHEN m IN (3, 4) THEN concat('o', page_id) END AS owner, CASE WHEN m IN (3, 4) THEN concat('r', page_id) END AS repo,
  CASE WHEN m IN (3, 4) THEN concat('https://raw.githubusercontent.com/o', page_id, '/r', page_id, '/main/README.md') END AS readme_url
FROM {LINKS_SQL}""")
def page_link_ids(spark, sf):
    """D-19 / D-20: kind, ids and derived URLs of a link of every kind (see ``LINKS_SQL``)."""
    d = spark.sql(f"SELECT page_id, url FROM {LINKS_SQL.replace('FROM pages', 'FROM {pages}')}", pages=table(spark, sf, "pages"))
    return D.url_ids(d.withColumn("kind", D.url_kind("url"))).drop("url")


@register("allocation_violations_found", f"""
WITH v AS (SELECT *, substr(md5(experiment_id), 1, 1) AS c FROM ({VARIANTS_SQL})), e AS (SELECT DISTINCT experiment_id, c FROM v)
SELECT experiment_id, 'percentages_do_not_sum_to_100' AS violation FROM e WHERE c < '8'
UNION ALL SELECT experiment_id, 'variant_without_allocation' FROM e WHERE c BETWEEN '4' AND '7'
UNION ALL SELECT experiment_id, 'allocation_for_unknown_variant' FROM e WHERE c IN ('8', '9', 'a', 'b')
UNION ALL SELECT experiment_id, 'not_exactly_one_control' FROM e WHERE c >= 'c'""")
def allocation_violations_found(spark, sf):
    """A-13 over experiments that are each broken in one of four ways, by a digest of their id: five points too
    much, no allocation for the control, an allocation for an unknown variant, no control."""
    v = variants(spark, sf).withColumn("c", F.substring(F.md5("experiment_id"), 1, 1))
    extra = v.filter("is_control AND c IN ('8', '9', 'a', 'b')") \
        .select("experiment_id", F.lit("ghost").alias("variant_id"), F.lit(0.0).alias("percentage"))
    a = v.filter("NOT (is_control AND c BETWEEN '4' AND '7')").select(
        "experiment_id", "variant_id", (F.col("percentage") + F.when(F.expr("is_control AND c < '4'"), 5.0).otherwise(0.0)).alias("percentage"))
    shown = v.withColumn("is_control", F.expr("is_control AND c < 'c'")).drop("c")
    return X.allocation_violations(shown, a.unionByName(extra))


@register("document_postings", f"""
WITH w AS (SELECT DISTINCT doc_id, unnest({sql_tokens('text')}) AS word FROM documents)
SELECT word, doc_id, count(*) OVER (PARTITION BY word) AS n_docs FROM w WHERE length(word) >= 4""")
def document_postings(spark, sf):
    """A-26 inverted index, every posting."""
    return A.inverted_index(table(spark, sf, "documents"), "doc_id", "text", 4)
