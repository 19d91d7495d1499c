"""Scalar-function, version, mapping and filter queries over driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import mapping as P
from ..operators import stats as A
from ..operators import versions as VR
from ..session import table
from .catalog import register


def _paths(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.expr("parse_url(url, 'PATH')").alias("path"), F.expr("parse_url(url, 'HOST')").alias("host"))


@register("url_path_rules", """
WITH p AS (SELECT page_id, '/' || split_part(split_part(split_part(url, '://', 2), '/', 2), '?', 1) AS path0,
                  split_part(split_part(url, '://', 2), '/', 1) AS host, url FROM pages),
q AS (SELECT page_id, CASE WHEN regexp_matches(url, '^[a-z]+://[^/]+/') THEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) ELSE '' END AS path, host FROM p),
s AS (SELECT page_id, path, host, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM q)
SELECT page_id, CASE WHEN len(parts) > 0 THEN '/' || array_to_string(list_transform(parts, lambda x:
         CASE WHEN (length(x) = 36 AND length(x) - length(replace(x, '-', '')) = 4) OR regexp_full_match(x, '[0-9]+') THEN '{id}' ELSE x END), '/') ELSE '/' END AS seg_path,
  regexp_replace(regexp_replace(regexp_replace(path, '/[a-f0-9]{8}(-[a-f0-9]{4}){3}-[a-f0-9]{12}', '/{id}', 'g'),
    '/[a-f0-9]{8}(/|$)', '/{id}\\1', 'g'), '/[0-9]+(/|$)', '/{id}\\1', 'g') AS regex_path,
  CASE WHEN contains(path, '/auth/') THEN 'auth' WHEN contains(path, '/predict') OR contains(path, '/inference') THEN 'inference'
       WHEN starts_with(path, '/ws') THEN 'websocket' ELSE 'api' END AS category,
  'ratelimit:' || CASE WHEN contains(path, '/auth/') THEN 'auth' WHEN contains(path, '/predict') OR contains(path, '/inference') THEN 'inference'
       WHEN starts_with(path, '/ws') THEN 'websocket' ELSE 'api' END || ':ip:' || host || ':ep:' || substr(md5('GET:' || path), 1, 8) AS limit_key
FROM s""")
def url_path_rules(spark, sf):
    """X-01 (both profiles), X-02 category and X-03 key (ip = host, endpoint hashed) per page URL."""
    p = _paths(spark, sf)
    cat = X.limit_category("path")
    return p.select("page_id", X.normalize_path_segments("path").alias("seg_path"), X.normalize_path_regex("path").alias("regex_path"),
                    cat.alias("category"),
                    X.limit_key(cat, host=F.col("host"), method=F.lit("GET"), path=F.col("path"), by_endpoint=True).alias("limit_key"))


@register("document_sizes", """
SELECT doc_id, CASE WHEN n_chars IS NULL OR n_chars = 0 THEN 'N/A'
  WHEN n_chars < 1024 THEN printf('%.1f B', round_even(n_chars::DOUBLE, 1))
  WHEN n_chars < 1048576 THEN printf('%.1f KB', round_even(n_chars / 1024.0, 1))
  ELSE printf('%.1f MB', round_even(n_chars / 1048576.0, 1)) END AS size FROM documents""")
def document_sizes(spark, sf):
    """X-04 human-readable sizes of the document character counts."""
    return table(spark, sf, "documents").select("doc_id", X.format_size("n_chars").alias("size"))


def _order_versions(spark, sf):
    o = table(spark, sf, "orders")
    ver = F.concat(F.format_string("%d.%d.%d", F.year("o_orderdate") - 1990, F.month("o_orderdate"), F.dayofmonth("o_orderdate")),
                   F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("-rc."), F.dayofweek("o_orderdate").cast("string"))).otherwise(F.lit("")))
    return o.select(F.col("o_orderpriority").alias("name"), ver.alias("version"))


@register("latest_order_versions", """
WITH v AS (SELECT o_orderpriority AS name, year(o_orderdate) - 1990 AS ma, month(o_orderdate) AS mi, day(o_orderdate) AS pa,
  o_orderstatus <> 'P' AS rel, CASE WHEN o_orderstatus = 'P' THEN dayofweek(o_orderdate) + 1 ELSE 0 END AS rc,
  printf('%d.%d.%d', year(o_orderdate) - 1990, month(o_orderdate), day(o_orderdate)) ||
  CASE WHEN o_orderstatus = 'P' THEN '-rc.' || CAST(dayofweek(o_orderdate) + 1 AS VARCHAR) ELSE '' END AS version FROM orders)
SELECT name, arg_max(version, struct_pack(ma := ma, mi := mi, pa := pa, rel := rel, rc := rc)) AS latest,
  arg_max(version, struct_pack(ma := ma, mi := mi, pa := pa, rel := rel, rc := rc)) AS effective FROM v GROUP BY name""")
def latest_order_versions(spark, sf):
    """X-06 / W-05: order dates as SemVer (pending orders as release candidates numbered by
    weekday); latest per priority under SemVer 2.0 order."""
    return VR.latest_versions(_order_versions(spark, sf)).select("name", "latest", "effective")


@register("nested_path_samples", """
SELECT CAST(json_extract(props, '$.k') AS VARCHAR) AS input, event_type AS output FROM events""")
def nested_path_samples(spark, sf):
    """P-02 nested-path mapping over landed JSON bodies built from events ({"a": {"b": props}, "t": type})."""
    e = table(spark, sf, "events").select(F.concat(F.lit('{"a": {"b": '), F.col("props"), F.lit('}, "t": "'),
                                                   F.col("event_type"), F.lit('"}')).alias("body"))
    good, _ = P.map_nested(e, "body", "a.b.k", "t")
    return good.select("input", "output")


@register("page_field_samples", "SELECT url AS input, '' AS output FROM pages")
def page_field_samples(spark, sf):
    """P-04 field mapping (url -> input; the absent title column -> '')."""
    return P.field_mapping(table(spark, sf, "pages"), {"input": "url", "output": "title"}).select("input", "output")


@register("task_contract_rejects", """
SELECT count(*) FILTER (WHERE text IS NOT NULL AND role IS NOT NULL) AS accepted,
       count(*) FILTER (WHERE text IS NULL OR role IS NULL) AS rejected FROM conversations""")
def task_contract_rejects(spark, sf):
    """P-05 task contract: (text -> input, role -> output); rows lacking either rejected."""
    ok, bad = P.task_contract(table(spark, sf, "conversations"), "text", "role")
    from ..operators.relate import with_one_row
    return with_one_row(ok.agg(F.count(F.lit(1)).alias("accepted")), bad.agg(F.count(F.lit(1)).alias("rejected")))


@register("long_user_messages", """
SELECT conv_id, turn FROM conversations WHERE length(coalesce(text, '')) >= 200 AND role <> 'system' AND turn BETWEEN 1 AND 5""")
def long_user_messages(spark, sf):
    """F-02 message filter: no bots (system turns), >= 200 chars, turn range 1..5."""
    m = table(spark, sf, "conversations").withColumn("is_bot", F.col("role") == "system")
    return P.message_filter(m, 200, False, 1, 5, ts_col="turn").select("conv_id", "turn")


@register("metadata_filter", "SELECT doc_id FROM documents WHERE lang = 'de' AND source = 'src3'")
def metadata_filter(spark, sf):
    """F-03 metadata equality filters over a metadata struct."""
    d = table(spark, sf, "documents").select("doc_id", F.struct("lang", "source").alias("metadata"))
    return P.metadata_equals(d, {"lang": "de", "source": "src3"}).select("doc_id")


@register("page_text_search", """
SELECT page_id FROM pages WHERE contains(lower(coalesce(url, '')), 'example.com/en') OR contains(lower(coalesce(html, '')), 'ththre')""")
def page_text_search(spark, sf):
    """F-05 case-insensitive contains over title (url here) else body (html)."""
    p = table(spark, sf, "pages")
    a = P.text_search(p, "example.com/en", "url", "html", title_only=True).select("page_id")
    b = P.text_search(p, "ththre", "url", "html").select("page_id")
    return a.union(b).distinct()


@register("error_level_events", "SELECT DISTINCT user_id FROM events WHERE upper(event_type) = 'ERROR'")
def error_level_events(spark, sf):
    """F-06 level filter (upper-cased) and the distinct source list (users)."""
    return P.level_filter(table(spark, sf, "events"), "error", level_col="event_type").select("user_id").distinct()


@register("document_keyword_coverage", """
WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS r, [lang, 'the', 'und', 'que'] AS kw, length(coalesce(text, '')) AS rl FROM documents),
s AS (SELECT doc_id, len(list_filter(kw, lambda k: contains(r, lower(k)))) / len(kw) AS coverage, rl FROM d)
SELECT doc_id, round(coverage, 6) AS coverage, coverage >= 0.5 AS passed, CAST(rl AS INTEGER) AS response_length FROM s""")
def document_keyword_coverage(spark, sf):
    """A-21 keyword coverage of each document for [lang, the, und, que]."""
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("response"),
                                             F.array("lang", F.lit("the"), F.lit("und"), F.lit("que")).alias("expected_keywords"))
    k = A.keyword_coverage(d)
    return k.select("doc_id", F.round("coverage", 6).alias("coverage"), "passed", "response_length")


@register("document_tag_match", """
SELECT doc_id FROM documents WHERE list_has_any([lang, source], ['de', 'src1'])""")
def document_tag_match(spark, sf):
    """F-04 any-tag match: documents tagged [lang, source] matching any of {de, src1}."""
    d = table(spark, sf, "documents").select("doc_id", F.array("lang", "source").alias("tags"))
    return P.tags_match(d, ["de", "src1"]).select("doc_id")


@register("aliased_samples", """
SELECT text AS input, role AS output FROM conversations""")
def aliased_samples(spark, sf):
    """P-06 column aliasing (profile extract): a (Question, Answer) frame -> (input, output)."""
    c = table(spark, sf, "conversations").select(F.col("text").alias("Question"), F.col("role").alias("Answer"), "turn")
    return P.alias_columns(c, "extract")


@register("conversation_alignment", """
WITH f AS (SELECT conv_id, arg_min(text, turn) AS prediction, arg_max(text, turn) AS reference FROM conversations GROUP BY conv_id)
SELECT conv_id, prediction, reference FROM f""")
def conversation_alignment(spark, sf):
    """J-09 alignment by id: each conversation's first turn (prediction) and last turn
    (reference); an id on one side only would fail the query."""
    from ..operators import relate as J
    c = table(spark, sf, "conversations")
    preds = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("prediction"))
    refs = c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("reference"))
    return J.align_by_key(preds, refs, "conv_id").select("conv_id", "prediction", "reference")


@register("chunk_parent_columns", """
SELECT 'doc-' || CAST(d.doc_id AS VARCHAR) AS name, CAST((s.st - 1) / 1000 AS INTEGER) AS chunk_index, d.lang, d.source
FROM (SELECT doc_id, unnest(range(1, length(text) + 1, 1000)) AS st FROM documents WHERE length(text) > 0) s
JOIN documents d ON d.doc_id = s.doc_id""")
def chunk_parent_columns(spark, sf):
    """J-15 parent document columns (lang, source) attached to every fixed-size chunk."""
    from ..operators import relate as J
    from ..operators import text as D
    docs = table(spark, sf, "documents")
    ch = D.fixed_chunks(docs.select("doc_id", "text", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name")),
                        "name", "text", 1000).withColumn("doc_id", F.regexp_extract("name", r"^doc-(\d+)$", 1).cast("bigint"))
    return J.attach_parent(ch, docs, "doc_id", ["lang", "source"]).select("name", "chunk_index", "lang", "source")
