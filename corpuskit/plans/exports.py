"""File and export sources over driver tables: rows land as the files that a source brings (chat, wiki
and workspace exports, JSON arrays, mixed folders, XML) in the shared checkpoint folder, some of them
broken, and are read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import mapping as M
from ..session import checkpoint_dir, table
from ..sources import api as SA
from ..sources import exports as SE
from ..sources import files as SF
from ..sources import jsonl as SJ
from ..sources import sql as SQ
from ..streaming import stream as S
from .catalog import register

#: Conversations of a channel, and which channels land cut short, with a wrong bracket, or with a stray element.
CHANNEL = 5
CUT, BRACKET, STRAY = 3, 5, 6


def _scratch(spark, tag):
    return checkpoint_dir(spark).rstrip("/") + f"/{tag}-{uuid.uuid4().hex[:12]}"


def _land(df, folder: str, path: str):
    """(folder, value) -> a file of that one text in a folder of that name."""
    df.select(folder, "value").write.partitionBy(folder).text(path)


def _channel_files(spark, sf, path):
    c = table(spark, sf, "conversations").withColumn("channel", F.floor(F.col("conv_id") / CHANNEL))
    ts = F.format_string("%d.%06d", 1_700_000_000 + F.col("conv_id"), F.col("turn"))
    message = F.to_json(F.struct(ts.alias("ts"), "text", F.when(F.col("role") == "user", F.concat(F.lit("U"), "conv_id")).alias("user"),
                                 F.when(F.col("role") == "assistant", F.lit("B1")).alias("bot_id"),
                                 F.when(F.col("role") == "system", F.lit("bot_message")).alias("subtype")))
    files = c.groupBy("channel").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "turn", message.alias("m")))), lambda x: x["m"]), ",").alias("m"))
    kind = F.pmod("channel", F.lit(8))
    value = (F.when(kind == CUT, F.concat(F.lit('{"messages":['), "m")).when(kind == BRACKET, F.concat(F.lit("["), "m", F.lit("}]")))
             .when(kind == STRAY, F.concat(F.lit('[17,'), "m", F.lit("]"))).when(kind % 2 == 0, F.concat(F.lit("["), "m", F.lit("]")))
             .otherwise(F.concat(F.lit('{"ok":true,"messages":['), "m", F.lit('],"more":{"messages":[]}}'))))
    _land(files.withColumn("value", value), "channel", path)


@register("chat_export_messages", f"""
SELECT 'channel=' || CAST(conv_id // {CHANNEL} AS VARCHAR) AS channel_id, printf('%d.%06d', 1700000000 + conv_id, turn) AS ts,
  (1700000000 + conv_id) * 1000000 + turn AS at_us, coalesce(text, '') AS text, CASE WHEN role = 'user' THEN 'U' || CAST(conv_id AS VARCHAR) END AS user,
  role IN ('assistant', 'system') AS is_bot FROM conversations WHERE (conv_id // {CHANNEL}) % 8 NOT IN ({CUT}, {BRACKET})""")
def chat_export_messages(spark, sf):
    """S-12 / X-07: conversations landed as one export file a channel (array root or wrapped) -> messages;
    files that are cut short or unbalanced give none."""
    p = _scratch(spark, "chat")
    _channel_files(spark, sf, p)
    m = SE.chat_messages(spark, p)
    return m.select("channel_id", "ts", F.unix_micros("at").alias("at_us"), "text", "user", "is_bot")


@register("chat_export_rejects", f"""
WITH c AS (SELECT DISTINCT CAST(conv_id // {CHANNEL} AS BIGINT) AS k FROM conversations)
SELECT 'channel=' || CAST(k AS VARCHAR) AS channel, CASE k % 8 WHEN {CUT} THEN 'open brackets at the end' WHEN {BRACKET} THEN 'too many closing brackets'
  ELSE 'not an object' END AS reason, CASE k % 8 WHEN {STRAY} THEN '17' END AS text FROM c WHERE k % 8 IN ({CUT}, {BRACKET}, {STRAY})""")
def chat_export_rejects(spark, sf):
    """S-12: what the same read leaves out, and why."""
    p = _scratch(spark, "chat")
    _channel_files(spark, sf, p)
    r = SE.rejects(spark, p, "chat_messages")
    return r.select(F.element_at(F.split("file", "/"), -2).alias("channel"), "reason", "text")


@register("wiki_export_pages", """
SELECT CAST(page_id AS VARCHAR) AS id, url AS title, 'S' || CAST(page_id % 7 AS VARCHAR) AS space_key, CAST(page_id % 4 + 1 AS INTEGER) AS version,
  CASE WHEN page_id % 3 > 0 THEN 'a' || CAST(page_id % 3 AS VARCHAR) END AS parent_id, CAST(page_id % 3 AS INTEGER) AS n_ancestors, md5(coalesce(html, '')) AS body_md5 FROM pages""")
def wiki_export_pages(spark, sf):
    """S-13: pages landed as wiki exports of some 50 pages -> typed pages; the parent is the last ancestor."""
    p = _scratch(spark, "wiki")
    d = table(spark, sf, "pages").select(F.floor(F.col("page_id") / 50).alias("batch"), "page_id", F.to_json(F.struct(
        F.col("page_id").cast("string").alias("id"), F.col("url").alias("title"), F.struct(F.concat(F.lit("S"), F.col("page_id") % 7).alias("key")).alias("space"),
        F.when(F.col("page_id") % 4 > 0, F.struct((F.col("page_id") % 4 + 1).alias("number"))).alias("version"),
        F.transform(F.slice(F.array(F.lit("a1"), F.lit("a2")), F.lit(1), (F.col("page_id") % 3).cast("int")), lambda a: F.struct(a.alias("id"))).alias("ancestors"),
        F.struct(F.struct(F.col("html").alias("value")).alias("storage")).alias("body"))).alias("j"))
    files = d.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "j"))), lambda x: x["j"]), ",\n").alias("j"))
    _land(files.withColumn("value", F.concat(F.lit('{"results": [\n'), "j", F.lit('\n], "size": 50}'))), "batch", p)
    w = SE.wiki_pages(spark, p)
    return w.select("id", "title", "space_key", "version", "parent_id", F.size("ancestors").alias("n_ancestors"), F.md5("body_html").alias("body_md5"))


@register("workspace_export_samples", """
SELECT 'Database ' || CAST(doc_id // 200 AS VARCHAR) AS database_title, CAST(doc_id AS VARCHAR) AS id, 'Document ' || CAST(doc_id AS VARCHAR) AS title,
  CASE WHEN doc_id % 2 = 0 THEN 'database_id' ELSE 'workspace' END AS parent_type,
  coalesce(CASE doc_id % 5 WHEN 0 THEN lang WHEN 1 THEN source || ', ' || lang WHEN 2 THEN CASE WHEN n_chars > 1000 THEN 'True' ELSE 'False' END
    WHEN 3 THEN CAST(n_chars AS VARCHAR) ELSE 'https://example.org/' || CAST(doc_id AS VARCHAR) END, '') AS input,
  'Document ' || CAST(doc_id AS VARCHAR) AS output FROM documents""")
def workspace_export_samples(spark, sf):
    """S-14 / P-03: documents landed as workspace databases of 200 pages with properties of five types ->
    pages, and samples from the property "About" and the title."""
    p = _scratch(spark, "workspace")
    name = F.concat(F.lit("Document "), "doc_id")
    kind = F.col("doc_id") % 5
    about = (F.when(kind == 0, F.to_json(F.struct(F.lit("select").alias("type"), F.struct(F.col("lang").alias("name")).alias("select"))))
             .when(kind == 1, F.to_json(F.struct(F.lit("multi_select").alias("type"), F.array(F.struct(F.col("source").alias("name")), F.struct(F.col("lang").alias("name"))).alias("multi_select"))))
             .when(kind == 2, F.to_json(F.struct(F.lit("checkbox").alias("type"), (F.col("n_chars") > 1000).alias("checkbox"))))
             .when(kind == 3, F.to_json(F.struct(F.lit("number").alias("type"), F.col("n_chars").alias("number"))))
             .otherwise(F.to_json(F.struct(F.lit("url").alias("type"), F.concat(F.lit("https://example.org/"), "doc_id").alias("url")))))
    title = F.to_json(F.struct(F.lit("title").alias("type"), F.array(F.struct(F.lit("Document ").alias("plain_text")), F.struct(F.col("doc_id").cast("string").alias("plain_text"))).alias("title")))
    parent = F.when(F.col("doc_id") % 2 == 0, F.lit('{"type":"database_id","database_id":"d"}')).otherwise(F.lit('{"type":"workspace","workspace":true}'))
    page = F.concat(F.lit('{"id":"'), "doc_id", F.lit('","parent":'), parent, F.lit(',"properties":{"About":'), about, F.lit(',"Name":'), title, F.lit("}}"))
    files = (table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 200).alias("db"), "doc_id", page.alias("j"), name)
             .groupBy("db").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "j"))), lambda x: x["j"]), ", ").alias("j")))
    _land(files.withColumn("value", F.concat(F.lit('{"title": "Database '), "db", F.lit('", "pages": ['), "j", F.lit("]}"))), "db", p)
    pages = SE.workspace_pages(spark, p)
    samples = M.workspace_samples(pages, {"input": "About", "output": "title"})
    about_page = pages.select("database_title", "id", "title", "parent_type")
    return about_page.join(samples.select(F.col("metadata.page_id").alias("id"), "input", "output"), "id")


@register("json_file_records", """
SELECT md5(coalesce(text, '')) AS input_md5, role AS output, count(*) AS n FROM conversations GROUP BY 1, 2""")
def json_file_records(spark, sf):
    """S-04: turns landed as JSON arrays, and those of turn 0 as files of one object a line -> records."""
    p = _scratch(spark, "json")
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.col("text").alias("input"), F.col("role").alias("output"))).alias("j"))
    arrays = c.filter("turn > 0").groupBy(F.floor(F.col("conv_id") / 50).alias("part")).agg(F.array_join(F.collect_list("j"), ",").alias("j"))
    _land(arrays.withColumn("value", F.concat(F.lit("["), "j", F.lit("]"))), "part", p + "/arrays")
    _land(c.filter("turn = 0").select((F.col("conv_id") % 3).alias("part"), F.col("j").alias("value")), "part", p + "/objects")
    r = [SJ.load_json_records(spark, f"{p}/{x}", "input string, output string") for x in ("arrays", "objects")]
    return r[0].unionByName(r[1]).groupBy(F.md5(F.coalesce("input", F.lit(""))).alias("input_md5"), "output").agg(F.count(F.lit(1)).alias("n"))


@register("mixed_folder_samples", """
SELECT md5(text) AS input_md5, md5(coalesce(role, '')) AS output_md5, count(*) AS n FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL GROUP BY 1, 2""")
def mixed_folder_samples(spark, sf):
    """S-07: turns landed in one folder as JSON lines (even conversations) and JSON arrays (odd ones)."""
    p = _scratch(spark, "mixed")
    c = table(spark, sf, "conversations").filter("text IS NOT NULL AND role IS NOT NULL").select(
        "conv_id", F.to_json(F.struct(F.col("text").alias("question"), F.col("role").alias("answer"))).alias("value"))
    # Spark's CSV writer with a separator and a quote that occur nowhere writes lines as they are, under any suffix
    plain = {"sep": "\x01", "quote": "\x02", "escapeQuotes": "false"}
    c.filter("conv_id % 2 = 0").select("value").write.options(extension="jsonl", **plain).csv(p + "/lines")
    odd = c.filter("conv_id % 2 <> 0").groupBy(F.floor(F.col("conv_id") / 50).alias("part")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))
    odd.write.partitionBy("part").options(extension="json", **plain).csv(p + "/arrays")
    m = SF.load_mixed_folder(spark, p, mapping={"input": "question", "output": "answer"})
    return m.groupBy(F.md5("input").alias("input_md5"), F.md5("output").alias("output_md5")).agg(F.count(F.lit(1)).alias("n"))


@register("text_folder_documents", """
SELECT source || '-' || lang AS name, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(strlen(replace(text, chr(10), ' ')) + 1) AS BIGINT) AS size
FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL GROUP BY 1""")
def text_folder_documents(spark, sf):
    """S-06: documents landed as a text file for each source and language -> one row per file."""
    p = _scratch(spark, "texts")
    d = table(spark, sf, "documents").filter("text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL")
    one = d.select(F.concat_ws("-", "source", "lang").alias("name"), F.translate("text", "\n", " ").alias("value")).repartition("name")
    one.write.partitionBy("name").text(p)
    t = SF.load_text_files(spark, p, (".txt", ".md"))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -2), "^name=", "")
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return t.groupBy(name.alias("name")).agg(F.sum(lines).cast("long").alias("n_docs"), F.sum("size").alias("size"))


@register("xml_part_records", """
SELECT CAST(p_partkey AS VARCHAR) AS id, trim(p_name) AS name, p_brand AS first_tag, CAST(2 AS INTEGER) AS n_tags FROM part""")
def xml_part_records(spark, sf):
    """S-11: parts landed as XML responses (attribute, repeated children, padded text) -> records."""
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.concat(F.lit('<item id="'), "p_partkey", F.lit('"><tag>'), esc("p_brand"), F.lit("</tag><tag>"), esc("p_type"), F.lit("</tag><name>  "), esc("p_name"), F.lit(" </name></item>"))
    r = SA.xml_records(table(spark, sf, "part").select(body.alias("body")), "body", "_id string, tag array<string>, name string").select("record.*")
    return r.select(F.col("_id").alias("id"), "name", F.col("tag")[0].alias("first_tag"), F.size("tag").alias("n_tags"))


@register("stream_jsonl_samples", """
SELECT md5(text) AS input_md5, role AS output FROM conversations WHERE text IS NOT NULL""")
def stream_jsonl_samples(spark, sf):
    """S-03: turns landed as JSON-lines files, read one file a micro-batch."""
    p = _scratch(spark, "incremental")
    c = table(spark, sf, "conversations").filter("text IS NOT NULL").select(F.col("text").alias("input"), F.col("role").alias("output"))
    c.repartition(4, "input").write.json(p)
    r = S.run_to_table(SJ.stream_jsonl(spark, p, max_files=1), name="samples")
    return r.select(F.md5("input").alias("input_md5"), "output")


@register("catalog_query_samples", """
SELECT CAST(o_orderpriority AS VARCHAR) AS input, CAST(count(*) AS VARCHAR) AS output FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderpriority""")
def catalog_query_samples(spark, sf):
    """S-08, catalogue half: a parameterised SQL query over a table -> samples."""
    view = f"orders_{uuid.uuid4().hex[:8]}"
    table(spark, sf, "orders").createOrReplaceTempView(view)
    s = SQ.catalog_samples(spark, f"SELECT o_orderpriority, count(*) AS n FROM {view} WHERE o_totalprice > :least GROUP BY o_orderpriority",
                           {"input": "o_orderpriority", "output": "n"}, {"least": 100000})
    return s.select("input", "output")
