"""Source / sink round trips over driver tables (S family): data is written to the shared
checkpoint folder by one operator and read back by another."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import checkpoint_dir, table
from ..sources import api as SA
from ..sources import files as SF
from ..sources import jsonl as SJ
from ..sources import sinks as SK
from .catalog import register
from .text import CHUNK_OVERLAP, CHUNK_SIZE, CHUNKS_SQL


def _scratch(spark, tag):
    return checkpoint_dir(spark).rstrip("/") + f"/{tag}-{uuid.uuid4().hex[:12]}"


@register("jsonl_roundtrip", """
SELECT md5(text) AS input_md5, source AS output FROM documents WHERE text IS NOT NULL AND source IS NOT NULL""")
def jsonl_roundtrip(spark, sf):
    """S-15 JSONL sink -> S-01 strict JSONL read of every document sample."""
    p = _scratch(spark, "jsonl")
    d = table(spark, sf, "documents").select(F.col("text").alias("input"), F.col("source").alias("output"))
    SK.save_samples(d, p, "jsonl")
    r = SJ.load_jsonl_strict(spark, p)
    return r.select(F.md5("input").alias("input_md5"), "output")


@register("csv_roundtrip", """
SELECT regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS input, regexp_replace(role, '^\\s+|\\s+$', '', 'g') AS output FROM conversations
WHERE regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') <> '' AND regexp_replace(coalesce(role, ''), '^\\s+|\\s+$', '', 'g') <> ''""")
def csv_roundtrip(spark, sf):
    """S-15 CSV sink (multi-line quoted fields) -> S-05 CSV read with mapping, trim, drop empty."""
    p = _scratch(spark, "csv")
    c = table(spark, sf, "conversations").select(F.col("text").alias("input"), F.col("role").alias("output"))
    SK.save_samples(c, p, "csv")
    return SF.load_csv_mapped(spark, p, {"input": "input", "output": "output"})


@register("api_envelope_items", """
SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') || '/' || CAST(event_id // 500 AS VARCHAR) AS page, count(*) AS n_items,
  CAST(sum(event_id) AS BIGINT) AS id_sum FROM events GROUP BY 1""")
def api_envelope_items(spark, sf):
    """S-10: events landed as API responses of one day and at most 500 ids
    ({"data": [...], "next": cursor}) -> items again."""
    page = F.concat_ws("/", F.date_format("ts", "yyyy-MM-dd"), F.floor(F.col("event_id") / 500).cast("string"))
    e = table(spark, sf, "events").withColumn("page", page)
    resp = e.groupBy("page").agg(F.to_json(F.struct(
        F.collect_list(F.struct("event_id", "event_type")).alias("data"), F.max("event_id").cast("string").alias("next")))
        .alias("body"))
    items = SA.envelope_items(resp, "body")
    return items.groupBy("page").agg(F.count(F.lit(1)).alias("n_items"),
                                     F.sum(F.try_variant_get("item", "$.event_id", "bigint")).alias("id_sum"))


LINES_SQL = """
SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS seq,
  CASE WHEN role = 'system' THEN json_object('input', text)::VARCHAR
       WHEN role = 'user' THEN json_object('question', text, 'answer', role)::VARCHAR
       ELSE json_object('input', text, 'output', role)::VARCHAR END AS line FROM conversations
UNION ALL SELECT CAST(1000000000 + doc_id AS BIGINT), replace(text, chr(10), ' ') FROM documents WHERE trim(text) <> ''"""


def _landed_lines(spark, sf, path):
    c = table(spark, sf, "conversations")
    line = (F.when(F.col("role") == "system", F.to_json(F.struct(F.col("text").alias("input"))))
            .when(F.col("role") == "user", F.to_json(F.struct(F.col("text").alias("question"), F.col("role").alias("answer"))))
            .otherwise(F.to_json(F.struct(F.col("text").alias("input"), F.col("role").alias("output")))))
    d = table(spark, sf, "documents").filter(F.trim("text") != "").select(F.regexp_replace("text", "\n", " ").alias("value"))
    c.select(line.alias("value")).unionByName(d).write.mode("overwrite").text(path)


@register("jsonl_lenient_outcomes", f"""
WITH l AS ({LINES_SQL})
SELECT CASE WHEN try(json(line)) IS NULL THEN 'invalid_json' WHEN json_extract_string(line, '$.input') IS NULL THEN 'missing_input'
  WHEN json_extract_string(line, '$.output') IS NULL THEN 'missing_output' ELSE 'valid' END AS outcome, count(*) AS n FROM l GROUP BY 1""")
def jsonl_lenient_outcomes(spark, sf):
    """S-02 lenient JSONL read of landed conversation records and document lines: kept rows
    and rejects by reason."""
    p = _scratch(spark, "lenient")
    _landed_lines(spark, sf, p)
    good, bad = SJ.load_jsonl_lenient(spark, p)
    g = good.agg(F.count(F.lit(1)).alias("n")).select(F.lit("valid").alias("outcome"), "n")
    return g.unionByName(bad.groupBy(F.col("reason").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))).filter("n > 0")


@register("record_key_fallback", f"""
WITH l AS ({LINES_SQL}), j AS (SELECT try(json(line)) AS v FROM l)
SELECT CASE WHEN json_extract_string(v, '$.input') IS NOT NULL AND json_extract_string(v, '$.output') IS NOT NULL THEN 'io' ELSE 'qa' END AS kind,
  count(*) AS n FROM j WHERE (json_extract_string(v, '$.input') IS NOT NULL AND json_extract_string(v, '$.output') IS NOT NULL)
  OR (json_extract_string(v, '$.question') IS NOT NULL AND json_extract_string(v, '$.answer') IS NOT NULL) GROUP BY 1""")
def record_key_fallback(spark, sf):
    """P-07: records mapped by input/output, else question/answer (user turns land as Q/A)."""
    from ..operators.mapping import record_fallback
    p = _scratch(spark, "records")
    _landed_lines(spark, sf, p)
    r = record_fallback(spark.read.text(p), "value")
    return r.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@register("prediction_lines", """
SELECT CASE WHEN role = 'assistant' THEN text ELSE 'turn ' || CAST(turn AS VARCHAR) END AS text, count(*) AS n
FROM conversations GROUP BY 1""")
def prediction_lines(spark, sf):
    """S-18: prediction files (assistant turns carry "response", others only "turn") read with
    field fallback: configured field, else default field, else the plain line."""
    p = _scratch(spark, "preds")
    c = table(spark, sf, "conversations")
    line = F.when(F.col("role") == "assistant", F.to_json(F.struct(F.col("text").alias("response")))) \
        .otherwise(F.to_json(F.struct(F.format_string("turn %d", "turn").alias("prediction"))))
    c.select(line.alias("value")).write.mode("overwrite").text(p)
    r = SJ.load_prediction_lines(spark, p, field="response")
    return r.groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@register("index_persist", f"""
SELECT doc_id, count(*) AS n_chunks, CAST(sum(n_chars) AS BIGINT) AS chars, CAST({CHUNK_SIZE} AS BIGINT) AS chunk_size,
  CAST({CHUNK_OVERLAP} AS BIGINT) AS overlap FROM ({CHUNKS_SQL}) GROUP BY doc_id""")
def index_persist(spark, sf):
    """S-16: every chunk of every document persisted with the index config, then loaded."""
    from ..operators.text import chunk_documents
    p = _scratch(spark, "index")
    ch = chunk_documents(table(spark, sf, "documents"), "doc_id", "text", "index", CHUNK_SIZE, CHUNK_OVERLAP)
    SK.save_index(ch.select(F.col("chunk_id").alias("id"), "content", "doc_id"), {"chunk_size": CHUNK_SIZE, "overlap": CHUNK_OVERLAP}, p)
    back, cfg = SK.load_index(spark, p)
    n = back.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("content")).alias("chars"))
    return n.select("*", F.lit(cfg["chunk_size"]).cast("long").alias("chunk_size"), F.lit(cfg["overlap"]).cast("long").alias("overlap"))
