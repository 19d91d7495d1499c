"""Sample-building queries: chat pairs, threads, mapping, dedup, combine (J, P, A-01...A-08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mapping as P
from ..operators import relate as J
from ..operators import stats as A
from ..functions.text import py_strip
from ..session import table
from .catalog import register, sql_clean_chat, sql_word_count

MIN_CHAT_LEN = 20


def _messages(spark, sf):
    """Conversations as chat messages: channel = conversation, ts = turn."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("channel_id"), F.col("turn").alias("ts"), "role", "text")


def _pairs(spark, sf):
    p = J.consecutive_pairs(_messages(spark, sf), min_length=MIN_CHAT_LEN, carry=["role"])
    return p.select("input", "output", F.col("metadata.channel_id").alias("channel_id"),
                    F.col("metadata.input_ts").alias("input_ts"), F.col("metadata.output_ts").alias("output_ts"),
                    F.col("metadata.input_role").alias("input_role"), F.col("metadata.output_role").alias("output_role"))


PAIRS_SQL = f"""
WITH p AS (
  SELECT conv_id AS channel_id, turn AS ts, role, coalesce(text, '') AS text,
         lead(turn) OVER w AS next_ts, lead(coalesce(text, '')) OVER w AS next_text, lead(role) OVER w AS next_role
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT {sql_clean_chat('text')} AS input, {sql_clean_chat('next_text')} AS output,
       channel_id, ts AS input_ts, next_ts AS output_ts, role AS input_role, next_role AS output_role
FROM p WHERE next_ts IS NOT NULL AND length(text) >= {MIN_CHAT_LEN} AND length(next_text) >= {MIN_CHAT_LEN}
"""


@register("chat_pairs", PAIRS_SQL)
def chat_pairs(spark, sf):
    """J-06 + D-08: consecutive message pairs per conversation, both sides >= 20 chars."""
    return _pairs(spark, sf)


def deduped_pairs(spark, sf):
    return J.dedup(_pairs(spark, sf), ["channel_id", "input_ts"], "lower_trim_input")


DEDUP_PAIRS_SQL = f"""
WITH s AS ({PAIRS_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY lower(regexp_replace(input, '^\\s+|\\s+$', '', 'g')) ORDER BY channel_id, input_ts) AS rn FROM s)
SELECT input, output, channel_id, input_ts, output_ts, input_role, output_role FROM r WHERE rn = 1
"""


@register("chat_samples", DEDUP_PAIRS_SQL)
def chat_samples(spark, sf):
    """Flagship: J-06 pairs -> J-01 keep-first dedup on lower(trim(input))."""
    return deduped_pairs(spark, sf)


@register("chat_samples_summary", f"""
WITH d AS ({DEDUP_PAIRS_SQL})
SELECT count(*) AS n_records,
       round(coalesce(avg({sql_word_count('input')}), 0), 6) AS avg_input_len,
       round(coalesce(avg({sql_word_count('output')}), 0), 6) AS avg_output_len FROM d""")
def chat_samples_summary(spark, sf):
    """A-01 over the flagship samples (word counts by X-10)."""
    s = A.dataset_summary(deduped_pairs(spark, sf))
    return s.select("n_records", F.round("avg_input_len", 6).alias("avg_input_len"),
                    F.round("avg_output_len", 6).alias("avg_output_len"))


@register("chat_prompts", f"""
WITH s AS ({PAIRS_SQL})
SELECT 'User: ' || input || chr(10) || 'Assistant:' AS input, output, channel_id, input_ts
FROM s WHERE input_role = 'user' AND output_role = 'assistant'""")
def chat_prompts(spark, sf):
    """P-11: user turn -> assistant reply wrapped as a chat prompt."""
    p = _pairs(spark, sf).filter((F.col("input_role") == "user") & (F.col("output_role") == "assistant"))
    return P.chat_prompt(p).select("input", "output", "channel_id", "input_ts")


@register("causal_lm_text", f"""
WITH s AS ({DEDUP_PAIRS_SQL}) SELECT channel_id, input_ts, input || ' ' || output AS text FROM s""")
def causal_lm_text(spark, sf):
    """P-08: ``input + " " + output`` over the flagship samples."""
    return P.causal_text(deduped_pairs(spark, sf)).select("channel_id", "input_ts", "text")


THREAD_SQL = f"""
WITH t AS (SELECT conv_id, min(turn) AS thread_ts FROM conversations GROUP BY conv_id),
r AS (SELECT c.conv_id, t.thread_ts, string_agg(coalesce(c.text, ''), chr(10) ORDER BY c.turn) AS reply_text,
             count(*) AS reply_count
      FROM conversations c JOIN t ON c.conv_id = t.conv_id AND c.turn <> t.thread_ts GROUP BY c.conv_id, t.thread_ts)
SELECT {sql_clean_chat('p.text')} AS input, {sql_clean_chat('r.reply_text')} AS output,
       r.conv_id AS channel_id, r.thread_ts, r.reply_count
FROM r JOIN conversations p ON p.conv_id = r.conv_id AND p.turn = r.thread_ts
"""


@register("thread_samples", THREAD_SQL)
def thread_samples(spark, sf):
    """J-04: each conversation as a thread (first turn = parent) -> ordered, joined replies."""
    c = table(spark, sf, "conversations")
    first = c.groupBy("conv_id").agg(F.min("turn").alias("thread_ts"), F.count(F.lit(1)).alias("_n"))
    m = c.join(first, "conv_id").select(
        F.col("conv_id").alias("channel_id"), F.col("turn").alias("ts"), "thread_ts", "text",
        F.when(F.col("turn") == F.col("thread_ts"), F.col("_n") - 1).otherwise(F.lit(0)).alias("reply_count"))
    t = J.thread_qa(m, order_bucket=F.floor(F.col("rts") / 1024))
    return t.select("input", "output", F.col("metadata.channel_id").alias("channel_id"),
                    F.col("metadata.thread_ts").alias("thread_ts"), F.col("metadata.reply_count").alias("reply_count"))


@register("order_samples", """
SELECT CAST(o_orderpriority AS VARCHAR) AS input, CAST(o_orderstatus AS VARCHAR) AS output,
       'db' AS source, o_orderkey FROM orders""")
def order_samples(spark, sf):
    """P-01: SQL rows -> samples (priority -> status), source tag, key kept."""
    o = table(spark, sf, "orders")
    s = P.row_to_sample(o, {"input": "o_orderpriority", "output": "o_orderstatus"}, source="db",
                        extra_metadata={"o_orderkey": F.col("o_orderkey")})
    return s.select("input", "output", F.col("metadata.source").alias("source"),
                    F.col("metadata.o_orderkey").alias("o_orderkey"))


DOC_DEDUP_SQL = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) ORDER BY doc_id) AS rn FROM documents)
SELECT doc_id, lang, source, n_chars FROM r WHERE rn = 1"""


@register("document_dedup", DOC_DEDUP_SQL)
def document_dedup(spark, sf):
    """J-01 on documents: first doc id per lower(trim(text))."""
    d = table(spark, sf, "documents")
    return J.dedup(d, "doc_id", key=F.lower(py_strip("text"))).select("doc_id", "lang", "source", "n_chars")


@register("document_dedup_report", f"""
SELECT (SELECT count(*) FROM documents) AS before, count(*) AS after,
       (SELECT count(*) FROM documents) - count(*) AS removed FROM ({DOC_DEDUP_SQL})""")
def document_dedup_report(spark, sf):
    """J-01 report: rows before / after / removed."""
    d = table(spark, sf, "documents")
    return J.dedup_report(d, J.dedup(d, "doc_id", key=F.lower(py_strip("text"))))


@register("combined_source_counts", """
SELECT source_name, count(*) AS n FROM (
  SELECT 'documents' AS source_name FROM documents
  UNION ALL SELECT 'conversations' FROM conversations
  UNION ALL SELECT 'benchmark' FROM benchmark) GROUP BY source_name""")
def combined_source_counts(spark, sf):
    """J-02: union of three sample sources with per-source counts."""
    docs = table(spark, sf, "documents").select(F.col("text").alias("input"), F.col("source").alias("output"))
    conv = table(spark, sf, "conversations").select(F.col("text").alias("input"), F.col("role").alias("output"))
    bench = table(spark, sf, "benchmark").select(F.col("text").alias("input"))
    _, counts = J.combine_sources({"documents": docs, "conversations": conv, "benchmark": bench})
    return counts


@register("merged_failures", """
WITH f AS (SELECT text AS input, '' AS output, item_id AS seq FROM benchmark),
n AS (SELECT *, row_number() OVER (PARTITION BY lower(input) ORDER BY seq) AS rn FROM f
      WHERE lower(input) NOT IN (SELECT lower(text) FROM documents WHERE text IS NOT NULL))
SELECT text AS input, source AS output, doc_id AS seq FROM documents
UNION ALL SELECT input, output, seq + 1000000000 FROM n WHERE rn = 1""")
def merged_failures(spark, sf):
    """J-03: benchmark items as failures merged into documents-as-training (new inputs only)."""
    train = table(spark, sf, "documents").select(F.col("text").alias("input"), F.col("source").alias("output"),
                                                 F.col("doc_id").alias("seq"))
    fail = table(spark, sf, "benchmark").select(F.col("text").alias("input"), F.lit("").alias("output"),
                                                F.col("item_id").alias("seq"))
    m = J.merge_failures(train, fail, "seq")
    # failures keep their own order after the training rows
    return m.select("input", "output", "seq").withColumn(
        "seq", F.when(F.col("output") == "", F.col("seq") + 1000000000).otherwise(F.col("seq")))


@register("order_customer_names", """
SELECT o.o_orderkey, o.o_custkey, coalesce(c.c_name, 'user_' || right(CAST(o.o_custkey AS VARCHAR), 4)) AS user_name
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def order_customer_names(spark, sf):
    """J-07: user lookup with the default ``user_<last 4>`` name."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer")
    return J.user_lookup(o, c, "o_custkey", "c_custkey", "c_name").select("o_orderkey", "o_custkey", "user_name")


@register("document_stats", """
SELECT count(*) AS total_examples, count(DISTINCT source) AS unique_outputs,
       round(avg(length(text)), 6) AS avg_input_length, round(avg(length(source)), 6) AS avg_output_length,
       min(length(text)) AS min_input_length, max(length(text)) AS max_input_length FROM documents""")
def document_stats(spark, sf):
    """A-02 over documents as samples (text -> source)."""
    d = table(spark, sf, "documents").select(F.col("text").alias("input"), F.col("source").alias("output"))
    s = A.dataset_stats(d)
    return s.select("total_examples", "unique_outputs", F.round("avg_input_length", 6).alias("avg_input_length"),
                    F.round("avg_output_length", 6).alias("avg_output_length"),
                    F.col("min_input_length").cast("bigint").alias("min_input_length"),
                    F.col("max_input_length").cast("bigint").alias("max_input_length"))


@register("lang_distribution", """
SELECT lang AS output, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, output LIMIT 15""")
def lang_distribution(spark, sf):
    """A-02 output distribution (top 15) with language as the output."""
    return A.output_distribution(table(spark, sf, "documents").select(F.col("lang").alias("output")), 15)


@register("pair_quality", f"""
WITH s AS ({PAIRS_SQL})
SELECT count(*) AS total, count(*) FILTER (WHERE length(input) < 3) AS input_too_short,
       count(*) FILTER (WHERE length(output) < 3) AS output_too_short,
       count(*) FILTER (WHERE length(output) > 2000) AS output_too_long,
       count(*) - count(DISTINCT input) AS duplicate_inputs FROM s""")
def pair_quality(spark, sf):
    """A-04 quality checks over chat pairs."""
    return A.quality_checks(_pairs(spark, sf))


@register("label_balance", """
WITH c AS (SELECT quality AS output, count(*) AS n FROM labels GROUP BY quality),
s AS (SELECT output, n, n / sum(n) OVER () AS share FROM c)
SELECT output, n, round(share, 6) AS share, round(max(share) OVER (), 6) AS dominant_share FROM s""")
def label_balance(spark, sf):
    """A-05 class balance of the quality label."""
    b = A.class_balance(table(spark, sf, "labels").select(F.col("quality").alias("output")))
    return b.select("output", "n", F.round("share", 6).alias("share"), F.round("dominant_share", 6).alias("dominant_share"))


@register("source_lang_counts", """
SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang""")
def source_lang_counts(spark, sf):
    """A-06 counts per source and language."""
    return A.counts_by(table(spark, sf, "documents"), ["source", "lang"])


@register("order_status_totals", """
SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f,
       count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p,
       round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders""")
def order_status_totals(spark, sf):
    """A-07 one-pass conditional totals."""
    t = A.status_totals(table(spark, sf, "orders"), "o_orderstatus", ["F", "O", "P"], "o_totalprice")
    return t.withColumn("sum_o_totalprice", F.round("sum_o_totalprice", 2))


@register("order_status_counts", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def order_status_counts(spark, sf):
    """A-08 count by status."""
    return A.status_counts(table(spark, sf, "orders"), "o_orderstatus")


JSONL_LINES_SQL = """
SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS line_num,
       CASE WHEN role = 'system' THEN json_object('input', text)::VARCHAR
            ELSE json_object('input', text, 'output', role)::VARCHAR END AS line FROM conversations
UNION ALL SELECT CAST(1000000000 + doc_id AS BIGINT), text FROM documents"""


def _jsonl_lines(spark, sf):
    c = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).cast("bigint").alias("line_num"),
        F.when(F.col("role") == "system", F.to_json(F.struct(F.col("text").alias("input"))))
        .otherwise(F.to_json(F.struct(F.col("text").alias("input"), F.col("role").alias("output")))).alias("line"))
    d = table(spark, sf, "documents").select((F.lit(1000000000) + F.col("doc_id")).cast("bigint").alias("line_num"),
                                             F.col("text").alias("line"))
    return c.unionByName(d)


@register("jsonl_validation", f"""
WITH l AS ({JSONL_LINES_SQL}),
p AS (SELECT line_num, line, regexp_replace(coalesce(line, ''), '^\\s+|\\s+$', '', 'g') = '' AS blank, try(json(line)) AS j FROM l),
k AS (SELECT *, CASE WHEN blank THEN 'blank' WHEN j IS NULL THEN 'invalid_json'
                     WHEN json_extract_string(j, '$.input') IS NULL THEN 'missing_input'
                     WHEN json_extract_string(j, '$.output') IS NULL THEN 'missing_output' ELSE 'valid' END AS kind,
              json_extract_string(j, '$.input') AS input, json_extract_string(j, '$.output') AS output FROM p),
v AS (SELECT *, line_num > min(line_num) OVER (PARTITION BY input) AS dup FROM k WHERE kind = 'valid')
SELECT (SELECT count(*) FROM k) AS total_lines,
       (SELECT count(*) FROM k WHERE kind = 'invalid_json') AS invalid_json,
       (SELECT count(*) FROM k WHERE kind IN ('missing_input', 'missing_output')) AS missing_field,
       count(*) AS valid_examples, count(*) FILTER (WHERE regexp_replace(input, '^\\s+|\\s+$', '', 'g') = '') AS empty_inputs,
       count(*) FILTER (WHERE regexp_replace(output, '^\\s+|\\s+$', '', 'g') = '') AS empty_outputs, count(*) FILTER (WHERE dup) AS duplicates,
       count(*) FILTER (WHERE length(output) < 10) AS short_outputs,
       round(coalesce(avg(length(input)), 0), 6) AS avg_input_length,
       round(coalesce(avg(length(output)), 0), 6) AS avg_output_length FROM v""")
def jsonl_validation(spark, sf):
    """A-03 over JSON lines built from conversations (system turns lack ``output``) and
    raw document texts (invalid JSON)."""
    _, stats = A.validation_report(_jsonl_lines(spark, sf))
    return stats.select("total_lines", "invalid_json", "missing_field", "valid_examples", "empty_inputs",
                        "empty_outputs", "duplicates", "short_outputs",
                        F.round("avg_input_length", 6).alias("avg_input_length"),
                        F.round("avg_output_length", 6).alias("avg_output_length"))


@register("conversation_documents", """
SELECT conv_id, string_agg('Input: ' || coalesce(text, '') || chr(10) || 'Output: ' || coalesce(role, ''), chr(10) || chr(10) ORDER BY turn) AS text,
  count(*) AS n_parts FROM conversations GROUP BY conv_id""")
def conversation_documents(spark, sf):
    """P-09: per conversation, its records as one "Input: ...\\nOutput: ..." document in turn order."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("input"), F.col("role").alias("output"))
    return P.records_to_document(c, "conv_id", "turn")


@register("chat_timestamps", """
SELECT conv_id, turn, strftime(make_timestamp(CAST((1700000000 + conv_id * 3600 + turn * 60) * 1000000 + turn AS BIGINT)), '%Y-%m-%d %H:%M:%S.%f') AS at
FROM conversations""")
def chat_timestamps(spark, sf):
    """X-07: chat "sec.micros" stamps (built from conversation and turn) -> timestamps."""
    from ..sources.exports import chat_ts
    from ..functions.time import to_ntz
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.format_string(
        "%d.%06d", F.lit(1700000000) + F.col("conv_id") * 3600 + F.col("turn") * 60, F.col("turn")).alias("ts"))
    return c.select("conv_id", "turn", F.date_format(to_ntz(chat_ts("ts")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


@register("jsonl_validation_hands_on", f"""
WITH l AS ({JSONL_LINES_SQL}),
p AS (SELECT line_num, try(json(line)) AS j FROM l),
k AS (SELECT j IS NOT NULL AS ok, json_extract_string(j, '$.input') AS input, json_extract_string(j, '$.output') AS output FROM p),
f AS (SELECT ok, (CASE WHEN NOT ok THEN 1 ELSE 0 END) + (CASE WHEN ok AND input IS NULL THEN 1 ELSE 0 END)
        + (CASE WHEN ok AND output IS NULL THEN 1 ELSE 0 END)
        + (CASE WHEN ok AND regexp_replace(coalesce(input, ''), '^\\\\s+|\\\\s+$', '', 'g') = '' THEN 1 ELSE 0 END)
        + (CASE WHEN ok AND regexp_replace(coalesce(output, ''), '^\\\\s+|\\\\s+$', '', 'g') = '' THEN 1 ELSE 0 END)
        + (CASE WHEN ok AND length(coalesce(output, '')) < 10 THEN 1 ELSE 0 END) AS n FROM k)
SELECT count(*) AS total_lines, count(*) FILTER (WHERE ok) AS examples, CAST(sum(n) AS BIGINT) AS issues FROM f""")
def jsonl_validation_hands_on(spark, sf):
    """A-03 second profile over the same landed lines."""
    _, totals = A.validation_report_hands_on(_jsonl_lines(spark, sf))
    return totals.select("total_lines", "examples", F.col("issues").cast("bigint").alias("issues"))
