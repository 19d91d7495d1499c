"""Joins, unions and self-relations over samples and messages (J-01 ... J-11, J-15).

Joins are declared without hints: the planner sizes both sides and AQE turns a join into a
broadcast only after measuring the small side at runtime.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_chat_text, py_strip
from .ordered import keep_first, lead_split, ordered_concat


def with_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame (a global aggregate) to every row of ``df``.

    Catalyst plans this as a nested-loop join against the single broadcast row: linear in
    ``df``, no pairs are produced. Use only for one-row frames."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one").drop("_one")


# Dedup key profiles.
DEDUP_KEYS = {
    "lower_trim_input": lambda: F.lower(py_strip("input")),
    "lower_input": lambda: F.lower(F.col("input")),
    "pair": lambda: F.struct(F.col("input"), F.col("output")),
}


def dedup(df: DataFrame, order: Sequence[str] | str, profile: str = "lower_trim_input",
          key: Column | None = None) -> DataFrame:
    """J-01: keep-first dedup by a key expression (first = smallest ``order``)."""
    return keep_first(df, key if key is not None else DEDUP_KEYS[profile](), order)


def dedup_report(df: DataFrame, deduped: DataFrame) -> DataFrame:
    """J-01 report: rows before, after and removed (one row)."""
    a = df.agg(F.count(F.lit(1)).alias("before"))
    b = deduped.agg(F.count(F.lit(1)).alias("after"))
    return with_one_row(a, b).withColumn("removed", F.col("before") - F.col("after"))


def combine_sources(frames: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """J-02: union by name with a ``source_name`` column, plus per-source counts."""
    parts = [f.withColumn("source_name", F.lit(name)) for name, f in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    counts = out.groupBy("source_name").agg(F.count(F.lit(1)).alias("n"))
    return out, counts


def merge_failures(train: DataFrame, failures: DataFrame, order: str = "seq") -> DataFrame:
    """J-03: append failures whose lower-cased input is not already in training,
    themselves de-duplicated (first wins)."""
    fk = failures.withColumn("_lk", F.lower(F.col("input")))
    tk = train.select(F.lower(F.col("input")).alias("_lk")).distinct()
    new = keep_first(fk.join(tk, on="_lk", how="left_anti"), F.col("_lk"), order).drop("_lk")
    return train.unionByName(new, allowMissingColumns=True)


def thread_qa(messages: DataFrame, channel: str = "channel_id", ts: str = "ts",
              thread_ts: str = "thread_ts", text: str = "text", reply_count: str = "reply_count",
              order_bucket: Column | None = None) -> DataFrame:
    """J-04: thread parent (reply_count > 0) -> its replies (same thread, other ts) in ts
    order (string stamps compared as numbers), newline-joined, then cleaned (D-08). Parents
    without replies are skipped."""
    parents = messages.filter(F.col(reply_count) > 0).select(
        F.col(channel).alias("channel_id"), F.col(ts).alias("thread_ts"), F.col(text).alias("parent_text"))
    order = F.col(ts).cast("decimal(20,6)") if dict(messages.dtypes)[ts] == "string" else F.col(ts)
    replies = messages.filter(F.col(thread_ts).isNotNull() & (F.col(ts) != F.col(thread_ts))).select(
        F.col(channel).alias("channel_id"), F.col(thread_ts).alias("thread_ts"), order.alias("rts"),
        F.coalesce(F.col(text), F.lit("")).alias("rtext"))
    joined = ordered_concat(replies, ["channel_id", "thread_ts"], "rts", "rtext", "\n", "reply_text",
                            bucket=order_bucket)
    out = parents.join(joined.withColumnRenamed("n_parts", "n_replies"), on=["channel_id", "thread_ts"], how="inner")
    return out.select(
        clean_chat_text("parent_text").alias("input"), clean_chat_text("reply_text").alias("output"),
        F.struct(F.lit("slack").alias("source"), "channel_id", "thread_ts",
                 F.col("n_replies").alias("reply_count")).alias("metadata"))


def reaction_samples(messages: DataFrame, threads: DataFrame | None = None) -> DataFrame:
    """J-05: messages with reactions; output = their thread's joined replies, else ''."""
    m = messages.filter(F.size(F.coalesce(F.col("reactions"), F.array())) > 0)
    base = m.select("channel_id", F.col("ts"), clean_chat_text("text").alias("input"), "reactions", "reply_count")
    if threads is None:
        threads = thread_qa(messages)
    t = threads.select(F.col("metadata.channel_id").alias("channel_id"), F.col("metadata.thread_ts").alias("ts"),
                       F.col("output").alias("_out"))
    return base.join(t, on=["channel_id", "ts"], how="left").select(
        "input", F.when(F.col("reply_count") > 0, F.coalesce("_out", F.lit(""))).otherwise(F.lit("")).alias("output"),
        F.struct(F.lit("slack").alias("source"), "channel_id", "ts", "reactions").alias("metadata"))


def consecutive_pairs(messages: DataFrame, channel: str = "channel_id", ts: str = "ts", text: str = "text",
                      min_length: int = 0, bucket_width: float = 1024.0,
                      carry: Sequence[str] = ()) -> DataFrame:
    """J-06: message i -> message i+1 per channel by numeric ts (string stamps are compared as
    numbers); the pair is dropped when either raw text is shorter than ``min_length``. Texts
    are cleaned (D-08).

    The successor is found per (channel, ts bucket) so a very busy channel is split.
    """
    carry = list(carry)
    typ = dict(messages.dtypes)[ts]
    if typ.startswith("timestamp"):
        from ..functions.time import epoch_micros
        num = epoch_micros(messages, ts) / F.lit(1_000_000.0)
    elif typ == "string":  # chat stamps "sec.micros": ordered numerically, as float(ts)
        num = F.col(ts).cast("decimal(20,6)")
    else:
        num = F.col(ts)
    d = messages.select(F.col(channel).alias("channel_id"), F.col(ts).alias("ts"), num.alias("_tnum"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"), *carry)
    bucket = F.floor(F.col("_tnum").cast("double") / F.lit(bucket_width))
    d = lead_split(d, ["channel_id"], ["_tnum", "ts"], ["text"] + carry, bucket)
    d = d.filter(F.col("next_ts").isNotNull()
                 & (F.length("text") >= min_length) & (F.length("next_text") >= min_length))
    return d.select(
        clean_chat_text("text").alias("input"), clean_chat_text("next_text").alias("output"),
        F.struct(F.lit("slack").alias("source"), "channel_id", F.col("ts").alias("input_ts"),
                 F.col("next_ts").alias("output_ts"),
                 *[F.col(c).alias("input_" + c) for c in carry],
                 *[F.col("next_" + c).alias("output_" + c) for c in carry]).alias("metadata"))


def user_lookup(df: DataFrame, users: DataFrame, user_col: str, id_col: str = "id",
                name_col: str = "name") -> DataFrame:
    """J-07: attach the user name; unknown ids get ``user_<last 4 chars of id>``."""
    u = users.select(F.col(id_col).alias("_uid"), F.col(name_col).alias("user_name"))
    j = df.join(u, df[user_col] == u["_uid"], "left")
    uid = F.col(user_col).cast("string")
    default = F.concat(F.lit("user_"), F.substring(uid, -4, 4))
    return j.withColumn("user_name", F.coalesce("user_name", default)).drop("_uid")


def align_by_key(preds: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """J-09: predictions <-> references by id (full outer). An id on one side only fails
    the query at run time (distributed ``raise_error``, nothing collected)."""
    p = preds.withColumn("_pside", F.lit(True))
    r = refs.withColumn("_rside", F.lit(True))
    j = p.join(r, on=key, how="full_outer")
    unmatched = F.col("_pside").isNull() | F.col("_rside").isNull()
    # a filter predicate is never pruned, so the check runs on every row
    ok = F.when(unmatched, F.raise_error(F.lit("predictions and references must have the same length / ids")).cast("boolean")) \
        .otherwise(F.lit(True))
    return j.filter(ok).drop("_pside", "_rside")


def align_by_position(preds: DataFrame, refs: DataFrame, pred_order, ref_order) -> DataFrame:
    """J-09 by position: 0-based position of each side in its order, then ``align_by_key``."""
    from .ordered import positional_index
    return align_by_key(positional_index(preds, pred_order, "pos"), positional_index(refs, ref_order, "pos"), "pos")


def quota_check(requests: DataFrame, tenants: DataFrame, tiers: DataFrame,
                text_col: str = "text", tokens_col: str | None = None) -> DataFrame:
    """J-10: request x tenant x tier limits -> ``reject_reason`` (NULL = allowed).

    Input tokens are the word count of the text unless ``tokens_col`` is given. Checks in
    order: tenant inactive, input tokens above ``max_input_tokens``, model not allowed.
    """
    from ..functions.text import word_count
    d = requests.join(tenants, on="tenant_id", how="left").join(tiers, on="tier", how="left")
    tok = F.col(tokens_col) if tokens_col else word_count(text_col)
    d = d.withColumn("input_tokens", tok)
    allowed = F.when(F.col("allowed_models").isNull() | (F.size("allowed_models") == 0), F.lit(True)) \
        .otherwise(F.array_contains("allowed_models", F.col("model")))
    reason = (F.when(F.col("tier").isNull(), F.lit("unknown_tenant"))
              .when(F.col("status") != "active", F.lit("tenant_inactive"))
              .when(F.col("input_tokens") > F.col("max_input_tokens"), F.lit("input_too_long"))
              .when(~allowed, F.lit("model_not_allowed")))
    return d.withColumn("reject_reason", reason)


def event_fanout(events: DataFrame, endpoints: DataFrame, type_col: str = "event_type") -> DataFrame:
    """J-11: each event x every enabled endpoint subscribed to its type (empty or missing list =
    all types; a type listed twice counts once). The subscriptions are exploded and joined on the
    type; endpoints of all types come with every type that occurs, so the result follows the
    matches and no endpoint list is brought to the driver.
    """
    on = endpoints.filter(F.col("enabled")).select("endpoint_id", F.coalesce("events", F.array().cast("array<string>")).alias("_on"))
    listed = on.select("endpoint_id", F.explode(F.array_distinct("_on")).alias("_type")).filter(F.col("_type").isNotNull())
    # one row per event type, NULL included; every endpoint of all types goes with each of them
    types = events.select(F.col(type_col).alias("_type")).distinct().withColumn("_k", F.lit(1))
    every = on.filter(F.size("_on") == 0).select("endpoint_id", F.lit(1).alias("_k")).join(types, "_k").select("endpoint_id", "_type")
    subs = listed.unionByName(every)
    return events.join(subs, F.col(type_col).eqNullSafe(F.col("_type"))).drop("_type")


def attach_parent(hits: DataFrame, docs: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """J-15: parent document columns onto hits / chunks by id."""
    return hits.join(docs.select(key, *cols), on=key, how="left")
