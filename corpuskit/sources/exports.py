"""Chat, wiki and workspace exports -> typed tables (S-12, S-13, S-14, X-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .json_records import json_records


def chat_ts(c) -> Column:
    """X-07: chat "sec.micros" text -> TIMESTAMP (UTC)."""
    x = F.col(c) if isinstance(c, str) else c
    return F.timestamp_micros((x.cast("decimal(16,6)") * 1_000_000).cast("long"))


#: The key of each kind of export under which its records stand, if they are not the file's root.
WRAPPERS = {"chat_messages": "messages", "chat_channels": "channels", "chat_users": "members", "wiki_pages": "results",
            "wiki_spaces": "results", "workspace_pages": "pages"}


def _variants(spark: SparkSession, path: str, wrapper: str) -> DataFrame:
    """One VARIANT per record: the file's array root, or the array under ``wrapper``. Files are cut
    between records, so one of any size is read by many tasks."""
    return json_records(spark, path, (wrapper,))[0].select("file", "r")


def rejects(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """What a read of this kind of export (a key of ``WRAPPERS``) leaves out: file, n (place of the
    record in its file; NULL for the whole file), reason, text."""
    return json_records(spark, path, (WRAPPERS[kind],))[2]


def _g(path: str, typ: str = "string") -> Column:
    return F.try_variant_get("r", path, typ)


def _value_or_text(key: str) -> Column:
    """``{"value": ...}`` objects unwrapped, plain strings kept."""
    return F.coalesce(_g(f"$.{key}.value"), F.when(_g(f"$.{key}", "variant").isNotNull()
                                                   & ~F.startswith(F.to_json(_g(f"$.{key}", "variant")), F.lit("{")),
                                                   _g(f"$.{key}")))


def chat_messages(spark: SparkSession, path: str, channel_from_folder: bool = True) -> DataFrame:
    """S-12 messages: ts / text default "", channel from the parent folder (else the record's
    ``channel``), reply_count default 0, reactions default [], ``is_bot`` = bot id present or
    subtype bot_message, ``at`` from the ts text (X-07)."""
    m = _variants(spark, path, "messages")
    folder = F.element_at(F.split("file", "/"), -2) if channel_from_folder else F.lit(None).cast("string")
    ts = F.coalesce(_g("$.ts"), F.lit(""))
    reactions = F.coalesce(_g("$.reactions", "array<struct<name:string,count:int>>"),
                           F.array().cast("array<struct<name:string,count:int>>"))
    return m.select(F.coalesce(folder, _g("$.channel")).alias("channel_id"), ts.alias("ts"),
                    F.when(ts != "", chat_ts(ts)).alias("at"), F.coalesce(_g("$.text"), F.lit("")).alias("text"),
                    _g("$.user").alias("user"), _g("$.thread_ts").alias("thread_ts"),
                    F.coalesce(_g("$.reply_count", "int"), F.lit(0)).alias("reply_count"), reactions.alias("reactions"),
                    (_g("$.bot_id", "variant").isNotNull() | (F.coalesce(_g("$.subtype"), F.lit("")) == "bot_message")).alias("is_bot"),
                    _g("$.subtype").alias("subtype"), _g("$.edited", "variant").isNotNull().alias("edited"))


def chat_channels(spark: SparkSession, path: str) -> DataFrame:
    """S-12 channels: id / name default "", flags default false (member: true), topic and
    purpose unwrapped from ``{"value": ...}`` or kept as text."""
    c = _variants(spark, path, "channels")
    return c.select(F.coalesce(_g("$.id"), F.lit("")).alias("id"), F.coalesce(_g("$.name"), F.lit("")).alias("name"),
                    F.coalesce(_g("$.is_private", "boolean"), F.lit(False)).alias("is_private"),
                    F.coalesce(_g("$.is_archived", "boolean"), F.lit(False)).alias("is_archived"),
                    F.coalesce(_g("$.is_member", "boolean"), F.lit(True)).alias("is_member"),
                    _value_or_text("topic").alias("topic"), _value_or_text("purpose").alias("purpose"),
                    _g("$.num_members", "int").alias("num_members"), _g("$.created", "bigint").alias("created"))


def chat_users(spark: SparkSession, path: str) -> DataFrame:
    """S-12 users: real name from the profile, else the record; flags default false."""
    u = _variants(spark, path, "members")
    return u.select(F.coalesce(_g("$.id"), F.lit("")).alias("id"), F.coalesce(_g("$.name"), F.lit("")).alias("name"),
                    F.coalesce(_g("$.profile.real_name"), _g("$.real_name")).alias("real_name"),
                    _g("$.profile.display_name").alias("display_name"),
                    F.coalesce(_g("$.is_bot", "boolean"), F.lit(False)).alias("is_bot"),
                    F.coalesce(_g("$.is_admin", "boolean"), F.lit(False)).alias("is_admin"),
                    F.coalesce(_g("$.deleted", "boolean"), F.lit(False)).alias("deleted"))


def wiki_pages(spark: SparkSession, path: str, space_key: str | None = None) -> DataFrame:
    """S-13 pages: id / title default "", type "page", status "current", version default 1,
    created date / author from the history, modified date / author from the version, ancestors
    as ids with the last one as parent, body html default "", space key = the given one, else
    the nested space's key."""
    p = _variants(spark, path, "results")
    anc = F.transform(F.coalesce(_g("$.ancestors", "array<variant>"), F.array().cast("array<variant>")),
                      lambda a: F.try_variant_get(a, "$.id", "string"))
    anc = F.filter(anc, lambda x: x.isNotNull())
    key = F.lit(space_key) if space_key else _g("$.space.key")
    return p.select(F.coalesce(_g("$.id"), F.lit("")).alias("id"), F.coalesce(_g("$.title"), F.lit("")).alias("title"),
                    key.alias("space_key"), F.coalesce(_g("$.type"), F.lit("page")).alias("type"),
                    F.coalesce(_g("$.status"), F.lit("current")).alias("status"),
                    F.coalesce(_g("$.version.number", "int"), F.lit(1)).alias("version"),
                    _g("$.history.createdDate").alias("created_date"), _g("$.version.when").alias("modified_date"),
                    _g("$.history.createdBy.displayName").alias("created_by"), _g("$.version.by.displayName").alias("modified_by"),
                    F.try_element_at(anc, F.lit(-1)).alias("parent_id"), anc.alias("ancestors"),
                    F.coalesce(_g("$._links.webui"), F.lit("")).alias("url"),
                    F.coalesce(_g("$.body.storage.value"), F.lit("")).alias("body_html"))


def workspace_pages(spark: SparkSession, path: str) -> DataFrame:
    """S-14: database export -> pages with ``properties MAP<STRING, VARIANT>``; title from the
    title-typed property, falling back to a ``title`` string or rich-text list when that is
    empty; parent type and id; archived default false."""
    from ..operators.mapping import property_text
    records, frames, _ = json_records(spark, path, ("pages",))
    titles = frames.select("file", F.try_variant_get("r", "$.title", "string").alias("database_title"))
    pages = records.select("file", "r").join(titles, "file", "left")  # a title for each file
    props = _g("$.properties", "map<string,variant>")
    title_prop = F.try_element_at(F.map_values(F.map_filter(
        props, lambda k, x: F.try_variant_get(x, "$.type", "string") == "title")), F.lit(1))
    from_prop = F.when(title_prop.isNotNull(), property_text(title_prop)).otherwise(F.lit(""))
    rich = F.array_join(F.transform(_g("$.title", "array<struct<plain_text:string>>"),
                                    lambda t: F.coalesce(t["plain_text"], F.lit(""))), "")
    title = F.when(from_prop != "", from_prop).otherwise(F.coalesce(_g("$.title"), rich, F.lit("")))
    ptype = _g("$.parent.type")
    return pages.select("database_title", F.coalesce(_g("$.id"), F.lit("")).alias("id"), title.alias("title"),
                        _g("$.url").alias("url"), _g("$.created_time").alias("created_time"),
                        _g("$.last_edited_time").alias("last_edited_time"), ptype.alias("parent_type"),
                        F.when(ptype == "database_id", _g("$.parent.database_id")).when(ptype == "page_id", _g("$.parent.page_id"))
                        .when(ptype == "workspace", _g("$.parent.workspace")).alias("parent_id"),
                        props.alias("properties"), F.coalesce(_g("$.archived", "boolean"), F.lit(False)).alias("archived"),
                        _g("$.content").alias("content"))


def wiki_spaces(spark: SparkSession, path: str) -> DataFrame:
    """S-13 spaces: key / name default "", description from its plain value when it is an
    object (else the text itself), homepage id when present."""
    e = _variants(spark, path, "results")

    def g(p):
        return F.try_variant_get("r", p, "string")

    desc = F.coalesce(g("$.description.plain.value"), F.when(F.try_variant_get("r", "$.description", "string").isNotNull()
                                                          & ~F.startswith(F.to_json(F.try_variant_get("r", "$.description", "variant")), F.lit("{")),
                                                          g("$.description")), F.lit(""))
    return e.select(g("$.id").alias("id"), F.coalesce(g("$.key"), F.lit("")).alias("key"),
                    F.coalesce(g("$.name"), F.lit("")).alias("name"), g("$.type").alias("type"), g("$.status").alias("status"),
                    desc.alias("description"), g("$.homepage.id").alias("homepage_id"))
