"""Projections and mapping into the sample schema (P-01 ... P-11).

The sample schema is ``input STRING, output STRING`` plus a ``metadata`` struct. All
operators here are narrow (no shuffle) except P-09, which is an ordered per-file concat.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col_, py_strip
from .ordered import ordered_concat


class MappingError(KeyError):
    """Raised on a mapping that names a missing key or column."""


def _require_mapping(mapping: dict) -> tuple[str, str]:
    for k in ("input", "output"):
        if k not in mapping:
            raise MappingError(f"Mapping must contain '{k}' key naming the {k} column")
    return mapping["input"], mapping["output"]


def row_to_sample(df: DataFrame, mapping: dict, source: str = "db", keep_raw: bool = False,
                  extra_metadata: dict | None = None) -> DataFrame:
    """P-01: two named columns cast to string become ``input``/``output``.

    A mapping without both keys, or naming a column not in ``df``, is an error (raised while
    the plan is built, from the schema alone). ``keep_raw`` keeps the whole row as JSON in
    ``metadata.raw_row``; it is opt-in so column pruning still reaches the scan.
    String form follows Spark's cast (profile ``spark``): 1.0, true, NULL stays NULL.
    """
    in_col, out_col = _require_mapping(mapping)
    for c, side in ((in_col, "input"), (out_col, "output")):
        if c not in df.columns:
            raise MappingError(f"Row missing required {side} column: '{c}'")
    meta = [F.lit(source).alias("source")]
    for k, v in (extra_metadata or {}).items():
        meta.append((v if isinstance(v, Column) else F.lit(v)).alias(k))
    if keep_raw:
        meta.append(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("raw_row"))
    return df.select(
        F.col(in_col).cast("string").alias("input"),
        F.col(out_col).cast("string").alias("output"),
        F.struct(*meta).alias("metadata"),
    )


def map_nested(df: DataFrame, json_col: str, input_path: str, output_path: str,
               source: str = "api") -> tuple[DataFrame, DataFrame]:
    """P-02: nested-path mapping (``a.b.c``) over a JSON / VARIANT column.

    Profile ``reject``: rows where either side resolves to NULL go to the second frame
    with a ``reason``; the reference raises on the first such row, we quarantine them all.
    """
    v = F.try_parse_json(F.col(json_col)) if dict(df.dtypes)[json_col] == "string" else F.col(json_col)

    def path(p: str) -> Column:
        return F.try_variant_get(v, "$." + p, "string")

    d = df.select("*", path(input_path).alias("input"), path(output_path).alias("output"))
    reason = (F.when(F.col("input").isNull(), F.lit(f"missing {input_path}"))
              .when(F.col("output").isNull(), F.lit(f"missing {output_path}")))
    d = d.withColumn("reason", reason)
    good = d.filter(F.col("reason").isNull()).select(
        "input", "output", F.struct(F.lit(source).alias("source")).alias("metadata"))
    bad = d.filter(F.col("reason").isNotNull()).drop("input", "output")
    return good, bad


def property_text(prop) -> Column:
    """P-03: type-directed text of one workspace property value (VARIANT).

    title / rich_text -> joined plain_text, number, select.name, multi_select names joined
    by ", ", checkbox, url, email, phone_number, date.start; anything else / NULL -> "".
    """
    p = col_(prop)
    typ = F.try_variant_get(p, "$.type", "string")

    def s(path):
        return F.try_variant_get(p, path, "string")

    def texts(path):
        arr = F.try_variant_get(p, path, "array<struct<plain_text:string>>")
        return F.array_join(F.transform(arr, lambda x: F.coalesce(x["plain_text"], F.lit(""))), "")

    out = (F.when(typ == "title", texts("$.title"))
           .when(typ == "rich_text", texts("$.rich_text"))
           .when(typ == "number", s("$.number"))
           .when(typ == "select", s("$.select.name"))
           .when(typ == "multi_select", F.array_join(F.transform(
               F.try_variant_get(p, "$.multi_select", "array<struct<name:string>>"),
               lambda x: F.coalesce(x["name"], F.lit(""))), ", "))
           .when(typ == "checkbox", F.when(F.try_variant_get(p, "$.checkbox", "boolean"), "True")
                 .otherwise("False"))
           .when(typ == "url", s("$.url"))
           .when(typ == "email", s("$.email"))
           .when(typ == "phone_number", s("$.phone_number"))
           .when(typ == "date", s("$.date.start")))
    return F.coalesce(out, F.lit(""))


def workspace_samples(pages: DataFrame, mapping: dict, props_col: str = "properties") -> DataFrame:
    """P-03 applied: map workspace pages (``properties MAP<STRING, VARIANT>``) to samples.

    ``mapping`` names the property for input and output; the special name ``title`` falls back
    to the title-typed property, then the page ``title`` column.
    """
    in_name, out_name = _require_mapping(mapping)
    props = F.col(props_col)

    def value(name):
        direct = property_text(F.try_element_at(props, F.lit(name)))
        if name != "title":
            return direct
        title_prop = F.try_element_at(F.map_values(F.map_filter(
            props, lambda k, v: F.try_variant_get(v, "$.type", "string") == "title")), F.lit(1))
        fallback = F.coalesce(F.col("title").cast("string"), F.lit("")) if "title" in pages.columns else F.lit("")
        return F.when(direct != "", direct).when(title_prop.isNotNull(), property_text(title_prop)).otherwise(fallback)

    return pages.select(value(in_name).alias("input"), value(out_name).alias("output"),
                        F.struct(F.lit("notion").alias("source"), F.col("id").alias("page_id")).alias("metadata"))


def field_mapping(df: DataFrame, mapping: dict, source: str = "confluence") -> DataFrame:
    """P-04: sample from named page columns; missing column or NULL -> ''."""
    in_col, out_col = _require_mapping(mapping)

    def get(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")

    return df.select(get(in_col).alias("input"), get(out_col).alias("output"),
                     F.struct(F.lit(source).alias("source")).alias("metadata"))


def task_contract(df: DataFrame, input_field: str, output_field: str) -> tuple[DataFrame, DataFrame]:
    """P-05: rename task fields to (input, output); rows lacking either go to rejects."""
    for c in (input_field, output_field):
        if c not in df.columns:
            raise MappingError(f"missing task field '{c}'")
    d = df.withColumnsRenamed({input_field: "input", output_field: "output"})
    ok = F.col("input").isNotNull() & F.col("output").isNotNull()
    return d.filter(ok), d.filter(~ok).withColumn(
        "reason", F.when(F.col("input").isNull(), "missing input").otherwise("missing output"))


# Column names each aliasing profile accepts, in the order they are tried.
ALIAS_PROFILES = {
    "extract": {"input": ["input", "question", "query", "prompt", "q"],
                "output": ["output", "answer", "response", "a", "target"]},
    "upload": {"input": ["input", "question", "text", "query"],
               "output": ["output", "answer", "response", "label"]},
}


def alias_columns(df: DataFrame, profile: str = "extract") -> DataFrame:
    """P-06: pick input/output columns by name (schema-only decision on the driver).

    ``extract``: the *last* column (in column order) whose lower-cased name is in each list;
    when either side is missing, the first two columns. ``upload``: the first name of each
    ordered list present; missing side is an error.
    """
    rules = ALIAS_PROFILES[profile]
    cols = df.columns
    if profile == "extract":
        pick_in = [c for c in cols if c.lower() in rules["input"]]
        pick_out = [c for c in cols if c.lower() in rules["output"] and c.lower() not in rules["input"]]
        if pick_in and pick_out:
            i, o = pick_in[-1], pick_out[-1]
        elif len(cols) >= 2:
            i, o = cols[0], cols[1]
        else:
            raise MappingError(f"need two columns, found {cols}")
    else:
        i = next((c for c in rules["input"] if c in cols), None)
        o = next((c for c in rules["output"] if c in cols), None)
        if i is None or o is None:
            raise MappingError(f"Could not find input/output columns. Found: {cols}")
    return df.select(F.col(i).cast("string").alias("input"), F.col(o).cast("string").alias("output"))


def record_fallback(df: DataFrame, json_col: str = "value") -> DataFrame:
    """P-07: JSON record -> sample using input/output, else question/answer (pairwise presence).

    Lines that are not exactly one JSON value and records with neither pair are dropped.
    Values are stringified JSON scalars.
    """
    from ..functions.jsonl import parse_json_strict
    v = parse_json_strict(F.col(json_col))

    def g(k):
        return F.try_variant_get(v, "$." + k, "string")

    has_io = g("input").isNotNull() & g("output").isNotNull()
    has_qa = g("question").isNotNull() & g("answer").isNotNull()
    return (df.select(F.when(has_io, g("input")).when(has_qa, g("question")).alias("input"),
                      F.when(has_io, g("output")).when(has_qa, g("answer")).alias("output"),
                      F.when(has_io, F.lit("io")).when(has_qa, F.lit("qa")).alias("kind"))
            .filter(F.col("input").isNotNull()))


def ticket_samples(tickets: DataFrame) -> DataFrame:
    """P-07 tickets profile: subject -> input, description -> output, both non-empty after trim."""
    s = py_strip(F.coalesce(F.col("subject").cast("string"), F.lit("")))
    d = py_strip(F.coalesce(F.col("description").cast("string"), F.lit("")))
    return tickets.select(s.alias("input"), d.alias("output")).filter((F.col("input") != "") & (F.col("output") != ""))


def causal_text(df: DataFrame) -> DataFrame:
    """P-08: causal-LM training text ``input + " " + output``."""
    return df.withColumn("text", F.concat_ws(" ", F.coalesce("input", F.lit("")), F.coalesce("output", F.lit(""))))


def records_to_document(df: DataFrame, file_col: str, seq_col: str) -> DataFrame:
    """P-09: per file, "Input: i\\nOutput: o" blocks joined by a blank line, in record order."""
    block = F.format_string("Input: %s\nOutput: %s", F.coalesce("input", F.lit("")), F.coalesce("output", F.lit("")))
    bucket = F.floor(F.col(seq_col) / 4096) if dict(df.dtypes)[seq_col] in ("int", "bigint", "smallint") else None
    return ordered_concat(df.withColumn("_block", block), [file_col], seq_col, "_block", "\n\n", "text", bucket=bucket)


def chat_prompt(pairs: DataFrame) -> DataFrame:
    """P-11: wrap a user turn as "User: ...\\nAssistant:" with the reply as output."""
    return pairs.withColumn("input", F.format_string("User: %s\nAssistant:", F.col("input")))


# ---------------------------------------------------------------- filters (F-01 ... F-08)

def min_confidence(df: DataFrame, threshold: float, col: str = "confidence") -> DataFrame:
    """F-01: keep rows with confidence >= threshold."""
    return df.filter(F.col(col) >= F.lit(threshold))


def message_filter(df: DataFrame, min_length: int = 0, include_bots: bool = False,
                   oldest=None, latest=None, ts_col: str = "ts", text_col: str = "text",
                   bot_col: str | None = "is_bot") -> DataFrame:
    """F-02: chat message filter (bots, min text length, inclusive time range).

    The ordered ``limit`` of the reference is W-12 applied afterwards.
    """
    cond = F.length(F.coalesce(F.col(text_col), F.lit(""))) >= min_length
    if not include_bots and bot_col and bot_col in df.columns:
        cond = cond & ~F.coalesce(F.col(bot_col), F.lit(False))
    if oldest is not None:
        cond = cond & (F.col(ts_col) >= F.lit(oldest))
    if latest is not None:
        cond = cond & (F.col(ts_col) <= F.lit(latest))
    return df.filter(cond)


def metadata_equals(df: DataFrame, filters: dict, col: str = "metadata") -> DataFrame:
    """F-03: every key in ``filters`` must equal the metadata field (struct or map)."""
    typ = dict(df.dtypes).get(col, "")
    cond = F.lit(True)
    for k, v in filters.items():
        field = F.try_element_at(F.col(col), F.lit(k)) if typ.startswith("map") else F.col(col)[k]
        cond = cond & (field == F.lit(v))
    return df.filter(cond)


def tags_match(df: DataFrame, tags: Sequence[str] | None = None, task_type: str | None = None,
               status: str | None = None) -> DataFrame:
    """F-04: any-tag match plus optional task type and status equality."""
    cond = F.lit(True)
    if tags:
        cond = cond & F.arrays_overlap(F.col("tags"), F.array(*[F.lit(t) for t in tags]))
    if task_type:
        cond = cond & (F.col("task_type") == task_type)
    if status:
        cond = cond & (F.col("status") == status)
    return df.filter(cond)


def text_search(df: DataFrame, query: str, title_col: str = "title", body_col: str = "body",
                title_only: bool = False) -> DataFrame:
    """F-05: case-insensitive contains over title, else body; input order kept."""
    q = F.lit(query.lower())
    cond = F.contains(F.lower(F.coalesce(F.col(title_col), F.lit(""))), q)
    if not title_only:
        cond = cond | F.contains(F.lower(F.coalesce(F.col(body_col), F.lit(""))), q)
    return df.filter(cond)


def level_filter(df: DataFrame, level: str | None = None, source: str | None = None,
                 level_col: str = "level", source_col: str = "source") -> DataFrame:
    """F-06: level (upper-cased on both sides) and source equality filters."""
    cond = F.lit(True)
    if level:
        cond = cond & (F.upper(F.col(level_col)) == level.upper())
    if source:
        cond = cond & (F.col(source_col) == source)
    return df.filter(cond)


def min_length(df: DataFrame, n: int, col: str = "text") -> DataFrame:
    """F-07: chunk minimum length in characters."""
    return df.filter(F.length(F.col(col)) >= n)
