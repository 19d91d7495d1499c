"""Landed API responses and XML (S-10, S-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys searched, in order, for the item list of an object envelope, and the
# usual next-cursor keys.
ENVELOPE_KEYS = ["data", "items", "results", "records", "rows", "content"]
CURSOR_KEYS = ["next_cursor", "cursor", "next", "nextToken", "next_page_token"]


def _truthy_text(v, path: str):
    """The value at ``path`` as text when it is present and not empty / zero / false."""
    x = F.try_variant_get(v, "$." + path, "variant")
    j = F.to_json(x)
    return F.when(x.isNotNull() & ~j.isin('""', "0", "0.0", "false", "[]", "{}", "null"),
                  F.try_variant_get(v, "$." + path, "string"))


def envelope_items(responses: DataFrame, body_col: str = "body", cursor_path: str | None = None) -> DataFrame:
    """S-10: one response per row -> its items: a root array, else the first array under
    the envelope keys, else the object itself. ``next_cursor``: the value at ``cursor_path``
    when given, else the first non-empty usual key."""
    v = F.try_parse_json(F.col(body_col))
    arr = F.coalesce(F.try_variant_get(v, "$", "array<variant>"),
                     *[F.try_variant_get(v, f"$.{k}", "array<variant>") for k in ENVELOPE_KEYS],
                     F.array(v))
    cur = _truthy_text(v, cursor_path) if cursor_path else F.coalesce(*[_truthy_text(v, k) for k in CURSOR_KEYS])
    return responses.select("*", cur.alias("next_cursor"), F.posexplode(arr).alias("item_index", "item"))


def xml_records(responses: DataFrame, body_col: str, schema: str, row_tag_path: str | None = None) -> DataFrame:
    """S-11: XML responses -> records with ``from_xml``: attributes as ``_name`` fields,
    repeated children as arrays (declare them ARRAY in ``schema``), leaf text trimmed."""
    opts = {"attributePrefix": "_", "valueTag": "_value", "ignoreSurroundingSpaces": "true"}
    return responses.select("*", F.from_xml(F.col(body_col), schema, opts).alias("record"))


def read_xml_files(spark, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    """S-11 for landed XML files: one record per ``row_tag`` element (Spark's XML source;
    attributes as ``_name``, repeated children as arrays, leaf text trimmed)."""
    r = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "_") \
        .option("valueTag", "_value").option("ignoreSurroundingSpaces", "true")
    if schema:
        r = r.schema(schema)
    return r.load(path)
