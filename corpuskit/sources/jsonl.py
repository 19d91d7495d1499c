"""JSON-lines and JSON file sources (S-01 ... S-04, S-18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip


class DatasetError(ValueError):
    """A strict read found a bad line."""


def read_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """Text lines with ``file`` and 1-based ``line_num`` inside their file.

    Files stay splittable: each split's first row and size come from a small per-split
    table (one row per split), cumulated per file and joined back.
    """
    d = spark.read.options(**options).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_blk"),
        F.monotonically_increasing_id().alias("_mid"))
    blocks = d.groupBy("file", "_blk").agg(F.min("_mid").alias("_m0"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("file").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    return d.join(F.broadcast(blocks), ["file", "_blk"]).select(
        "value", "file", (F.col("_off") + F.col("_mid") - F.col("_m0") + 1).alias("line_num"))


def _parse(lines: DataFrame, keys=("input", "output")) -> DataFrame:
    from ..functions.jsonl import parse_json_strict
    v = parse_json_strict("value")
    d = lines.withColumn("_v", v)
    for k in keys:
        d = d.withColumn(k, F.try_variant_get("_v", f"$.{k}", "string"))
    reason = F.when(py_strip("value") == "", F.lit("blank")).when(F.col("_v").isNull(), F.lit("invalid_json"))
    for k in keys:
        reason = reason.when(F.col(k).isNull(), F.lit(f"missing_{k}"))
    return d.withColumn("reason", reason)


def load_jsonl_strict(spark: SparkSession, path: str, keys=("input", "output")) -> DataFrame:
    """S-01: blank lines skipped; any invalid JSON or record without the keys fails the load,
    naming the first bad file and line. Returns the records (plus ``raw`` VARIANT)."""
    d = _parse(read_lines(spark, path), keys)
    bad = d.filter(F.col("reason").isNotNull() & (F.col("reason") != "blank"))
    first = bad.orderBy("file", "line_num").select("file", "line_num", "reason").first()  # one row at most
    if first is not None:
        raise DatasetError(f"{first.file}: line {first.line_num}: {first.reason}")
    return d.filter(F.col("reason").isNull()).select(*keys, F.col("_v").alias("raw"), "file", "line_num")


def load_jsonl_lenient(spark: SparkSession, path: str, keys=("input", "output")) -> tuple[DataFrame, DataFrame]:
    """S-02: good records and rejects (bad JSON, missing key) with their reason."""
    d = _parse(read_lines(spark, path), keys)
    good = d.filter(F.col("reason").isNull()).select(*keys, "file", "line_num")
    bad = d.filter(F.col("reason").isNotNull() & (F.col("reason") != "blank")).select("value", "reason", "file", "line_num")
    return good, bad


def stream_jsonl(spark: SparkSession, path: str, schema: str = "input string, output string", max_files: int = 1) -> DataFrame:
    """S-03: incremental JSONL read (file source, ``maxFilesPerTrigger``)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def load_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S-04: JSON files holding an array of records or one object -> rows. A file of any size is read
    by many tasks; what is broken is left out (``json_records`` lists it)."""
    from .json_records import json_records
    records = json_records(spark, path)[0]
    return records.select(F.from_json(F.col("text"), schema).alias("x")).select("x.*")


def load_prediction_lines(spark: SparkSession, path: str, field: str | None = None,
                          default_field: str = "prediction") -> DataFrame:
    """S-18: responses / predictions: the configured field, else the default field, else the
    plain line; with 0-based position for J-09 alignment."""
    from ..functions.jsonl import parse_json_strict
    d = read_lines(spark, path).filter(py_strip("value") != "")
    v = parse_json_strict("value")
    val = F.coalesce(*([F.try_variant_get(v, f"$.{field}", "string")] if field else []),
                     F.try_variant_get(v, f"$.{default_field}", "string"), F.col("value"))
    return d.select("file", "line_num", val.alias("text"))
