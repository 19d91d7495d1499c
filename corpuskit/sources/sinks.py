"""Dataset and index sinks (S-15, S-16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

def save_samples(df: DataFrame, path: str, fmt: str = "jsonl", mode: str = "overwrite") -> None:
    """S-15: JSONL (one record per line) or CSV (input, output, header), both written by all tasks.
    One JSON array for all records is not offered: it would have to pass through one task."""
    d = df.select("input", "output")
    if fmt == "jsonl":
        d.write.mode(mode).json(path)
    elif fmt == "csv":
        d.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"Unsupported format: {fmt}")


def save_index(chunks: DataFrame, config: dict, path: str) -> None:
    """S-16: chunks (id, content, metadata, embedding) as parquet plus a one-row config table that
    keeps the types of its values."""
    chunks.write.mode("overwrite").parquet(path.rstrip("/") + "/chunks")
    spark = chunks.sparkSession
    spark.createDataFrame([tuple(config.values())], list(config)).write.mode("overwrite").parquet(path.rstrip("/") + "/config")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """S-16: the chunk table and the stored config."""
    cfg = spark.read.parquet(path.rstrip("/") + "/config").first().asDict()  # one row
    return spark.read.parquet(path.rstrip("/") + "/chunks"), cfg
