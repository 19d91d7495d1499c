"""SQL sources (S-08)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.mapping import row_to_sample


def jdbc_samples(spark: SparkSession, url: str, query: str, mapping: dict, fetch_size: int = 1000,
                 partition: dict | None = None, properties: dict | None = None) -> DataFrame:
    """S-08: a SQL query over JDBC mapped to samples (P-01). ``fetch_size`` is the batched
    fetch; ``partition`` = {column, lowerBound, upperBound, numPartitions} reads in parallel
    (``dbtable`` sub-query form, since ``query`` cannot be partitioned)."""
    r = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_size)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition:
        r = r.option("dbtable", f"({query}) q").option("partitionColumn", partition["column"]) \
            .option("lowerBound", partition["lowerBound"]).option("upperBound", partition["upperBound"]) \
            .option("numPartitions", partition["numPartitions"])
    else:
        r = r.option("query", query)
    return row_to_sample(r.load(), mapping, source="db")


def catalog_samples(spark: SparkSession, query: str, mapping: dict, args: dict | None = None) -> DataFrame:
    """S-08 for catalog tables / views: parameterised ``spark.sql`` (named markers)."""
    return row_to_sample(spark.sql(query, args=args or {}), mapping, source="db")
