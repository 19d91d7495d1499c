"""Small helpers shared by the operators: written tables, and Arrow batches with bounded text."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Words everywhere: maximal runs without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a NULL doc_id where ids are compared: such a row comes after all others.
LAST_ID = (1 << 63) - 1


def written(df: DataFrame, name: str, collect: bool = True) -> DataFrame:
    """``df`` written once as Parquet to the shared folder of ``spark.checkpoint.dir`` and read
    again: cuts the lineage, and survives lost executors. With ``collect``, for plans that shuffle
    whole texts, the shuffle files behind it are let go at once."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    if collect:
        del df  # holds the plan
        released(spark)
    return spark.read.schema(schema).parquet(path)


def released(spark) -> None:
    """Let the driver's JVM collect what finished jobs leave: Spark deletes the shuffle files of a
    plan only when the plan is collected, which a quiet driver does late."""
    gc.collect()
    if (jvm := getattr(spark, "_jvm", None)) is not None:
        jvm.java.lang.System.gc()
        time.sleep(0.2)  # what the first one queued goes with the second
        jvm.java.lang.System.gc()


def boxed(docs: DataFrame) -> Column:
    """All columns of a row in one, so that no name can clash with those an operator adds."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns])


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into runs of rows whose ``column`` holds about ``limit`` bytes; one
    longer value makes a run of its own."""
    ends = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
    first = 0
    while first < batch.num_rows:
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(ends.searchsorted(base + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last


def lean(run):
    """A function for ``mapInArrow`` whose worker gives freed memory back to the system at its end:
    workers are kept for later tasks, and what they hold counts against the executor."""
    def inner(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return inner


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def id_order(column: str = "doc_id"):
    """``doc_id`` as a number to compare: NULL is the largest."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))
