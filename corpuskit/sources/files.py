"""File-folder sources (S-05, S-06, S-07)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mapping import MappingError
from .json_records import json_records


def load_csv_mapped(spark: SparkSession, path: str, mapping: dict) -> DataFrame:
    """S-05: CSV with header; ``mapping`` {"input": col, "output": col}; values trimmed;
    rows with an empty side dropped; a missing column is an error."""
    d = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    for side in ("input", "output"):
        if mapping.get(side) not in d.columns:
            raise MappingError(f"CSV has no column '{mapping.get(side)}' (columns: {d.columns})")
    def strip(c):  # Python str.strip(): all surrounding whitespace, not only spaces
        return F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", "")

    out = d.select(strip(mapping["input"]).alias("input"), strip(mapping["output"]).alias("output"))
    return out.filter((F.coalesce("input", F.lit("")) != "") & (F.coalesce("output", F.lit("")) != ""))


def load_text_files(spark: SparkSession, path: str, suffixes=(".txt", ".md")) -> DataFrame:
    """S-06: one row per file (whole text), recursive, suffix-filtered, with name, suffix,
    size and modification time from the file metadata."""
    glob = "*{" + ",".join(suffixes) + "}" if len(suffixes) > 1 else "*" + suffixes[0]
    d = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return d.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"),
                    F.col("_metadata.file_name").alias("name"),
                    F.regexp_extract(F.col("_metadata.file_name"), r"(\.[^.]*)$", 1).alias("suffix"),
                    F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"))


# MIME type per suffix, the MIME allow-list, and suffixes always read.
MIME = {".txt": "text/plain", ".md": "text/markdown", ".json": "application/json", ".jsonl": "application/json",
        ".csv": "text/csv", ".pdf": "application/pdf",
        ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}
ALLOWED_MIME = ["application/vnd.google-apps.document", "application/vnd.google-apps.spreadsheet", "text/plain",
                "text/markdown", "application/json", "text/csv"]
ALWAYS_SUFFIXES = [".json", ".jsonl", ".txt"]


def load_mixed_folder(spark: SparkSession, path: str, name_contains: str | None = None,
                      mapping: dict | None = None) -> DataFrame:
    """S-07: a folder of mixed files -> samples with ``source_file`` and ``source_id`` (stem).

    A file is read when its name contains ``name_contains`` and its MIME type is allowed (or
    it ends in .json / .jsonl / .txt). ``.jsonl``: one sample per non-blank line; ``.json``: one
    per array element, or the object itself; the first invalid line or record without the
    mapped keys ends that file (earlier samples are kept). Any other read file is one sample:
    its whole text as input, empty output.
    """
    from ..functions.jsonl import parse_json_strict
    from .jsonl import read_lines
    mapping = mapping or {"input": "input", "output": "output"}
    ki, ko = mapping["input"], mapping["output"]
    mime = F.create_map(*[x for k, v in MIME.items() for x in (F.lit(k), F.lit(v))])

    def suffix(c):
        return F.lower(F.regexp_extract(c, r"(\.[^.]*)$", 1))

    def keep(name):
        m = F.coalesce(F.try_element_at(mime, suffix(name)), F.lit("application/octet-stream"))
        cond = m.isin(ALLOWED_MIME) | suffix(name).isin(ALWAYS_SUFFIXES)
        if name_contains:
            cond = cond & F.contains(name, F.lit(name_contains))
        return cond

    def stem(name):
        return F.regexp_replace(name, r"\.[^.]*$", "")

    def fields(v):
        return (F.try_variant_get(v, f"$.{ki}", "string"), F.try_variant_get(v, f"$.{ko}", "string"))

    def rd():  # a fresh reader per branch: DataFrameReader.option mutates the reader
        return spark.read.option("recursiveFileLookup", True)

    # .jsonl: stop each file at its first bad line
    jl = read_lines(spark, path, recursiveFileLookup=True, pathGlobFilter="*.jsonl") \
        .withColumn("source_file", F.regexp_extract("file", r"([^/]+)$", 1)).filter(keep(F.col("source_file")))
    jl = jl.filter(F.regexp_replace("value", r"(?U)^\s+|\s+$", "") != "").withColumn("_v", parse_json_strict("value"))
    i_, o_ = fields(F.col("_v"))
    jl = jl.withColumn("input", i_).withColumn("output", o_)
    bad = F.col("_v").isNull() | F.col("input").isNull() | F.col("output").isNull()
    cut = jl.filter(bad).groupBy("file").agg(F.min("line_num").alias("_cut"))
    jl = jl.join(cut, "file", "left").filter(F.col("_cut").isNull() | (F.col("line_num") < F.col("_cut"))) \
        .filter(~bad).select("input", "output", "source_file", stem(F.col("source_file")).alias("source_id"))
    # .json: an array (stop at the first bad record) or one object; large files are cut between records
    records, _, rejected = json_records(spark, path, recursiveFileLookup=True, pathGlobFilter="*.json")
    # an element that is no object stands after the record of its number
    after = F.when(F.col("reason") == "not an object", 0.5).otherwise(0.0)
    js = records.select("file", F.col("n").cast("double").alias("pos"), "r").unionByName(
        rejected.filter("n IS NOT NULL").select("file", (F.col("n") + after).alias("pos"), F.lit(None).cast("variant").alias("r")))
    js = js.withColumn("source_file", F.regexp_extract("file", r"([^/]+)$", 1)).filter(keep(F.col("source_file")))
    i_, o_ = fields(F.col("r"))
    js = js.withColumn("input", i_).withColumn("output", o_)
    jbad = F.col("input").isNull() | F.col("output").isNull()
    jcut = js.filter(jbad).groupBy("file").agg(F.min("pos").alias("_cut"))
    js = js.join(jcut, "file", "left").filter(F.col("_cut").isNull() | (F.col("pos") < F.col("_cut"))) \
        .filter(~jbad).select("input", "output", "source_file", stem(F.col("source_file")).alias("source_id"))
    # every other read file: whole text
    ot = rd().text(path, wholetext=True).select(F.col("value").alias("input"), F.col("_metadata.file_name").alias("source_file")) \
        .filter(keep(F.col("source_file")) & ~suffix(F.col("source_file")).isin(".json", ".jsonl"))
    ot = ot.select("input", F.lit("").alias("output"), "source_file", stem(F.col("source_file")).alias("source_id"))
    return jl.unionByName(js).unionByName(ot)
