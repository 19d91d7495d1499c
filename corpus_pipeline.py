"""Corpus pipeline over ``documents``: quality rules, SimHash near-dedup, suffix-array dedup, mixing
sources to target weights, BPE encoding. Each stage reads what the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm import bpe_automaton, mixing, quality, simhash, suffix_repeats
from corpuskit.llm.common import written
from corpuskit.session import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is too low, or that fail the base rule, go."""
    return quality.good_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays (the smallest doc_id)."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a 50-byte string of an earlier document go; every document stays."""
    return suffix_repeats.without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents fill their source's target: none, one or two rows for each."""
    mixed = mixing.mix_sources(docs)
    return mixed.select(F.explode(F.array_repeat("whole", F.col("copies"))).alias("row")).select("row.*")


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with the row's other columns."""
    import public_tokenizers
    return bpe_automaton.encoded(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeated_passages),
    ("mix_sources", source_mix),
    ("bpe_automaton", bpe_tokens),
]

#: Expectation-maximisation, components and tokenization have no SQL twin; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
