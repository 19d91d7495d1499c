"""Registered whole-table queries of the operators (name -> callable, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import license_scan, mixing, suffix_repeats

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


@register("op1_mix_sources", mixing.ORACLE)
def op1_mix_sources(spark, sf_dir):
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@register("op6_quality_rules")
def op6_quality_rules(spark, sf_dir):
    from .quality import scored
    return scored(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


@register("op9_suffix_array_dedup", suffix_repeats.ORACLE)
def op9_suffix_array_dedup(spark, sf_dir):
    return suffix_repeats.keep_first_copies(table(spark, sf_dir, "documents"))


@register("op10_simhash_near_dedup")
def op10_simhash_near_dedup(spark, sf_dir):
    from .simhash import near_duplicates
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register("op2_html_main_text")
def op2_html_main_text(spark, sf_dir):
    from .html_extract import extracted
    found = extracted(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


@register("op4_bpe_automaton")
def op4_bpe_automaton(spark, sf_dir):
    import public_tokenizers

    from .bpe_automaton import digests
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register("op5_document_fingerprints")
def op5_document_fingerprints(spark, sf_dir):
    from .fingerprint import compared
    return compared(table(spark, sf_dir, "documents"))


@register("op3_compact_window_passages")
def op3_compact_window_passages(spark, sf_dir):
    from .passages import passage_classes
    return passage_classes(table(spark, sf_dir, "documents"))


@register("op7_language_id")
def op7_language_id(spark, sf_dir):
    from .langid import held_out_languages
    return held_out_languages(table(spark, sf_dir, "documents"))


@register("op8_license_scan", license_scan.oracle())
def op8_license_scan(spark, sf_dir):
    from .license_scan import scanned
    return scanned(table(spark, sf_dir, "documents"))


@register("op13_merkle_manifest")
def op13_merkle_manifest(spark, sf_dir):
    from .merkle import manifest
    return manifest(table(spark, sf_dir, "documents"))


@register("op11_merge_replay")
def op11_merge_replay(spark, sf_dir):
    import public_tokenizers

    from .merge_replay import digests
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@register("op12_prefix_trie")
def op12_prefix_trie(spark, sf_dir):
    from .prefix_trie import prefix_trie
    return prefix_trie(table(spark, sf_dir, "conversations"))
