"""Registered queries of this subpackage: each operator over its whole table, with production settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earmark.llm import decontaminate, html, language, licenses, mixing, phrases, pii, quality, resampling, sharding, simhash, sql, substrings, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The public tokenizer of the registered queries; a file that Spark need not reach."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op3_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op4_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op6_conditional_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(table(spark, sf_dir, "documents"), vocabulary())


def op9_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    shown = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*shown, *[F.round(f"{m}_limit", 6).alias(f"{m}_limit") for m in quality.METRICS])


def op10_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages"))


def op11_regular_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op13_phrase_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_spaced_seeds": op1_spaced_seeds,
    "op2_semi_markov_pii": op2_semi_markov_pii,
    "op3_entropy_balancing": op3_entropy_balancing,
    "op4_fixed_block_anchors": op4_fixed_block_anchors,
    "op5_hash_tree": op5_hash_tree,
    "op6_conditional_compression": op6_conditional_compression,
    "op7_simhash": op7_simhash,
    "op8_elias_fano": op8_elias_fano,
    "op9_adaptive_quality": op9_adaptive_quality,
    "op10_block_labeller": op10_block_labeller,
    "op11_regular_sampling": op11_regular_sampling,
    "op12_language_filters": op12_language_filters,
    "op13_phrase_tries": op13_phrase_tries,
}
ORACLES = {"op4_fixed_block_anchors": sql.REPEATS, "op9_adaptive_quality": sql.QUALITY, "op13_phrase_tries": sql.COLLOCATIONS}
