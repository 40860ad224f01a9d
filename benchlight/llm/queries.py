"""The published queries of the subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchlight.llm import (
    exact,
    mixing,
    packing,
    passages,
    polytope,
    quality,
    rules,
    search,
    sequences,
    simhash,
    spread,
    surrogates,
    trie,
)
from benchlight.llm.texts import documents


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return quality.classify(documents(spark, sf_dir), labels)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = surrogates.replace(documents(spark, sf_dir))
    return rows.select("doc.doc_id", F.size("kinds").alias("n_replaced"), "kinds", F.col("replaced").alias("text"))


def op3_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(documents(spark, sf_dir))


def op4_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread.without_boilerplate(documents(spark, sf_dir))
    return rows.select("doc.doc_id", "n_lines", "n_removed", F.col("cleaned").alias("text"))


def op5_line_first_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir)).select(
        "doc.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "lines_removed",
        "kept_words",
    )


def op6_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return sequences.round_trip(documents(spark, sf_dir), tokenizer, end=1)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", "fingerprint", "component_id"
    )


def op9_variable_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op10_exact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(documents(spark, sf_dir)).drop("row")


def op11_polytope_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polytope.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_shared_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_compact_windows": op3_compact_windows,
    "op4_site_spread": op4_site_spread,
    "op5_line_first_rules": op5_line_first_rules,
    "op6_arrow_sequences": op6_arrow_sequences,
    "op7_source_mix": op7_source_mix,
    "op8_simhash_groups": op8_simhash_groups,
    "op9_variable_packing": op9_variable_packing,
    "op10_exact_index": op10_exact_index,
    "op11_polytope_groups": op11_polytope_groups,
    "op12_shared_search": op12_shared_search,
    "op13_prefix_trie": op13_prefix_trie,
}
