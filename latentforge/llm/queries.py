"""One registered query per operator, over the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import sql
from .common import documents
from .exact_dedup import exact_dedup
from .host_rules import apply_host_rules
from .language_id import identify
from .lexicon import transduced
from .licences import scan_licences
from .maxent_lm import score_corpus
from .near_dedup import near_dedup
from .packing import best_fit_packing, packed_matrices
from .prefix_trie import prefix_trie
from .suffix_dedup import repeated_bytes
from .term_scan import search
from .toxicity import score_toxicity


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op1_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every text under the hashed maximum-entropy model."""
    return score_corpus(documents(spark, sf_dir).select("doc_id", "text"))


def op2_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and verdict per document, hosts judged by shrunk rates."""
    out = apply_host_rules(documents(spark, sf_dir).select("doc_id", "text", "source"),
                           ["doc_id"])
    return out.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", "kept", "host_docs", "host_failed")


def op3_byte_gru_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text by the bidirectional byte network."""
    return identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))


def op4_exact_dedup_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates through the persistent digest index."""
    return exact_dedup(documents(spark, sf_dir).select("doc_id", "text"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded-space online best-fit packing of all documents."""
    return best_fit_packing(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path())


def op6_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding through the acyclic transducer lexicon."""
    return transduced(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path())


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every text by Dice over word bigrams."""
    return scan_licences(documents(spark, sf_dir).select("doc_id", "text")).drop("matches")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left after removal of 400-byte strings that start elsewhere too."""
    return repeated_bytes(documents(spark, sf_dir).select("doc_id", "text"))


def op9_packed_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-fit-decreasing packed id matrices with segment lengths."""
    return packed_matrices(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path())


def op10_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components by tensored MinHash banding."""
    return near_dedup(documents(spark, sf_dir).select("doc_id", "text"), 85)


def op11_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text by compression distance, learned from labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(documents(spark, sf_dir).select("doc_id", "text"),
                          labels.select("doc_id", "toxic"))


def op12_aho_corasick_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return search(documents(spark, sf_dir).select("doc_id", "text"),
                  items.select("item_id", "text"))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie(turns.select("conv_id", "turn", "role", "text"))


QUERIES = {f.__name__: f for f in (
    op1_maxent_lm, op2_host_quality_rules, op3_byte_gru_language_id, op4_exact_dedup_index,
    op5_best_fit_packing, op6_transducer_bpe, op7_licence_scan, op8_suffix_array_dedup,
    op9_packed_token_matrices, op10_tensored_minhash,
    op11_compression_toxicity, op12_aho_corasick_search,
    op13_conversation_prefix_trie)}
SQL = {"op2_host_quality_rules": sql.HOST_RULES, "op4_exact_dedup_index": sql.EXACT_DEDUP,
       "op12_aho_corasick_search": sql.TERM_SCAN,
       "op13_conversation_prefix_trie": sql.PREFIX_TRIE}
