"""Registered queries of this subpackage: ``(spark, sf_dir) -> DataFrame`` over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import (
    chat_trees, decontaminate, exact_dedup, hamming_trie, near_dup, packing, prefix_trie, secret_scan,
    token_alignment, token_ids, toxicity, unit_dedup, url_rules,
)
from quarry.llm.oracle import ORACLE_SQL as ORACLE_SQL
from quarry.llm.skew import materialise
from quarry.session import shared_dir

VOCABULARY = "word_bpe_49k.json"
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers
    return str(public_tokenizers.path(VOCABULARY))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, one row per document and item."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity, grade and decision for every document, by a model fitted on the labels."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_severity(docs, toxicity.fit_severity(docs, table(spark, sf_dir, "labels")))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: pattern counts and digest, all spans."""
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 4-word shingles, similarity 0.8."""
    return near_dup.near_groups(table(spark, sf_dir, "documents"), k=4, percent=80)


def op5_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of every document: removed spans, and what stays."""
    return unit_dedup.repeat_report(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (end id 2) packed into sequences of at most 4096 tokens, one row per piece."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(), capacity=4096, end_id=2)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document (end id 1), write the token files, and index them from the files."""
    out = shared_dir(spark, "token-files")
    token_ids.write_token_files(table(spark, sf_dir, "documents"), out, vocabulary(), end_id=1)
    return token_ids.token_index(spark, out)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of all documents; of equal texts the largest doc_id stays."""
    return (exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")
            .select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page URL: fixed rules first, then rules mined from the labels."""
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations, and one of control strings, and read the output back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    nodes = materialise(chat_trees.linear_nodes(rows.unionByName(control)), "chat-nodes")
    formatted = materialise(chat_trees.format_paths(nodes, chat_trees.chosen_paths(nodes)), "chat-formatted")
    return chat_trees.conversation_report(formatted)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every document's ids by a byte-level and a piece tokenizer, links scored by corpus-wide counts."""
    import public_tokenizers
    return token_alignment.alignment_report(
        table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")),
        str(public_tokenizers.path("piece_bpe_32k.model")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all rebuilt conversations: members, children, subtree totals and ends of every node."""
    return prefix_trie.trie_report(table(spark, sf_dir, "conversations"))


def op13_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents: 3-word shingles, at most 2 differing bits."""
    return hamming_trie.simhash_groups(table(spark, sf_dir, "documents"), k=3, budget=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_decontaminate, op2_toxicity, op3_secret_scan, op4_near_dedup, op5_unit_dedup, op6_packing,
        op7_token_files, op8_exact_dedup, op9_url_filter, op10_chat_format, op11_token_alignment,
        op12_prefix_trie, op13_simhash_trie)}
