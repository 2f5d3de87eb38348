"""Queries over the whole corpus, one per operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.llm import (
    conversation_trie,
    language_id,
    license_scan,
    line_dedup,
    lsm_dedup,
    matroska,
    mixing,
    packing,
    phrases,
    sentence_dedup,
    simhash,
    suffix_dedup,
    token_counts,
)
from signalspark.llm.common import documents


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents by SimHash of three-word shingles."""
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken so that sources weigh 5, 2, 1 in turn."""
    return mixing.mix(documents(spark, sf_dir)).drop("source")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in bins of 4096 words, duplicates apart and eight pieces of a source at most in one."""
    return packing.pack(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents; the one with the largest id stays."""
    return lsm_dedup.exact_duplicates(documents(spark, sf_dir), keep="largest").withColumnRenamed("sha", "text_sha256")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    return language_id.identify(documents(spark, sf_dir))


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as the payload of a Matroska file and read back from its packets."""
    return matroska.read_back(matroska.store(documents(spark, sf_dir)))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document under the 32k piece vocabulary."""
    import public_tokenizers

    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without bytes covered by 50-byte strings of earlier ones, as digests."""
    out = suffix_dedup.dedup_substrings(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and license templates in all documents."""
    return license_scan.scan(documents(spark, sf_dir))


def op10_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the sentences of repeated spans, as digests: three sentences, more up to 12 words, fewer from 20 words."""
    out = sentence_dedup.dedup_sentences(documents(spark, sf_dir), min_words=12, long_words=20)
    return out.select("doc_id", "n_sentences", "n_removed", "n_spans", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, rebuilt so that twenty share their first turns."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_trie.prefix_trie(conversation_trie.shared_starts(conversation_trie.paths(turns)))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two to four words of each language, by the cohesion of their weakest cut."""
    return phrases.collocations(documents(spark, sf_dir))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten documents or more hold, as digests."""
    out = line_dedup.dedup_lines(documents(spark, sf_dir), min_docs=10, with_text=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_mixing": op2_mixing,
        "op3_packing": op3_packing,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_language_id": op5_language_id,
        "op6_matroska": op6_matroska,
        "op7_token_counts": op7_token_counts,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_license_scan": op9_license_scan,
        "op10_sentence_dedup": op10_sentence_dedup,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_collocations": op12_collocations,
        "op13_line_dedup": op13_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": mixing.MIX_SQL,
        "op4_exact_dedup": lsm_dedup.DEDUP_SQL,
        "op9_license_scan": license_scan.oracle_sql(),
        "op11_conversation_trie": conversation_trie.TRIE_SQL,
        "op12_collocations": phrases.PHRASES_SQL,
        "op13_line_dedup": line_dedup.LINES_SQL,
    }
