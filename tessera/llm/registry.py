"""The ``opN_<name>`` queries: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (byte_bpe, conversations, lm_scoring, mixing, oracle_sql, packing, pages, phrases, quality, simhash, sketch, substring,
               token_counts, url_filter)
from .common import read_table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of ``documents`` that occur earlier in the table, per document that repeats one."""
    return substring.repeat_report(read_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document in the vocabulary of byte_bpe_50k.json."""
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"),
                                     public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, limit=1024)


#: Pre-tokens of ``op3_`` whose distinct words are folded together: about those of an Arrow batch. It changes the plan only.
BLOCK_WORDS = 4_000_000


def digests(coded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids (little-endian uint32) and of the decoded bytes."""
    packed = byte_bpe.pack_ids(byte_bpe.decode(coded, path), path)
    return packed.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"),
                         F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document under byte_bpe_multi_50k.tiktoken and their decoding, as digests."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = read_table(spark, sf_dir, "documents")
    return digests(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id"], block_words=BLOCK_WORDS), ranks)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document (4-word shingles, up to 4 differing bits)."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k sketches of every document and its edited text (5-word shingles), and their likeness."""
    return sketch.edited_report(read_table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by its host's winning container path."""
    return pages.extract_pages(read_table(spark, sf_dir, "pages"))


def op7_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of 2048 ids (byte_bpe_50k.tiktoken) packed from every document."""
    return packing.packed_rows(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                               public_tokenizers.PATTERN, row_len=2048, pad_id=50256)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes every document: weights 5, 2, 1 over the sources, 150% of all words."""
    mixed = mixing.mixture(read_table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), budget=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document: documents labelled of quality 1 against all documents."""
    return lm_scoring.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word statistics, base rules and the host's verdict (host: ``source``) of every document."""
    return quality.quality_report(read_table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of 2 to 5 words of each lang of ``documents`` by collocation score."""
    return phrases.collocations(read_table(spark, sf_dir, "documents"), max_words=5, min_count=100, absorb=100, top=2000)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation after the contract's damage."""
    return conversations.repair(conversations.damage(read_table(spark, sf_dir, "conversations")))


#: The rules of ``op13_``.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and the verdict of every page's URL; blocks reach aliases by redirects and canonical links."""
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op6_html_extraction": op6_html_extraction,
    "op7_token_packing": op7_token_packing,
    "op8_source_mixing": op8_source_mixing,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_quality_rules": op10_quality_rules,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_url_filter": op13_url_filter,
}

ORACLE_SQL = oracle_sql.ORACLE_SQL
