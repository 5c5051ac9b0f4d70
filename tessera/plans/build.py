"""PIP-5 ``build_corpus``: one pass of preparation, so that queries never encode the corpus."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import RetrievalConfig
from tessera.functions.text import normalize_text
from tessera.operators.encode import encode, fit_idf, tfidf_encoder
from tessera.operators.ivfpq import ivfpq_build, write_index
from tessera.operators.minhash import with_signatures
from tessera.sources.corpus import minhash_text, record_key, record_to_text, source_id
from tessera.sources.store import keyed_records, new_version, publish, write_embeddings, write_records, write_table


def corpus_rows(corpus: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """One row per stored key (the last record wins): key, norm_key, ord, bucket, value,
    source_id, text (PRJ-1) and the MinHash text (PRJ-4)."""
    store = keyed_records(corpus, cfg.num_buckets)
    named = corpus.withColumn("key", record_key()).withColumn("text_out", record_to_text()) \
        .withColumn("source_id", source_id()).withColumn("mh_text", minhash_text()).select("key", "ord", "text_out", "source_id", "mh_text")
    return store.join(named, ["key", "ord"]).withColumn("norm_key", normalize_text(F.col("key")))


def build_corpus(corpus: DataFrame, root: str, cfg: RetrievalConfig = RetrievalConfig(), *,
                 encoder: Callable[[DataFrame, str, str], DataFrame] = encode, index: bool = False,
                 weighted: bool = False) -> DataFrame:
    """Write records, embeddings, MinHash signatures and counts of ``corpus`` (ord, record
    fields, extra), with ``index`` an IVF-PQ index too, as a new version under ``root``, publish it and
    return the stored rows. The rows are written once and read back for the vectors; readers
    of the version before see nothing until the last table is written, and a build that fails
    leaves that one in place. ``weighted`` fits an IDF of the texts, stores it and encodes with it;
    ``stored_encoder`` then gives the same encoder for queries. ``encoder(df, text_col, out_col)`` makes the vectors; a
    null text has the zero vector with the default one."""
    spark: SparkSession = corpus.sparkSession
    to = new_version(root)
    write_table(corpus_rows(corpus, cfg), to, "corpus")
    rows = spark.read.parquet(os.path.join(to, "corpus"))
    write_records(rows.select("key", "value", "ord", "bucket"), to)
    if weighted:
        write_table(fit_idf(rows, "text_out").coalesce(1), to, "idf")
        encoder = tfidf_encoder(spark.read.parquet(os.path.join(to, "idf")))
    write_embeddings(encoder(rows.select("ord", "key", "text_out"), "text_out", "embedding"), to)
    write_table(with_signatures(rows.select("ord", "key", "mh_text"), "mh_text").select("ord", "key", "sig"), to, "minhash")
    write_table(rows.agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.octet_length("value")).alias("value_bytes")), to, "counts")
    if index:
        write_index(ivfpq_build(spark.read.parquet(os.path.join(to, "embeddings")), key="key", k=cfg.top_k), spark, to)
    publish(spark, root, to)
    return rows
