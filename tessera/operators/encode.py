"""ANN-1 ``encode``: text -> unit vector column.

There is no sentence-embedding model in this environment, so the default
encoder is a **hashed bag of words** (a stand-in, not semantic): Unicode word
tokens (STR-4) are hashed to ``dim`` buckets on the JVM (first 32 bits of
``md5``), then an Arrow UDF turns each bucket list into counts and L2-normalises
them (float32, like a stored embedding matrix), ``SLICE`` rows at a time: what a
worker holds is one Arrow batch of buckets and its vectors, however large the table.

Any other encoder plugs in through ``encode_with``: an iterator pandas UDF that
builds the user's model once per Python worker and encodes Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import tokenize_words

DEFAULT_DIM = 256
#: Rows whose counts are held at once in a worker.
SLICE = 512


def token_buckets(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """Bucket id of every word token: ``md5(token)[:8]`` as an integer, mod ``dim``."""
    return F.transform(
        tokenize_words(text),
        lambda t: F.pmod(F.conv(F.substr(F.md5(t), F.lit(1), F.lit(8)), 16, 10).cast("bigint"), F.lit(dim)),
    )


def _counts_to_unit(buckets: pa.ListArray, dim: int, weights: np.ndarray | None = None) -> pa.ListArray:
    """Unit vectors of lists of buckets (no nulls); the counts of ``SLICE`` rows are held at a time."""
    n = len(buckets)
    out = np.empty((n, dim), np.float32)
    for i in range(0, n, SLICE):
        part = buckets.slice(i, SLICE)
        rows = np.repeat(np.arange(len(part)), np.diff(part.offsets.to_numpy()))
        flat = part.flatten().to_numpy(zero_copy_only=False)
        counts = np.bincount(rows * dim + flat, minlength=len(part) * dim).reshape(-1, dim).astype(np.float64)
        if weights is not None:
            counts *= weights
        norms = np.sqrt((counts * counts).sum(axis=1))
        with np.errstate(invalid="ignore", divide="ignore"):
            out[i:i + SLICE] = np.where(norms[:, None] > 0, counts / norms[:, None], 0.0)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(out.ravel()))


def hashed_bow(text: Column, dim: int = DEFAULT_DIM, weights: np.ndarray | None = None) -> Column:
    """Unit float32 vector of hashed word counts, times the ``weights`` of the buckets if given."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def _unit(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield _counts_to_unit(b, dim, weights)
            del b
            pa.default_memory_pool().release_unused()

    # a null text has no tokens: it becomes the zero vector; a bucket travels as the smallest type that holds it
    kind = "array<smallint>" if dim <= 1 << 15 else "array<int>"
    return _unit(F.coalesce(token_buckets(text, dim).cast(kind), F.array().cast(kind)))


def encode(df: DataFrame, text: str = "text", out: str = "embedding", dim: int = DEFAULT_DIM) -> DataFrame:
    """Add ``out`` = default encoder of ``text``."""
    return df.withColumn(out, hashed_bow(F.col(text), dim))


def fit_idf(records: DataFrame, text: str = "text_out", dim: int = DEFAULT_DIM) -> DataFrame:
    """(bucket, n_records, idf): the corpus statistic that records and queries share, one row per bucket: in how
    many records it occurs, and ``ln((1 + N) / (1 + n)) + 1`` to six decimals. Null and empty texts count to N."""
    has = records.select(F.explode(F.array_distinct(token_buckets(F.col(text), dim))).alias("bucket"))
    counts = has.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_records"))
    every = records.sparkSession.range(dim).select(F.col("id").alias("bucket"))
    n = F.coalesce("n_records", F.lit(0))
    return every.join(counts, "bucket", "left").select(
        F.col("bucket").cast("int").alias("bucket"), n.alias("n_records"),
        F.round(F.log(F.lit(1.0 + records.count()) / (n + 1.0)) + 1.0, 6).alias("idf"))


def tfidf_encoder(idf: DataFrame) -> Callable[[DataFrame, str, str], DataFrame]:
    """An encoder of counts weighted by a fitted ``idf`` (a row per bucket, collected), normalised."""
    rows = sorted((r["bucket"], r["idf"]) for r in idf.select("bucket", "idf").collect())
    weights = np.array([w for _, w in rows])

    def run(df: DataFrame, text: str = "text", out: str = "embedding") -> DataFrame:
        return df.withColumn(out, hashed_bow(F.col(text), len(weights), weights))
    return run


def encode_with(df: DataFrame, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]],
                text: str = "text", out: str = "embedding", normalize: bool = True) -> DataFrame:
    """Add ``out`` using a user encoder. ``make_encoder()`` runs once per Python
    worker and returns ``f(list_of_texts) -> (n, dim) array``; batches follow
    ``spark.sql.execution.arrow.maxRecordsPerBatch``."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_encoder()
        for s in batches:
            m = np.asarray(model(s.fillna("").tolist()), dtype=np.float64)
            if normalize:
                n = np.linalg.norm(m, axis=1, keepdims=True)
                m = np.where(n > 0, m / np.where(n > 0, n, 1.0), 0.0)
            yield pd.Series(list(m.astype(np.float32)))

    return df.withColumn(out, _enc(F.col(text)))
