"""AGG-7 MinHash signatures, JOIN-8 candidates by Jaccard estimate, JOIN-6
candidate rerank, ANN-6 MinHash retrieval (Broder 1997).

Shingles are the distinct lower-cased whitespace tokens of a text (STR-5).
Each token gets a 32-bit base hash (first 8 hex digits of ``md5``); hash
function ``i`` of 64 is ``(a_i * x + b_i) mod (2^31 - 1)``; the signature keeps
the minimum of each. Signatures are per row (no shuffle): base hashes on the
JVM, the 64-way minimum vectorised in NumPy over each Arrow batch.

Candidates are the exact top ``k * overfetch`` by signature agreement (the Jaccard
estimate): a short query and a long record agree in few positions, which bands of several
positions would miss. They are re-ranked by cosine.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import RetrievalConfig
from tessera.functions.text import py_strip, whitespace_set
from tessera.functions.vector import cosine_eps
from tessera.operators.knn import BLOCK_BYTES, MAX_QUERY_BYTES, knn_topk
from tessera.operators.rank import topk_per_query

NUM_HASHES = 64
PRIME = 2147483647  # 2^31 - 1


def hash_params(n: int = NUM_HASHES) -> list[tuple[int, int]]:
    """(a_i, b_i) of the ``n`` hash functions, from a fixed linear rule."""
    return [(1 + (i * 48271 + 11) % (PRIME - 1), (i * 69621 + 7) % PRIME) for i in range(n)]


def token_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.conv(F.substr(F.md5(t), F.lit(1), F.lit(8)), 16, 10).cast("bigint"))


def _mod_mersenne31(x: np.ndarray) -> np.ndarray:
    """``x mod (2^31 - 1)`` for 0 <= x < 2^63 with shifts and masks."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    return np.where(x >= PRIME, x - PRIME, x)


def _signatures(hashes: pd.Series, n: int, chunk_tokens: int = 1 << 14) -> pd.Series:
    """Vectorised over an Arrow batch, in row chunks of about ``chunk_tokens``
    tokens: one (n x tokens) int64 matrix per chunk, then a segmented minimum."""
    params = np.array(hash_params(n), dtype=np.int64)
    a, b = params[:, 0:1], params[:, 1:2]
    arrs = [None if h is None else np.asarray(h, dtype=np.int64) for h in hashes]
    out = [None] * len(arrs)
    i = 0
    while i < len(arrs):
        j, tot = i, 0
        while j < len(arrs) and (tot == 0 or tot + (0 if arrs[j] is None else len(arrs[j])) <= chunk_tokens):
            tot += 0 if arrs[j] is None else len(arrs[j])
            j += 1
        idx = [r for r in range(i, j) if arrs[r] is not None and len(arrs[r])]
        if idx:
            flat = np.concatenate([arrs[r] for r in idx])
            vals = _mod_mersenne31(a * flat[None, :] + b)
            lengths = np.array([len(arrs[r]) for r in idx])
            starts = np.r_[0, np.cumsum(lengths)[:-1]]
            mins = np.minimum.reduceat(vals, starts, axis=1)
            for c, r in enumerate(idx):
                out[r] = mins[:, c]
        i = j
    return pd.Series(out, dtype=object)


def minhash_signature(text: Column, n: int = NUM_HASHES) -> Column:
    """AGG-7: ``array<bigint>`` of ``n`` minima over the text's shingles (null if
    none). Base hashes on the JVM, the ``n``-way minimum in NumPy per Arrow batch."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def _sig(hs: pd.Series) -> pd.Series:
        return _signatures(hs, n)

    return _sig(token_hashes(whitespace_set(text)))


def minhash_signature_sql(text: Column, n: int = NUM_HASHES) -> Column:
    """The same signature as one SQL expression (interpreted lambdas; slower)."""
    params = hash_params(n)
    a = F.array(*[F.lit(p[0]).cast("bigint") for p in params])
    b = F.array(*[F.lit(p[1]).cast("bigint") for p in params])
    hs = token_hashes(whitespace_set(text))
    sig = F.transform(F.sequence(F.lit(1), F.lit(n)),
                      lambda i: F.array_min(F.transform(hs, lambda x: F.pmod(F.element_at(a, i) * x + F.element_at(b, i),
                                                                             F.lit(PRIME)))))
    return F.when(F.size(hs) > 0, sig)


def with_signatures(df: DataFrame, text: str, out: str = "sig") -> DataFrame:
    """Add signatures; rows without any token (null signature) are dropped. The
    filter is on the text, a JVM predicate: a filter on the Python result would
    be pushed below an exchange and evaluate the UDF twice."""
    has_token = F.length(py_strip(F.col(text))) > 0
    return df.filter(has_token).withColumn(out, minhash_signature(F.col(text)))


#: Less than any agreement of one position.
_SOME = 0.5 / NUM_HASHES


def minhash_candidates(queries: DataFrame, corpus: DataFrame, k: int, *, query_id: str = "query_id",
                       key: str = "key", sig: str = "sig", max_query_bytes: int = MAX_QUERY_BYTES,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """JOIN-8: the top ``k`` records of each query by signature agreement (the Jaccard estimate) above
    0, ties by key: the exact ranking, with no bands. The signatures are scored where they lie
    against postings of the queries' positions, so a record costs one look-up a position and one
    count a match; only each task's top ``k`` travels. More queries than ``max_query_bytes`` go by
    blocks (JOIN-1); both bounds change the plan only."""
    best = knn_topk(queries.select(query_id, sig), corpus.select(key, sig), k=k, threshold=_SOME, query_id=query_id, query_vec=sig,
                    key=key, corpus_vec=sig, kind="agree", decimals=None, max_query_bytes=max_query_bytes, block_bytes=block_bytes)
    return best.withColumnRenamed("score", "jaccard_est")


def candidate_rerank(cands: DataFrame, query_vecs: DataFrame, record_vecs: DataFrame, *,
                     query_id: str = "query_id", key: str = "key", decimals: int | None = 6) -> DataFrame:
    """JOIN-6: exact cosine (``dot / (|q||r| + 1e-9)``) of each candidate with the
    stored record vector (no re-encoding). ``query_vecs(query_id, qvec)``,
    ``record_vecs(key, embedding)``."""
    j = cands.join(query_vecs, query_id).join(record_vecs, key)
    s = cosine_eps(F.col("qvec"), F.col("embedding"))
    if decimals is not None:
        s = F.round(s, decimals)
    return j.withColumn("score", s).drop("qvec", "embedding")


def minhash_retrieve(queries: DataFrame, q_sigs: DataFrame, corpus_sigs: DataFrame, query_vecs: DataFrame,
                     record_vecs: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), *,
                     query_id: str = "query_id", key: str = "key") -> DataFrame:
    """ANN-6 (Tier 2): ``k * minhash_overfetch`` candidates by Jaccard estimate ->
    exact cosine -> threshold -> top k by (score desc, key asc)."""
    cands = minhash_candidates(q_sigs, corpus_sigs, cfg.top_k * cfg.minhash_overfetch,
                               query_id=query_id, key=key, max_query_bytes=cfg.max_query_bytes,
                               block_bytes=cfg.block_bytes).drop("rank")
    scored = candidate_rerank(cands, query_vecs, record_vecs, query_id=query_id, key=key,
                              decimals=cfg.score_decimals)
    kept = scored.filter(~F.isnan("score") & (F.col("score") >= cfg.threshold))
    return topk_per_query(kept, cfg.top_k, group=query_id, tie=key)
