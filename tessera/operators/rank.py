"""FLT-1 threshold, SRT-1/2/3 ranking, WIN-1/5 top-k per query, JOIN-2 fetch,
AGG-1 best score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filter_by_threshold(df: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """FLT-1: keep ``score >= threshold``. NaN is dropped explicitly because Spark
    orders NaN above every number."""
    return df.filter(~F.isnan(F.col(score)) & (F.col(score) >= F.lit(threshold)))


def rank_fragments(df: DataFrame, score: str = "score", tie: str = "ord") -> DataFrame:
    """SRT-1: global order by score descending (stable: input order on ties).
    Use only for output; per-query ranking is ``topk_per_query``."""
    return df.orderBy(F.col(score).desc(), F.col(tie).asc())


def single_query_topk(df: DataFrame, k: int, threshold: float, score: str = "score",
                      tie: str = "ord") -> DataFrame:
    """SRT-2: threshold -> sort -> first k of one query (plans a TakeOrderedAndProject)."""
    return filter_by_threshold(df, threshold, score).orderBy(F.col(score).desc(), F.col(tie).asc()).limit(k)


def topk_per_query(df: DataFrame, k: int, *, group: str = "query_id", score: str = "score",
                   tie: str = "ord", rank: str = "rank") -> DataFrame:
    """WIN-1 / WIN-5 (``k * factor`` for an overfetch shortlist) / SRT-3:
    ``row_number`` per query by (score desc, tie asc) <= k."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie).asc())
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def max_score_per_query(fragments: DataFrame, group: str = "query_id", score: str = "score") -> DataFrame:
    """AGG-1: best fragment score of each query."""
    return fragments.groupBy(group).agg(F.max(score).alias("max_score"), F.count(F.lit(1)).alias("n_fragments"))


def fetch_records(cands: DataFrame, records: DataFrame, *, key: str, cand_bytes: int | None = None,
                  max_broadcast_bytes: int = 0) -> DataFrame:
    """JOIN-2 late fetch: inner join the shortlist to the records (FLT-2: an
    unresolved key drops out). The shortlist is broadcast only when its size has a
    proven bound in bytes (queries x k rows of fixed width) of at most
    ``max_broadcast_bytes``; otherwise both sides shuffle on the key."""
    if cand_bytes is not None and cand_bytes <= max_broadcast_bytes:
        return records.join(F.broadcast(cands), key, "inner")
    return cands.join(records.hint("merge"), key, "inner")
