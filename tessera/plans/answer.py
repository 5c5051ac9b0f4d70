"""PIP-1 retrieve (text), PIP-2 answer, PIP-3 chat answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import RetrievalConfig
from tessera.operators import synth as SY
from tessera.operators.audit import grounding_audit
from tessera.operators.chat import last_messages, token_usage
from tessera.operators.encode import encode
from tessera.operators.knn import knn_topk
from tessera.operators.rank import fetch_records


#: Bytes of a shortlist row: query id, ord, score and rank, with Spark's row header.
_SHORT_ROW = 64


def retrieve_text(queries: DataFrame, records: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), *,
                  query: str = "query", vectors: DataFrame | None = None,
                  encoder: Callable[[DataFrame, str, str], DataFrame] = encode) -> DataFrame:
    """PIP-1 (JSON mode, ANN-5 without boost): encode the queries, score all records,
    threshold, top-k per query, then fetch the text of the winners only (late
    materialisation). ``records`` needs ``ord``, ``source_id``, ``text_out``; ``vectors(ord,
    embedding)`` are the records' stored vectors (``build_corpus``), without them the
    records are encoded here. ``encoder(df, text_col, out_col)`` must be the one that
    made the vectors. Returns ``fragments(query_id, rank, source_id, text, score)``."""
    qv = encoder(queries.select("query_id", query), query, "embedding")
    rv = vectors if vectors is not None else encoder(records.select("ord", "text_out"), "text_out", "embedding")
    top = knn_topk(qv, rv.select("ord", "embedding"), k=cfg.top_k, threshold=cfg.threshold, query_id="query_id", key="ord",
                   kind="dot", decimals=cfg.score_decimals, max_query_bytes=cfg.max_query_bytes, block_bytes=cfg.block_bytes)
    texts = records.select("ord", "source_id", F.col("text_out").alias("text"))
    bound = queries.count() * cfg.top_k * _SHORT_ROW
    frags = fetch_records(top, texts, key="ord", cand_bytes=bound, max_broadcast_bytes=cfg.max_broadcast_bytes)
    return frags.select("query_id", "rank", "source_id", "text", "score", "ord")


def answer(queries: DataFrame, fragments: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), *,
           query: str = "query",
           make_generator: Callable[[], Callable[[list], str]] | None = None) -> DataFrame:
    """PIP-2: route (SYN-6) -> statistical rewrite (SYN-5) or generator
    (SYN-7/8/9) -> fallback (SYN-10). Every query keeps one row:
    ``(query_id, mode, response)``."""
    has_gen = make_generator is not None
    routed = SY.route_and_prompt(queries, fragments, has_generator=has_gen, cfg=cfg, query=query)
    has_frag = F.coalesce(F.col("n_fragments"), F.lit(0)) > 0
    if has_gen:
        gen = SY.generate(routed.select("query_id", "mode", "n_fragments", "messages"), make_generator)
        return gen.select("query_id", "mode", SY.answer_or_fallback(F.col("response"), has_frag, True).alias("response"))
    rw = SY.rewrite(queries, fragments, cfg, query)
    out = routed.select("query_id", "mode", "n_fragments").join(rw, "query_id", "left")
    return out.select("query_id", "mode", SY.answer_or_fallback(F.col("response"), has_frag, False).alias("response"))


def audited_answer(queries: DataFrame, fragments: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), *,
                   query: str = "query",
                   make_generator: Callable[[], Callable[[list], str]] | None = None) -> DataFrame:
    """PIP-2 with SET-3: ``answer`` plus ``grounded`` and ``offending``. Under
    ``restricted_vocabulary`` every answer made from fragments (statistical or guided) is
    audited against them; fallbacks and free answers, and all answers without the
    restriction, have null there."""
    ans = answer(queries, fragments, cfg, query=query, make_generator=make_generator)
    nothing = F.lit(None)
    if not cfg.restricted_vocabulary:
        return ans.select("*", nothing.cast("boolean").alias("grounded"), nothing.cast("array<string>").alias("offending"))
    made = ans.where(F.col("mode").isin("statistical", "guided") & ~F.col("response").isin(SY.K.NOTHING_FOUND, SY.K.NOT_ENOUGH))
    checked = grounding_audit(made.select("query_id", "response"), fragments)
    return ans.join(checked, "query_id", "left").select(*ans.columns, "grounded", "offending")


def chat_answer(conversations: DataFrame, records: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), *,
                vectors: DataFrame | None = None, encoder: Callable[[DataFrame, str, str], DataFrame] = encode,
                make_generator: Callable[[], Callable[[list], str]] | None = None) -> DataFrame:
    """PIP-3: last user / system message of each conversation (AGG-4, FLT-6)
    -> PIP-1 -> PIP-2 -> whitespace token usage (AGG-5). A conversation with no
    non-blank user message gets no row (the reference answers HTTP 400)."""
    last = last_messages(conversations).filter(F.col("user_text").isNotNull())
    queries = last.select(F.col("conv_id").alias("query_id"), F.col("user_text").alias("query"),
                          F.col("system_text").alias("system_prompt"))
    frags = retrieve_text(queries, records, cfg, vectors=vectors, encoder=encoder)
    ans = answer(queries, frags, cfg, make_generator=make_generator)
    out = queries.join(ans, "query_id").withColumnRenamed("query_id", "conv_id")
    return token_usage(out, prompt="query", completion="response")
