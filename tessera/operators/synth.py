"""Synthesis over tables of queries and fragments (SYN-1..10, WIN-2/3, AGG-3/8/9).

Inputs: ``queries(query_id, query[, system_prompt])`` and
``fragments(query_id, rank, source_id, text, score)``. Every step is bounded
per query: the focused fragment is one row, its sentences are one document's,
and at most ``min(sentence_cap, max_output_sentences)`` sentences are chained.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import RetrievalConfig
from tessera.functions import constants as K
from tessera.functions.text import (decapitalize, ensure_period, extract_keywords, extract_query_term,
                                    normalize_text, overlap_score, prefix_match, py_strip,
                                    sentence_parts, word_set)
from tessera.operators.rank import max_score_per_query


def with_query_features(queries: DataFrame, query: str = "query") -> DataFrame:
    """SYN-1 keywords of the whole query, and its term (STR-2)."""
    return (queries.withColumn("term", extract_query_term(F.col(query)))
            .withColumn("keywords", extract_keywords(F.col(query))))


def focus_fragment(fragments: DataFrame, qf: DataFrame) -> DataFrame:
    """WIN-2: one fragment per query — the source id equal to the term, else the
    first whose text head starts with the term, else the best ranked; with no
    term, the best ranked."""
    t = F.col("term")
    sid = F.col("source_id")
    match_class = (F.when(t == "", F.lit(2))
                   .when(sid.isNotNull() & (sid != "") & (normalize_text(sid) == normalize_text(t)), F.lit(0))
                   .when(prefix_match(F.col("text"), t), F.lit(1))
                   .otherwise(F.lit(2)))
    w = Window.partitionBy("query_id").orderBy(F.col("match_class"), F.col("rank"))
    return (fragments.join(qf.select("query_id", "term", "keywords"), "query_id")
            .withColumn("match_class", match_class)
            .withColumn("__n", F.row_number().over(w)).filter(F.col("__n") == 1).drop("__n"))


def extract_sentences(focused: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """SYN-2 + FLT-4 + AGG-3: sentences of the focused fragment, stripped, longer
    than ``min_sentence_chars``; a repeated sentence keeps its first position."""
    parts = focused.select("query_id", "keywords", F.posexplode(sentence_parts(F.col("text"))).alias("pos", "raw"))
    s = parts.select("query_id", "keywords", "pos", py_strip(F.col("raw")).alias("sentence"))
    s = s.filter(F.length("sentence") > cfg.min_sentence_chars)
    return s.groupBy("query_id", "sentence").agg(F.min("pos").alias("pos"), F.first("keywords").alias("keywords"))


def score_sentences(sentences: DataFrame) -> DataFrame:
    """SYN-3 / MTH-5: share of the sentence's distinct words that are query keywords."""
    return sentences.withColumn("sentence_score", overlap_score(word_set(F.col("sentence")), F.col("keywords")))


def top_sentences(scored: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """WIN-3: best ``min(sentence_cap, max_output_sentences)`` by (score desc, first position)."""
    cap = min(cfg.sentence_cap, cfg.max_output_sentences)
    w = Window.partitionBy("query_id").orderBy(F.col("sentence_score").desc(), F.col("pos").asc())
    return scored.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= cap)


def _connector(i: Column) -> Column:
    arr = F.array(*[F.lit(c) for c in K.CONNECTORS])
    return F.element_at(arr, (F.pmod(i, F.lit(len(K.CONNECTORS))) + 1).cast("int"))


def chain_sentences(top: DataFrame) -> DataFrame:
    """SYN-4 / AGG-9: first sentence with a final period; each next one after a
    connector (``i mod 7``), first letter lowered, final period; joined by spaces."""
    piece = F.when(F.col("n") == 1, ensure_period(F.col("sentence"))).otherwise(
        F.concat(_connector(F.col("n") - 2), F.lit(" "), ensure_period(decapitalize(F.col("sentence")))))
    pieces = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", piece.alias("p")))).alias("ps"))
    return pieces.select("query_id", py_strip(F.array_join(F.transform("ps", lambda x: x["p"]), " ")).alias("response"))


def rewrite(queries: DataFrame, fragments: DataFrame, cfg: RetrievalConfig = RetrievalConfig(),
            query: str = "query") -> DataFrame:
    """SYN-5: focus -> sentences -> score -> top -> chain. One row per query that
    has fragments; a query without usable sentences gets ``""``."""
    qf = with_query_features(queries.select("query_id", query), query)
    focused = focus_fragment(fragments, qf)
    chained = chain_sentences(top_sentences(score_sentences(extract_sentences(focused, cfg)), cfg))
    return (focused.select("query_id").join(chained, "query_id", "left")
            .select("query_id", F.coalesce(F.col("response"), F.lit("")).alias("response")))


def context_block(fragments: DataFrame) -> DataFrame:
    """AGG-8: ``[i] text`` lines in rank order, per query."""
    lines = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return fragments.groupBy("query_id").agg(
        F.array_join(F.transform(lines, lambda x: F.format_string("[%d] %s", x["rank"], x["text"])), "\n")
        .alias("context"))


def guided_messages(query: Column, context: Column) -> Column:
    """SYN-7: the grounding system prompt + ``CONTEXTO``/``PREGUNTA`` user message."""
    user = F.concat(F.lit("CONTEXTO:\n"), context, F.lit("\n\nPREGUNTA: "), query)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(K.GUIDED_SYSTEM_PROMPT).alias("content")),
                   F.struct(F.lit("user").alias("role"), user.alias("content")))


def free_messages(query: Column, system_prompt: Column | None = None) -> Column:
    """SYN-8: per-row system prompt (or the default) + the query."""
    sp = F.coalesce(system_prompt, F.lit(K.FREE_SYSTEM_PROMPT)) if system_prompt is not None \
        else F.lit(K.FREE_SYSTEM_PROMPT)
    return F.array(F.struct(F.lit("system").alias("role"), sp.alias("content")),
                   F.struct(F.lit("user").alias("role"), query.alias("content")))


def route_and_prompt(queries: DataFrame, fragments: DataFrame, *, has_generator: bool,
                     cfg: RetrievalConfig = RetrievalConfig(), query: str = "query") -> DataFrame:
    """SYN-6 (+FLT-7, AGG-1): per query, the mode and, for generator modes, the
    chat messages. Modes: ``statistical`` / ``empty`` without a generator;
    ``free`` (no fragments or best score < relevance threshold) / ``guided`` with one."""
    best = max_score_per_query(fragments)
    ctx = context_block(fragments)
    sp = F.col("system_prompt") if "system_prompt" in queries.columns else None
    q = queries.join(best, "query_id", "left").join(ctx, "query_id", "left")
    has_frag = F.coalesce(F.col("n_fragments"), F.lit(0)) > 0
    if has_generator:
        mode = F.when(~has_frag | (F.col("max_score") < cfg.relevance_threshold), F.lit("free")).otherwise(F.lit("guided"))
    else:
        mode = F.when(has_frag, F.lit("statistical")).otherwise(F.lit("empty"))
    q = q.withColumn("mode", mode)
    msgs = (F.when(F.col("mode") == "guided", guided_messages(F.col(query), F.col("context")))
            .when(F.col("mode") == "free", free_messages(F.col(query), sp)))
    return q.withColumn("messages", msgs)


def generate(prompts: DataFrame, make_generator: Callable[[], Callable[[list], str]],
             messages: str = "messages", out: str = "response") -> DataFrame:
    """SYN-9: apply a user generator to each row's messages. ``make_generator``
    runs once per partition's Python worker; rows with no messages get null."""
    schema = T.StructType(list(prompts.schema.fields) + [T.StructField(out, T.StringType())])

    def _run(it):
        gen = make_generator()
        for pdf in it:
            pdf[out] = [None if m is None else str(gen([dict(x) for x in m])) for m in pdf[messages]]
            yield pdf

    return prompts.mapInPandas(_run, schema=schema)


def answer_or_fallback(response: Column, has_fragments: Column, has_generator: bool) -> Column:
    """SYN-10: nothing relevant (no fragments, no generator) / not enough (empty answer)."""
    out = F.when(~has_fragments & F.lit(not has_generator), F.lit(K.NOTHING_FOUND))
    return out.when(F.coalesce(response, F.lit("")) == "", F.lit(K.NOT_ENOUGH)).otherwise(response)


def stub_generator() -> Callable[[list], str]:
    """Deterministic stand-in generator for tests: echoes the last message's
    first line. (Model runtimes are outside this library.)"""
    def gen(msgs: list) -> str:
        return str(msgs[-1]["content"]).split("\n")[0]
    return gen


__all__ = [
    "with_query_features", "focus_fragment", "extract_sentences", "score_sentences",
    "top_sentences", "chain_sentences", "rewrite",
    "context_block", "guided_messages", "free_messages", "route_and_prompt",
    "generate", "answer_or_fallback", "stub_generator",
]
