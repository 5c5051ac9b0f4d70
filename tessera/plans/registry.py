"""Registered queries over the driver tables, and their DuckDB oracle SQL.

Every query reads whole tables (or data Spark derives from them); none filters
ids, samples or caps rows to make the check cheaper.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import RetrievalConfig
from tessera.plans.retrieve import cosine_retrieve
from tessera.sources.tables import table

CFG = RetrievalConfig()


def _long(df: DataFrame, *cols: str) -> DataFrame:
    """Counts, ranks and positions are reported as bigint (as the oracle does)."""
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("bigint"))
    return df


# ---------------------------------------------------------------- vectors
def q_cosine_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    """Every embedding is a query against the whole table: top 5 by dot product, >= 0.3."""
    emb = table(spark, sf, "embeddings")
    queries = emb.select(F.col("vec_id").alias("query_id"), "embedding")
    res = cosine_retrieve(queries, emb, CFG, key="vec_id")
    return _long(res.select("query_id", "vec_id", "rank", "score"), "rank")


SQL_COSINE_RETRIEVE = """
WITH s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q, embeddings c),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM s WHERE score >= 0.3)
SELECT query_id, vec_id, rank, score FROM r WHERE rank <= 5
"""


# ---------------------------------------------------------------- text functions
from tessera.functions import text as TX  # noqa: E402
from tessera.plans import oracle_sql as S  # noqa: E402
from tessera.plans.inputs import definition_questions, part_records  # noqa: E402
from tessera.operators import match as M  # noqa: E402


def q_normalize_text(spark, sf):
    """STR-1 over every document."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", TX.normalize_text(F.col("text")).alias("norm_text"))


SQL_NORMALIZE_TEXT = f"SELECT doc_id, {S.norm('text')} AS norm_text FROM documents"


def q_word_stats(spark, sf):
    """STR-4, STR-5, AGG-2 over every document."""
    d = table(spark, sf, "documents")
    return _long(d.select(
        "doc_id",
        F.size(TX.tokenize_words("text")).alias("n_words"),
        F.size(TX.word_set("text")).alias("n_distinct_words"),
        F.size(TX.tokenize_whitespace("text")).alias("n_tokens"),
        F.size(TX.whitespace_set("text")).alias("n_distinct_tokens"),
        TX.whitespace_token_count("text").alias("n_split"),
    ), "n_words", "n_distinct_words", "n_tokens", "n_distinct_tokens", "n_split")


SQL_WORD_STATS = f"""
SELECT doc_id, length({S.words('text')}) AS n_words, length({S.word_set('text')}) AS n_distinct_words,
       length({S.ws_tokens('text')}) AS n_tokens, length(list_distinct({S.ws_tokens('text')})) AS n_distinct_tokens,
       {S.ws_count('text')} AS n_split
FROM documents"""


def q_split_sentences(spark, sf):
    """STR-6 + FLT-4: every sentence (> 8 characters after strip) of every document."""
    d = table(spark, sf, "documents")
    parts = d.select("doc_id", F.posexplode(TX.sentence_parts("text")).alias("pos", "raw"))
    return _long(parts.select("doc_id", "pos", TX.py_strip(F.col("raw")).alias("sentence"))
                 .filter(F.length("sentence") > 8), "pos")


SQL_SPLIT_SENTENCES = f"""
SELECT doc_id, pos, sentence FROM (
  SELECT doc_id, i AS pos, {S.strip('parts[i + 1]')} AS sentence FROM (
    SELECT doc_id, parts, unnest(range(length(parts))) AS i FROM (
      SELECT doc_id, string_split_regex(text, '[.!?;]+') AS parts FROM documents)))
WHERE length(sentence) > 8"""


def q_query_terms(spark, sf):
    """STR-2, FLT-8, STR-1, SYN-1 on definition questions built from ``part``."""
    q = definition_questions(table(spark, sf, "part"))
    return M.with_query_terms(q, "query").select(
        "query_id", "term", "norm_term", F.array_sort(TX.extract_keywords("query")).alias("keywords"))


SQL_QUERY_TERMS = f"""
WITH q AS ({S.definition_questions()}), t AS (SELECT query_id, query, {S.term('query')} AS term FROM q)
SELECT query_id, term, CASE WHEN term <> '' THEN {S.norm('term')} ELSE '' END AS norm_term,
       list_sort({S.keywords('query')}) AS keywords
FROM t"""


def q_benchmark_keywords(spark, sf):
    """SYN-1 on every ``benchmark`` text (whole query, no accent folding)."""
    b = table(spark, sf, "benchmark")
    return b.select("item_id", F.array_sort(TX.extract_keywords("text")).alias("keywords"))


SQL_BENCHMARK_KEYWORDS = f"SELECT item_id, list_sort({S.keywords('text')}) AS keywords FROM benchmark"


def q_key_boosts(spark, sf):
    """JOIN-4/5, AGG-10, WIN-4 (embedding-cache tier): definition questions vs
    ``part`` names as keys; one boost row per question that names a key."""
    part = table(spark, sf, "part")
    recs = part_records(part)
    q = definition_questions(part)
    return M.key_boosts(q, recs, CFG).withColumnRenamed("ord", "p_partkey")


SQL_KEY_BOOSTS = f"""
WITH q AS ({S.definition_questions()}),
t AS (SELECT query_id, {S.term('query')} AS term FROM q),
nt AS (SELECT query_id, {S.norm('term')} AS norm_term FROM t WHERE term <> ''),
nk AS (SELECT {S.norm('p_name')} AS norm_key, max(p_partkey) AS last_ord, min(p_partkey) AS first_ord
       FROM part GROUP BY 1),
ex AS (SELECT nt.query_id, nk.last_ord AS p_partkey, 'exact' AS match_kind, 0.40::DOUBLE AS boost
       FROM nt JOIN nk ON nt.norm_term = nk.norm_key),
fz AS (SELECT nt.query_id, arg_min(nk.last_ord, nk.first_ord) AS p_partkey, 'fuzzy' AS match_kind, 0.28::DOUBLE AS boost
       FROM nt JOIN nk ON levenshtein(nt.norm_term, nk.norm_key) <= 1
       WHERE length(nt.norm_term) >= 5 AND nt.query_id NOT IN (SELECT query_id FROM ex)
       GROUP BY nt.query_id)
SELECT * FROM ex UNION ALL SELECT * FROM fz"""


def q_exact_key_lookup(spark, sf):
    """JOIN-3 (no-index tier) + PRJ-5: a question equal to a stored key returns
    that key's record from the keyed store (last record wins), score 1.0."""
    from tessera.sources.corpus import PARSED_FIELDS, parse_record_or_wrap, record_to_text
    from tessera.sources.store import keyed_records
    from tessera.sources.corpus import as_corpus
    from tessera.plans.inputs import PART_AS_CORPUS
    store = keyed_records(as_corpus(table(spark, sf, "part"), PART_AS_CORPUS, "p_partkey"), CFG.num_buckets)
    parsed = store.select("key", "ord", parse_record_or_wrap("value").alias("r"))
    recs = parsed.select("key", "ord", *[F.col(f"r.{f}").alias(f) for f in PARSED_FIELDS]) \
        .select("key", "ord", record_to_text().alias("text"))
    q = definition_questions(table(spark, sf, "part"))
    return M.exact_key_lookup(q, recs).select("query_id", "key", F.col("ord").alias("p_partkey"), "text", "score")


SQL_EXACT_KEY_LOOKUP = f"""
WITH q AS ({S.definition_questions()}),
st AS (SELECT p_name AS key, max(p_partkey) AS p_partkey, arg_max(p_name || ': ' || p_type, p_partkey) AS text
       FROM part WHERE p_name IS NOT NULL AND p_name <> '' GROUP BY p_name)
SELECT q.query_id, st.key, st.p_partkey, st.text, 1.0::DOUBLE AS score
FROM q JOIN st ON q.query = st.key"""


# ---------------------------------------------------------------- retrieval + synthesis
from tessera.plans.answer import answer as answer_plan, retrieve_text  # noqa: E402
from tessera.plans.inputs import document_records  # noqa: E402
from tessera.operators import synth as SY  # noqa: E402

BENCH_QUERIES_SQL = "SELECT item_id AS query_id, text AS query FROM benchmark"


def _bench_queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _bench_fragments(spark, sf):
    q = _bench_queries(spark, sf)
    recs = document_records(table(spark, sf, "documents"))
    return q, retrieve_text(q, recs, CFG)


def q_text_retrieve(spark, sf):
    """PIP-1 / ANN-5 / ANN-1 / JOIN-2: every benchmark text against all documents
    (hashed bag-of-words vectors), top 5 >= 0.3, text fetched for the winners."""
    _, frags = _bench_fragments(spark, sf)
    return _long(frags.select("query_id", "rank", "source_id", "text", "score"), "rank")


SQL_TEXT_RETRIEVE = f"""WITH {S.text_fragments(BENCH_QUERIES_SQL)}
SELECT query_id, rank, source_id, text, score FROM frag"""


def q_rewrite(spark, sf):
    """SYN-1..5, WIN-2/3, AGG-3/9: statistical rewrite of the fragments of every benchmark text."""
    q, frags = _bench_fragments(spark, sf)
    return SY.rewrite(q, frags, CFG)


SQL_REWRITE = f"""WITH {S.text_fragments(BENCH_QUERIES_SQL)},
{S.rewrite()}
SELECT query_id, response FROM rw"""


def q_answer(spark, sf):
    """PIP-2 / SYN-6 / SYN-10 / AGG-1: answer (or fallback) for every benchmark text."""
    q, frags = _bench_fragments(spark, sf)
    return answer_plan(q, frags, CFG)


SQL_ANSWER = f"""WITH {S.text_fragments(BENCH_QUERIES_SQL)},
{S.rewrite()},
{S.answer()}
SELECT query_id, mode, response FROM ans"""


def q_guided_prompt(spark, sf):
    """SYN-6/7/8, AGG-8: routing and prompts when a generator is configured."""
    q, frags = _bench_fragments(spark, sf)
    r = SY.route_and_prompt(q, frags, has_generator=True, cfg=CFG)
    m = F.col("messages")
    return r.select("query_id", "mode", m[0]["content"].alias("system_content"), m[1]["content"].alias("user_content"))


SQL_GUIDED_PROMPT = f"""WITH {S.text_fragments(BENCH_QUERIES_SQL)},
ctx AS (SELECT query_id, max(score) AS max_score, string_agg('[' || rank || '] ' || text, chr(10) ORDER BY rank) AS context
        FROM frag GROUP BY 1)
SELECT q.query_id,
  CASE WHEN ctx.query_id IS NULL OR ctx.max_score < 0.4 THEN 'free' ELSE 'guided' END AS mode,
  CASE WHEN ctx.query_id IS NULL OR ctx.max_score < 0.4 THEN {S.lit(SY.K.FREE_SYSTEM_PROMPT)}
       ELSE {S.lit(SY.K.GUIDED_SYSTEM_PROMPT)} END AS system_content,
  CASE WHEN ctx.query_id IS NULL OR ctx.max_score < 0.4 THEN q.query
       ELSE 'CONTEXTO:' || chr(10) || ctx.context || chr(10) || chr(10) || 'PREGUNTA: ' || q.query END AS user_content
FROM qsrc q LEFT JOIN ctx USING (query_id)"""


# ---------------------------------------------------------------- audit, dedup, conversations
from tessera.operators.audit import connector_words, grounding_audit  # noqa: E402
from tessera.operators.dedup import dedup_fragments  # noqa: E402
from tessera.operators.chat import chunk_response, last_messages  # noqa: E402
from tessera.plans.answer import chat_answer  # noqa: E402


def q_grounding_audit(spark, sf):
    """SET-3 / JOIN-10: every word of every statistical answer must occur in the
    query's fragments or in the connectors (the "oregano test")."""
    q, frags = _bench_fragments(spark, sf)
    rw = SY.rewrite(q, frags, CFG)
    return grounding_audit(rw, frags).select("query_id", "grounded", "offending")


SQL_GROUNDING_AUDIT = f"""WITH {S.text_fragments(BENCH_QUERIES_SQL)},
{S.rewrite()},
aw AS (SELECT query_id, unnest({S.word_set('response')}) AS word FROM rw),
fw AS (SELECT DISTINCT query_id, unnest({S.word_set('text')}) AS word FROM frag),
bad AS (SELECT query_id, list_sort(list(DISTINCT word)) AS offending FROM aw
        WHERE NOT list_contains([{", ".join(S.lit(w) for w in connector_words())}], word)
          AND NOT EXISTS (SELECT 1 FROM fw WHERE fw.query_id = aw.query_id AND fw.word = aw.word)
        GROUP BY 1)
SELECT rw.query_id, coalesce(length(bad.offending), 0) = 0 AS grounded,
       coalesce(bad.offending, []::VARCHAR[]) AS offending
FROM rw LEFT JOIN bad USING (query_id)"""


def q_dedup_fragments(spark, sf):
    """DUP-1 / STR-5 / STR-7 / JOIN-9: greedy near-duplicate removal (Jaccard >= 0.7)
    over each benchmark text's fragments, in rank order."""
    _, frags = _bench_fragments(spark, sf)
    return _long(dedup_fragments(frags, CFG.dedup_threshold).select("query_id", "rank", "source_id", "score"), "rank")


SQL_DEDUP_FRAGMENTS = f"""WITH {S.text_fragments(BENCH_QUERIES_SQL)},
it AS (SELECT query_id, list({{'rank': rank, 'w': list_distinct({S.ws_tokens('text')}), 'source_id': source_id, 'score': score}}
        ORDER BY rank) AS l FROM frag GROUP BY 1),
kp AS (SELECT query_id, list_reduce(list_transform(l, lambda x: [x]),
        lambda kept, xs: CASE WHEN length(list_filter(kept, lambda y: {S.jaccard('xs[1].w', 'y.w')} >= 0.7)) > 0
                              THEN kept ELSE list_concat(kept, xs) END) AS kept FROM it)
SELECT query_id, k.rank AS rank, k.source_id AS source_id, k.score AS score
FROM (SELECT query_id, unnest(kept) AS k FROM kp)"""


LAST_MESSAGE_SQL = f"""SELECT conv_id,
  max_by(st, turn) FILTER (WHERE role = 'user' AND st <> '') AS user_text,
  max_by(st, turn) FILTER (WHERE role = 'system' AND st <> '') AS system_text
FROM (SELECT conv_id, turn, role, {S.strip('text')} AS st FROM conversations) GROUP BY conv_id"""


def q_last_message(spark, sf):
    """AGG-4 / FLT-6: last non-blank user and system message of every conversation."""
    return last_messages(table(spark, sf, "conversations"))


def _chat(spark, sf):
    recs = document_records(table(spark, sf, "documents"))
    return chat_answer(table(spark, sf, "conversations"), recs, CFG)


def q_chat_answer(spark, sf):
    """PIP-3 / AGG-5: each conversation's last user message answered against all
    documents, with whitespace token usage."""
    return _long(_chat(spark, sf).select("conv_id", "mode", "response", "prompt_tokens", "completion_tokens",
                                         "total_tokens"), "prompt_tokens", "completion_tokens", "total_tokens")


CHAT_QUERIES_SQL = f"SELECT conv_id AS query_id, user_text AS query FROM ({LAST_MESSAGE_SQL}) WHERE user_text IS NOT NULL"

SQL_CHAT_ANSWER = f"""WITH {S.text_fragments(CHAT_QUERIES_SQL)},
{S.rewrite()},
{S.answer()}
SELECT a.query_id AS conv_id, a.mode, a.response, {S.ws_count('q.query')} AS prompt_tokens,
       {S.ws_count('a.response')} AS completion_tokens,
       {S.ws_count('q.query')} + {S.ws_count('a.response')} AS total_tokens
FROM ans a JOIN qsrc q USING (query_id)"""


def q_chunk_response(spark, sf):
    """PIP-4: every chat answer cut into word chunks plus a stop row."""
    return _long(chunk_response(_chat(spark, sf).select("conv_id", "response"), key="conv_id"), "seq")


SQL_CHUNK_RESPONSE = f"""WITH {S.text_fragments(CHAT_QUERIES_SQL)},
{S.rewrite()},
{S.answer()},
cw AS (SELECT query_id AS conv_id, string_split(response, ' ') AS w FROM ans)
SELECT conv_id, i AS seq, CASE WHEN i < length(w) - 1 THEN w[i + 1] || ' ' ELSE w[i + 1] END AS content,
       NULL::VARCHAR AS finish_reason
FROM (SELECT *, unnest(range(length(w))) AS i FROM cw)
UNION ALL
SELECT conv_id, length(w) AS seq, NULL::VARCHAR AS content, 'stop' AS finish_reason FROM cw"""


# ---------------------------------------------------------------- record store
from tessera.sources.store import keyed_records, store_stats  # noqa: E402
from tessera.sources.corpus import as_corpus  # noqa: E402
from tessera.plans.inputs import PART_AS_CORPUS  # noqa: E402


def _part_store(spark, sf):
    return keyed_records(as_corpus(table(spark, sf, "part"), PART_AS_CORPUS, "p_partkey"), CFG.num_buckets)


def q_record_store(spark, sf):
    """SRC-3 / PRJ-2 / FLT-5 / JSN-1: ``part`` as a keyed store (key = name, last record wins)."""
    return _part_store(spark, sf).select("key", "value", "ord", "bucket")


RECORD_STORE_SQL = f"""SELECT key, arg_max(value, ord) AS value, max(ord) AS ord,
       CAST(('0x' || substr(md5(key), 1, 8))::BIGINT % {CFG.num_buckets} AS INTEGER) AS bucket
FROM (SELECT p_partkey AS ord, p_name AS key,
             CAST(to_json({{'id': CAST(p_partkey AS VARCHAR), 'lemma': p_name, 'definition': p_type}}) AS VARCHAR) AS value
      FROM part WHERE p_name IS NOT NULL AND p_name <> '')
GROUP BY key"""


def q_store_stats(spark, sf):
    """SRC-6 / AGG-11: records and value bytes per bucket, with a rollup total."""
    return store_stats(_part_store(spark, sf))


SQL_STORE_STATS = f"""SELECT bucket, count(*) AS n_records, CAST(sum(strlen(value)) AS BIGINT) AS value_bytes
FROM ({RECORD_STORE_SQL}) GROUP BY ROLLUP (bucket)"""


# ---------------------------------------------------------------- MinHash
from tessera.operators import minhash as MH  # noqa: E402
from tessera.operators.encode import encode as encode_text  # noqa: E402
from tessera.sources.corpus import minhash_text  # noqa: E402


def q_minhash_signature(spark, sf):
    """AGG-7 / PRJ-4: 64-hash MinHash signature of every document."""
    recs = document_records(table(spark, sf, "documents"))
    return MH.with_signatures(recs.withColumn("mh_text", minhash_text()), "mh_text") \
        .select(F.col("ord").alias("doc_id"), "sig")


SQL_MINHASH_SIGNATURE = f"""SELECT doc_id, sig FROM (
  SELECT doc_id, {S.minhash_sig("'  ' || coalesce(text, '')")} AS sig FROM documents) WHERE sig IS NOT NULL"""


def q_minhash_retrieve(spark, sf):
    """ANN-6 / JOIN-8 / JOIN-6: MinHash tier — for every benchmark text the top 20 of all documents by
    Jaccard estimate above 0, exact cosine of stored vectors, >= 0.3, top 5."""
    q = _bench_queries(spark, sf)
    recs = document_records(table(spark, sf, "documents"))
    q_sigs = MH.with_signatures(q, "query").select("query_id", "sig")
    # the signature table of the tier's index, written once (``build_corpus`` keeps it as ``minhash``)
    c_sigs = MH.with_signatures(recs.withColumn("mh_text", minhash_text()), "mh_text").select("ord", "sig").checkpoint()
    q_vecs = encode_text(q, "query", "qvec").select("query_id", "qvec")
    r_vecs = encode_text(recs, "text_out", "embedding").select("ord", "embedding")
    res = MH.minhash_retrieve(q, q_sigs, c_sigs, q_vecs, r_vecs, CFG, key="ord")
    return _long(res.select("query_id", F.col("ord").alias("doc_id"), "rank", "score"), "rank")


SQL_MINHASH_RETRIEVE = f"""WITH qsrc AS ({BENCH_QUERIES_SQL}),
dsrc AS (SELECT doc_id AS ord, CASE WHEN text IS NOT NULL AND text <> '' THEN text
           ELSE CAST(to_json({{'id': CAST(doc_id AS VARCHAR)}}) AS VARCHAR) END AS text,
         '  ' || coalesce(text, '') AS mh FROM documents),
qs AS MATERIALIZED (SELECT * FROM (SELECT query_id, {S.minhash_sig('query')} AS sig FROM qsrc) WHERE sig IS NOT NULL),
ds AS MATERIALIZED (SELECT * FROM (SELECT ord, {S.minhash_sig('mh')} AS sig FROM dsrc) WHERE sig IS NOT NULL),
ag AS (SELECT * FROM (
         SELECT query_id, ord, length(list_filter(range(1, 65), lambda i: qs.sig[i] = ds.sig[i])) / 64.0 AS jac FROM qs, ds)
       WHERE jac > 0),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY jac DESC, ord) AS r FROM ag)
         WHERE r <= 20),
{S.unit_vectors('qv', 'qsrc', 'query_id', 'query')},
{S.unit_vectors('dv', 'dsrc', 'ord', 'text')},
qn AS (SELECT id, sqrt(sum(w * w)) AS n FROM qv GROUP BY 1),
dn AS (SELECT id, sqrt(sum(w * w)) AS n FROM dv GROUP BY 1),
dots AS (SELECT c.query_id, c.ord, coalesce(sum(q.w * d.w), 0.0) AS dot
         FROM cand c LEFT JOIN qv q ON q.id = c.query_id LEFT JOIN dv d ON d.id = c.ord AND d.b = q.b
         GROUP BY 1, 2),
cs AS (SELECT x.query_id, x.ord, round(x.dot / (coalesce(qn.n, 0) * coalesce(dn.n, 0) + 1e-9), 6) AS score
       FROM dots x LEFT JOIN qn ON qn.id = x.query_id LEFT JOIN dn ON dn.id = x.ord),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rank FROM cs WHERE score >= 0.3)
SELECT query_id, ord AS doc_id, rank, score FROM rk WHERE rank <= 5"""


# ---------------------------------------------------------------- IVF-PQ (approximate: rows-only checks)
from tessera.operators.ivfpq import ivfpq_build  # noqa: E402
from tessera.plans.retrieve import ivf_retrieve  # noqa: E402
from tessera.operators.audit import recall_at_k  # noqa: E402


def _ivf(spark, sf):
    emb = table(spark, sf, "embeddings")
    index = ivfpq_build(emb, key="vec_id", vec="embedding", profile="low-ram", seed=1)
    queries = emb.select(F.col("vec_id").alias("query_id"), "embedding")
    records = emb.select(F.col("vec_id").alias("key"), "label")
    return emb, queries, ivf_retrieve(index, queries, records, CFG, key="key")


def q_ivf_retrieve(spark, sf):
    """ANN-2/3/4: IVF-PQ index over all embeddings, every embedding as a query,
    shortlist k*8, exact re-rank, >= 0.3, top 5."""
    _, _, res = _ivf(spark, sf)
    return _long(res.select("query_id", F.col("key").alias("vec_id"), "rank", "score"), "rank")


def q_ivf_recall(spark, sf):
    """ANN-8: self-query hit rate in the top 5 and recall@5 against the exact search."""
    emb, queries, res = _ivf(spark, sf)
    exact = cosine_retrieve(queries, emb.withColumnRenamed("vec_id", "key"), CFG, key="key")
    hits = res.groupBy("query_id").agg(F.max((F.col("key") == F.col("query_id")).cast("int")).alias("hit"))
    rec = recall_at_k(res, exact, key="key")
    per_q = queries.select("query_id").join(hits, "query_id", "left").join(rec, "query_id", "left")
    return per_q.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("hit_rate"), F.count(F.lit(1)).alias("n_queries"),
                     F.avg("recall").alias("recall_at_5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "cosine_retrieve": q_cosine_retrieve,
    "normalize_text": q_normalize_text,
    "word_stats": q_word_stats,
    "split_sentences": q_split_sentences,
    "query_terms": q_query_terms,
    "benchmark_keywords": q_benchmark_keywords,
    "key_boosts": q_key_boosts,
    "exact_key_lookup": q_exact_key_lookup,
    "text_retrieve": q_text_retrieve,
    "rewrite": q_rewrite,
    "answer": q_answer,
    "guided_prompt": q_guided_prompt,
    "grounding_audit": q_grounding_audit,
    "dedup_fragments": q_dedup_fragments,
    "last_message": q_last_message,
    "chat_answer": q_chat_answer,
    "chunk_response": q_chunk_response,
    "record_store": q_record_store,
    "store_stats": q_store_stats,
    "minhash_signature": q_minhash_signature,
    "minhash_retrieve": q_minhash_retrieve,
    "ivf_retrieve": q_ivf_retrieve,
    "ivf_recall": q_ivf_recall,
}

ORACLE_SQL: dict[str, str] = {
    "cosine_retrieve": SQL_COSINE_RETRIEVE,
    "normalize_text": SQL_NORMALIZE_TEXT,
    "word_stats": SQL_WORD_STATS,
    "split_sentences": SQL_SPLIT_SENTENCES,
    "query_terms": SQL_QUERY_TERMS,
    "benchmark_keywords": SQL_BENCHMARK_KEYWORDS,
    "key_boosts": SQL_KEY_BOOSTS,
    "exact_key_lookup": SQL_EXACT_KEY_LOOKUP,
    "text_retrieve": SQL_TEXT_RETRIEVE,
    "rewrite": SQL_REWRITE,
    "answer": SQL_ANSWER,
    "guided_prompt": SQL_GUIDED_PROMPT,
    "grounding_audit": SQL_GROUNDING_AUDIT,
    "dedup_fragments": SQL_DEDUP_FRAGMENTS,
    "last_message": LAST_MESSAGE_SQL,
    "chat_answer": SQL_CHAT_ANSWER,
    "chunk_response": SQL_CHUNK_RESPONSE,
    "record_store": RECORD_STORE_SQL,
    "store_stats": SQL_STORE_STATS,
    "minhash_signature": SQL_MINHASH_SIGNATURE,
    "minhash_retrieve": SQL_MINHASH_RETRIEVE,
}
from tessera.plans import registry_records as RR, registry_stores as RS  # noqa: E402

for _more in (RR, RS):
    QUERIES.update(_more.QUERIES)
    ORACLE_SQL.update(_more.ORACLE_SQL)
FLAGSHIP = "answer"
