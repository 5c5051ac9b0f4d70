"""Registered queries over stores, key boosts, prompts and the corpus build, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import RetrievalConfig
from tessera.functions import constants as K
from tessera.functions.text import render_messages
from tessera.operators import match as M
from tessera.operators import synth as SY
from tessera.operators.chat import last_messages
from tessera.operators.dedup import dedup_corpus
from tessera.operators.encode import encode, fit_idf, tfidf_encoder
from tessera.operators.knn import knn_topk
from tessera.operators.rank import filter_by_threshold, topk_per_query
from tessera.operators.setjoin import jaccard_pairs
from tessera.plans import oracle_sql as S
from tessera.plans.answer import answer, audited_answer, retrieve_text
from tessera.plans.build import corpus_rows
from tessera.plans.inputs import PART_AS_CORPUS, definition_questions, document_records
from tessera.plans.retrieve import cosine_boost_retrieve, once_per_text
from tessera.sources.corpus import as_corpus, cache_embedding_text, record_key, with_ordinal
from tessera.session import ensure_checkpoint_dir
from tessera.sources.store import keyed_records_kv, write_bucketed
from tessera.sources.tables import table

CFG = RetrievalConfig()


def _part(spark: SparkSession, sf: str) -> DataFrame:
    return as_corpus(table(spark, sf, "part"), PART_AS_CORPUS, "p_partkey")


def q_kv_store(spark, sf):
    """SRC-4: ``part`` with the name as key and the type as value; the last record of a name wins."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), "p_name", "p_type")
    return keyed_records_kv(part, "p_name", "p_type").select("key", "value", "ord", "bucket")


SQL_KV_STORE = """SELECT p_name AS key, arg_max(p_type, p_partkey) AS value, max(p_partkey) AS ord,
       CAST(('0x' || substr(md5(p_name), 1, 8))::BIGINT % 1000 AS INTEGER) AS bucket
FROM part WHERE p_name IS NOT NULL AND p_name <> '' GROUP BY p_name"""


def q_ordinal_keymap(spark, sf):
    """SRC-7 / PRJ-2: the dense 0-based ordinal of every ``part`` record in read order, and its key."""
    scan = spark.read.parquet(f"{sf.rstrip('/')}/part.parquet").select("p_partkey", "p_name")
    return with_ordinal(scan).select("ord", "p_partkey", F.col("p_name").alias("key"))


SQL_ORDINAL_KEYMAP = "SELECT row_number() OVER () - 1 AS ord, p_partkey, p_name AS key FROM part"


def q_cache_text(spark, sf):
    """PRJ-3 and PRJ-2 with the ``rec_`` fill: what the embedding cache stores of every document."""
    docs = as_corpus(table(spark, sf, "documents"), {"text": "text"}, "doc_id")
    return docs.select(F.col("ord").alias("doc_id"), record_key(fill_missing=True).alias("key"), cache_embedding_text().alias("text"))


SQL_CACHE_TEXT = "SELECT doc_id, 'rec_' || doc_id AS key, '. ' || coalesce(text, '') AS text FROM documents"


def q_built_corpus(spark, sf):
    """PIP-5: the rows that ``build_corpus`` stores of ``part``."""
    return corpus_rows(_part(spark, sf), CFG).select("key", "norm_key", F.col("text_out").alias("text"), "bucket", "ord")


SQL_BUILT_CORPUS = f"""SELECT key, {S.norm('key')} AS norm_key, text, ord,
       CAST(('0x' || substr(md5(key), 1, 8))::BIGINT % {CFG.num_buckets} AS INTEGER) AS bucket
FROM (SELECT p_name AS key, arg_max(p_name || ': ' || p_type, p_partkey) AS text, max(p_partkey) AS ord
      FROM part WHERE p_name IS NOT NULL AND p_name <> '' GROUP BY p_name)"""


def _key_vectors(spark, sf):
    """Vectors of the names of ``part``, and the definition questions."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("key"))
    return encode(part, "key", "embedding"), definition_questions(table(spark, sf, "part"))


def q_tier1_retrieve(spark, sf):
    """ANN-5 Tier 1 / MTH-4 / WIN-5 / SRT-3 / PRJ-8: every definition question against the names of
    ``part``, the named key boosted, shortlist of 15, at least 0.3, top 5."""
    vectors, questions = _key_vectors(spark, sf)
    res = once_per_text(questions, lambda q: cosine_boost_retrieve(
        encode(q, "query", "embedding"), vectors, vectors.select("ord", "key"), CFG))
    return res.select("query_id", F.col("ord").alias("p_partkey"), F.col("rank").cast("bigint").alias("rank"), "raw_score", "score")


_KEY_SCORES = f"""qsrc AS ({S.definition_questions()}),
dsrc AS (SELECT p_partkey AS ord, p_name AS text FROM part),
{S.unit_vectors('qv', 'qsrc', 'query_id', 'query')},
{S.unit_vectors('dv', 'dsrc', 'ord', 'text')},
dots AS (SELECT q.id AS query_id, d.id AS ord, round(sum(q.w * d.w), 6) AS raw FROM qv q JOIN dv d ON q.b = d.b GROUP BY 1, 2),
nt AS (SELECT query_id, {S.norm('term')} AS norm_term FROM (SELECT query_id, {S.term('query')} AS term FROM qsrc) WHERE term <> ''),
nk AS (SELECT p_partkey AS ord, {S.norm('p_name')} AS norm_key FROM part)"""

SQL_TIER1_RETRIEVE = f"""WITH {_KEY_SCORES},
kk AS (SELECT norm_key, max(ord) AS last_ord, min(ord) AS first_ord FROM nk GROUP BY 1),
ex AS (SELECT query_id, last_ord AS ord, 0.40::DOUBLE AS boost FROM nt JOIN kk ON norm_term = norm_key),
fz AS (SELECT query_id, arg_min(last_ord, first_ord) AS ord, 0.28::DOUBLE AS boost FROM nt JOIN kk ON levenshtein(norm_term, norm_key) <= 1
       WHERE length(norm_term) >= 5 AND query_id NOT IN (SELECT query_id FROM ex) GROUP BY 1),
bo AS (SELECT * FROM ex UNION ALL SELECT * FROM fz),
al AS (SELECT coalesce(d.query_id, b.query_id) AS query_id, coalesce(d.ord, b.ord) AS ord, coalesce(raw, 0.0) AS raw_score,
              least(1.0, coalesce(raw, 0.0) + coalesce(boost, 0.0)) AS boosted, boost
       FROM dots d FULL JOIN bo b ON d.query_id = b.query_id AND d.ord = b.ord),
rk AS (SELECT query_id, ord, raw_score, CASE WHEN boost IS NULL THEN raw_score ELSE boosted END AS score FROM al)
SELECT query_id, ord AS p_partkey, rank, raw_score, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rank FROM rk WHERE score >= 0.3) WHERE rank <= 5"""


def q_shortlist_boost(spark, sf):
    """Tier-0 boost (JOIN-4/5 ``fuzzy="all"``, MTH-4, PRJ-8) on the exact top 40 names of ``part`` per
    definition question: every exact key and every key within one edit, at least 0.3, top 5."""
    vectors, questions = _key_vectors(spark, sf)

    def boosted(q: DataFrame) -> DataFrame:
        short = knn_topk(encode(q, "query", "embedding"), vectors, k=CFG.top_k * CFG.ivf_overfetch, key="ord",
                         decimals=CFG.score_decimals).drop("rank")
        terms = M.with_query_terms(q.select("query_id", "query")).select("query_id", "norm_term")
        named = short.join(terms.hint("merge"), "query_id").join(vectors.select("ord", "key").hint("merge"), "ord")
        return topk_per_query(filter_by_threshold(M.boost_shortlist(named, CFG), CFG.threshold), CFG.top_k, tie="ord")
    return once_per_text(questions, boosted).select(
        "query_id", F.col("ord").alias("p_partkey"), F.col("rank").cast("bigint").alias("rank"), "raw_score", "boost", "score")


SQL_SHORTLIST_BOOST = f"""WITH {_KEY_SCORES},
al AS (SELECT q.query_id, d.ord, coalesce(raw, 0.0) AS raw_score
       FROM qsrc q CROSS JOIN dsrc d LEFT JOIN dots s ON s.query_id = q.query_id AND s.ord = d.ord),
sh AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, ord) <= 40),
bo AS (SELECT sh.*, CASE WHEN norm_term IS NULL THEN 0.0 WHEN norm_key = norm_term THEN 0.40
                         WHEN length(norm_term) >= 5 AND levenshtein(norm_term, norm_key) <= 1 THEN 0.28 ELSE 0.0 END::DOUBLE AS boost
       FROM sh LEFT JOIN nt USING (query_id) JOIN nk USING (ord)),
sc AS (SELECT *, CASE WHEN boost > 0 THEN least(1.0, raw_score + boost) ELSE raw_score END AS score FROM bo)
SELECT query_id, ord AS p_partkey, rank, raw_score, boost, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rank FROM sc WHERE score >= 0.3) WHERE rank <= 5"""


def q_rendered_chat(spark, sf):
    """STR-11: every conversation as one prompt text, in turn order."""
    msgs = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))),
                       lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(msgs.alias("m")).select("conv_id", render_messages("m").alias("prompt"))


SQL_RENDERED_CHAT = """SELECT conv_id, string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn) || chr(10) || 'ASSISTANT:' AS prompt
FROM conversations GROUP BY conv_id"""


def _chat(spark, sf):
    last = last_messages(table(spark, sf, "conversations")).where(F.col("user_text").isNotNull())
    q = last.select(F.col("conv_id").alias("query_id"), F.col("user_text").alias("query"), F.col("system_text").alias("system_prompt"))
    return q, retrieve_text(q, document_records(table(spark, sf, "documents")), CFG)


_CHAT = f"""last AS (SELECT conv_id AS query_id,
  max_by(st, turn) FILTER (WHERE role = 'user' AND st <> '') AS query,
  max_by(st, turn) FILTER (WHERE role = 'system' AND st <> '') AS system_prompt
  FROM (SELECT conv_id, turn, role, {S.strip('text')} AS st FROM conversations) GROUP BY conv_id),
{S.text_fragments("SELECT query_id, query FROM last WHERE query IS NOT NULL")},
ctx AS (SELECT query_id, max(score) AS best, string_agg('[' || rank || '] ' || text, chr(10) ORDER BY rank) AS context FROM frag GROUP BY 1),
md AS (SELECT q.query_id, q.query, system_prompt, context, CASE WHEN best IS NULL OR best < 0.4 THEN 'free' ELSE 'guided' END AS mode
       FROM qsrc q JOIN last USING (query_id) LEFT JOIN ctx USING (query_id))"""


def q_chat_prompt(spark, sf):
    """SYN-6/7/8: the messages a generator gets for every conversation, with its own system prompt in free mode."""
    r = SY.route_and_prompt(*_chat(spark, sf), has_generator=True, cfg=CFG)
    m = F.col("messages")
    return r.select(F.col("query_id").alias("conv_id"), "mode", m[0]["content"].alias("system_content"), m[1]["content"].alias("user_content"))


SQL_CHAT_PROMPT = f"""WITH {_CHAT}
SELECT query_id AS conv_id, mode,
  CASE WHEN mode = 'guided' THEN {S.lit(K.GUIDED_SYSTEM_PROMPT)} ELSE coalesce(system_prompt, {S.lit(K.FREE_SYSTEM_PROMPT)}) END AS system_content,
  CASE WHEN mode = 'guided' THEN 'CONTEXTO:' || chr(10) || context || chr(10) || chr(10) || 'PREGUNTA: ' || query ELSE query END AS user_content
FROM md"""


def q_generated_answer(spark, sf):
    """SYN-9 / SYN-10: the answer of a generator that returns its last message's first line, for every conversation."""
    q, frags = _chat(spark, sf)
    return answer(q, frags, CFG, make_generator=SY.stub_generator).withColumnRenamed("query_id", "conv_id")


SQL_GENERATED_ANSWER = f"""WITH {_CHAT},
ln AS (SELECT query_id, mode, CASE WHEN mode = 'guided' THEN 'CONTEXTO:' ELSE string_split(query, chr(10))[1] END AS line FROM md)
SELECT query_id AS conv_id, mode, CASE WHEN line = '' THEN {S.lit(K.NOT_ENOUGH)} ELSE line END AS response FROM ln"""


def q_audited_answer(spark, sf):
    """PIP-2 with SET-3 under ``restricted_vocabulary``: every benchmark answer and whether its words are its fragments'."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return audited_answer(q, retrieve_text(q, document_records(table(spark, sf, "documents")), CFG), CFG)


def _audit_sql() -> str:
    from tessera.operators.audit import connector_words
    words = ", ".join(S.lit(w) for w in connector_words())
    return f"""WITH {S.text_fragments("SELECT item_id AS query_id, text AS query FROM benchmark")},
{S.rewrite()},
{S.answer()},
aw AS (SELECT query_id, unnest({S.word_set('response')}) AS word FROM ans),
fw AS (SELECT DISTINCT query_id, unnest({S.word_set('text')}) AS word FROM frag),
bad AS (SELECT query_id, list_sort(list(DISTINCT word)) AS offending FROM aw
        WHERE NOT list_contains([{words}], word) AND NOT EXISTS (SELECT 1 FROM fw WHERE fw.query_id = aw.query_id AND fw.word = aw.word) GROUP BY 1)
SELECT ans.query_id, mode, response,
       CASE WHEN mode = 'statistical' AND response <> {S.lit(K.NOT_ENOUGH)} THEN bad.query_id IS NULL END AS grounded,
       CASE WHEN mode = 'statistical' AND response <> {S.lit(K.NOT_ENOUGH)} THEN coalesce(bad.offending, []::VARCHAR[]) END AS offending
FROM ans LEFT JOIN bad USING (query_id)"""


def q_dedup_corpus(spark, sf):
    """DUP-2: the documents that the greedy rule (Jaccard >= 0.7, by id) keeps of the whole table."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return dedup_corpus(docs, CFG.dedup_threshold, order="doc_id").select("doc_id")


SQL_DEDUP_CORPUS = f"""WITH s AS (SELECT doc_id, list_distinct({S.ws_tokens('text')}) AS ws FROM documents),
tk AS MATERIALIZED (SELECT doc_id, length(ws) AS n, unnest(ws) AS w FROM s),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb
       FROM tk a JOIN tk b ON a.w = b.w AND a.doc_id < b.doc_id AND a.n >= 0.7 * b.n - 1e-9 AND b.n >= 0.7 * a.n - 1e-9 GROUP BY 1, 2),
ed AS (SELECT b, list(a) AS before FROM pr WHERE shared::DOUBLE / (na + nb - shared) >= 0.7 GROUP BY 1),
it AS (SELECT list({{'id': doc_id, 'before': coalesce(before, []::BIGINT[])}} ORDER BY doc_id) AS l FROM s LEFT JOIN ed ON b = doc_id),
kp AS (SELECT list_reduce(list_transform(l, lambda x: [x]), lambda kept, xs:
                CASE WHEN length(list_intersect(xs[1].before, list_transform(kept, lambda k: k.id))) > 0 THEN kept
                     ELSE list_concat(kept, xs) END) AS kept FROM it)
SELECT k.id AS doc_id FROM (SELECT unnest(kept) AS k FROM kp)"""


def q_jaccard_pairs(spark, sf):
    """JOIN-9: every pair of a benchmark text and a document with word Jaccard >= 0.2."""
    items, docs = table(spark, sf, "benchmark").select("item_id", "text"), table(spark, sf, "documents").select("doc_id", "text")
    return jaccard_pairs(items, docs, 0.2, left_id="item_id", right_id="doc_id")


SQL_JACCARD_PAIRS = f"""WITH b AS (SELECT item_id, list_distinct({S.ws_tokens('text')}) AS wb FROM benchmark),
d AS (SELECT doc_id, list_distinct({S.ws_tokens('text')}) AS wd FROM documents),
p AS (SELECT item_id, doc_id, length(list_intersect(wb, wd)) AS i, length(wb) AS nb, length(wd) AS nd FROM b, d)
SELECT item_id, doc_id, i::DOUBLE / (nb + nd - i) AS jaccard FROM p WHERE i > 0 AND i::DOUBLE / (nb + nd - i) >= 0.2"""


def q_bucketed_fetch(spark, sf):
    """SRC-3 / JOIN-2: records and their labels as stored tables bucketed by key; the fetch join moves no row."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bucketed-{uuid.uuid4().hex}"
    docs, labels = (table(spark, sf, name).withColumnRenamed("doc_id", "key") for name in ("documents", "labels"))
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    records = write_bucketed(docs.select("key", "text", "source"), root, f"records_{uuid.uuid4().hex}", buckets)
    wanted = write_bucketed(labels.select("key", "quality", "toxic"), root, f"labels_{uuid.uuid4().hex}", buckets)
    got = wanted.hint("merge").join(records, "key")
    return got.select(F.col("key").alias("doc_id"), "quality", "toxic", "source", F.length("text").cast("bigint").alias("n_chars"),
                      F.md5("text").alias("text_md5"))


SQL_BUCKETED_FETCH = """SELECT doc_id, quality, toxic, source, length(text)::BIGINT AS n_chars, md5(text) AS text_md5
FROM labels JOIN documents USING (doc_id)"""


def q_tfidf_retrieve(spark, sf):
    """ANN-1 / PIP-1 with a fitted IDF: every benchmark text against all documents, top 5 >= 0.3."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    recs = document_records(table(spark, sf, "documents"))
    frags = retrieve_text(q, recs, CFG, encoder=tfidf_encoder(fit_idf(recs, "text_out")))
    return frags.select("query_id", F.col("rank").cast("bigint").alias("rank"), "source_id", "score")


SQL_TFIDF_RETRIEVE = f"""WITH qsrc AS (SELECT item_id AS query_id, text AS query FROM benchmark),
dsrc AS (SELECT doc_id AS ord, CASE WHEN text IS NOT NULL AND text <> '' THEN text
           ELSE CAST(to_json({{'id': CAST(doc_id AS VARCHAR)}}) AS VARCHAR) END AS text FROM documents),
has AS (SELECT DISTINCT ord, {S.bucket('t', 256)} AS b FROM (SELECT ord, unnest({S.words('text')}) AS t FROM dsrc)),
idf AS (SELECT b, round(ln((1.0 + (SELECT count(*) FROM dsrc))::DOUBLE / (count(ord) + 1.0)::DOUBLE) + 1.0, 6) AS idf
        FROM (SELECT unnest(range(256)) AS b) LEFT JOIN has USING (b) GROUP BY b),
{S.weighted_vectors('qv', 'qsrc', 'query_id', 'query', 'idf')},
{S.weighted_vectors('dv', 'dsrc', 'ord', 'text', 'idf')},
sc AS (SELECT q.id AS query_id, d.id AS ord, round(sum(q.w * d.w), 6) AS score FROM qv q JOIN dv d ON q.b = d.b GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rank FROM sc WHERE score >= 0.3)
SELECT query_id, rank, CAST(ord AS VARCHAR) AS source_id, score FROM rk WHERE rank <= 5"""


QUERIES = {
    "dedup_corpus": q_dedup_corpus, "jaccard_pairs": q_jaccard_pairs, "bucketed_fetch": q_bucketed_fetch,
    "tfidf_retrieve": q_tfidf_retrieve,
    "kv_store": q_kv_store, "ordinal_keymap": q_ordinal_keymap, "cache_text": q_cache_text, "built_corpus": q_built_corpus,
    "tier1_retrieve": q_tier1_retrieve, "shortlist_boost": q_shortlist_boost, "rendered_chat": q_rendered_chat,
    "chat_prompt": q_chat_prompt, "generated_answer": q_generated_answer, "audited_answer": q_audited_answer,
}
ORACLE_SQL = {
    "dedup_corpus": SQL_DEDUP_CORPUS, "jaccard_pairs": SQL_JACCARD_PAIRS, "bucketed_fetch": SQL_BUCKETED_FETCH,
    "tfidf_retrieve": SQL_TFIDF_RETRIEVE,
    "kv_store": SQL_KV_STORE, "ordinal_keymap": SQL_ORDINAL_KEYMAP, "cache_text": SQL_CACHE_TEXT, "built_corpus": SQL_BUILT_CORPUS,
    "tier1_retrieve": SQL_TIER1_RETRIEVE, "shortlist_boost": SQL_SHORTLIST_BOOST, "rendered_chat": SQL_RENDERED_CHAT,
    "chat_prompt": SQL_CHAT_PROMPT, "generated_answer": SQL_GENERATED_ANSWER, "audited_answer": _audit_sql(),
}
