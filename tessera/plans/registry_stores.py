"""Registered queries over stored corpora, streams and hooks, with their SQL.

Each writes what it needs of the given tables into a folder of its own under the shared
checkpoint folder, reads it back through the library's sources, and returns whole results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import RetrievalConfig
from tessera.functions.vector import dot_product
from tessera.operators.encode import encode_with
from tessera.operators.rank import fetch_records, rank_fragments, single_query_topk
from tessera.plans import oracle_sql as S
from tessera.plans.answer import retrieve_text
from tessera.plans.build import build_corpus
from tessera.plans.inputs import PART_AS_CORPUS, definition_questions, document_records
from tessera.plans.retrieve import cosine_retrieve, tiered_retrieve
from tessera.session import ensure_checkpoint_dir
from tessera.sources.corpus import as_corpus, columnar_corpus_scan, fragment_preview, json_corpus_scan
from tessera.sources.store import StoreCatalog
from tessera.sources.tables import table
from tessera.streaming.stream import (TURN_SCHEMA, compact_store, current_messages, latest_records, stream_answer, stream_corpus_upsert,
                                      stream_last_messages)

CFG = RetrievalConfig()
BENCH_QUERIES_SQL = "SELECT item_id AS query_id, text AS query FROM benchmark"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _bench(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return q, document_records(table(spark, sf, "documents"))


def q_columnar_scan(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-2: ``part`` read as a columnar corpus of two fields, numbered in read order."""
    scan = columnar_corpus_scan(spark, f"{sf.rstrip('/')}/part.parquet", fields=("p_name", "p_type"))
    return scan.select("ord", F.col("p_name").alias("lemma"), F.col("p_type").alias("definition"))


SQL_COLUMNAR_SCAN = "SELECT row_number() OVER () - 1 AS ord, p_name AS lemma, p_type AS definition FROM part"


def _write_arrays(records: DataFrame, path: str) -> None:
    """Write the rows of ``records`` (raw: a JSON object as text) as JSON array files, one a partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = False
        for b in batches:
            if b.num_rows:
                lines = b.column(0).to_pylist()
                lines[0] = ("," if some else "[") + lines[0]
                yield pa.RecordBatch.from_arrays([pa.array([lines[0], *("," + x for x in lines[1:])], pa.string())], names=["value"])
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(["]"], pa.string())], names=["value"])
    records.select("raw").mapInArrow(run, "value string").write.text(path)


def q_json_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-1: ``documents`` written as JSON array files by ranges of the id, read back by byte ranges:
    ordinals over all files, known fields, and a field the schema does not know kept in ``extra``."""
    path = _folder(spark, "arrays")
    docs = table(spark, sf, "documents").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    known = F.struct(F.col("doc_id").cast("string").alias("id"), "text", "n_chars")
    _write_arrays(docs.select(F.to_json(known).alias("raw")), path)
    return json_corpus_scan(spark, path).select("ord", "id", "text", F.col("extra")["n_chars"].alias("n_chars"))


SQL_JSON_CORPUS = """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, CAST(doc_id AS VARCHAR) AS id, text, CAST(n_chars AS VARCHAR) AS n_chars
FROM documents"""


def q_fragment_preview(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-7 / SRT-1: the fragments of all benchmark texts, best first, each as its preview."""
    q, records = _bench(spark, sf)
    ranked = rank_fragments(retrieve_text(q, records, CFG))
    return ranked.select("query_id", "source_id", "score", fragment_preview().alias("preview"))


SQL_FRAGMENT_PREVIEW = f"""WITH {S.text_fragments(BENCH_QUERIES_SQL)}
SELECT query_id, source_id, score,
       'Fragment(score=' || CAST(CAST(CAST(score AS DECIMAL(18, 6)) AS DECIMAL(18, 3)) AS VARCHAR) || ', text=' || substr(text, 1, 60) || ')' AS preview
FROM frag"""


def q_labelled_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-2: of every vector's five nearest those whose key a label record has; unresolved keys drop."""
    emb = table(spark, sf, "embeddings")
    found = cosine_retrieve(emb.select(F.col("vec_id").alias("query_id"), "embedding"), emb, CFG, key="vec_id")
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"), "quality", "toxic")
    return fetch_records(found, labels, key="vec_id").select("query_id", "vec_id", "score", "quality", "toxic")


SQL_LABELLED_NEIGHBOURS = """WITH s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q, embeddings c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= 0.3)
SELECT query_id, vec_id, score, quality, toxic FROM r JOIN labels ON doc_id = vec_id WHERE rank <= 5"""


def q_single_query(spark: SparkSession, sf: str) -> DataFrame:
    """SRT-2: one query, the vector of the smallest id, against every vector: at least 0.3, first 5."""
    emb = table(spark, sf, "embeddings")
    first = emb.agg(F.min_by("embedding", "vec_id")).first()[0] or []
    query = F.array(*[F.lit(float(x)) for x in first]).cast("array<double>")
    scored = emb.select("vec_id", F.round(dot_product(F.col("embedding"), query), CFG.score_decimals).alias("score"))
    return single_query_topk(scored, CFG.top_k, CFG.threshold, tie="vec_id")


SQL_SINGLE_QUERY = """SELECT c.vec_id, round(list_inner_product(q.e::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
FROM embeddings c, (SELECT arg_min(embedding, vec_id) AS e FROM embeddings) q
WHERE round(list_inner_product(q.e::DOUBLE[], c.embedding::DOUBLE[]), 6) >= 0.3 ORDER BY score DESC, vec_id LIMIT 5"""


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_encoder():
    """An encoder for the hook: how often each of a-z is in a text."""
    def run(texts: list[str]) -> np.ndarray:
        return np.array([[t.count(c) for c in LETTERS] for t in texts], np.float64).reshape(len(texts), len(LETTERS))
    return run


def q_custom_encoder(spark: SparkSession, sf: str) -> DataFrame:
    """UDF hooks (encoder, retrieval tool): every benchmark text against all documents by the vectors
    of a user's encoder, the retrieval given as a step of ``DataFrame.transform``."""
    q, records = _bench(spark, sf)
    frags = q.transform(lambda d: retrieve_text(d, records, CFG, encoder=lambda df, text, out: encode_with(df, letter_encoder, text, out)))
    return frags.select("query_id", F.col("rank").cast("bigint").alias("rank"), "source_id", "score")


def _letter_vectors(name: str, src: str, id_col: str, text_col: str) -> str:
    """CTE ``{name}`` (id, v): unit vectors of the letter counts, float32 values."""
    counts = ", ".join(f"length({text_col}) - length(replace({text_col}, '{c}', ''))" for c in LETTERS)
    return f"""{name}_cnt AS (SELECT {id_col} AS id, [{counts}]::DOUBLE[] AS c FROM {src}),
{name} AS (SELECT id, list_transform(c, lambda x: (x / n)::FLOAT::DOUBLE) AS v FROM (
  SELECT id, c, sqrt(list_inner_product(c, c)) AS n FROM {name}_cnt) WHERE n > 0)"""


SQL_CUSTOM_ENCODER = f"""WITH qsrc AS ({BENCH_QUERIES_SQL}),
dsrc AS (SELECT doc_id AS ord, CASE WHEN text IS NOT NULL AND text <> '' THEN text
           ELSE CAST(to_json({{'id': CAST(doc_id AS VARCHAR)}}) AS VARCHAR) END AS text FROM documents),
{_letter_vectors('qv', 'qsrc', 'query_id', 'query')},
{_letter_vectors('dv', 'dsrc', 'ord', 'text')},
sc AS (SELECT q.id AS query_id, d.id AS ord, round(list_inner_product(q.v, d.v), 6) AS score FROM qv q, dv d),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rank FROM sc WHERE score >= 0.3)
SELECT query_id, rank, CAST(ord AS VARCHAR) AS source_id, score FROM rk WHERE rank <= 5"""


def q_stored_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    """PIP-5, SRC-5, SRC-8, ANN-7: ``part`` built into a versioned store, the store opened and searched by
    every definition question in the tier that its tables allow (vectors: cosine with key boost)."""
    part, root = table(spark, sf, "part"), _folder(spark, "store")
    build_corpus(as_corpus(part, PART_AS_CORPUS, "p_partkey"), root, CFG)
    found = tiered_retrieve(StoreCatalog.open(spark, root), spark, definition_questions(part), CFG)
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "source_id", "text", "score", "key", "tier")


SQL_STORED_RETRIEVE = f"""WITH qsrc AS ({S.definition_questions()}),
dsrc AS (SELECT max(p_partkey) AS ord, p_name AS key, arg_max(concat_ws(': ', p_name, nullif(p_type, '')), p_partkey) AS text
         FROM part WHERE p_name IS NOT NULL AND p_name <> '' GROUP BY p_name),
{S.unit_vectors('qv', 'qsrc', 'query_id', 'query')},
{S.unit_vectors('dv', 'dsrc', 'ord', 'text')},
dots AS (SELECT q.id AS query_id, d.id AS ord, round(sum(q.w * d.w), 6) AS raw FROM qv q JOIN dv d ON q.b = d.b GROUP BY 1, 2),
nt AS (SELECT query_id, {S.norm('term')} AS norm_term FROM (SELECT query_id, {S.term('query')} AS term FROM qsrc) WHERE term <> ''),
kk AS (SELECT norm_key, max(ord) AS last_ord, min(ord) AS first_ord FROM (SELECT ord, {S.norm('key')} AS norm_key FROM dsrc) GROUP BY 1),
ex AS (SELECT query_id, last_ord AS ord, 0.40::DOUBLE AS boost FROM nt JOIN kk ON norm_term = norm_key),
fz AS (SELECT query_id, arg_min(last_ord, first_ord) AS ord, 0.28::DOUBLE AS boost FROM nt JOIN kk ON levenshtein(norm_term, norm_key) <= 1
       WHERE length(norm_term) >= 5 AND query_id NOT IN (SELECT query_id FROM ex) GROUP BY 1),
bo AS (SELECT * FROM ex UNION ALL SELECT * FROM fz),
al AS (SELECT coalesce(d.query_id, b.query_id) AS query_id, coalesce(d.ord, b.ord) AS ord, coalesce(raw, 0.0) AS raw, boost
       FROM dots d FULL JOIN bo b ON d.query_id = b.query_id AND d.ord = b.ord),
rk AS (SELECT query_id, ord, CASE WHEN boost IS NULL THEN raw ELSE least(1.0, raw + boost) END AS score FROM al)
SELECT query_id, rank, CAST(ord AS VARCHAR) AS source_id, text, score, key, 'cosine' AS tier FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rank FROM rk WHERE score >= 0.3) JOIN dsrc USING (ord) WHERE rank <= 5"""


def q_stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """STM-2: the names of ``part`` as keys come in two batches (even part keys, then odd ones); the first
    is compacted, then the store is read as its generation and the batch after it."""
    root = _folder(spark, "upserts")
    part = table(spark, sf, "part").where("p_name <> ''").select(F.col("p_name").alias("key"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("text"))
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("ord", T.LongType()), T.StructField("text", T.StringType())])
    for odd in (0, 1):
        part.where(F.pmod("ord", F.lit(2)) == odd).write.mode("append").parquet(f"{root}/source")
        stream = stream_corpus_upsert(spark, f"{root}/source", f"{root}/store", schema, checkpoint=f"{root}/checkpoint")
        try:
            stream.processAllAvailable()
        finally:
            stream.stop()
        if not odd:
            compact_store(spark, f"{root}/store")
    return latest_records(spark, f"{root}/store/records").select("key", "ord", "text")


SQL_STREAM_UPSERT = """SELECT p_name AS key, p_partkey AS ord, p_type AS text FROM part WHERE p_name <> ''
QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey % 2 DESC, p_partkey DESC) = 1"""


def q_stream_answer(spark: SparkSession, sf: str) -> DataFrame:
    """STM-1: every benchmark text comes as a stream of files, one a batch, and is answered against all documents."""
    root = _folder(spark, "answers")
    q, records = _bench(spark, sf)
    q.repartition(2, "query_id").write.parquet(f"{root}/source")
    stream = stream_answer(spark, f"{root}/source", records, f"{root}/sink", cfg=CFG, checkpoint=f"{root}/checkpoint", max_files_per_trigger=1)
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    return spark.read.parquet(f"{root}/sink").select("query_id", "mode", "response")


SQL_STREAM_ANSWER = f"""WITH {S.text_fragments(BENCH_QUERIES_SQL)},
{S.rewrite()},
{S.answer()}
SELECT query_id, mode, response FROM ans"""


def q_stream_last_message(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-4 on a stream: the turns of all conversations, dealt over two batches by turn, through keyed state."""
    root = _folder(spark, "turns")
    turns = table(spark, sf, "conversations").select(*[F.col(f.name).cast(f.dataType) for f in TURN_SCHEMA])
    for odd in (1, 0):                                     # later turns may come first
        turns.where(F.pmod(F.coalesce("turn", F.lit(0)), F.lit(2)) == odd).write.mode("append").parquet(f"{root}/source")
        stream = stream_last_messages(spark, f"{root}/source", f"{root}/sink", checkpoint=f"{root}/checkpoint")
        try:
            stream.processAllAvailable()
        finally:
            stream.stop()
    return current_messages(spark, f"{root}/sink")


SQL_STREAM_LAST_MESSAGE = f"""SELECT conv_id,
  max_by(st, turn) FILTER (WHERE role = 'user' AND st <> '') AS user_text,
  max_by(st, turn) FILTER (WHERE role = 'system' AND st <> '') AS system_text
FROM (SELECT conv_id, turn, role, {S.strip('text')} AS st FROM conversations) GROUP BY conv_id"""


QUERIES = {
    "json_corpus": q_json_corpus, "columnar_scan": q_columnar_scan, "fragment_preview": q_fragment_preview, "labelled_neighbours": q_labelled_neighbours,
    "single_query": q_single_query, "custom_encoder": q_custom_encoder, "stored_retrieve": q_stored_retrieve,
    "stream_upsert": q_stream_upsert, "stream_answer": q_stream_answer, "stream_last_message": q_stream_last_message,
}
ORACLE_SQL = {
    "json_corpus": SQL_JSON_CORPUS, "columnar_scan": SQL_COLUMNAR_SCAN, "fragment_preview": SQL_FRAGMENT_PREVIEW, "labelled_neighbours": SQL_LABELLED_NEIGHBOURS,
    "single_query": SQL_SINGLE_QUERY, "custom_encoder": SQL_CUSTOM_ENCODER, "stored_retrieve": SQL_STORED_RETRIEVE,
    "stream_upsert": SQL_STREAM_UPSERT, "stream_answer": SQL_STREAM_ANSWER, "stream_last_message": SQL_STREAM_LAST_MESSAGE,
}
