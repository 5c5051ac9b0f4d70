"""Stand-in inputs built from the driver tables.

These only shape rows into the schemas the operators expect (queries, corpus
records); they do none of the operators' work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.corpus import as_corpus, record_key, record_to_text, source_id

PART_AS_CORPUS = {"id": "p_partkey", "lemma": "p_name", "definition": "p_type"}
DOCS_AS_CORPUS = {"id": "doc_id", "text": "text"}


def part_records(part: DataFrame) -> DataFrame:
    """``part`` as a keyed corpus: ``p_name`` -> lemma, ``p_type`` -> definition."""
    c = as_corpus(part, PART_AS_CORPUS, "p_partkey")
    return c.withColumn("key", record_key()).withColumn("text_out", record_to_text())


def document_records(documents: DataFrame) -> DataFrame:
    """``documents`` as a corpus: ``doc_id`` -> id, ``text`` -> text."""
    c = as_corpus(documents, DOCS_AS_CORPUS, "doc_id")
    return c.withColumn("source_id", source_id()).withColumn("text_out", record_to_text())


def definition_questions(part: DataFrame) -> DataFrame:
    """Three questions per ``part`` row: a definition phrase + the name, a
    one-character edit of the name after a phrase, and the bare name."""
    name = F.col("p_name")
    half = F.floor(F.length(name) / 2)
    edited = F.concat(F.substr(name, F.lit(1), half), F.lit("x"), F.substr(name, half + 2))
    tmpl = F.array(*[F.lit(t) for t in ("qué es el ", "¿Qué significa ", "define ", "significado de ", "Que son las ")])
    q0 = F.concat(F.element_at(tmpl, (F.pmod(F.col("p_partkey"), F.lit(5)) + 1).cast("int")), name, F.lit("?"))
    q1 = F.concat(F.lit("qué es "), edited)
    return (part.select("p_partkey", F.posexplode(F.array(q0, q1, name)).alias("i", "query"))
            .select((F.col("p_partkey") * 3 + F.col("i")).alias("query_id"), "query"))
