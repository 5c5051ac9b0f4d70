"""SET-3 grounding audit (JOIN-10 form) and ANN-8 recall evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions.text import word_set


def connector_words() -> list[str]:
    """Lower-case word tokens of the connector list (the only words a
    statistical answer may add)."""
    import re
    out: list[str] = []
    for c in K.CONNECTORS:
        out.extend(re.findall(r"\w+", c.lower()))
    return sorted(set(out))


def grounding_audit(answers: DataFrame, fragments: DataFrame, *, response: str = "response",
                    text: str = "text") -> DataFrame:
    """SET-3: ``words(answer) ⊆ words(fragments of the query) ∪ words(connectors)``,
    case-insensitive. Table form: answer words anti-joined with fragment words on
    ``(query_id, word)`` — no per-query arrays of whole documents are built.
    Returns ``(query_id, grounded, offending array<string>)``."""
    conn = F.array(*[F.lit(w) for w in connector_words()])
    aw = (answers.select("query_id", F.explode(word_set(F.col(response))).alias("word"))
          .filter(~F.array_contains(conn, F.col("word"))))
    fw = fragments.select("query_id", F.explode(word_set(F.col(text))).alias("word")).distinct()
    bad = aw.join(fw, ["query_id", "word"], "left_anti")
    per_q = bad.groupBy("query_id").agg(F.array_sort(F.collect_set("word")).alias("offending"))
    return (answers.select("query_id").join(per_q, "query_id", "left")
            .select("query_id",
                    F.coalesce(F.col("offending"), F.array().cast("array<string>")).alias("offending"))
            .withColumn("grounded", F.size("offending") == 0))


def recall_at_k(approx: DataFrame, exact: DataFrame, *, query_id: str = "query_id", key: str = "key") -> DataFrame:
    """ANN-8 (recall form): per query, the share of the exact top-k keys the
    approximate top-k found; plus the overall mean as ``recall``."""
    e = exact.select(query_id, key).withColumn("__e", F.lit(1))
    a = approx.select(query_id, key).withColumn("__a", F.lit(1))
    j = e.join(a, [query_id, key], "left")
    per_q = j.groupBy(query_id).agg((F.sum(F.coalesce("__a", F.lit(0))) / F.count(F.lit(1))).alias("recall"))
    return per_q


def self_hit_rate(results: DataFrame, *, query_id: str = "query_id", target: str = "target",
                  key: str = "key") -> DataFrame:
    """ANN-8 (hit-rate form): share of queries whose own record is among their
    results. ``results`` holds one row per (query, returned key) with the
    query's ``target`` key; a query with no results counts as a miss only if it
    appears (left-join the query table first)."""
    hit = results.groupBy(query_id).agg(F.max((F.col(key) == F.col(target)).cast("int")).alias("hit"))
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("hit_rate"), F.count(F.lit(1)).alias("n_queries"))
