"""ANN-5 Tier 1: cosine with the exact / first-fuzzy key boost, on worked scores."""
from pyspark.sql import functions as F

from tessera.config import RetrievalConfig
from tessera.plans.retrieve import cosine_boost_retrieve

KEYS = ["faro", "brújula", "ancla", "vela"]
#: Unit vectors: the score of record i for query (1, 0) is 0.1, 0.6, 0.7, 0.8.
SCORES = [0.1, 0.6, 0.7, 0.8]


def run(spark, text, **cfg):
    vecs = spark.createDataFrame([(i, k, [s, (1 - s * s) ** 0.5]) for i, (k, s) in enumerate(zip(KEYS, SCORES))],
                                 "ord long, key string, embedding array<double>")
    recs = vecs.select("ord", F.col("key").alias("text"))
    q = spark.createDataFrame([(0, text, [1.0, 0.0])], "query_id long, query string, embedding array<double>")
    rows = cosine_boost_retrieve(q, vecs, recs, RetrievalConfig(threshold=-1.0, **cfg)).orderBy("rank").collect()
    return [(r.ord, r.score) for r in rows]


def test_no_key_no_boost(spark):
    assert run(spark, "nada que ver", top_k=4) == [(3, 0.8), (2, 0.7), (1, 0.6), (0, 0.1)]


def test_exact_key_is_raised_and_clamped(spark):
    assert run(spark, "que es la brujula", top_k=2) == [(1, 1.0), (3, 0.8)]
    assert run(spark, "define vela", top_k=1) == [(3, 1.0)]                    # 0.8 + 0.40 is cut at 1


def test_one_edit_key_gets_the_smaller_boost(spark):
    assert run(spark, "define anclas", top_k=2) == [(2, 0.98), (3, 0.8)]


def test_boosted_row_enters_from_outside_the_shortlist(spark):
    got = run(spark, "que es el faro", top_k=1, cosine_overfetch=1)
    assert got == [(3, 0.8)]                                                   # 0.1 + 0.40 stays below 0.8
    assert (0, 0.5) in run(spark, "que es el faro", top_k=4, cosine_overfetch=1)


def test_no_side_as_long_as_the_queries_is_broadcast(spark):
    vecs = spark.createDataFrame([(0, "faro", [1.0, 0.0])], "ord long, key string, embedding array<double>")
    q = spark.createDataFrame([(0, "define faro", [1.0, 0.0])], "query_id long, query string, embedding array<double>")
    plan = cosine_boost_retrieve(q, vecs, vecs.select("ord", "key"), RetrievalConfig())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_each_text_is_run_once_and_every_query_gets_its_rows(spark):
    from tessera.plans.retrieve import once_per_text
    seen = []

    def run(q):
        seen.append(q.count())
        return q.select("query_id", F.coalesce("query", F.lit("none")).alias("got"))
    q = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "query_id long, query string")
    assert sorted(map(tuple, once_per_text(q, run).collect())) == [(1, "a"), (2, "a"), (3, "none"), (4, "none"), (5, "b")]
    again = q.unionByName(q.where("query_id = 5"))          # an id that repeats: as it is
    assert once_per_text(again, run).count() == 6
    assert seen == [3, 6]
