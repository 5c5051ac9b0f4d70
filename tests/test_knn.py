"""JOIN-1 scorer against brute force: both plans, NaN and null vectors, ties, k above the corpus."""
import numpy as np
import pytest

from tessera.operators import knn
from tessera.operators.knn import knn_topk


def data(spark, nc=300, nq=70, dim=16):
    rng = np.random.default_rng(3)
    X = rng.standard_normal((nc, dim)).astype(np.float32)
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    corpus = spark.createDataFrame([(i, X[i].tolist()) for i in range(nc)], "key long, embedding array<float>")
    queries = spark.createDataFrame([(i, X[i].tolist()) for i in range(nq)], "query_id long, embedding array<float>")
    return corpus.repartition(5), queries, np.round(X[:nq].astype(np.float64) @ X.astype(np.float64).T, 6)


def rows(df):
    return sorted((r.query_id, r["rank"], r.key, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("pairs", [4_000_000, 200])
def test_both_plans_match_brute_force(spark, monkeypatch, pairs):
    corpus, queries, S = data(spark)
    monkeypatch.setattr(knn, "_PAIR_BUDGET", pairs)
    how = {"k": 4, "threshold": 0.1}
    sent = knn_topk(queries, corpus, **how)
    blocks = knn_topk(queries, corpus, max_query_bytes=0, block_bytes=4000, **how)
    assert "Exchange" not in sent._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[1].replace("REPARTITION_BY_NUM", "").split("Scan")[0].replace("Exchange RoundRobin", "")
    want = []
    for qi in range(len(S)):
        order = sorted(range(S.shape[1]), key=lambda j: (-S[qi, j], j))
        want += [(qi, r, j, S[qi, j]) for r, j in enumerate([j for j in order if S[qi, j] >= 0.1][:4], start=1)]
    assert rows(sent) == rows(blocks) == sorted((a, b, c, round(float(d), 9)) for a, b, c, d in want)


@pytest.mark.parametrize("most", [1 << 30, 0])
def test_bad_vectors_only_lose_themselves(spark, most):
    nan = float("nan")
    corpus = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [nan, 0.0]), ("c", None), ("d", [0.6, 0.8]), ("e", [0.6, 0.8])],
                                   "key string, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [nan, 1.0])], "query_id long, embedding array<double>")
    got = knn_topk(queries, corpus, k=9, max_query_bytes=most, block_bytes=1)
    assert rows(got) == [(1, 1, "a", 1.0), (1, 2, "d", 0.6), (1, 3, "e", 0.6)]       # equal scores: by key
    assert rows(knn_topk(queries, corpus, k=2, max_query_bytes=most, block_bytes=1)) == rows(got)[:2]
    assert knn_topk(queries.where("query_id > 9"), corpus, k=2, max_query_bytes=most).count() == 0
    assert knn_topk(queries, corpus.where("key > 'x'"), k=2, max_query_bytes=most).count() == 0


def test_agreement_kernel(spark):
    q = spark.createDataFrame([(1, [1, 2, 3, 4])], "query_id long, sig array<bigint>")
    c = spark.createDataFrame([(10, [1, 2, 3, 4]), (11, [1, 2, 0, 0]), (12, [9, 9, 9, 9])], "key long, sig array<bigint>")
    got = knn_topk(q, c, k=3, query_vec="sig", corpus_vec="sig", kind="agree", decimals=None).orderBy("rank").collect()
    assert [(r.key, r.score) for r in got] == [(10, 1.0), (11, 0.5), (12, 0.0)]


def test_memory_of_the_kernel_is_flat():
    """Candidates are cut back while records go by."""
    rng = np.random.default_rng(0)
    q = rng.integers(0, 3, (64, 64))
    top = knn.TopK(q, 20, None, None, "agree")
    for i in range(40):
        top.add(np.arange(i * 500, i * 500 + 500), rng.integers(0, 3, (500, 64)))
        assert top.held <= max(knn._PAIR_BUDGET // 4, 2 * 64 * 20) + 64 * 500
    assert len(top.result()[0]) == 64 * 20


def test_agreement_by_postings_equals_comparing_all():
    rng = np.random.default_rng(4)
    for n, m, values in ((7, 40, 3), (1, 5, 50), (30, 200, 8), (3, 0, 2)):
        q, c = rng.integers(0, values, (n, 16)), rng.integers(0, values, (m, 16))
        got = knn.TopK(q, 5, None, None, "agree")._agree(c)
        assert (got == (q[:, None, :] == c[None, :, :]).sum(axis=2) / 16).all() and got.shape == (n, m)


def test_an_encoder_runs_once(spark):
    """No filter stands on the encoder's result, which would be pushed below an exchange and run it again."""
    from tessera.config import RetrievalConfig
    from tessera.plans.answer import retrieve_text
    records = spark.createDataFrame([(i, str(i), f"text {i}") for i in range(20)], "ord long, source_id string, text_out string")
    queries = spark.createDataFrame([(1, "text 3"), (2, None)], "query_id long, query string")
    plan = retrieve_text(queries, records.repartition(4), RetrievalConfig(threshold=0.0))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "isnotnull(pythonUDF" not in plan


def test_equal_vectors_are_scored_once(spark, monkeypatch):
    """Beyond the broadcast bound only distinct vectors of both sides meet; ties over keys, repeated rows and ids as by brute force."""
    kinds = [[1.0, 0.0], [0.0, 1.0], [0.6, 0.8], None, [-0.0, 1.0]]
    c = [(i % 40, kinds[i % 5]) for i in range(60)]
    q = [(i, kinds[i % 3]) for i in range(30)] + [(0, kinds[0]), (1, kinds[2]), (99, None)]
    corpus = spark.createDataFrame(c, "key long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame(q, "query_id long, embedding array<float>").repartition(3)
    met, blocks = [], knn._in_blocks
    monkeypatch.setattr(knn, "_in_blocks", lambda a, b, *args, **how: (met.append((a.count(), b.count())), blocks(a, b, *args, **how))[1])
    got = knn_topk(queries, corpus, k=7, max_query_bytes=0, block_bytes=80)
    want = []
    for i in sorted({i for i, _ in q}):
        hits = [(float(np.round(np.float32(v) @ np.float32(w), 6)), key) for j, v in q if j == i and v for key, w in c if w]
        want += [(i, r, key, round(s, 9)) for r, (s, key) in enumerate(sorted(hits, key=lambda h: (-h[0], h[1]))[:7], start=1)]
    assert rows(got) == sorted((i, r, key, round(float(s), 6)) for i, r, key, s in want)
    assert met == [(4, 4)]                                 # three vectors and the null one


def test_encoding_holds_a_slice_of_counts():
    """Beyond its result the encoder's memory does not grow with the rows of a batch."""
    import tracemalloc

    import pyarrow as pa

    from tessera.operators import encode as E
    buckets = pa.array([[i % 256, (7 * i) % 256, i % 256] for i in range(8000)] + [[]], pa.list_(pa.int16()))
    tracemalloc.start()
    got = E._counts_to_unit(buckets, 256)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8001 * 256 * 4 + 8 * E.SLICE * 256 * 8
    assert len(got) == 8001 and got[0].as_py()[0] == 1.0 and not any(got[8000].as_py())
    assert [round(x, 6) for x in (got[1].as_py()[1], got[1].as_py()[7])] == [0.894427, 0.447214]
