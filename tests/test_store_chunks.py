"""SRC-4 key/value store, bucket-pruned lookup, PIP-4 chunks vs Python's split."""
import tempfile

from pyspark.sql import functions as F

from tessera.functions.vector import l2_normalize
from tessera.operators.chat import chunk_response, last_messages, token_usage
from tessera.operators.encode import encode_with
from tessera.operators.rank import rank_fragments, single_query_topk
from tessera.sources.corpus import columnar_corpus_scan, fragment_preview
from tessera.sources.store import keyed_records_kv, lookup, read_records, write_embeddings, write_records


def test_kv_store_and_pruned_lookup(spark):
    df = spark.createDataFrame([("casa", "choza", 0), ("perro", "animal", 1), ("", "sin clave", 2), ("casa", "edificio", 3)],
                               "word string, definition string, ord int")
    store = keyed_records_kv(df, num_buckets=8)
    assert {r.key: r.value for r in store.collect()} == {"casa": "edificio", "perro": "animal"}      # the last of a key
    unnumbered = spark.createDataFrame([("x", "1"), ("x", "2")], "word string, definition string").coalesce(1)
    assert [r.value for r in keyed_records_kv(unnumbered).collect()] == ["2"]
    root = tempfile.mkdtemp(prefix="kv-")
    write_records(store, root)
    back = read_records(spark, root)
    hit = lookup(back, spark.createDataFrame([("perro",)], "key string"), 8)
    assert [r.value for r in hit.collect()] == ["animal"]


def test_chunks_match_python_split(spark):
    texts = ["Hola mundo.", "uno  dos", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "query_id long, response string")
    got = {}
    for r in chunk_response(df).collect():
        got.setdefault(r.query_id, []).append((r.seq, r.content, r.finish_reason))
    for qid, t in enumerate(texts):
        words = t.split(" ")
        want = [(i, w + (" " if i < len(words) - 1 else ""), None) for i, w in enumerate(words)]
        want.append((len(words), None, "stop"))
        assert sorted(got[qid]) == want


def test_chunks_are_linear(spark):
    """The response is cut once, not once per word."""
    import time

    def seconds(n):
        df = spark.createDataFrame([(i, " ".join(["word"] * n)) for i in range(8)], "query_id long, response string")
        chunk_response(df).write.format("noop").mode("overwrite").save()
        t = time.time()
        chunk_response(df).write.format("noop").mode("overwrite").save()
        return time.time() - t
    seconds(1000)
    assert seconds(80_000) < 10


def test_columnar_scan_vectors_and_previews(spark):
    root = tempfile.mkdtemp(prefix="col-")
    rows = [("faro", "luz"), ("vela", None)]
    spark.createDataFrame(rows, "lemma string, definition string").withColumn("other", F.lit(1)).coalesce(1).write.parquet(root + "/in")
    scan = columnar_corpus_scan(spark, root + "/in")
    assert [(r.ord, r.lemma, r.definition) for r in scan.orderBy("ord").collect()] == [(0, "faro", "luz"), (1, "vela", None)]
    vec = spark.createDataFrame([("faro", [3.0, 4.0]), ("zero", [0.0, 0.0])], "key string, embedding array<double>")
    write_embeddings(vec.withColumn("embedding", l2_normalize("embedding")), root)
    back = {r.key: r.embedding for r in spark.read.parquet(root + "/embeddings").collect()}
    assert back == {"faro": [0.6, 0.8], "zero": [0.0, 0.0]}
    frags = spark.createDataFrame([(0, "x" * 70, 0.25), (1, "short", 0.75), (2, "tie", 0.75)], "ord long, text string, score double")
    assert [r.ord for r in rank_fragments(frags).collect()] == [1, 2, 0]
    assert [r.ord for r in single_query_topk(frags, 1, 0.5).collect()] == [1]
    shown = [r.p for r in frags.orderBy("ord").select(fragment_preview().alias("p")).collect()]
    assert shown[:2] == [f"Fragment(score=0.250, text={'x' * 60})", "Fragment(score=0.750, text=short)"]
    half = encode_with(frags.select("ord", "text"), lambda: (lambda ts: [[len(t), 0.0] for t in ts]))
    assert all(r.embedding == [1.0, 0.0] for r in half.collect())


def test_last_messages_and_usage(spark):
    conv = spark.createDataFrame([(1, 0, "system", " be brief "), (1, 1, "user", "first q"), (1, 2, "assistant", "a"),
                                  (1, 3, "user", "   "), (2, 0, "assistant", "only")],
                                 "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.user_text, r.system_text) for r in last_messages(conv).collect()}
    assert got == {1: ("first q", "be brief"), 2: (None, None)}
    u = token_usage(spark.createDataFrame([("a b  c", "x\ty")], "query string, response string")).first()
    assert (u.prompt_tokens, u.completion_tokens, u.total_tokens) == (3, 2, 5)


def test_bucketed_tables_join_without_exchange(spark):
    import uuid

    from tessera.sources.store import open_bucketed, write_bucketed
    root, names = tempfile.mkdtemp(prefix="bk-"), [f"t_{uuid.uuid4().hex}" for _ in range(2)]
    rows = [(f"k{i}", i) for i in range(100)]
    a = write_bucketed(spark.createDataFrame(rows, "key string, a long"), root, names[0], 4)
    b = write_bucketed(spark.createDataFrame(rows[::2] + [("k2", -1)], "key string, b long"), root, names[1], 4)
    want = sorted((k, i, i) for k, i in rows[::2]) + [("k2", 2, -1)]
    for x, y in ((a, b), [None, None]):
        if x is None:                                      # another session knows the files only
            for n in names:
                spark.sql(f"DROP TABLE {n}")
            x, y = (open_bucketed(spark, root, n) for n in names)
        joined = x.hint("merge").join(y, "key")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, joined.collect())) == sorted(want)
