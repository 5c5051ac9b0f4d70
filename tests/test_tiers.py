"""SRC-8 / ANN-7: the tier follows the tables a store has; each tier returns fragments."""
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from tessera.config import RetrievalConfig
from tessera.operators import minhash as MH
from tessera.operators.encode import encode
from tessera.plans.inputs import document_records
from tessera.operators.ivfpq import ivfpq_build, write_index
from tessera.plans.build import build_corpus
from tessera.plans.retrieve import tiered_retrieve
from tessera.sources.corpus import as_corpus
from tessera.sources.store import StoreCatalog, keyed_records, write_records, write_table
from tessera.sources.tables import table


def test_tiers(spark):
    docs = table(spark, SF001, "documents")
    corpus = as_corpus(docs, {"id": "doc_id", "text": "text"}, "doc_id")
    root = tempfile.mkdtemp(prefix="store-")
    write_records(keyed_records(corpus, 4), root)
    q = table(spark, SF001, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    cfg = RetrievalConfig(threshold=0.0)

    cat = StoreCatalog.open(spark, root)
    assert cat.tier == "exact"
    assert tiered_retrieve(cat, spark, q, cfg).count() == 0   # no query equals a key

    recs = document_records(docs).withColumn("key", F.col("id"))
    sigs = MH.with_signatures(recs, "text_out").select("key", "sig")
    write_table(sigs, root, "minhash")
    cat = StoreCatalog.open(spark, root)
    assert cat.tier == "minhash"
    res = tiered_retrieve(cat, spark, q, cfg)
    assert res.count() > 0 and res.groupBy("query_id").count().agg(F.max("count")).first()[0] <= cfg.top_k

    write_table(encode(recs, "text_out").select("key", "embedding"), root, "embeddings")
    cat = StoreCatalog.open(spark, root)
    assert cat.tier == "cosine"
    res = tiered_retrieve(cat, spark, q, cfg)
    assert res.filter("tier = 'cosine'").count() == q.count() * cfg.top_k
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert all(r.text == texts[int(r.source_id)] for r in res.collect())          # the text, not the stored JSON

    index = ivfpq_build(spark.read.parquet(root + "/embeddings"), key="key")
    write_index(index, spark, root)
    cat = StoreCatalog.open(spark, root)
    assert cat.tier == "ivf" and cat.index(spark).nprobe == index.nprobe
    ivf = tiered_retrieve(cat, spark, q, cfg)
    pairs = lambda d: {(r.query_id, r.key) for r in d.collect()}
    assert ivf.columns == res.columns and len(pairs(ivf) & pairs(res)) >= 0.9 * len(pairs(res))


def test_key_boost_and_fields_in_every_tier(spark):
    """A store of lemma/definition records: the named key wins its query in the cosine and IVF
    tiers, and every tier returns the record's text."""
    words = ["cold widget", "warm widget", "blue lamp", "green lamp", "iron gate"]
    part = spark.createDataFrame([(i, w, f"kind {i}") for i, w in enumerate(words)], "id long, lemma string, definition string")
    corpus = as_corpus(part, {"id": "id", "lemma": "lemma", "definition": "definition"}, "id")
    q = spark.createDataFrame([(1, "define cold widget"), (2, "define blue lampp")], "query_id long, query string")
    cfg = RetrievalConfig(threshold=0.0, top_k=1)
    root = tempfile.mkdtemp(prefix="store-")
    build_corpus(corpus, root, cfg)
    want = {1: ("cold widget: kind 0", 0.97735), 2: ("blue lamp: kind 2", None)}     # 1 / sqrt(3) + 0.40
    for drop, tier in (([], "cosine"), (["embeddings"], "minhash")):
        cat = StoreCatalog.open(spark, root)
        cat = StoreCatalog(cat.root, False, cat.has_embeddings and "embeddings" not in drop, cat.has_minhash)
        assert cat.tier == tier
        for r in tiered_retrieve(cat, spark, q, cfg).collect():
            assert r.text == want[r.query_id][0] and r.source_id in ("0", "2")
            assert tier != "cosine" or want[r.query_id][1] in (None, r.score)
    build_corpus(corpus, root, cfg, index=True)
    got = {r.query_id: (r.text, r.tier) for r in tiered_retrieve(StoreCatalog.open(spark, root), spark, q, cfg).collect()}
    assert got == {k: (t, "ivf") for k, (t, _) in want.items()}


def test_minhash_candidates_are_the_exact_top(spark):
    """Recall 1 against the exhaustive ranking by agreement, also of short queries over long records."""
    docs = document_records(table(spark, SF001, "documents")).select(F.col("ord").alias("key"), F.col("text_out").alias("text"))
    asked = table(spark, SF001, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    sigs, q_sigs = (MH.with_signatures(d, "text").drop("text").checkpoint() for d in (docs, asked))
    got = {}
    for r in MH.minhash_candidates(q_sigs, sigs, 20).collect():
        got.setdefault(r.query_id, []).append((-r.jaccard_est, r.key))
    blocks = {}
    for r in MH.minhash_candidates(q_sigs, sigs, 20, max_query_bytes=0, block_bytes=20_000).collect():
        blocks.setdefault(r.query_id, []).append((-r.jaccard_est, r.key))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in blocks.items()}
    rows, total = [(r.key, r.sig) for r in sigs.collect()], 0
    for q in q_sigs.collect():
        alike = [(-sum(x == y for x, y in zip(q.sig, sig)) / 64, key) for key, sig in rows]
        want = sorted(a for a in alike if a[0] < 0)[:20]
        assert sorted(got.get(q.query_id, [])) == want
        total += len(want)
    assert total > 0


def test_versions_are_published_whole(spark, monkeypatch):
    """A build that fails half-way leaves the version before readable; an opened one stays as it is."""
    import pytest

    from tessera.plans import build
    from tessera.sources.store import drop_versions, published, read_records

    def corpus(text):
        return as_corpus(spark.createDataFrame([(0, "lamp", text)], "id long, lemma string, definition string"),
                         {"id": "id", "lemma": "lemma", "definition": "definition"}, "id")

    def value(cat):
        return read_records(spark, cat.root).first().value
    root = tempfile.mkdtemp(prefix="versions-")
    assert published(spark, root) is None
    build_corpus(corpus("first"), root)
    first = StoreCatalog.open(spark, root)
    assert first.tier == "cosine" and "first" in value(first)

    def broken(*a, **k):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(build, "with_signatures", broken)
        with pytest.raises(RuntimeError):
            build_corpus(corpus("half"), root)
    assert StoreCatalog.open(spark, root) == first
    for text in ("second", "third"):
        build_corpus(corpus(text), root)
    assert "third" in value(StoreCatalog.open(spark, root)) and "first" in value(first)
    assert "second" in value(StoreCatalog.open(spark, root, 2))
    assert drop_versions(spark, root) == [1]
    assert "third" in value(StoreCatalog.open(spark, root)) and "second" in value(StoreCatalog.open(spark, root, 2))
    with pytest.raises(FileNotFoundError):
        StoreCatalog.open(spark, root, 1)


def test_stored_kv_lookup_reads_its_buckets(spark):
    from tessera.sources.store import keyed_records_kv, lookup, read_records
    rows = [(f"k{i}", f"v{i}", i) for i in range(200)]
    root = tempfile.mkdtemp(prefix="kv-")
    write_records(keyed_records_kv(spark.createDataFrame(rows, "word string, definition string, ord long"), num_buckets=50), root)
    hit = lookup(read_records(spark, root), spark.createDataFrame([("k7",), ("k7",), ("none",), (None,)], "key string"), 50)
    scan = next(x for x in hit._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x and "bucket" in x)
    assert "PartitionFilters: [bucket#" in scan and [r.value for r in hit.collect()] == ["v7", "v7"]
