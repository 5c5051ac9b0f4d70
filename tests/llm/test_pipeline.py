"""The pipeline: stage by stage against brute force, odd rows, and the entry point."""
import hashlib

import public_tokenizers as P
from llm.conftest import ODD, words
from llm.test_quality import brute as brute_words
from llm.test_simhash import brute_components, brute_fingerprint

import corpus_pipeline
from tessera.llm import packing


def test_stages_and_run(spark, sf, corpus, tmp_path):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    columns, out = df.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, df, sf).write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        out[name] = df
        assert df.columns == columns or name == "byte_bpe"
    kept = {r.doc_id: r.text for r in out["quality_rules"].collect()}
    base = {i for i, (t, _) in corpus.items() if (b := brute_words(t))[0] >= 50 and 2 * b[4] <= b[0]}
    assert set(kept) == base                                   # no host of the test table is rejected
    fps = [(i, brute_fingerprint(t)) for i, t in kept.items()]
    one = {r.doc_id for r in out["simhash_near_dedup"].collect()}
    assert one == set(brute_components(fps))
    cut = {r.doc_id: r for r in out["substring_dedup"].collect()}
    assert set(cut) <= one and all(len(r.text) == r.n_chars <= len(kept[i]) for i, r in cut.items())
    assert sum(cut[i].text == kept[i] for i in cut) > 0.8 * len(one)
    mixed = [r.doc_id for r in out["source_mixing"].collect()]
    assert set(mixed) <= set(cut) and max(map(mixed.count, set(mixed))) <= 2
    want, total = sum(len(words(cut[i].text)) for i in mixed), sum(len(words(r.text)) for r in cut.values())
    assert abs(want / total - 1.5) < 0.02
    lib = packing.tokenizer(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    last = sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in out["byte_bpe"].collect())
    assert last == sorted((i, len(lib.encode_ordinary(cut[i].text)), hashlib.sha256(cut[i].text.encode()).hexdigest()) for i in mixed)
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()) == last


def test_odd_rows_and_empty(spark, docs, sf):
    for rows in (ODD, []):
        df = docs(rows, extra=["row_key", "size", "copies"])
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, sf)
            df.count()


def test_registered():
    import __spark_entry__ as e
    names = set(e.queries())
    assert {"pipeline"} <= names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
