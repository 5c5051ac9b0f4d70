"""SimHash near-dedup against an all-pairs brute force."""
import numpy as np
import pytest
import xxhash
from llm.conftest import ODD, words
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.registry import op4_simhash_near_dedup


def brute_fingerprint(text, n=4):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in words(text)]
    runs = [b" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits=4):
    """fps: list of (id, fingerprint) -> list of component ids."""
    f = np.array([x for _, x in fps], np.uint64)
    comp = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for a in range(len(fps)):
            near = np.flatnonzero(np.bitwise_count(f ^ f[a]) <= bits)
            low = min(comp[b] for b in near)
            for b in near:
                if comp[b] != low:
                    comp[b], changed = low, True
    names = {}
    for (i, _), c in zip(fps, comp):
        if i is not None:
            names[c] = min(names.get(c, i), i)
    return [names.get(c) for c in comp]


def test_query_matches_brute_force(spark, sf, corpus):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op4_simhash_near_dedup(spark, sf).collect()}
    fps = [(i, brute_fingerprint(t)) for i, (t, _) in corpus.items()]
    want = {i: (f"{f:016x}", c) for (i, f), c in zip(fps, brute_components(fps))}
    assert got == want


def test_odd_rows(spark, docs):
    rows = simhash.near_duplicates(docs(ODD, extra=["fp", "component_id", "row_key", "prefix"])).collect()
    fps = [(i, brute_fingerprint(t)) for i, t, _ in ODD]
    want = sorted(((i, f, c) for (i, f), c in zip(fps, brute_components(fps))), key=str)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in rows), key=str) == want
    assert simhash.near_duplicates(docs([])).count() == 0


def test_keep_one(spark, docs):
    extra = ["row_key", "fp"]
    df = docs(ODD, extra=extra)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == [1, 4, 5, 7]                      # blanks share one, copies keep the smallest id
    assert simhash.keep_one(docs([(None, "a b c", "x"), (None, "a b c", "x")])).count() == 1


@pytest.mark.parametrize("per_prefix,max_variants", [(512, 2_000_000), (4, 3_000), (1, 500)])
def test_ball_links_lose_no_pair(spark, per_prefix, max_variants):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 6), replace=False)))
            for b in base for _ in range(8)]
    fps = sorted({int(x) for x in near})
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    nodes = spark.createDataFrame(signed, "fp long")
    links = simhash.ball_links(nodes, per_prefix=per_prefix, max_variants=max_variants)
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    got = [roots.get(s, s) for s, in signed]
    want = brute_components([(k, f) for k, f in enumerate(fps)])
    pairs = {}
    for g, w in zip(got, want):
        assert pairs.setdefault(w, g) == g
    assert len(set(got)) == len(set(want))


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000, i) for i in range(1001, 1100)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 1000 for i in range(1000, 1100))


def test_long_text_in_parts():
    from tessera.llm.common import shingle_hashes
    text = (" ".join(f"word{i % 977}" for i in range(20_000))).encode()
    whole = np.concatenate(list(shingle_hashes(text, 4, 42)))
    parts = np.concatenate(list(shingle_hashes(text, 4, 42, part=1000)))
    assert (whole == parts).all() and len(whole) == 20_000 - 3


def test_no_python_lists_of_pairs(spark):
    """A dense group links through one member per word, not pair by pair."""
    centre = 0x0123456789ABCDEF
    fps = [centre ^ (1 << i) for i in range(60)]
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    assert simhash.ball_links(nodes).count() <= 60 * 30
    assert simhash.ball_links(nodes).select(F.countDistinct("a")).first()[0] <= 60
