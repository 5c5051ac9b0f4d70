"""FLT-1, SRT-1/2, WIN-1, DUP-1."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.dedup import dedup_corpus, dedup_fragments
from tessera.operators.setjoin import jaccard_pairs
from tessera.operators.rank import filter_by_threshold, single_query_topk, topk_per_query


def frags(spark, scores):
    return spark.createDataFrame([(1, i, f"t{i}", float(s)) for i, s in enumerate(scores)],
                                 "query_id long, ord long, text string, score double")


def test_threshold(spark):
    got = filter_by_threshold(frags(spark, [0.9, 0.5, 0.1]), 0.4).collect()
    assert len(got) == 2 and all(r.score >= 0.4 for r in got)
    assert filter_by_threshold(frags(spark, [0.1]), 0.4).count() == 0
    assert filter_by_threshold(frags(spark, [0.5, 0.6]), 0.4).count() == 2
    assert filter_by_threshold(frags(spark, [float("nan"), 0.5]), 0.4).count() == 1


def test_rank_desc_and_topk(spark):
    df = frags(spark, [0.3, 0.9, 0.6])
    assert [r.score for r in single_query_topk(df, 3, 0.0).collect()] == [0.9, 0.6, 0.3]
    top = topk_per_query(df, 2).orderBy("rank").collect()
    assert [r.score for r in top] == [0.9, 0.6]


def test_dedup_recipe_variants(spark):
    a = "huevo frito con aceite caliente y sal al gusto en sartén"
    b = "huevo frito con aceite caliente y sal al gusto hoy"          # Jaccard 8/12 with a? checked below
    c = "la democracia es una forma de gobierno"
    df = spark.createDataFrame([(1, 1, a), (1, 2, b), (1, 3, c)], "query_id long, rank int, text string")
    kept = dedup_fragments(df, 0.6).orderBy("rank").collect()
    assert [r["rank"] for r in kept] == [1, 3]


def test_dedup_keeps_unrelated_and_chain(spark):
    df = spark.createDataFrame([(1, 1, "a b c d"), (1, 2, "w x y z")], "query_id long, rank int, text string")
    assert dedup_fragments(df).count() == 2
    # A~B (0.6), B~C (0.6), A!~C: with t=0.6, B is dropped, C survives
    chain = spark.createDataFrame([(1, 1, "a b c d"), (1, 2, "a b c d e f"), (1, 3, "c d e f")],
                                  "query_id long, rank int, text string")
    kept = dedup_fragments(chain, 0.6).orderBy("rank").collect()
    assert [r["rank"] for r in kept] == [1, 3]


def _greedy(rows, t):
    """The rule by hand: in order, a row stays unless it is similar to one that stayed."""
    kept = []
    for i, text in sorted(rows):
        s = set((text or "").lower().split())
        if not any(s and k and len(s & k) / len(s | k) >= t for _, k in kept):
            kept.append((i, s))
    return {i for i, _ in kept}


@pytest.mark.parametrize("small_block,t,max_key", [(1, 0.7, 3), (3, 0.5, 1), (64, 0.7, 3), (2, 1.0, 2), (1, 0.4, 3)])
def test_corpus_dedup_equals_the_greedy_rule(spark, small_block, t, max_key):
    rng = np.random.default_rng(int(10 * t))
    words = [f"w{i}" for i in range(40)]
    rows, base = [], [list(rng.choice(words, rng.integers(3, 9), replace=False)) for _ in range(5)]
    for i in range(90):                                   # chains of near copies around a few centres, and chance meetings
        w = list(base[rng.integers(5)]) if i % 3 else list(rng.choice(words, rng.integers(1, 9)))
        for _ in range(rng.integers(0, 3)):
            w[rng.integers(len(w))] = str(rng.choice(words))
        rows.append((i, " ".join(w)))
    rows += [(200, ""), (201, None), (202, "  "), (203, "W1 w1"), (204, "w1")]
    df = spark.createDataFrame(rows, "ord long, text string").withColumn("words", F.lit("own"))
    out = dedup_corpus(df, t, small_block=small_block, max_key=max_key)
    assert out.columns == df.columns and {r.ord for r in out.collect()} == _greedy(rows, t)


def test_corpus_dedup_of_a_large_group(spark):
    rows = [(i, f"one two three four five six seven eight nine x{i}") for i in range(300)] + [(999, "other words here")]
    out = dedup_corpus(spark.createDataFrame(rows, "ord long, text string"), 0.7, small_block=8)
    assert sorted(r.ord for r in out.collect()) == [0, 999]


def test_corpus_dedup_of_a_long_block_without_copies(spark, monkeypatch):
    """One word that all rows have, and nothing alike: no round for each row of its block."""
    from tessera.operators import dedup
    verifies = []
    plain = dedup.verified
    monkeypatch.setattr(dedup, "verified", lambda *a: verifies.append(1) or plain(*a))
    rows = [(i, f"the x{i} y{i % 60} z{i % 50}") for i in range(200)]
    out = dedup_corpus(spark.createDataFrame(rows, "ord long, text string"), 0.7, small_block=4)
    assert out.count() == 200 and len(verifies) <= 8        # one for the pairs, one a round


def test_a_block_is_split_only_where_its_pairs_are_more_work(spark, monkeypatch):
    """Twelve near copies of thirty words: 66 pairs a block, where keys of three words would be 1440."""
    from tessera.operators import setjoin
    asked = []
    plain = setjoin._longer_keys
    monkeypatch.setattr(setjoin, "_longer_keys", lambda *a: asked.append(1) or plain(*a))
    rows = [(i, " ".join([*[f"w{k}" for k in range(29)], f"x{i}"])) for i in range(12)] + [(50, "other words here")]
    out = dedup_corpus(spark.createDataFrame(rows, "ord long, text string"), 0.7, small_block=8)
    assert sorted(r.ord for r in out.collect()) == [0, 50] and not asked


@pytest.mark.parametrize("small_block,max_key,t", [(1, 3, 0.5), (2, 2, 0.7), (64, 3, 0.3), (1, 1, 0.6), (3, 3, 1.0)])
def test_jaccard_pairs_are_all_pairs(spark, small_block, max_key, t):
    rng = np.random.default_rng(small_block)
    words = [f"w{i}" for i in range(30)]

    def some(n):
        p = 1 / np.arange(1, 31)
        return [(i, " ".join(rng.choice(words, rng.integers(1, 8), p=p / p.sum()))) for i in range(n)] + [
            (900, None), (901, " "), (902, "w0 W1"), (903, "w1 w0 w1"), (904, "w0"), (905, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9")]
    left, right = some(90), some(120)
    got = jaccard_pairs(spark.createDataFrame(left, "item_id long, text string").withColumn("n", F.lit(1)),
                        spark.createDataFrame(right, "doc_id long, text string").withColumn("h", F.lit(1)), t,
                        left_id="item_id", right_id="doc_id", small_block=small_block, max_key=max_key)
    sets = [[(i, set((x or "").lower().split())) for i, x in side] for side in (left, right)]
    want = {(i, j, len(a & b) / len(a | b)) for i, a in sets[0] for j, b in sets[1] if a and b and len(a & b) / len(a | b) >= t}
    rows = got.collect()
    assert got.columns == ["item_id", "doc_id", "jaccard"] and len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_jaccard_pairs_of_nothing(spark):
    none = spark.createDataFrame([], "a long, text string")
    assert jaccard_pairs(none, none.withColumnRenamed("a", "b"), 0.5, left_id="a", right_id="b").count() == 0
    assert dedup_corpus(spark.createDataFrame([], "ord long, text string")).count() == 0


@pytest.mark.parametrize("t,small_block,max_edges,max_bitmaps", [(0.6, 1, 0, 1 << 20), (0.7, 1, 1 << 20, 0), (0.85, 64, 8, 0), (0.65, 2, 1 << 20, 1 << 20)])
def test_corpus_dedup_by_neighbours_equals_the_greedy_rule(spark, monkeypatch, t, small_block, max_edges, max_bitmaps):
    """In rounds and at once, with bitmaps sent and joined, rows that come twice, ids of several texts and of text type."""
    from tessera.operators import dedup, nearpairs
    monkeypatch.setattr(dedup, "MAX_EDGES", max_edges)
    monkeypatch.setattr(nearpairs, "MAX_BITMAPS", max_bitmaps)
    rng = np.random.default_rng(int(100 * t))
    words = [f"w{i}" for i in range(300)]
    rows, base = [], [list(rng.choice(words, rng.integers(2, 120), replace=False)) for _ in range(6)]
    for i in range(100):
        w = list(base[rng.integers(6)]) if i % 4 else list(rng.choice(words[:9], rng.integers(1, 9)))
        for _ in range(rng.integers(0, 2 + len(w) // 6)):
            w[rng.integers(len(w))] = str(rng.choice(words))
        rows.append((f"id{i:03d}", " ".join(w[:len(w) - int(rng.integers(0, 1 + len(w) // 8))])))
    rows += [("id900", ""), ("id901", None), ("id902", "W1 w1"), ("id903", "w1"), rows[50], rows[0]]
    out = dedup_corpus(spark.createDataFrame([*rows, (None, "w5 w6")], "ord string, text string"), t, small_block=small_block)
    stay = _greedy(set(rows) - {("id901", None)} | {("id901", "")}, t)
    assert sorted(r.ord for r in out.collect()) == sorted(i for i, _ in rows if i in stay)


def test_corpus_dedup_keeps_less_than_its_input_on_disk(spark, tmp_path, monkeypatch):
    """Texts that nothing is similar to: four bytes a word are kept, not the words, their order and their keys."""
    from tessera.operators import nearpairs
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"word{x:016x}" for x in rng.integers(0, 1 << 40, 1000))) for i in range(200)]
    monkeypatch.setattr(nearpairs.Scratch, "drop", lambda self, name="": None)
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        assert dedup_corpus(spark.createDataFrame(rows, "ord long, text string")).count() == 200
    finally:
        spark.sparkContext.setCheckpointDir(before)
    assert sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file()) < sum(len(x) for _, x in rows) / 2


def test_a_candidate_that_is_not_similar_decides_nothing(spark):
    """a drops b and b would drop c; d only looks similar to a: b goes, c and d stay."""
    from tessera.operators.dedup import _decided
    held = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g i"), (3, "a b c d e f i j"), (4, "a b c d")], "id long, text string")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (3, 4)], "a long, b long")
    assert [r.id for r in _decided(pairs, held, 0.7).collect()] == [2]
