"""LM scoring against a dictionary model, and held-out separation."""
import math
from collections import Counter

import numpy as np
from llm.conftest import ODD, words
from pyspark.sql import functions as F

from tessera.llm import lm_scoring
from tessera.llm.registry import op9_lm_scoring


def brute(texts, good, weight=lm_scoring.BIGRAM_WEIGHT):
    """texts: list of (id, text) -> list of mean loss differences."""
    tokens = [[w.lower() for w in words(t)] for _, t in texts]
    size = len({w for t in tokens for w in t}) + 2
    seqs = [[None, *t] for t in tokens]
    pairs = [Counter(zip(s, s[1:])) for s in seqs]
    counts = [sum((p for p, (i, _) in zip(pairs, texts) if m or i in good), Counter()) for m in (0, 1)]
    kept = {k for k, n in counts[1].items() if n >= 2}
    out = []
    for seq, own, (i, _) in zip(seqs, pairs, texts):
        total = 0.0
        for m, sign in ((0, 1), (1, -1)):
            c = counts[m] - own if m or i in good else counts[m]
            uni, ctx = Counter(), Counter()
            for (a, b), n in c.items():
                uni[b] += n
                if a is not None or (a, b) in kept:
                    ctx[a] += n
            n_all = sum(uni.values())
            for a, b in zip(seq, seq[1:]):
                pair = c[(a, b)] if (a, b) in kept else 0
                context = max(uni[a] if a is not None else ctx[a], pair, 1)
                total -= sign * math.log2(weight * pair / context + (1 - weight) * (uni[b] + 1) / (n_all + size))
        out.append(total / (len(seq) - 1) if len(seq) > 1 else 0.0)
    return out


def test_matches_brute_force(spark, docs):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{x}" for x in rng.zipf(1.6, 40) % 50) + " " + "z" * (i * 9), "s") for i in range(30)]
    rows += [(100 + k, t, s) for k, (_, t, s) in enumerate(ODD[:7])]
    good = {i for i, _, _ in rows if i % 2 == 0}
    labels = spark.createDataFrame([(i, int(i in good)) for i, _, _ in rows if i < 100] + [(0, 0), (2, None), (None, 1), (777, 1)]
                                   + [(i, 1) for i in good if i >= 100], "doc_id long, quality int")
    df = docs(rows, extra=["id", "target", "inside", "quality"])
    got = {r.doc_id: r for r in lm_scoring.score(df, labels).collect()}
    for (i, t, _), want in zip(rows, brute([(i, t) for i, t, _ in rows], good)):
        assert got[i].n_tokens == len(words(t)) and got[i].in_target == (i in good)
        assert abs(got[i].loss_difference - want) < 1e-9, i


def test_held_out_documents_separate(spark, docs):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{x}" for x in rng.zipf(1.5, 60) % 200), "s") for i in range(200)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(120)], "doc_id long, quality int")
    got = {r.doc_id: r.loss_difference for r in lm_scoring.score(docs(rows), labels).collect()}
    assert max(got[i] for i in range(120, 200, 2)) < min(got[i] for i in range(121, 200, 2))


def test_query_and_empty(spark, sf, corpus, docs):
    rows = op9_lm_scoring(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(corpus) and all(math.isfinite(r.loss_difference) for r in rows)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert lm_scoring.score(docs([]), none).count() == 0
    assert lm_scoring.score(docs(ODD), none).where(F.col("in_target")).count() == 0


def test_both_ways_to_mark_the_target(spark, docs, monkeypatch):
    df, labels = docs([(i, f"w{i % 7} x y z", "s") for i in range(60)]), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    sent = sorted(map(tuple, lm_scoring.score(df, labels).collect()))
    monkeypatch.setattr(lm_scoring, "MAX_BROADCAST", 0)
    assert sorted(map(tuple, lm_scoring.score(df, labels).collect())) == sent


def agrees(spark, docs, rows, good):
    labels = spark.createDataFrame([(i, 1) for i in sorted(good)], "doc_id long, quality int")
    got = {r.doc_id: r.loss_difference for r in lm_scoring.score(docs(rows), labels).collect()}
    want = brute([(i, t) for i, t, _ in rows], good)
    assert len(got) == len(rows) and all(abs(got[i] - w) < 1e-9 for (i, _, _), w in zip(rows, want))


def test_no_word_or_bigram_is_cut(spark, docs):
    """More words than are broadcast, each of them twice, and words of over 64 bytes."""
    names = [f"w{i}" for i in range(70_000)] + ["x" * 65 + str(i) for i in range(50)]
    rows = [(i, " ".join(names[k::5]), "s") for i, k in enumerate((0, 1, 2, 3, 4, 0, 1, 2, 3, 4))]
    agrees(spark, docs, rows, {0, 1, 7})


def test_joined_counts_are_the_broadcast_ones(spark, docs, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{x}" for x in rng.zipf(1.4, 60) % 90), "s") for i in range(40)]
    for most in (0, 3, 40):
        monkeypatch.setattr(lm_scoring, "VOCABULARY", most)
        monkeypatch.setattr(lm_scoring, "MAX_BIGRAMS", 2 * most)
        agrees(spark, docs, rows, set(range(0, 30, 2)))
