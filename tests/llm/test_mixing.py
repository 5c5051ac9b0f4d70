"""Source mixing: targets, budgets and selection against plain Python."""
import itertools

import numpy as np
from llm.conftest import ODD, words

from tessera.llm import mixing
from tessera.llm.registry import op8_source_mixing


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), budget=1.5, most=2.0):
    """sizes: source -> words. Share by weight, cap, reshare until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = budget * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else share[s] for s in order}
        capped |= over


def check(rows, source_of, size_of):
    sums = {}
    for i, s in source_of:
        sums[s] = sums.get(s, 0) + size_of[i]
    want = brute_targets(sums)
    taken = {}
    for r, s in rows:
        assert r["source_size"] == sums[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] = taken.get(s, 0) + r["taken"]
    return taken, want


def test_query(spark, sf, corpus):
    rows = op8_source_mixing(spark, sf).collect()
    size = {i: len(words(t)) for i, (t, _) in corpus.items()}
    assert {r.doc_id: r["size"] for r in rows} == size
    taken, want = check([(r.asDict(), corpus[r.doc_id][1]) for r in rows], [(i, s) for i, (_, s) in corpus.items()], size)
    for s in want:                                      # ten documents a source: every subset can be tried
        own = [size[i] for i, (_, t) in corpus.items() if t == s]
        rest = want[s] - want[s] // sum(own) * sum(own)
        best = min(abs(sum(c) - rest) for n in range(len(own) + 1) for c in itertools.combinations(own, n))
        assert abs(taken[s] - want[s]) <= best + 1
    again = op8_source_mixing(spark, sf).repartition(7).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_fit_counts_is_optimal():
    rng = np.random.default_rng(4)
    for _ in range(60):
        sizes = np.unique(rng.integers(1, 40, rng.integers(1, 6)))
        counts = rng.integers(1, 4, len(sizes))
        budget = int(rng.integers(0, (sizes * counts).sum() + 5))
        take = mixing.fit_counts(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        got = int((take * sizes).sum())
        best = min(abs(int(np.dot(c, sizes)) - budget) for c in itertools.product(*(range(n + 1) for n in counts)))
        assert abs(got - budget) == best


def test_fit_counts_beyond_the_dp_budget():
    sizes, counts = np.array([3, 1000, 50_000]), np.array([5, 400, 30])
    for budget in (0, 7, 300_123, 1_500_000, 1_899_999, 1_900_015, 5_000_000):
        take = mixing.fit_counts(sizes, counts, budget, dp_budget=2000)
        got = int((take * sizes).sum())
        assert (take <= counts).all() and abs(budget - got) < 1000 or got == int((sizes * counts).sum())


def test_hot_length_and_odd_rows(spark, docs):
    rows = [(i, "same length here", "hot") for i in range(3000)] + [(5000 + i, "w " * (i % 17 + 1), f"s{i % 5}") for i in range(200)]
    odd = [(9000 + k, t, s) for k, (_, t, s) in enumerate(ODD)] + [(None, "a b", None), (None, "a b", None)]
    df = docs(rows + odd, extra=["size", "copies", "nth", "row_key", "has_source"])
    got = mixing.mixture(df).collect()
    size = {i: len(words(t)) for i, t, _ in rows + odd}
    source = {i: s for i, _, s in rows + odd}
    assert len(got) == len(rows + odd)
    out = [(r.asDict() | {"taken": r.copies * r["size"]}, source[r.doc_id]) for r in got]
    taken, want = check(out, [(i, s) for i, _, s in rows + odd], size)
    for s in want:
        longest = max(size[i] for i in source if source[i] == s)
        assert abs(taken[s] - want[s]) <= max(3, longest / 2 if longest > 1000 else 3)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mixture(docs([])).count() == 0 and mixing.mix(docs([])).count() == 0
    assert mixing.mixture(docs([(1, None, "a"), (2, " ", None)])).count() == 2


def test_global_index(spark):
    df = spark.createDataFrame([(x,) for x in range(999, -1, -1)], "x int").repartition(13)
    assert all(r.x == r.nth for r in mixing.global_index(df, ["x"], "nth").collect())


def test_documents_above_the_fitted_budget():
    """Documents that are each longer than a rest above ``dp_budget``: the nearer of one and none."""
    fit = lambda sizes, counts, budget, **kw: mixing.fit_counts(np.array(sizes), np.array(counts), budget, **kw).tolist()
    assert fit([300_000], [1], 290_000) == [1]
    assert fit([300_000, 700_000], [1, 2], 290_000) == [1, 0]
    assert fit([600_000, 700_000], [2, 2], 290_000) == [0, 0]
    for budget in range(1, 900, 7):              # as without the bound
        assert fit([300], [3], budget, dp_budget=10) == fit([300], [3], budget), budget
