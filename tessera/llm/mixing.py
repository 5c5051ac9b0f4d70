"""Mixing sources to target weights by subset-sum budget fitting.

Targets come from a water-filling over the per-source sums. What a source takes is a
whole number of passes over all its documents and a rest. For the rest, documents are
counted by exact length; most of it is spread evenly over the lengths, what remains is
hit exactly by a bounded-knapsack dynamic programme over the counts that are left. The
plan says how many documents of each length are taken once more; which ones is decided
by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, WORD, checkpoint, free_keys, free_name, row_keys

WEIGHTS = (5.0, 2.0, 1.0)
#: The largest budget that the dynamic programme is run over (words).
DP_BUDGET = 1 << 18


def global_index(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with the 0-based position of each row in ``order`` (total): a range-partitioned
    sort; only the row count of each partition meets in one place."""
    pid, pos = free_name(df, "pid"), free_name(df, "pos")
    at = F.monotonically_increasing_id()
    parts = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(pos, at)
                       .withColumn(pid, F.shiftright(F.col(pos), 33))
                       .withColumn(pos, F.col(pos).bitwiseAND(F.lit((1 << 33) - 1))))
    counts = sorted((r[0], r[1]) for r in parts.groupBy(pid).count().collect())      # one row per partition
    starts = np.r_[0, np.cumsum([n for _, n in counts])].tolist()
    if not counts:
        return parts.select(*df.columns, F.lit(0).cast("bigint").alias(name))
    start = F.element_at(F.array(*[F.lit(s).cast("bigint") for s in starts[:-1]]),
                         F.array_position(F.array(*[F.lit(p).cast("bigint") for p, _ in counts]), F.col(pid).cast("bigint")).cast("int"))
    return parts.select(*[F.col(f"`{c}`") for c in df.columns], (start + F.col(pos)).alias(name))


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5,
            most: float = 2.0) -> DataFrame:
    """``sizes`` (has_source, source, source_size: one row per source) with ``target``.
    Sources in code-point order, null last, weigh ``weights``, repeating; the targets share
    ``budget`` times all sizes by weight, none above ``most`` times its source's size."""
    ranked = checkpoint(global_index(sizes, [F.col("has_source").desc(), F.col("source")], "nth"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    rows = checkpoint(ranked.select("has_source", "source", "source_size", w.alias("w")))
    cap = F.col("source_size") * F.lit(float(most))
    total = (rows.agg(F.sum("source_size")).first()[0] or 0) * budget
    level, capped = 0.0, -1
    while total:
        full = cap <= F.lit(level) * F.col("w")
        n, held, free = rows.agg(F.count(F.when(full, 1)), F.sum(F.when(full, cap).otherwise(0.0)),
                                 F.sum(F.when(~full, F.col("w")).otherwise(0.0))).first()
        if n == capped or not free:
            break
        capped, level = n, (total - held) / free
    return rows.select("has_source", "source", "source_size", F.least(cap, F.lit(level) * F.col("w")).alias("target"))


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int, dp_budget: int = DP_BUDGET) -> np.ndarray:
    """How many of the ``counts`` documents of each length to take so that their sum is as
    near to ``budget`` as can be. All but about ``dp_budget`` words of it is an even share of
    every length (and, where that leaves more, whole documents from the longest down); the
    rest is fitted by bounded knapsack over the documents that are left: the nearest sum
    that can be reached, one longest document above the rest at most. Where all that are left
    are longer than a rest above ``dp_budget``, that is one of the shortest or none."""
    take = np.zeros(len(sizes), np.int64)
    total = int((sizes * counts).sum())
    if not total or budget <= 0:
        return take
    if budget >= total:
        return counts.copy()
    take = np.minimum(counts, (counts * max(0.0, (budget - dp_budget) / total)).astype(np.int64))
    rest = budget - int((take * sizes).sum())
    order = np.argsort(-sizes, kind="stable")
    for j in order:
        if rest <= dp_budget:
            break
        n = min(int(counts[j] - take[j]), -((dp_budget - rest) // int(sizes[j])), rest // int(sizes[j]))
        take[j] += n
        rest -= n * int(sizes[j])
    if rest > dp_budget:                                     # what is left is longer: one of the shortest, or none
        left = np.flatnonzero(counts > take)
        j = left[sizes[left].argmin()]
        take[j] += int(sizes[j]) - rest < rest
        return take
    if rest <= 0:
        return take
    top = rest + min(int(sizes[counts > take].max()), rest)
    made_by = np.full(top + 1, -1, np.int32)                 # the step that first reached a sum
    reach = np.zeros(top + 1, bool)
    reach[0] = True
    steps: list[tuple[int, int]] = []
    for j in order:
        left = min(int(counts[j] - take[j]), top // int(sizes[j]))
        part = 1
        while left > 0 and not reach[rest]:
            n = min(part, left)
            amount = n * int(sizes[j])
            new = np.zeros(top + 1, bool)
            new[amount:] = reach[:top + 1 - amount]
            new &= ~reach
            made_by[new] = len(steps)
            reach |= new
            steps.append((int(j), n))
            left -= n
            part *= 2
        if reach[rest]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.abs(sums - rest).argmin()])
    while at:
        j, n = steps[made_by[at]]
        take[j] += n
        at -= n * int(sizes[j])
    return take


def mixture(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            seed: int = 17, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, ROW, size, source_size, target, copies: how often each row is taken.
    ``size`` is the number of words; a null source is a source of its own (last).

    Null or blank texts have size 0 and are taken as often as their source is passed over
    in full; rows are told apart by a hash of all columns (equal rows: by nothing, any of
    them may be the one taken); an empty table gives no rows. Reruns agree."""
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`").cast("string")
    rows = checkpoint(df.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), *row_keys(df),
        source.isNotNull().alias("has_source"), F.coalesce(source, F.lit("")).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")))
    lengths = checkpoint(rows.groupBy("has_source", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    goal = targets(lengths.groupBy("has_source", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")),
                   weights=weights, budget=budget, most=most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    counted = lengths.join(checkpoint(goal), ["has_source", "source"]).withColumn("passes", passes).withColumn(
        "rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("bigint"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        some = pdf["size"].to_numpy() > 0
        take = np.zeros(len(pdf), np.int64)
        if len(pdf) and pdf["passes"].iat[0] < most:
            take[some] = fit_counts(pdf["size"].to_numpy()[some], pdf["n"].to_numpy()[some], int(pdf["rest"].iat[0]))
        return pdf.assign(take=take)[["has_source", "source", "size", "source_size", "target", "passes", "n", "take"]]

    # a source's histogram has one row per distinct length, however many documents it holds
    plan = checkpoint(counted.groupBy("has_source", "source").applyInPandas(
        fit, "has_source boolean, source string, size long, source_size long, target double, passes long, n long, take long"))
    key = ["has_source", "source", "size"]
    joined = rows.join(plan, key).withColumn("h", F.xxhash64(F.lit(seed), ROW[0], "doc_id"))
    whole = joined.where("take = 0 OR take = n").withColumn("more", (F.col("take") > 0).cast("bigint"))
    # of a length taken in part: the smallest hashes, found by 1024 ranges of the hash so that one length can be hot
    partly = checkpoint(joined.where("take > 0 AND take < n").withColumn("b", F.shiftright("h", 54)))
    ranges = partly.groupBy(*key, "b").agg(F.count(F.lit(1)).alias("in_b"))
    before = F.sum("in_b").over(Window.partitionBy(*key).orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    ranges = checkpoint(ranges.withColumn("before", F.coalesce(before, F.lit(0))).select(*key, "b", "in_b", "before"))
    placed = partly.join(ranges, [*key, "b"])
    sure = placed.where("before >= take OR before + in_b <= take").withColumn("more", (F.col("before") < F.col("take")).cast("bigint"))
    nth = F.row_number().over(Window.partitionBy(*key, "b").orderBy("h", "doc_id", *ROW))
    edge = placed.where("before < take AND before + in_b > take").withColumn("nth", nth).withColumn(
        "more", (F.col("before") + F.col("nth") <= F.col("take")).cast("bigint"))
    cols = ["doc_id", *ROW, "size", "source_size", "target", (F.col("passes") + F.col("more")).alias("copies")]
    return whole.select(*cols).unionByName(sure.select(*cols)).unionByName(edge.select(*cols))


def mix(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` (same columns), each as often as ``mixture`` takes it."""
    picks = checkpoint(mixture(df, **options).groupBy(*ROW).agg(
        F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("same")).where("copies > 0"))
    keys, nth = free_keys(df), free_name(df, "nth")
    keyed = df.select("*", *row_keys(df, keys))
    own, share = free_name(keyed, "copies"), free_name(keyed, "same")
    joined = keyed.join(picks.select(*[F.col(r).alias(n) for r, n in zip(ROW, keys)], F.col("copies").alias(own),
                                    F.col("same").alias(share)), list(keys))
    # equal rows share their copies out among them
    ranked = joined.withColumn(nth, F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)))
    mine = F.floor(F.col(own) / F.col(share)) + (F.col(nth) <= F.col(own) % F.col(share)).cast("bigint")
    return (ranked.withColumn(nth, mine).where(F.col(nth) > 0)
            .withColumn(nth, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(nth))))
            .select(*[F.col(f"`{c}`") for c in df.columns]))
