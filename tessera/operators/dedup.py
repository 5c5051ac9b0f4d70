"""DUP-1 near-duplicate removal among a query's fragments (JOIN-9 inside a query), and DUP-2
over a whole table.

Greedy in rank order: a fragment is kept unless its word-set Jaccard with an
already *kept* fragment is >= t (so in a chain A~B~C, C survives when B was
dropped). The fold runs as one SQL ``aggregate`` over the query's fragments,
which are at most ``k`` rows after top-k — the group size is bounded by the
top-k parameter, never by the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import jaccard_sets, whitespace_set
from tessera.operators.nearpairs import LEAST, Scratch, hashed_sets, near_pairs, without
from tessera.operators.setjoin import MAX_KEY, SMALL_BLOCK, candidate_pairs, distinct_sets, has_word, verified, with_order, word_sets

#: Candidates of a table that are decided in the driver's process at most (16 bytes each).
MAX_EDGES = 1 << 21


def dedup_fragments(fragments: DataFrame, threshold: float = 0.7, *, group: str = "query_id",
                    order: str = "rank", text: str = "text") -> DataFrame:
    """Keep the fragments that survive the greedy Jaccard filter; columns unchanged."""
    cols = fragments.columns
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"),
                                                 whitespace_set(F.col(text)).alias("__w"),
                                                 F.struct(*[F.col(c) for c in cols]).alias("__r"))))
    empty = F.array().cast(fragments.select(F.array(F.struct(
        F.col(order).alias("__o"), whitespace_set(F.col(text)).alias("__w"),
        F.struct(*[F.col(c) for c in cols]).alias("__r")))).schema[0].dataType)

    def step(kept, x):
        dup = F.exists(kept, lambda y: jaccard_sets(x["__w"], y["__w"]) >= F.lit(threshold))
        return F.when(dup, kept).otherwise(F.concat(kept, F.array(x)))

    folded = fragments.groupBy(group).agg(F.aggregate(items, empty, step).alias("__kept"))
    return folded.select(F.explode("__kept").alias("__k")).select("__k.__r.*")


def dedup_corpus(df: DataFrame, threshold: float = 0.7, *, order: str = "ord", text: str = "text",
                 small_block: int = SMALL_BLOCK, max_key: int = MAX_KEY) -> DataFrame:
    """DUP-2: the greedy rule of ``dedup_fragments`` over a whole table: in ``order`` (unique), a
    row stays unless its word set has Jaccard >= ``threshold`` with an earlier row that stayed.
    Columns unchanged; rows without a word all stay.

    Equal sets collapse first (the first stays). The candidates of similar pairs come from the keys of
    neighbours (``nearpairs``) or, for a threshold under its LEAST, from the set join of the table with
    itself. Every row that waits for no earlier undecided one stays, what is similar to it goes, and so
    on: only pairs with a row that stayed are verified on the words. Long blocks of near copies are
    not listed: each round the first undecided row of one meets the rest. Rounds
    repeat until up to MAX_EDGES candidates are left, which are decided at once (``_decided``), so
    nothing depends on the last two parameters but the plan."""
    scratch = Scratch(df.sparkSession)
    if threshold >= LEAST:
        sets = scratch.keep("sets", hashed_sets(df, order, text))
        ids = sets.select("id")
        later = ids.join(sets.groupBy("d").agg(F.min("id").alias("id")), "id", "left_anti").distinct().checkpoint()
        pairs, long = near_pairs(without(sets, later, "left_anti"), scratch, threshold, small_block=small_block)
        ids = without(ids, later, "left_anti")
    else:
        rows, _ = distinct_sets(word_sets(df, order, text))
        pairs, long = candidate_pairs(*with_order(rows), None, threshold, small_block=small_block, max_key=max_key)
        ids = rows.select("id")
    live = pairs.checkpoint()
    here = long.distinct().checkpoint()
    ends = live.select(F.col("b").alias("id")).unionByName(live.select(F.col("a").alias("id")))
    open_rows = ends.unionByName(here.select("id")).distinct().checkpoint()
    kept = ids.join(open_rows, "id", "left_anti").checkpoint()
    # the rows that wait or are waited for are few: their texts alone are kept, and cut when they are verified
    held = scratch.keep("texts", without(df.select(F.col(order).alias("id"), F.col(text).alias("text")), open_rows, "left_semi"))
    words = word_sets(held, "id", "text")
    while True:
        blocks = here.groupBy("key").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("l")).where("l > 1")
        edges = live.count() + (blocks.agg(F.sum(F.expr("l * (l - 1) / 2"))).first()[0] or 0)
        if edges <= MAX_EDGES:
            other = here.select("key", F.col("id").alias("a")).join(here.select("key", F.col("id").alias("b")), "key").where("a < b").select("a", "b")
            gone = _decided(live.unionByName(other).distinct(), held, threshold)
            kept = kept.unionByName(open_rows.join(gone, "id", "left_anti")).checkpoint()
            break
        waits = live.select(F.col("b").alias("id")).unionByName(here.join(blocks, "key").where("id > head").select("id"))
        stay = open_rows.join(waits, "id", "left_anti").checkpoint()
        beside = blocks.join(stay, blocks["head"] == stay["id"], "left_semi")
        met = live.join(stay.select(F.col("id").alias("a")), "a", "left_semi").unionByName(
            here.join(beside, "key").where("id > head").select(F.col("head").alias("a"), F.col("id").alias("b"))).distinct().checkpoint()
        gone = verified(met, words, words, threshold).select(F.col("b").alias("id")).distinct().checkpoint()
        kept = kept.unionByName(stay)
        open_rows = open_rows.join(stay.unionByName(gone), "id", "left_anti").checkpoint()
        live = live.join(open_rows.select(F.col("id").alias("a")), "a", "left_semi").join(
            open_rows.select(F.col("id").alias("b")), "b", "left_semi").checkpoint()   # what the decided rows had to say is said
        here = here.join(open_rows, "id", "left_semi").select("key", "id").checkpoint()
    scratch.drop()
    staying = kept.unionByName(df.where(~has_word(text)).select(F.col(order).alias("id"))).withColumnRenamed("id", order)
    return df.join(staying, order, "left_semi")


def _decided(pairs: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """(id): the rows that go, by the candidates ``pairs`` (a < b) of rows (``held``: id, text) of which none is decided.

    The rule runs as if all candidates were similar, and for each row that goes the pair with the first
    row that stayed is verified. If all hold, this is the rule's result: a row that stays is
    similar to no earlier one that stays, and one that goes is to one. A pair that fails is no
    candidate any more, and the rule runs again, after all pairs of its later row are verified."""
    pairs = pairs.select("a", "b")
    got = pairs.toArrow()
    kind, n = got.schema.field("a").type, got.num_rows
    names = pc.unique(pa.concat_arrays([c for x in ("a", "b") for c in got.column(x).chunks] or [pa.array([], kind)]))
    names = names.take(pc.sort_indices(names))
    a, b = (pc.index_in(got.column(x), names).to_numpy().astype(np.int64) for x in ("a", "b"))
    place = np.lexsort((a, b))
    a, b = a[place], b[place]
    alive, sure, doubted = np.ones(n, bool), np.zeros(n, bool), np.zeros(len(names), bool)
    spark, schema = pairs.sparkSession, pairs.schema
    while True:
        stays, by = np.ones(len(names), bool), []
        own = np.flatnonzero(alive)
        starts = np.flatnonzero(np.r_[True, b[own][1:] != b[own][:-1]]) if len(own) else own
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(own)]):
            first = own[s:e][stays[a[own[s:e]]]]
            if len(first):
                stays[b[first[0]]] = False
                by.append(first[0])
        by = np.array(by, np.int64)
        if sure[by].all():
            out = names.take(pa.array(np.flatnonzero(~stays)))
            return spark.createDataFrame(pa.table({"id": out}), schema=f"id {schema["a"].dataType.simpleString()}")
        asked = np.flatnonzero(~sure & alive & (doubted[a] | doubted[b] | np.isin(np.arange(n), by)))
        rows = spark.createDataFrame(pa.table({"a": names.take(pa.array(a[asked])), "b": names.take(pa.array(b[asked]))}), schema=schema)
        x, y = (word_sets(without(held, rows.select(F.col(c).alias("id")).distinct(), "left_semi"), "id", "text") for c in ("a", "b"))
        true = verified(F.broadcast(rows), x, y, threshold).select("a", "b").distinct().toArrow()
        x, y = (pc.index_in(true.column(c).cast(kind), names).to_numpy().astype(np.int64) for c in ("a", "b"))
        holds = np.isin(a[asked] * len(names) + b[asked], x * len(names) + y)
        sure[asked[holds]] = True
        alive[asked[~holds]] = False
        doubted[b[np.intersect1d(asked[~holds], by)]] = True
