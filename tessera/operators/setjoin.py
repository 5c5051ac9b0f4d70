"""JOIN-9 as a join of tables: pairs of texts whose word sets have Jaccard >= t.

Words are ordered from the rarest up, so that similar sets share rare words early. By the
prefix rule two sets of Jaccard >= t share one of their first ``n - ceil(t n) + 1`` words;
more generally, with one word more for each, the first k words that they share lie in their
first ``n - ceil(t n) + k``. A block of one word that many rows have on both sides is not
compared all against all, unless that is less work than the longer keys of its rows: they go
on to blocks of that word and a second one, and then a third. What shares no more than the
block's words goes on to none, and is a result if those are enough.

Pairs are cut by length, by position (words that can still be shared) and by a bitmap of
each set before any word array travels: words flip bits, so two bitmaps differ in no more
bits than the sets in words. The remaining pairs are verified on the words themselves; word
hashes only deal rows to blocks and flip bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import jaccard_sets, py_strip, whitespace_set

#: A block whose smaller side has up to this many rows is compared; a larger one may be split by one more word.
SMALL_BLOCK = 64
#: Pairs of a block that cost as much as one longer key of a row, which is stored, shuffled and joined to the row's words.
KEY_COST = 4
#: Words of a block's key at most.
MAX_KEY = 3
#: A block of MAX_KEY words is not split; it is long over so many times the rows of a small one.
LAST_BLOCK = 8
#: Words that may be ordered by their count (16 bytes each are broadcast); rarer ones come before them by hash.
MAX_COUNTED = 1 << 20
#: Bits of a set's bitmaps: one for all candidates, and one for what is left, which are larger sets.
BITMAP, WIDE = 512, 4096
_EPS = 1e-6


def word_sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, words): the distinct whitespace words of each text that has any, sorted."""
    return df.where(has_word(text_col)).select(F.col(id_col).alias("id"), F.sort_array(whitespace_set(F.col(text_col))).alias("words"))


def has_word(text_col: str) -> Column:
    """Whether a text has a word: told on the text, for a filter on the words would cut them twice."""
    return F.length(py_strip(F.coalesce(F.col(text_col), F.lit("")))) > 0


def distinct_sets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, words) with one row per distinct set, the smallest id; (id, member) of all rows)."""
    # only the digests are kept; the words of the first rows are cut again, which is cheaper than a second copy of all
    keyed = sets.select("id", F.sha2(F.array_join("words", "\0"), 256).alias("d")).checkpoint()
    first = keyed.groupBy("d").agg(F.min("id").alias("first"))
    named = keyed.select("d", F.col("id").alias("member")).join(first, "d").select(F.col("first").alias("id"), "member")
    return sets.join(first.select(F.col("first").alias("id")), "id", "left_semi").select("id", "words").checkpoint(), named


def _common_words(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the words with the highest counts, at most MAX_COUNTED, by hash."""
    counts = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SMALL_BLOCK).checkpoint()
    step, room, least = F.floor(8 * F.log2("n")), MAX_COUNTED, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("w")).collect(), reverse=True):
        room -= r["w"]
        if room < 0:
            break
        least = r["step"]
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    top = counts.where(step >= least).orderBy("h").toArrow()
    return top.column("h").to_numpy(), top.column("n").to_numpy()


def ordered(sets: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, n, h, bits, wide): the word hashes of each set from the rarest up, and its bitmaps."""
    sent = sets.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = sent.value
        for b in (x.slice(i, 1024) for x in batches for i in range(0, x.num_rows, 1024)):
            lists = b.column(1)
            values, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            row, n = np.repeat(np.arange(len(sizes)), sizes), np.zeros(len(values), np.int64)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, values), len(hashes) - 1)
                n = np.where(hashes[at] == values, counts[at], 0)
            order = np.lexsort((values, n, row))
            flips = (np.bincount(row * WIDE + (values & (WIDE - 1)), minlength=len(sizes) * WIDE) & 1).astype(np.uint8)
            folded = np.bitwise_xor.reduce(flips.reshape(-1, WIDE // BITMAP, BITMAP), axis=1)

            def lists_of(x: np.ndarray, width: int) -> pa.ListArray:
                return pa.ListArray.from_arrays(pa.array((np.arange(len(sizes) + 1) * width).astype(np.int32)), pa.array(x))
            bits, wide = (lists_of(np.packbits(x.ravel(), bitorder="little").view(np.int64), w // 64) for x, w in ((folded, BITMAP), (flips, WIDE)))
            offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(values[order], pa.int64())),
                                              bits, wide], names=["id", "n", "h", "bits", "wide"])
    kind = sets.schema["id"].dataType.simpleString()
    return sets.select("id", F.transform("words", lambda w: F.xxhash64(w)).alias("h")).mapInArrow(
        run, f"id {kind}, n int, h array<bigint>, bits array<bigint>, wide array<bigint>")


def _prefix(n: Column, threshold: float, more: int) -> Column:
    """The words of a set of n among which the first ``1 + more`` shared ones lie."""
    return F.least(n, (n - F.ceil(n * threshold - _EPS) + 1 + more).cast("int"))


def _first_keys(side: DataFrame, threshold: float) -> DataFrame:
    """(key, id, n, at): the blocks of one word of each set."""
    return side.select(F.posexplode(F.slice("h", F.lit(1), _prefix(F.col("n"), threshold, 0))).alias("at", "key"), "id", "n") \
        .select("key", "id", "n", "at")


def _marked(rows: DataFrame, threshold: float, words: int, left: int, right: int) -> DataFrame:
    """(key, l, r, more): which sides a row counts on, and how many longer keys it has."""
    more = F.greatest(F.lit(0), _prefix(F.col("n"), threshold, words) - F.col("at") - 1).cast("long")
    return rows.select("key", F.lit(left).alias("l"), F.lit(right).alias("r"), more.alias("more"))


def _longer_keys(rows: DataFrame, side: DataFrame, threshold: float, words: int) -> DataFrame:
    """The blocks of one more word of the rows of blocks of ``words`` words."""
    later = F.slice("h", F.col("at") + 2, F.greatest(F.lit(0), _prefix(F.col("n"), threshold, words) - F.col("at") - 1))
    held = rows.select("key", "id", "at").join(side.select("id", "n", "h"), "id")
    return held.select("key", "id", "n", "at", F.posexplode(later).alias("step", "word")).select(
        F.xxhash64("key", "word").alias("key"), "id", "n", (F.col("at") + 1 + F.col("step")).alias("at"))


def _meet(left: DataFrame, right: DataFrame, threshold: float, words: int, same: bool) -> DataFrame:
    """(a, b): pairs of a block that pass the length and position filters for a key of ``words`` words."""
    x = left.select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"))
    y = right.select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"))
    need = threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - _EPS
    reach = words + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) - 1
    near = (F.col("na") >= F.col("nb") * threshold - _EPS) & (F.col("nb") >= F.col("na") * threshold - _EPS) & (reach >= need)
    pairs = x.join(y, "key").where(near)
    return (pairs.where("a < b") if same else pairs).select("a", "b")


def _enough(left: DataFrame, right: DataFrame, threshold: float, words: int, same: bool) -> DataFrame:
    """(a, b): pairs of a block for which its ``words`` words are enough, so that all are results."""
    few = F.col("n") <= words / threshold + _EPS
    x = left.where(few).select("key", F.col("id").alias("a"), F.col("n").alias("na"))
    y = right.where(few).select("key", F.col("id").alias("b"), F.col("n").alias("nb"))
    pairs = x.join(y, "key").where(threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - _EPS <= words)
    return (pairs.where("a < b") if same else pairs).select("a", "b")


def candidate_pairs(left: DataFrame, right: DataFrame | None, threshold: float, *, small_block: int = SMALL_BLOCK,
                    max_key: int = MAX_KEY, key_cost: float = KEY_COST) -> tuple[DataFrame, DataFrame]:
    """((a, b) candidates, (key, id) rows of blocks that are long at ``max_key`` words) of the ordered
    sets ``left`` and ``right`` (None: pairs a < b within ``left``). Long blocks of two tables are
    in the candidates too; those within one table are left to the caller."""
    same = right is None
    sides = [left] if same else [left, right]
    rows = [_first_keys(s, threshold) for s in sides]
    found: DataFrame | None = None

    def add(pairs: DataFrame) -> None:
        nonlocal found
        found = pairs if found is None else found.unionByName(pairs)
    for words in range(1, max_key + 1):
        marked = _marked(rows[0], threshold, words, 1, int(same))
        if not same:
            marked = marked.unionByName(_marked(rows[1], threshold, words, 0, 1))
        sizes = marked.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("l", "r", "more")]).where("l > 1" if same else "l > 0 AND r > 0")
        if words == max_key:
            long = F.least("l", "r") > LAST_BLOCK * small_block
        else:
            long = (F.least("l", "r") > small_block) & (F.expr("l * (l - 1) / 2" if same else "l * r") > key_cost * F.col("more"))
        sizes = sizes.select("key", long.alias("long"))
        met = [r.join(sizes, "key").checkpoint() for r in rows]
        small, long = ([m.where(c).drop("long") for m in met] for c in ("NOT long", "long"))
        add(_meet(small[0], small[-1], threshold, words, same).distinct())
        if words == max_key or not met[0].where("long").limit(1).count():
            break
        add(_enough(long[0], long[-1], threshold, words, same))
        rows = [_longer_keys(x, s, threshold, words) for x, s in zip(long, sides)]
    if not same:
        add(_meet(long[0], long[1], threshold, words, same))
    close = found.distinct()
    for name, bits in (("bits", BITMAP), ("wide", WIDE)):
        close = _by_bitmap(close, sides[0], sides[-1], threshold, name, bits)
    return close, long[0].select("key", "id")


def _by_bitmap(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float, name: str, bits: int) -> DataFrame:
    """Those of ``pairs`` whose bitmaps differ in no more bits than similar sets do in words."""
    x, y = (s.select(F.col("id").alias(c), F.col("n").alias("n" + c), F.col(name).alias("s" + c)) for s, c in ((left, "a"), (right, "b")))
    apart = F.zip_with("sa", "sb", lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    most = (1 - threshold) / (1 + threshold) * (F.col("na") + F.col("nb")) + _EPS
    return pairs.join(x, "a").join(y, "b").where(F.aggregate(apart, F.lit(0), lambda s, v: s + v) <= most).select("a", "b")


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard): those of ``pairs`` whose word sets (id, words) have Jaccard >= ``threshold``."""
    x, y = (s.select(F.col("id").alias(c), F.col("words").alias("w" + c)) for s, c in ((left, "a"), (right, "b")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", jaccard_sets(F.col("wa"), F.col("wb")).alias("jaccard")) \
        .where(F.col("jaccard") >= threshold)


def with_order(*sides: DataFrame) -> list[DataFrame]:
    """The ordered sets (id, n, h, bits, wide) of some tables of sets, by the word counts of all of them."""
    tokens = None
    for s in sides:
        own = s.select(F.explode(F.transform("words", lambda w: F.xxhash64(w))).alias("h"))
        tokens = own if tokens is None else tokens.unionByName(own)
    common = _common_words(tokens)
    return [ordered(s, common).checkpoint() for s in sides]


def jaccard_pairs(left: DataFrame, right: DataFrame, threshold: float = 0.7, *, left_id: str, right_id: str, left_text: str = "text",
                  right_text: str = "text", small_block: int = SMALL_BLOCK, max_key: int = MAX_KEY) -> DataFrame:
    """(left_id, right_id, jaccard) of every pair of rows whose whitespace word sets have Jaccard >=
    ``threshold`` (over 0). Texts without a word have no pair; equal texts are compared once; ids
    must be unique on their side and have different names. The last two parameters change the plan only."""
    if not threshold > 0 or left_id == right_id:
        raise ValueError("the threshold must be over 0 and the ids must have different names")
    (x, xs), (y, ys) = (distinct_sets(word_sets(d, i, t)) for d, i, t in ((left, left_id, left_text), (right, right_id, right_text)))
    pairs, _ = candidate_pairs(*with_order(x, y), threshold, small_block=small_block, max_key=max_key)
    same = verified(pairs, x, y, threshold)
    out = same.join(xs, same["a"] == xs["id"]).select(F.col("member").alias(left_id), "b", "jaccard")
    return out.join(ys, out["b"] == ys["id"]).select(left_id, F.col("member").alias(right_id), "jaccard")
