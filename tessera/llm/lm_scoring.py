"""Cross-entropy difference scoring with matched n-gram models.

A target model (documents labelled good) and a background model (all documents) are
word bigram models over one vocabulary and one set of bigrams: every word, of any length,
and every bigram of at least 2 (a single one is gone when its own document is held out).
Their counts are Spark tables of any size, keyed by 64-bit word hashes. Probabilities are
interpolated with add-one unigrams; a document's own counts are taken off the models
that it helped to train. The loss difference of a token is its target loss less its
background loss; a document's score is the mean over its tokens: low is like the target.

The most frequent n-grams, up to a fixed number, are also broadcast, which keeps hot keys
out of the shuffle; a document's other n-grams are joined to the tables.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, checkpoint, texts

#: Bounds of what is broadcast, not of the models: words and bigrams, 24 bytes each.
VOCABULARY, MAX_BIGRAMS = (1 << 16) - 2, 1_000_000
#: The bits (a power of 2) that say which n-grams may be in the tables, so that most single ones are
#: not shuffled; full bits only let more through.
SIEVE_BITS = 1 << 27
#: The ids of the target's documents are broadcast up to this size, at so many bytes an id.
MAX_BROADCAST, ID_BYTES = 64 << 20, 16
#: Weight of the bigram part in the interpolation.
BIGRAM_WEIGHT = 0.6
#: In place of a word's hash before a text's first word.
START = 1
#: What the join adds to a document is summed as whole numbers of this part, so that reruns agree.
PART = 2.0 ** -34
#: In place of a left word's hash: a row of a word (START: of a text's first bigram).
WORD_ROW = 0
#: Documents that are counted at a time where all words and bigrams are.
COUNT_ROWS = 2048


def least_count(counts: DataFrame, most: int, lowest: int = 1) -> int:
    """The smallest count of at least ``lowest`` such that no more than ``most`` rows of
    ``counts`` (n) have it or a larger one. Spark counts the counts; at most ``most`` of
    them are looked at, from the largest down."""
    held, least = 0, None
    by_count = counts.where(F.col("n") >= lowest).groupBy("n").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.col("n").desc())
    for r in by_count.toLocalIterator():
        held += r["rows"]
        if held > most:
            return least if least is not None else r["n"] + 1
        least = r["n"]
    return lowest


def _hashed(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the batch's distinct words, ascending, and START; row, left and right word of each
    token, as positions in them; tokens of each text)."""
    words: defaultdict[bytes, int] = defaultdict()
    words.default_factory = words.__len__
    ids = [np.array([words[w] for w in t.lower().split()], np.int64) for t in batch]
    size = np.array([len(x) for x in ids], np.int64)
    h = xxhash.xxh64_intdigest
    hashes = np.array([*map(h, words)], np.uint64).view(np.int64)
    order = np.argsort(hashes)                             # sums over a text then do not hang on its batch
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    hashes = np.append(hashes[order], START)
    right = place[np.concatenate([*ids, np.zeros(0, np.int64)])]
    left = np.concatenate(([0], right[:-1])) if len(right) else right
    left[(np.cumsum(size) - size)[size > 0]] = len(words)
    return hashes, np.repeat(np.arange(len(batch)), size), left, right, size


def _key(left, right):
    """One number for an n-gram of two hashes."""
    return left ^ (right << 1)


def _with_key(df: DataFrame) -> DataFrame:
    return df.withColumn("k", F.col("l").bitwiseXOR(F.shiftleft("r", 1)))


def gram_counts(df: DataFrame) -> DataFrame:
    """(l, r, n, t): how often each word (l = WORD_ROW) and each bigram is in all rows of ``df``
    (text, target) and in the target rows; single bigrams are left out."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        hashes, row, left, right, _ = _hashed(texts(b.column("text")))
        target = b.column("target").to_numpy(zero_copy_only=False).astype(float)[row]
        pair, at, n = np.unique(left * len(hashes) + right, return_inverse=True, return_counts=True)
        own = np.bincount(right, minlength=len(hashes) - 1)
        cols = [np.concatenate((np.full(len(own), WORD_ROW), hashes[pair // len(hashes)])),
                np.concatenate((hashes[:-1], hashes[pair % len(hashes)])), np.concatenate((own, n)),
                np.concatenate((np.bincount(right, weights=target, minlength=len(own)), np.bincount(at, weights=target, minlength=len(n))))]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["l", "r", "n", "t"])
    counted = arrow_map(df.select("text", "target"), run, "l long, r long, n long, t long", rows=COUNT_ROWS)
    return counted.groupBy("l", "r").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).where((F.col("n") > 1) | (F.col("l") == WORD_ROW))


class Hot:
    """The counts of the n-grams that are broadcast: ``of`` gives (2, rows) counts, target
    first, and which of the rows are known."""

    def __init__(self, rows: DataFrame) -> None:
        got = rows.select("l", "r", "t", "n").toArrow()
        left, right, t, n = (got.column(c).to_numpy() for c in ("l", "r", "t", "n"))
        key = _key(left, right)
        order = np.argsort(key)
        self.key, self.count = key[order], np.stack([t, n])[:, order]

    def of(self, left, right) -> tuple[np.ndarray, np.ndarray]:
        key = _key(left, right)
        if not len(self.key):
            return np.zeros((2, len(key))), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        known = self.key[at] == key
        return np.where(known, self.count[:, at], 0).astype(float), known


def _sieve(rows: DataFrame) -> np.ndarray:
    """Two bits set for each n-gram of ``rows`` (k: its key)."""
    key = F.col("k")
    bits = rows.select(F.explode(F.array(*[x.bitwiseAND(F.lit(SIEVE_BITS - 1)) for x in (key, F.shiftright(key, 32))])).alias("p"))
    got = bits.groupBy(F.shiftright("p", 6).alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 AS int)))").alias("b")).toArrow()
    out = np.zeros(SIEVE_BITS >> 6, np.int64)
    out[got.column("i").to_numpy()] = got.column("b").to_numpy()
    return out


def _may_be(sieve: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    key = _key(left, right)
    known = np.ones(len(key), bool)
    for x in (key, key >> 32):
        p = x & (SIEVE_BITS - 1)
        known &= (sieve[p >> 6] >> (p & 63)) & 1 == 1
    return known


def _with_words(pairs: DataFrame, hot: DataFrame, cold: DataFrame, start: tuple[int, int]) -> DataFrame:
    """``pairs`` with the counts of their left (ct, cn) and right words (ut, un). Pairs of a hot
    word meet it by broadcast and are spread in the join with the cold ones."""
    for key, to in (("l", "c"), ("r", "u")):
        side = hot.select(F.col("r").alias("hw"), F.col("t").alias("ht"), F.col("n").alias("hn"))
        rest = cold.select(F.col("r").alias("w"), F.col("t").alias("wt"), F.col("n").alias("wn"))
        met = pairs.join(F.broadcast(side), F.col(key) == F.col("hw"), "left")
        known = F.col("hw").isNotNull() | (F.col(key) == START)
        met = met.withColumn("by", F.when(known, F.xxhash64("l", "r")).otherwise(F.col(key))).join(rest, F.col("by") == F.col("w"), "left")
        pairs = met.select(*pairs.columns, *[F.when(F.col(key) == START, F.lit(s)).otherwise(F.coalesce("h" + m, "w" + m)).alias(to + m)
                                             for m, s in zip("tn", start)])
    return pairs


def _corrected(totals: tuple[int, int], size: int) -> Column:
    """What a row of ``score`` joined to its counts adds to its document's sum of differences:
    a word its loss less that of an unseen word, a bigram its loss less that of its word alone."""
    total = F.lit(0.0)
    for m, sign, off in (("t", 1, F.col("target").cast("long")), ("n", -1, F.lit(1).cast("long"))):
        base = F.lit(float(totals[m == "n"])) - off * F.col("n_tokens") + F.lit(float(size))
        is_word = F.col("l") == WORD_ROW
        word = F.when(is_word, F.col(m)).otherwise(F.col("u" + m)) - off * F.col("own_r") + F.lit(1.0)
        alone = F.lit(1 - BIGRAM_WEIGHT) * word / base
        pair = F.greatest(F.col(m) - off * F.col("own"), F.lit(0).cast("long")).cast("double")
        context = F.greatest((F.col("c" + m) - off * F.col("own_l")).cast("double"), pair, F.lit(1.0))
        gain = F.when(is_word, F.log2(word)).otherwise(F.log2(F.lit(BIGRAM_WEIGHT) * pair / context + alone) - F.log2(alone))
        total = total - F.lit(sign) * F.col("own") * gain
    return total


def score(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
          label_col: str = "quality") -> DataFrame:
    """doc_id, n_tokens, in_target, loss_difference (bits per token; 0 without tokens).

    The target is the rows whose id has a label of 1 (of several labels the largest counts;
    a null label or id is none). Null or blank texts have no tokens; repeated rows count
    each; an empty target gives the uniform target model; an empty table gives no rows."""
    good = checkpoint(labels.groupBy(F.col(f"`{label_id}`").cast("bigint").alias("id")).agg(
        F.max(f"`{label_col}`").alias("q")).where("q = 1 AND id IS NOT NULL").select("id"))
    side = F.broadcast(good) if good.count() * ID_BYTES <= MAX_BROADCAST else good
    src = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                    F.monotonically_increasing_id().alias("row"))
    marked = src.join(side, src["doc_id"] == side["id"], "left").select("row", "doc_id", "text", F.col("id").isNotNull().alias("target"))
    grams = checkpoint(gram_counts(marked))
    words, pairs = grams.where(F.col("l") == WORD_ROW), grams.where(F.col("l") != WORD_ROW)
    distinct, *totals = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    start = tuple(pairs.where(F.col("l") == START).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("t", "n")]).first())
    size = distinct + 2                                    # add-one smoothing: all words, an unseen one and the start
    # a word is no rarer than its bigrams: the words of a hot bigram are hot
    word_least = least_count(words, VOCABULARY, lowest=2)
    pair_least = max(least_count(pairs, MAX_BIGRAMS, lowest=2), word_least)
    hot_words, cold_words = words.where(F.col("n") >= word_least), words.where((F.col("n") > 1) & (F.col("n") < word_least))
    cold_pairs = pairs.where(F.col("n") < pair_least)
    cold = cold_words.unionByName(cold_pairs)
    sent = df.sparkSession.sparkContext.broadcast((Hot(hot_words), Hot(pairs.where(F.col("n") >= pair_least)), _sieve(_with_key(cold))))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        hot, hot_pairs, sieve = sent.value
        hashes, row, left, right, n = _hashed(texts(b.column("text")))
        member, width = b.column("target").to_numpy(zero_copy_only=False).astype(np.int64), len(hashes)
        word, own = np.unique(row * width + right, return_counts=True)
        w_row, w = word // width, word % width
        distinct_pair, pair = np.unique(left * width + right, return_inverse=True)
        times = max(len(distinct_pair), 1)
        pair, n_pair = np.unique(row * times + pair, return_counts=True)
        p_row, which = pair // times, pair % times
        l, r = distinct_pair[which] // width, distinct_pair[which] % width
        own_r = own[np.searchsorted(word, p_row * width + r)]
        own_l = np.ones(len(l), np.int64)
        inner = l < width - 1
        own_l[inner] = own[np.searchsorted(word, (p_row * width + l)[inner])]
        count, hot_word = hot.of(np.full(width, WORD_ROW), hashes)
        pairs_of, hot_pair = hot_pairs.of(hashes[distinct_pair // width], hashes[distinct_pair % width])
        known = hot_pair[which]
        total = np.zeros(len(n))
        for m, sign in ((0, 1), (1, -1)):
            off = member if m == 0 else np.ones(len(n), np.int64)
            base = totals[m] - off * n + size
            unigram = np.where(hot_word[w], count[m][w] - off[w_row] * own, 0)
            total -= sign * np.bincount(w_row, weights=own * np.log2((1 - BIGRAM_WEIGHT) * (unigram + 1.0) / base[w_row]), minlength=len(n))
            i, at, a, z = p_row[known], which[known], l[known], r[known]
            p = np.maximum(pairs_of[m][at] - off[i] * n_pair[known], 0.0)
            context = np.where(a == width - 1, float(start[m]), count[m][a]) - off[i] * own_l[known]
            alone = (1 - BIGRAM_WEIGHT) * (count[m][z] - off[i] * own_r[known] + 1.0) / base[i]
            both = BIGRAM_WEIGHT * p / np.maximum(np.maximum(context, p), 1.0) + alone
            total -= sign * np.bincount(i, weights=n_pair[known] * (np.log2(both) - np.log2(alone)), minlength=len(n))
        ask_w = np.flatnonzero(~hot_word[w])
        ask_w = ask_w[_may_be(sieve, np.full(len(ask_w), WORD_ROW), hashes[w[ask_w]])]
        ask_p = np.flatnonzero(~known)
        ask_p = ask_p[_may_be(sieve, hashes[l[ask_p]], hashes[r[ask_p]])]
        rows = np.concatenate((np.arange(len(n)), w_row[ask_w], p_row[ask_p]))
        asked = len(rows) - len(n)
        ident = b.column("row").to_numpy()
        zero = np.zeros(len(n), np.int64)
        longs = {"k": np.concatenate((ident, _key(WORD_ROW, hashes[w[ask_w]]), _key(hashes[l[ask_p]], hashes[r[ask_p]]))),
                 "row": ident[rows], "n_tokens": n[rows],
                 "own": np.concatenate((zero, own[ask_w], n_pair[ask_p])), "own_l": np.concatenate((zero, 0 * ask_w, own_l[ask_p])),
                 "own_r": np.concatenate((zero, own[ask_w], own_r[ask_p]))}
        nothing = pa.nulls(asked, pa.int64())
        return pa.RecordBatch.from_arrays(
            [*[pa.array(x) for x in longs.values()], pa.array(member[rows] == 1), pa.concat_arrays([b.column("doc_id"), nothing]),
             pa.array(np.concatenate((total, np.zeros(asked))))], names=[*longs, "target", "doc_id", "total"])
    asked = arrow_map(marked, run, "k long, row long, n_tokens long, own long, own_l long, own_r long, target boolean, doc_id long, total double")
    none = F.lit(None).cast("long")
    tables = _with_words(cold_pairs, hot_words, cold_words, start).unionByName(
        cold_words.select("l", "r", "n", "t", *[none.alias(c) for c in ("ct", "cn", "ut", "un")]))
    own_row = F.col("own") == 0                            # the document's own row; the others ask for an n-gram
    summed = asked.join(_with_key(tables).drop("r"), "k", "left").where(own_row | F.col("n").isNotNull()).select(
        "row", "doc_id", "n_tokens", "target", F.when(own_row, F.col("total")).alias("total"),
        F.when(~own_row, F.round(_corrected(totals, size) / F.lit(PART)).cast("long")).alias("more"))
    # doc_id and total are in the document's own row only
    out = summed.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.max("target").alias("in_target"),
                                    (F.max("total") + F.coalesce(F.sum("more"), F.lit(0)) * F.lit(PART)).alias("total"))
    return out.select("doc_id", "n_tokens", "in_target", (F.col("total") / F.greatest("n_tokens", F.lit(1))).alias("loss_difference"))
