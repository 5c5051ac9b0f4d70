"""Phrase collocations by vertical partitioning of a word suffix tree.

The suffix tree of all pieces, over words and cut off at ``max_words``, is never built
whole. Vertical partitioning splits it by word prefixes: a prefix that starts too many
suffixes for the memory budget is counted by its next words instead, in rounds, until
every prefix fits; its own count is known from the round that split it. The prefixes are
dealt to groups of about one budget each. Every suffix goes to the group of its
prefix, already summed per task, and each group builds its depth-truncated subtrees on
its own: the suffixes in order, whose common beginnings are the inner nodes. A
node's count is the total of the leaves below it.

Only words found ``min_count`` times can stand in a phrase, so others end a suffix. The
most frequent of them travel as numbers; a bit table of bounded size tells the rest, and a
false hit only adds leaves.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Separators of pieces become BREAK, a byte that UTF-8 never has; tabs become spaces.
BREAK = 0xFF
_STOP = bytes([BREAK])
_PLAIN = bytes(BREAK if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words are cut and counted from about this many bytes of text at a time.
CHUNK = 1 << 22
SEED = 42
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words that are numbered ahead and broadcast, the most frequent first.
MAX_TOP = 1 << 18
#: The bit table of the others has 16 bits a word, up to this many (16 MB).
MAX_BITS = 1 << 27
#: Prefixes that are split, of one round: their hashes are broadcast (8 bytes each).
MAX_SPLIT = 1 << 23
#: Groups at least, so that the same prefixes are split of small inputs.
MIN_GROUPS = 64
#: The langs with their sums are broadcast up to this many bytes.
MAX_BROADCAST_BYTES = 1 << 20


def _chunks(texts: Iterator[bytes], keep: int, size: int = 0) -> Iterator[tuple[list[bytes], int]]:
    """(tokens, own): the words of some texts, BREAK between pieces. Suffixes start at the first ``own``
    tokens; the rest, of a text longer than ``size``, is looked ahead into and comes again."""
    held, n, size = [], 0, size or CHUNK

    def tokens(part: bytes) -> list[bytes]:
        return part.replace(_STOP, b" \xff ").split()
    for t in texts:
        t = t.translate(_PLAIN)
        if len(t) > size:
            at, carried = 0, []
            while at < len(t):
                end = len(t)
                if end - at > size:
                    found = [x for x in (t.find(b" ", at + size), t.find(_STOP, at + size)) if x >= 0]
                    end = min(found, default=len(t))
                words = carried + tokens(t[at:end])
                at = end
                own = len(words) if at == len(t) else max(0, len(words) - keep)
                carried = words[own:]
                yield words, own
            continue
        held.append(t)
        n += len(t)
        if n >= size:
            words = tokens(_STOP.join(held))
            held, n = [], 0
            yield words, len(words)
    if held:
        words = tokens(_STOP.join(held))
        yield words, len(words)


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
    """(lang, texts) of runs of about CHUNK bytes each, over batches of (lang, text)."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    total = 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
            text = text.as_py()
            if text:
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
                total += len(text)
                if sizes[lang] >= CHUNK:
                    total -= sizes.pop(lang)
                    yield lang, iter(held.pop(lang))
                elif total >= 4 * CHUNK:                   # many languages share the room
                    lang = max(sizes, key=sizes.get)
                    total -= sizes.pop(lang)
                    yield lang, iter(held.pop(lang))
    for lang, texts in held.items():
        yield lang, iter(texts)


def _numbered(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """(distinct, ids): the distinct tokens, BREAK first, and each token's number."""
    numbers = {_STOP: 0}
    for w in dict.fromkeys(words):
        numbers.setdefault(w, len(numbers))
    return list(numbers), np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))


def _map(df: DataFrame, fn, schema: str, max_words: int) -> DataFrame:
    """``fn(lang, distinct, ids, own)`` gives a record batch or None for each chunk of ``df`` (lang, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _by_lang(batches):
            for words, own in _chunks(texts, max_words - 1):
                out = fn(lang, *_numbered(words), own) if own else None
                del words
                if out is not None:
                    yield out
        pa.default_memory_pool().release_unused()
    return df.mapInArrow(run, schema)


def word_counts(texts: DataFrame, max_words: int) -> DataFrame:
    """(lang, word, n): all words of each lang; the row without a word has the lang's sum."""
    def count(lang: str, distinct: list[bytes], ids: np.ndarray, own: int) -> pa.RecordBatch:
        n = np.bincount(ids[:own], minlength=len(distinct))
        n[0] = n[1:].sum()
        at = np.flatnonzero(n)
        words = [distinct[i].decode() if i else None for i in at.tolist()]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(words, pa.string()), pa.array(n[at])],
                                          names=["lang", "word", "n"])
    rows = _map(texts, count, "lang string, word string, n long", max_words)
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The words that can stand in a phrase. The most frequent of each lang, up to a bound, have
    numbers from 1 by falling count; the rest are told by a bit table over hashes of lang and word."""

    def __init__(self, top: dict[str, list[bytes]], keys: dict[str, np.ndarray], bits: int, blocks: dict[int, bytes]) -> None:
        self.top, self.keys, self.bits, self.blocks = top, keys, bits, blocks
        self.numbers: dict[str, dict[bytes, int]] = {}
        self.table: np.ndarray | None = None

    def __getstate__(self) -> tuple:
        return self.top, self.keys, self.bits, self.blocks

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def _in_table(self, hashes: np.ndarray) -> np.ndarray:
        if self.table is None:
            self.table = np.zeros(self.bits // 8, np.uint8)
            for block, b in self.blocks.items():
                self.table[block * 4096:block * 4096 + len(b)] = np.frombuffer(b, np.uint8)
        at = hashes & np.uint64(self.bits - 1)
        return (self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def number(self, lang: str, distinct: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """(numbers, more, hashes): each token's number (0: BREAK or in no phrase), the words whose numbers
        follow those of the lang's frequent ones, and the hash of every number."""
        top = self.top.get(lang, [])
        if lang not in self.numbers:
            self.numbers[lang] = dict(zip(top, range(1, len(top) + 1)))
        found = self.numbers[lang]
        out = np.fromiter((found.get(w, 0) for w in distinct), np.int64, len(distinct))
        out[0] = 0
        more, hashes = [], np.concatenate((np.zeros(1, np.uint64), self.keys.get(lang, np.empty(0, np.uint64))))
        if self.blocks:
            rest = np.flatnonzero(out == 0)[1:]
            h, seed = xxhash.xxh64_intdigest, xxhash.xxh64_intdigest(lang.encode(), SEED)
            own = np.fromiter((h(distinct[i], seed) for i in rest.tolist()), np.uint64, len(rest))
            kept = np.flatnonzero(self._in_table(own))
            rest = rest[kept]
            out[rest] = len(top) + 1 + np.arange(len(rest))
            more, hashes = [distinct[i] for i in rest.tolist()], np.concatenate((hashes, own[kept]))
        return out, more, hashes


def build_vocabulary(words: DataFrame, max_top: int) -> Vocabulary:
    """The vocabulary of ``words`` (lang, word, n): those of the highest counts, at most ``max_top``, are
    collected; a bit table of at most MAX_BITS is formed in Spark by blocks of 32,768 bits for the rest."""
    step = F.floor(8 * F.log2("n")).cast("int")
    room, least = max_top, None
    n_words = 0
    for r in sorted(words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("w")).collect(), reverse=True):   # under 500 rows
        n_words += r["w"]
        room -= r["w"]
        if room >= 0:
            least = r["step"]
    top: dict[str, list[bytes]] = {}
    keys: dict[str, list[int]] = {}
    is_top = step >= (least if least is not None else 1 << 30)
    for r in sorted(words.where(is_top).select("lang", "word", "n", F.xxhash64("lang", "word").alias("key")).collect(),
                    key=lambda r: (-r["n"], r["word"])):
        top.setdefault(r["lang"], []).append(r["word"].encode())
        keys.setdefault(r["lang"], []).append(r["key"])
    n_rest = n_words - sum(map(len, top.values()))
    bits, blocks = 1 << 15, {}
    if n_rest:
        bits = min(MAX_BITS, max(bits, 1 << (16 * n_rest - 1).bit_length()))
        at = words.where(~is_top).select(F.xxhash64("lang", "word").bitwiseAND(F.lit(bits - 1)).alias("at"))
        formed = at.select(F.shiftright("at", 15).alias("block"), F.col("at").bitwiseAND(F.lit((1 << 15) - 1)).alias("bit")) \
            .groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
        blocks = {r["block"]: bytes(r["bits"]) for r in formed.collect()}
    return Vocabulary(top, {k: np.array(v, np.int64).view(np.uint64) for k, v in keys.items()}, bits, blocks)


def _suffixes(line: np.ndarray, own: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, n): the distinct suffixes of two words or more of the first ``own`` places of ``line``, cut off at
    ``depth`` words and before a 0 (zeros follow), in order, with their counts.

    Runs of words are ranked by doubling: a run of 2 p words is the pair of the ranks of its halves,
    and a window the pair of the ranks of its first and last runs."""
    zero = line == 0
    first = ~(zero & np.r_[False, zero[:-1]])              # of zeros side by side one stays, made wide
    at = np.flatnonzero(first)
    at = np.repeat(at, np.where(zero[at], depth - 1, 1))
    wide = np.concatenate((line[at], np.zeros(2 * depth, np.int64)))
    m, run = len(at), 1
    starts = np.flatnonzero((wide[:m] > 0) & (wide[1:m + 1] > 0) & (at < own))
    if not len(starts):
        return np.zeros((0, depth), np.int64), np.empty(0, np.int64)
    rank, size = wide, int(wide.max()) + 1
    while 2 * run < depth:
        pair = rank[:m + depth] * size + np.concatenate((rank[run:m + depth], np.zeros(run, np.int64)))
        seen, rank = np.unique(pair, return_inverse=True)
        rank = np.concatenate((rank, np.zeros(depth, np.int64)))
        size, run = len(seen), 2 * run
    key, n = np.unique(rank[starts] * size + rank[starts + depth - run], return_counts=True)
    place = np.zeros(size, np.int64)
    place[rank[:m + depth - run]] = np.arange(m + depth - run)   # where each rank can be read
    a, b = place[key // size], place[key % size]
    cols = [wide[a + k] if k < run else wide[b + k - (depth - run)] for k in range(depth)]
    return np.stack(cols, axis=1), n


def _prefix_hash(hashes: np.ndarray, windows: np.ndarray, so_far: np.ndarray | None, k: int) -> np.ndarray:
    """The hash of the first k + 1 words from that of the first k."""
    h = hashes[windows[:, k]]
    if so_far is not None:
        h = (so_far * _MIX) ^ (h + (so_far >> np.uint64(29)))
    return h ^ (h >> np.uint64(32))


def _is_in(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(h), bool)
    at = np.searchsorted(table, h)
    at[at == len(table)] = 0
    return table[at] == h


def split_counts(texts: DataFrame, vocabulary: Vocabulary, split: list[np.ndarray], max_words: int) -> DataFrame:
    """(lang, phrase, key, n): the counts of the prefixes one word longer than those ``split`` last."""
    spark, depth = texts.sparkSession, len(split) + 1
    shared = spark.sparkContext.broadcast((vocabulary, split))

    def count(lang: str, distinct: list[bytes], ids: np.ndarray, own: int) -> pa.RecordBatch | None:
        vocabulary, split = shared.value
        numbers, more, hashes = vocabulary.number(lang, distinct)
        words = [b"", *vocabulary.top.get(lang, []), *more]
        windows, n = _suffixes(numbers[ids], own, depth)
        keep, h = windows[:, depth - 1] > 0, None
        for k, table in enumerate(split):
            h = _prefix_hash(hashes, windows, h, k)
            keep &= _is_in(table, h)
        if not keep.any():
            return None
        h = _prefix_hash(hashes, windows, h, depth - 1)[keep].view(np.int64)
        phrases = [b" ".join([words[i] for i in w]).decode() for w in windows[keep].tolist()]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(phrases, pa.string()), pa.array(h),
                                           pa.array(n[keep])], names=["lang", "phrase", "key", "n"])
    rows = _map(texts, count, "lang string, phrase string, key long, n long", max_words)
    return rows.groupBy("lang", "phrase", "key").agg(F.sum("n").alias("n"))


def _pack(columns: np.ndarray) -> bytes:
    """Columns of non-negative integers, in the narrowest type that holds them, compressed."""
    most = int(columns.max(initial=0))
    kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64
    raw = np.ascontiguousarray(columns, dtype=kind).tobytes()
    return bytes([np.dtype(kind).itemsize]) + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes, rows: int, n: int) -> np.ndarray:
    width = packed[0]
    raw = pa.decompress(packed[1:], rows * n * width, codec="zstd", asbytes=True)
    return np.frombuffer(raw, f"<u{width}").reshape(rows, n)


LEAVES = "grp int, lang string, n_leaves int, more binary, leaves binary, counts binary"


def leaves(texts: DataFrame, shared: Broadcast, groups: int, max_words: int) -> DataFrame:
    """LEAVES: per chunk and group the suffixes as numbers, the number of words of their prefix in
    the partition (last row of ``leaves``), their counts, and the words behind the numbers that
    only this row has. ``shared``: the vocabulary and the keys of the split prefixes by length."""
    def deal(lang: str, distinct: list[bytes], ids: np.ndarray, own: int) -> pa.RecordBatch | None:
        vocabulary, split = shared.value
        numbers, more, hashes = vocabulary.number(lang, distinct)
        windows, n = _suffixes(numbers[ids], own, max_words)
        if not len(n):
            return None
        length = (windows > 0).sum(axis=1)
        h = _prefix_hash(hashes, windows, None, 0)
        depth, open_ = np.ones(len(n), np.int64), np.ones(len(n), bool)
        for k, table in enumerate(split):                  # a split prefix goes on by its next word
            open_ &= _is_in(table, h)
            depth += open_
            open_ &= length > k + 1
            if not open_.any():
                break
            h = np.where(open_, _prefix_hash(hashes, windows, h, k + 1), h)
        left = np.flatnonzero(depth <= length)             # one that ends with its split prefix is counted already
        group = ((h[left] * _MIX) >> np.uint64(33)) % np.uint64(groups)
        order = np.argsort(group, kind="stable")
        group, left = group[order].astype(np.int64), left[order]
        heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
        known = len(hashes) - len(more)                    # numbers from here on are those of ``more``
        out: list[tuple] = []
        for a, e in zip(heads.tolist(), [*heads[1:].tolist(), len(group)]):
            at = left[a:e]
            some, own_words = windows[at], b""
            if more and (rare := some >= known).any():
                used, again = np.unique(some[rare], return_inverse=True)
                some[rare] = known + again
                own_words = _STOP.join([more[i] for i in (used - known).tolist()])
            cols = np.concatenate((some.T, depth[at][None]))
            out.append((int(group[a]), lang, e - a, own_words, _pack(cols), _pack(n[at][None])))
        if not out:
            return None
        types = [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        names = [f.split()[0] for f in LEAVES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)
    return _map(texts, deal, LEAVES, max_words)


def _subtree(rows: list[dict], top: list[bytes], max_words: int, min_count: int) -> tuple[list[str], np.ndarray]:
    """(phrases, counts): the nodes of two words or more, at or below their prefix, of a lang's subtrees in one group."""
    known = len(top) + 1
    rare: dict[bytes, int] = {}
    parts, sums = [], []
    for r in rows:
        cols = _unpack(r["leaves"], max_words + 1, r["n_leaves"]).astype(np.int32)
        if r["more"]:
            own = [rare.setdefault(w, len(rare)) for w in r["more"].split(_STOP)]
            some = cols[:-1]
            at = some >= known
            some[at] = known + np.array(own, np.int32)[some[at] - known]
        parts.append(cols)
        sums.append(_unpack(r["counts"], 1, r["n_leaves"])[0].astype(np.int64))
    cols, n = np.concatenate(parts, axis=1), np.concatenate(sums)
    del parts, sums
    keys = list(cols[:max_words])
    if known + len(rare) < 1 << 21:                        # three numbers in one
        keys = [functools.reduce(lambda a, c: a << 21 | c, keys[i:i + 3], np.int64(0)) for i in range(0, max_words, 3)]
    order = np.lexsort(keys[::-1])
    del keys
    cols, n = cols[:, order], n[order]
    words = [b"", *top, *rare]
    phrases, counts = [], []
    new = np.zeros(len(n), bool)
    new[:1] = True
    for k in range(max_words):                             # a node of k + 1 words: leaves that begin alike
        new[1:] |= cols[k, 1:] != cols[k, :-1]
        if not k:
            continue
        head = np.flatnonzero(new)
        total = np.add.reduceat(n, head)
        keep = (total >= min_count) & (cols[k, head] > 0) & (cols[max_words, head] <= k + 1)
        counts.append(total[keep])
        phrases += [b" ".join([words[i] for i in w]).decode() for w in cols[:k + 1, head[keep]].T.tolist()]
    return phrases, np.concatenate(counts)


def subtree_counts(packed: DataFrame, shared: Broadcast, max_words: int, min_count: int) -> DataFrame:
    """(lang, phrase, f): the phrases of two words or more found ``min_count`` times, but those that were split."""
    def run(group: pa.Table) -> pa.Table:
        top = shared.value[0].top
        by_lang: dict[str, list[dict]] = {}
        for r in group.to_pylist():
            by_lang.setdefault(r["lang"], []).append(r)
        out = [(lang, *_subtree(rows, top.get(lang, []), max_words, min_count)) for lang, rows in by_lang.items()]
        pa.default_memory_pool().release_unused()
        return pa.table({"lang": pa.array([x for lang, p, _ in out for x in [lang] * len(p)], pa.string()),
                         "phrase": pa.array([x for _, p, _ in out for x in p], pa.string()),
                         "f": pa.array(np.concatenate([c for _, _, c in out]), pa.int64())})
    return packed.groupBy("grp").applyInArrow(run, "lang string, phrase string, f long")


def phrase_counts(texts: DataFrame, *, max_words: int = 5, min_count: int = 100, budget: int = 1 << 22,
                  max_top: int = MAX_TOP) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f), (lang, n)) of ``texts`` (lang, text): every phrase of 1 to ``max_words`` words that is
    found ``min_count`` times or more, and all words of each lang. ``budget``: suffixes that a task may hold
    for one group; ``max_top``: words that are numbered ahead. Both change the plan only, not the counts."""
    spark = texts.sparkSession
    counted = word_counts(texts, max_words)
    words = checkpoint(counted.where((F.col("n") >= min_count) | F.col("word").isNull()))
    common = words.where("word IS NOT NULL")
    suffixes = common.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = max(MIN_GROUPS, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * suffixes // budget))
    too_many = max(suffixes // (4 * groups), suffixes // MAX_SPLIT, min_count)
    vocabulary = build_vocabulary(common, max_top)
    total = words.where("word IS NULL").select("lang", "n")
    found = [common.select("lang", F.col("word").alias("phrase"), F.col("n").alias("f"))]
    heads = common.where(F.col("n") > too_many).select(F.xxhash64("lang", "word").alias("key"))
    split: list[np.ndarray] = []
    while len(split) < max_words - 1:
        keys = np.array([r["key"] for r in heads.collect()], np.int64).view(np.uint64)     # at most MAX_SPLIT
        if not len(keys):
            break
        keys = keys ^ (keys >> np.uint64(32)) if not split else keys
        split.append(np.unique(keys))
        if len(split) == max_words - 1:
            break
        longer = checkpoint(split_counts(texts, vocabulary, split, max_words).where(F.col("n") >= min_count))
        heads = checkpoint(longer.where(F.col("n") > too_many).select("key").distinct())
        found.append(longer.join(heads, "key", "left_semi").select("lang", "phrase", F.col("n").alias("f")))
    shared = spark.sparkContext.broadcast((vocabulary, split))
    found.append(subtree_counts(leaves(texts, shared, groups, max_words), shared, max_words, min_count))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return checkpoint(out), total


def collocations(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_words: int = 5, min_count: int = 100,
                 absorb: int = 100, top: int = 2000, budget: int = 1 << 22, max_top: int = MAX_TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of 2 to ``max_words`` words of each lang.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, those into words at
    spaces and tabs. a, l and r are how often a phrase, its first and its second part at
    the lowest-scoring cut occur, n all words of the lang; score = floor(1000 a n / (l r)) in exact decimals.
    A phrase inside a longer one that has ``absorb`` percent of its occurrences is left out. If any
    phrase has it, one of one more word has it, for its count lies between.

    A null text is empty, a null lang is ``und``; repeated rows count each time; an empty table
    gives no rows; other columns are ignored."""
    texts = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                      F.col(f"`{text_col}`").cast("string").alias("text")).where("text IS NOT NULL")
    counts, totals = phrase_counts(texts, max_words=max_words, min_count=min_count, budget=budget, max_top=max_top)
    phrases = counts.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 1)

    def some(first, n):
        return F.array_join(F.slice("words", first, n), " ")
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")) \
        .select("lang", "phrase", "a", "k", some(F.lit(1), F.col("k")).alias("head"), some(F.col("k") + 1, F.size("words")).alias("tail"))
    part = counts.select(F.col("lang").alias("lang2"), F.col("phrase").alias("part"), "f")
    for side, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(part.withColumnRenamed("f", name), (F.col("lang") == F.col("lang2")) & (F.col(side) == F.col("part"))) \
            .drop("lang2", "part", side)
    wide = [f"CAST({c} AS DECIMAL(20,0))" for c in ("a", "n", "l", "r")]
    size = totals.agg(F.coalesce(F.sum(F.octet_length("lang") + 16), F.lit(0))).first()[0]
    scored = cuts.join(F.broadcast(totals) if size <= MAX_BROADCAST_BYTES else totals, "lang") \
        .withColumn("score", F.expr("(1000 * {} * {}) div ({} * {})".format(*wide)))
    cut = F.struct("score", "k", "l", "r", "n", "a")
    lowest = scored.groupBy("lang", "phrase").agg(F.min(cut).alias("c")).select("lang", "phrase", "c.a", "c.l", "c.r", "c.n", "c.score")
    longer = phrases.where(F.size("words") > 2).select("lang", "f", F.explode(F.array(
        some(F.lit(2), F.size("words")), some(F.lit(1), F.size("words") - 1))).alias("phrase")) \
        .groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < absorb * F.col("a"))).drop("longer")
    ranks = "row_number() OVER (PARTITION BY lang{} ORDER BY score DESC, a DESC, phrase)"
    some_of = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))) \
        .withColumn("rank", F.expr(ranks.format(", part"))).where(F.col("rank") <= top)    # no lang meets in one task
    return some_of.withColumn("rank", F.expr(ranks.format("")).cast("long")).where(F.col("rank") <= top) \
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
