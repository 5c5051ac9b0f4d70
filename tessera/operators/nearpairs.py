"""Pairs of near copies within one table: candidates of Jaccard >= t for thresholds from LEAST on.

The words of a set are 32-bit hashes in ascending order (kept twice if two words meet in one), with a
first and a last mark around them. The keys of a set are its neighbours in that order, ``n + 1`` of them.
A word that is taken out undoes two keys and one that is put in undoes one, so that sets of na and nb
words that share o of them share ``3 o - na - nb + 1`` keys at least. By the prefix rule, sets that share
S keys of one common order share one of their first ``n + 1 - S + 1``; the order is from the rarest
up, by a table of counts. A key that no other set can have is left out. Unlike a word, a key of two
neighbours that was drawn at random from a common passage is rare, so no block need be split by more words.

Keys travel as columns of bytes, blocks are compared where they lie, and pairs are cut there by length, by
rank and by bitmaps of the sets, which are broadcast up to MAX_BITMAPS bytes and joined beyond.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import whitespace_set
from tessera.operators.setjoin import LAST_BLOCK, SMALL_BLOCK, has_word

#: From this threshold on sets share enough keys: ``(2 t - 1) n + 1`` of ``n + 1`` (0.2 of them here).
LEAST = 0.6
#: Slots of the table of key counts are 2 to the power of so much; two fit a byte.
LEAST_SLOTS, MOST_SLOTS = 16, 26
#: The table is added up in parts of 2 to the power of so many slots.
PART = 18
#: Bytes of bitmaps that are broadcast at most.
MAX_BITMAPS = 64 << 20
#: Ids that are broadcast at most, for a join with whole texts.
MAX_IDS = 1 << 20
#: Keys that a task holds before they are dealt out, and keys that a task compares.
HELD, COMPARED = 1 << 21, 1 << 20
#: Candidates of a task that are held before they are made distinct.
PAIRS = 1 << 22
#: A long block is left to the caller if this part of its pairs is candidates; else they are listed.
DENSE = 1 / 16
_EPS = 1e-6
_MARK = np.uint64(0xFFFFFFFF)


class Scratch:
    """A folder of tables in the checkpoint folder that are dropped when they are done with."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root = spark, f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/near-{uuid.uuid4()}"

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str = "") -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def without(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``df`` joined with some ids (semi or anti) without moving it, if they are few."""
    few = ids.limit(MAX_IDS + 1).count() <= MAX_IDS
    return df.join(F.broadcast(ids) if few else ids, ids.columns[0], how)


# --- columns of bytes -----------------------------------------------------------------------------

def _pack(*columns: np.ndarray) -> bytes:
    """64-bit columns as planes of bytes, which the shuffle's codec makes short."""
    return b"".join(np.ascontiguousarray(c.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)


def _unpack(blobs: list[bytes], columns: int) -> list[np.ndarray]:
    parts = [np.frombuffer(b, np.uint8).reshape(columns, 8, -1) for b in blobs]
    if not parts:
        return [np.empty(0, np.uint64)] * columns
    return [np.concatenate([np.ascontiguousarray(p[k].T).reshape(-1).view(np.uint64) for p in parts]) for k in range(columns)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _dealt(key: np.ndarray, parts: int, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(part, packed columns) of rows dealt by ``key``, sorted by the columns' order in each part."""
    part = (key % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=parts))
    for p in range(parts):
        own = order[ends[p - 1] if p else 0:ends[p]]
        if len(own):
            yield p, _pack(*[c[own] for c in columns])


def _blobs(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], names=["part", "blob"])


# --- sets and their keys ----------------------------------------------------------------------------

def hashed_sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, at, d, n, words): of each text with a word its number, the digest of its word set, its
    size and the sorted 32-bit hashes of its words as bytes."""
    words = F.sort_array(whitespace_set(F.col(text_col)))
    cut = df.where(has_word(text_col) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("at"), words.alias("w"))
    kind = cut.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            value, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32).view(np.uint32), np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
            value = np.sort((row << np.uint64(32)) | value).astype(np.uint32)
            ends = pa.array(np.r_[0, 4 * np.cumsum(sizes)].astype(np.int32)).buffers()[1]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sizes, pa.int32()),
                                              pa.Array.from_buffers(pa.binary(), len(sizes), [None, ends, pa.py_buffer(value.tobytes())])],
                                             names=["id", "at", "d", "n", "words"])
    return cut.select("id", "at", F.unhex(F.sha2(F.array_join("w", "\0"), 256)).alias("d"), F.transform("w", lambda w: F.hash(w)).alias("h")) \
        .mapInArrow(run, f"id {kind}, at bigint, d binary, n int, words binary")


def _words_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, n, hashes) of a batch of (at, n, words)."""
    value = b"".join(x.as_py() for x in b.column("words"))
    return b.column("at").to_numpy().astype(np.uint64), b.column("n").to_numpy().astype(np.int64), np.frombuffer(value, np.uint32)


def _keys(n: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all neighbours in the sets, in ascending order in each."""
    row = np.repeat(np.arange(len(n)), n + 1)
    left, right = np.zeros(len(row), np.uint64), np.full(len(row), _MARK)
    place = np.arange(len(value)) + np.repeat(np.arange(len(n)), n)
    right[place], left[place + 1] = value, value
    return row, (left << np.uint64(32)) | right


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _slots(key: np.ndarray, power: int) -> np.ndarray:
    return (_mixed(key) >> np.uint64(64 - power)).astype(np.int64)


class Levels:
    """How common a key is, by the count of its slot: 0 for a key that one set has only, up to 15."""

    def __init__(self, sets: DataFrame, power: int) -> None:
        self.power, self.part = power, min(PART, power)
        parts, part, unit = 1 << (power - self.part), self.part, np.uint64(1 << self.part)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out() -> pa.RecordBatch:
                slot, n = np.unique(np.concatenate(held), return_counts=True)
                ends = np.searchsorted(slot, np.arange(parts + 1) << part)
                return _blobs([(p, _pack(slot[s:e].astype(np.uint64) % unit | n[s:e].astype(np.uint64) << np.uint64(32)))
                               for p, s, e in zip(range(parts), ends[:-1], ends[1:]) if e > s])
            held: list[np.ndarray] = []
            for b in _slices(batches):
                _, n, value = _words_of(b)
                held.append(_slots(_keys(n, value)[1], power))
                if sum(map(len, held)) >= 2 * HELD:
                    yield out()
                    held = []
            if held:
                yield out()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for p, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    (x,) = _unpack([blob], 1)
                    sums.setdefault(p, np.zeros(1 << part, np.int64))[(x & _MARK).astype(np.int64)] += (x >> np.uint64(32)).astype(np.int64)
            for p, n in sums.items():
                level = np.minimum(15, np.floor(1.25 * np.log2(np.maximum(n, 1)))).astype(np.uint8)
                yield _blobs([(p, zlib.compress((level[::2] | level[1::2] << 4).tobytes(), 1))])
        found = sets.select("at", "n", "words").mapInArrow(count, "part int, blob binary").repartition("part").mapInArrow(add, "part int, blob binary")
        self.parts = {r["part"]: bytes(r["blob"]) for r in found.collect()}

    def table(self) -> np.ndarray:
        none = bytes(1 << (self.part - 1))
        return np.frombuffer(b"".join(zlib.decompress(self.parts[p]) if p in self.parts else none for p in range(1 << (self.power - self.part))), np.uint8)

    def of(self, table: np.ndarray, key: np.ndarray) -> np.ndarray:
        slot = _slots(key, self.power)
        return (table[slot >> 1] >> (4 * (slot & 1)).astype(np.uint8)) & 15


def prefix_keys(n: np.ndarray, threshold: float) -> np.ndarray:
    """How many keys of a set of n words count: sets down to ``threshold n`` words share the others."""
    return n + 2 - np.ceil((2 * threshold - 1) * n + 1 - _EPS).astype(np.int64)


def dealt_keys(sets: DataFrame, levels: Levels, threshold: float, parts: int) -> DataFrame:
    """(part, blob): of the rarest keys of each set key, number of the set, its size and the key's rank."""
    sent = sets.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, low = sent.value.table(), [], np.uint64((1 << 40) - 1)

        def out() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held)]
            return _blobs(list(_dealt(_mixed(columns[0]), parts, columns)))
        for b in _slices(batches):
            at, n, value = _words_of(b)
            row, key = _keys(n, value)
            level = sent.value.of(table, key).astype(np.uint64)
            own = np.arange(len(key), dtype=np.uint64)
            own = (np.sort(row.astype(np.uint64) << np.uint64(44) | level << np.uint64(40) | own) & low).astype(np.int64)
            rank = np.arange(len(key)) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1)
            few = own[rank < prefix_keys(n, threshold)[row]]
            rank = rank[rank < prefix_keys(n, threshold)[row]]
            rank, few = rank[level[few] > 0], few[level[few] > 0]
            held.append((key[few], at[row[few]], n[row[few]], rank))
            if sum(len(h[0]) for h in held) >= HELD:
                yield out()
                held = []
        if held:
            yield out()
    return sets.select("at", "n", "words").mapInArrow(run, "part int, blob binary")


# --- bitmaps -----------------------------------------------------------------------------------------

def widths(n: np.ndarray) -> np.ndarray:
    """Bits of a set's bitmap: a power of 2, not under its words."""
    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1)) - 1e-12).astype(np.int64))


def bitmaps(sets: DataFrame) -> DataFrame:
    """(at, n, bits): which of its bits an odd number of a set's words flips."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            at, n, value = _words_of(b)
            wide = widths(n)
            start = np.cumsum(wide) - wide
            flips = (np.bincount(np.repeat(start, n) + (value & np.repeat(wide - 1, n)), minlength=int(wide.sum())) & 1).astype(np.uint8)
            ends = pa.array(np.r_[0, np.cumsum(wide // 8)].astype(np.int32)).buffers()[1]
            bits = pa.py_buffer(np.packbits(flips, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("at"), b.column("n"), pa.Array.from_buffers(pa.binary(), len(n), [None, ends, bits])], names=["at", "n", "bits"])
    return sets.select("at", "n", "words").mapInArrow(run, "at bigint, n int, bits binary")


def _apart(x: np.ndarray, y: np.ndarray, rows: int, wide: int) -> np.ndarray:
    """In how many bits bitmaps differ, both folded to ``wide`` bits; ``rows`` of them in either."""
    x, y = (np.bitwise_xor.reduce(z.reshape(rows, -1, wide // 64), axis=1) for z in (x, y))
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


class Bitmaps:
    """All bitmaps, for ``close`` by numbers of sets."""

    def __init__(self, got: pa.Table) -> None:
        order = np.argsort(got.column("at").to_numpy())
        self.at = got.column("at").to_numpy()[order].astype(np.uint64)
        self.n = got.column("n").to_numpy()[order].astype(np.int64)
        bits = got.column("bits").combine_chunks().take(pa.array(order))
        self.words = np.frombuffer(b"".join(x.as_py() for x in bits), np.uint64)
        self.start = np.cumsum(widths(self.n) // 64) - widths(self.n) // 64

    def close(self, a: np.ndarray, b: np.ndarray, threshold: float, some: int = 1 << 15) -> np.ndarray:
        """Whether bitmaps differ in no more bits than similar sets do in words."""
        a, b = np.searchsorted(self.at, a), np.searchsorted(self.at, b)
        na, nb = self.n[a], self.n[b]
        wa, wb, most, out = widths(na), widths(nb), _most_apart(na, nb, threshold), np.zeros(len(a), bool)
        both = wa << 32 | wb
        for w in np.unique(both):
            own = np.flatnonzero(both == w)
            x, y = int(w >> 32) // 64, int(w & 0xFFFFFFFF) // 64
            step = max(1, some * 8 // max(x, y))
            for i in range(0, len(own), step):
                o = own[i:i + step]
                p, q = (self.words[self.start[s[o]][:, None] + np.arange(k)] for s, k in ((a, x), (b, y)))
                out[o] = _apart(p, q, len(o), 64 * min(x, y)) <= most[o]
        return out


def _shared(na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Words that similar sets of na and nb words share at least."""
    return np.ceil(threshold / (1 + threshold) * (na + nb) - _EPS)


def _most_apart(na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    return na + nb - 2 * _shared(na, nb, threshold)


def _joined_close(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): those of ``pairs`` whose bitmaps, joined to them, are close."""
    maps = bitmaps(sets)
    x, y = (maps.select(F.col("at").alias(c), F.col("n").alias("n" + c), F.col("bits").alias("bits" + c)) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            na, nb = (b.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            most = _most_apart(na, nb, threshold)
            far = [int(_apart(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), 1, min(len(x.as_py()), len(y.as_py())) * 8)[0])
                   for x, y in zip(b.column("bitsa"), b.column("bitsb"))]
            yield b.select(["a", "b"]).filter(pa.array(np.array(far, np.int64) <= most))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(run, "a bigint, b bigint")


# --- blocks ------------------------------------------------------------------------------------------

def _near(x: np.ndarray, y: np.ndarray, n: np.ndarray, rank: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs (places of rows) that pass by length and by the keys they can still share."""
    na, nb = n[x], n[y]
    reach = np.minimum(na - rank[x], nb - rank[y]) + 1
    return (na >= nb * threshold - _EPS) & (nb >= na * threshold - _EPS) & (reach >= 3 * _shared(na, nb, threshold) - na - nb + 1)


def _met(x: np.ndarray, last: np.ndarray, n: np.ndarray, rank: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs that pass ``_near`` of the rows ``x`` and the later ones of their blocks, which
    are sorted by n and end before ``last``."""
    x, last = x[x + 1 < last], last[x + 1 < last]
    step = 1
    while len(x):
        y = x + step
        ok = _near(x, y, n, rank, threshold)
        if ok.any():
            yield x[ok], y[ok]
        step += 1
        on = x + step < last
        x, last = x[on], last[on]
        on = n[x + step] * threshold - _EPS <= n[x]
        x, last = x[on], last[on]


def block_pairs(keys: DataFrame, tasks: int, parts: int, threshold: float, long_block: int, maps: Bitmaps | None) -> DataFrame:
    """(part, blob) of the candidates of the dealt keys: key, a and b; rows of blocks that are left whole have
    the key over 0 and no b. Pairs are distinct in each task only."""
    sent = None if maps is None else keys.sparkSession.sparkContext.broadcast(maps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, n, rank = _unpack([x for b in batches for x in b.column(1).to_pylist()], 4)
        if not len(key):
            return
        order = np.lexsort((n, key))
        key, at, n, rank = key[order], at[order], n[order].astype(np.int64), rank[order].astype(np.int64)
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        end = np.r_[start[1:], len(key)].astype(np.int64)
        size = end - start
        close = (lambda a, b: np.ones(len(a), bool)) if sent is None else (lambda a, b: sent.value.close(a, b, threshold))
        found, whole = [np.empty((0, 2), np.uint64)], []

        def distinct(x: list[np.ndarray]) -> np.ndarray:
            got = np.concatenate(x)
            got = got[np.lexsort((got[:, 1], got[:, 0]))]
            return got[np.r_[True, (got[1:] != got[:-1]).any(axis=1)]] if len(got) else got

        def list_pairs(rows: np.ndarray, last: np.ndarray) -> None:
            some: list[np.ndarray] = []

            def put() -> None:
                new = distinct(some)
                found.append(new[close(new[:, 0], new[:, 1])])
                if sum(map(len, found[1:])) >= PAIRS:
                    found[:] = [distinct(found)]
                some.clear()
            for x, y in _met(rows, last, n, rank, threshold):
                a, b = np.minimum(at[x], at[y]), np.maximum(at[x], at[y])
                some.append(np.stack([a, b], axis=1))
                if sum(map(len, some)) >= PAIRS:
                    put()
            if some:
                put()
        usual = np.flatnonzero(np.repeat((size > 1) & (size <= long_block), size))
        list_pairs(usual, np.repeat(end, size)[usual])
        for s, e in zip(start[size > long_block], end[size > long_block]):
            draw = np.random.default_rng(int(key[s]))
            x, y = draw.integers(s, e, 4096), draw.integers(s, e, 4096)
            x, y = x[x != y], y[x != y]
            near = _near(x, y, n, rank, threshold)
            near[near] = close(at[x][near], at[y][near])
            if near.sum() >= DENSE * len(x):
                whole.append(slice(s, e))
            else:
                list_pairs(np.arange(s, e), np.full(e - s, e))
        got = distinct(found)
        rows = [(np.zeros(len(got), np.uint64), got[:, 0], got[:, 1])] + [(_mixed(key[w]) | np.uint64(1), at[w], np.zeros(w.stop - w.start, np.uint64)) for w in whole]
        columns = [np.concatenate(c) for c in zip(*rows)]
        if len(columns[0]):
            yield _blobs(list(_dealt(_mixed(columns[1] ^ columns[0] * np.uint64(3)), parts, columns)))
    return keys.repartition(tasks, "part").mapInArrow(run, "part int, blob binary")


def _distinct_rows(found: DataFrame, tasks: int) -> DataFrame:
    """(key, a, b) of packed candidates, each once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[bytes]] = {}
        for b in batches:
            for p, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(p, []).append(blob)
        for blobs in by.values():
            key, a, b = _unpack(blobs, 3)
            order = np.lexsort((b, a, key))
            key, a, b = key[order], a[order], b[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(x[new].astype(np.int64)) for x in (key, a, b)], names=["key", "a", "b"])
    return found.repartition(tasks, "part").mapInArrow(run, "key bigint, a bigint, b bigint")


def near_pairs(sets: DataFrame, scratch: Scratch, threshold: float, *, small_block: int = SMALL_BLOCK) -> tuple[DataFrame, DataFrame]:
    """((a, b) candidates a < b, (key, id) rows of long blocks of near copies) of ``hashed_sets``, by id."""
    spark = sets.sparkSession
    stats = sets.groupBy("n").agg(F.count(F.lit(1)).alias("c")).toPandas()
    n, c = stats["n"].to_numpy(np.int64), stats["c"].to_numpy(np.int64)
    total, rows = int(((n + 1) * c).sum()), int((np.maximum(prefix_keys(n, threshold), 0) * c).sum())
    levels = Levels(sets, min(MOST_SLOTS, max(LEAST_SLOTS, math.ceil(math.log2(max(1, 2 * total))))))
    maps = Bitmaps(bitmaps(sets).toArrow()) if int(((widths(n) // 8 + 16) * c).sum()) <= MAX_BITMAPS else None
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(rows / COMPARED))
    keys = dealt_keys(sets, levels, threshold, 8 * tasks)
    found = block_pairs(keys, tasks, 8 * tasks, threshold, LAST_BLOCK * small_block, maps)
    met = scratch.keep("met", _distinct_rows(found, tasks))
    pairs, long = met.where("key = 0").select("a", "b"), met.where("key <> 0")
    if maps is None:
        pairs = _joined_close(pairs, sets, threshold)
    ids = sets.select("at", "id")
    named = pairs.join(ids.select(F.col("at").alias("a"), F.col("id").alias("x")), "a").join(
        ids.select(F.col("at").alias("b"), F.col("id").alias("y")), "b").where("x <> y")
    return (named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            long.join(ids, long["a"] == ids["at"]).select("key", "id"))
