"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

Blocks of documents are cut into pre-tokens; the distinct ones become an array column of strings, a character for each byte's id.
``aggregate`` folds the ranked merges over each: a step is one merge of the vocabulary, and ``replace`` puts the character of the
token it makes in the place of its pair, from the left, wherever the pair stands. Merges come in the order of their ranks, and only those
whose token's bytes stand in the word: no other can ever apply. The pairs and the tokens they make are literal arrays, read by rank, that stand in the one row of a local
relation: as an expression their text would be in every description of the plan that the driver holds. The ids of the words then
take the place of the words' numbers in the documents. Decoding concatenates the byte pieces of
the ids. All of it happens in the task that read the documents; nothing is shuffled.

That order is the library's (always the lowest rank that stands in the word) if each token is made by one pair out of its own bytes, as training
leaves it (``token_pairs``): where a token's bytes start and end on tokens, they were that pair when its turn came. In any other
vocabulary a merge may bring up a pair of lower rank than its own; there the fold looks for it at each step. Its state is one integer a token (the rank of the pair
that starts with it, its place, its id), so the smallest integer is the leftmost pair of lowest rank. A step merges that pair and looks up the
ranks of the two new pairs in the rank map, an array that is read by ids (see ``PairTable``).

A pre-token that is a token is known by its bytes in the task that cuts it. One of more than CUT_OVER characters is
first cut between neighbouring bytes that no token holds side by side, for no merge can cross such a place. A part that is still over LONG bytes (a run of one letter, say) is merged rank by rank
over an array in the same task, because a fold copies its state at each step.

A byte travels as the Latin-1 character of its value, so pieces are Spark strings
and ``encode(.., 'ISO-8859-1')`` turns their concatenation into the bytes.
"""

from __future__ import annotations

import base64
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, let
from .pretokens import piece_groups

#: Pre-tokens of more characters are cut where no merge can cross.
CUT_OVER = 64
#: Parts of more bytes are merged rank by rank.
LONG = 1024
#: Bits of a token's place in its part.
PLACE = 10
#: The first surrogate and their number: no character stands for them, so an id from there on is that much higher.
SURROGATE, SURROGATES = 0xD800, 0x800
#: Words whose bytes are looked at together for tokens.
FIND_WORDS = 1 << 13


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file: token bytes -> rank (the token's id)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


class PairTable:
    """The rank of each pair of ids that merges; the rank is the id of the token it makes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        missing = [x for x in range(256) if bytes([x]) not in ranks]
        if missing:
            raise ValueError(f"not a byte-level vocabulary: no token for byte {missing[0]}")
        self.size = max(ranks.values()) + 1
        self.bits = self.size.bit_length()
        self.none = (1 << self.bits) - 1                   # no rank: above every id
        found = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = np.array(found, np.int64).reshape(-1, 3).T
        keys = left << self.bits | right
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], -1), np.append(rank[order], self.none)
        self.byte_id = np.array([ranks[bytes([x])] for x in range(256)], np.int64)
        first_use = np.full(self.size, self.none, np.int64)
        np.minimum.at(first_use, left, rank)
        np.minimum.at(first_use, right, rank)
        #: whether a token starts or ends a pair of lower rank than its own: its merges are made one at a time
        self.single = first_use < np.arange(self.size)
        #: which bytes stand side by side in a token, by first byte * 256 + second byte
        text = np.frombuffer(b"".join(ranks), np.uint8).astype(np.int64)
        inner = np.ones(len(text), bool)
        inner[np.cumsum([len(t) for t in ranks]) - 1] = False
        at = np.flatnonzero(inner)
        self.beside = np.zeros(1 << 16, bool)
        self.beside[text[at] << 8 | text[at + 1]] = True
        self.starts = self.first()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << self.bits | right
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """(cells, shift): ``cells[shift[left] + right]`` is ``left << bits | rank``. The rows of the
        (left, right) matrix, which is nearly empty, are laid over each other so that no two entries share a
        cell; a cell of another left id says that the pair does not merge. ``size`` as right id: no token."""
        left, right = self.keys[:-1] >> self.bits, self.keys[:-1] & self.none
        ids, start, n = np.unique(left, return_index=True, return_counts=True)
        entries = left << self.bits | self.ranks[:-1]
        room = 16 * (self.size + len(left))                # more than is ever used; what is not is cut off below
        taken, shift, cells = np.zeros(room, bool), np.zeros(self.size, np.int64), np.full(room, self.none << self.bits, np.int64)
        at, by_size = 0, np.argsort(-n, kind="stable")
        for i, larger in zip(by_size, [0, *n[by_size]]):
            if n[i] == 1:
                break
            if n[i] <= 8 < larger:                         # the short rows start over between the long ones
                at = 0
            mine, step = right[start[i]:start[i] + n[i]], max(32, 1024 // int(n[i]))
            while True:                                    # the next shift at which all cells of the row are free
                fits = np.flatnonzero(~taken[at + np.arange(step)[:, None] + mine].any(axis=1))
                if len(fits):
                    break
                at += step
            at += int(fits[0])
            shift[ids[i]] = at
            taken[at + mine] = True
            cells[at + mine] = entries[start[i]:start[i] + n[i]]
        alone = np.flatnonzero(n == 1)                     # rows of one entry fill the free cells from ``size`` on
        free = self.size + np.flatnonzero(~taken[self.size:])[:len(alone)]
        shift[ids[alone]] = free - right[start[alone]]
        cells[free] = entries[start[alone]]
        return cells[:int(shift.max()) + self.size + 1], shift

    def first(self) -> np.ndarray:
        """By first byte + 256 * second byte (256: none): the rank of the pair and the id of the first byte."""
        y, x = np.divmod(np.arange(1 << 16), 256)
        pair = np.append(self.rank(self.byte_id[x], self.byte_id[y]), np.full(256, self.none))
        return pair << (PLACE + self.bits) | np.tile(self.byte_id, 257)

    def codes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, codes) of the words: what the fold starts with, an integer for each byte."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        x, ends = np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.cumsum(sizes)
        after = np.append(x[1:], 256)[:len(x)]
        after[ends[sizes > 0] - 1] = 256
        place = np.arange(len(x)) - np.repeat(ends - sizes, sizes)
        return sizes, self.starts[x + 256 * after] | place << self.bits

    def parts(self, word: bytes) -> list[bytes]:
        """``word`` cut where no merge can cross."""
        b = np.frombuffer(word, np.uint8).astype(np.int64)
        at = (np.flatnonzero(~self.beside[b[:-1] << 8 | b[1:]]) + 1).tolist()
        return [word[i:j] for i, j in zip([0, *at], [*at, len(word)])]

    def merged(self, word: bytes) -> np.ndarray:
        """The ids of a word, whatever its length: all pairs of the lowest rank at a time, from the
        left; one at a time where the made token starts a pair of lower rank."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)]
        rank = self.rank(ids[:-1], ids[1:])
        while len(rank) and (low := rank.min()) < self.none:
            at = np.flatnonzero(rank == low)
            if self.single[low]:
                at = at[:1]
            else:                                          # of overlapping pairs every second one
                begin = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) > 1], np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
            ids[at] = low
            ids = np.delete(ids, at + 1)
            rank = np.delete(rank, at)
            at = at - np.arange(len(at))
            near = np.unique(np.concatenate((at, at - 1)))
            near = near[(near >= 0) & (near < len(rank))]
            rank[near] = self.rank(ids[near], ids[near + 1])
        return ids


@lru_cache(maxsize=2)
def pair_table(path: str) -> PairTable:
    return PairTable(read_ranks(path))


def sign(i: int) -> str:
    """The character that stands for an id in a folded word."""
    return chr(i if i < SURROGATE else i + SURROGATES)


@lru_cache(maxsize=2)
def token_pairs(path: str) -> dict[int, tuple[int, int]] | None:
    """By rank of each token of two bytes or more: the pair that its bytes have become when all merges of lower
    rank are done. None if that is not one pair for some token: then the merges' order is not that of the ranks alone."""
    ranks, pairs = read_ranks(path), {}
    for token, rank in ranks.items():
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            low, at = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if low >= rank:
                return None
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            pairs[rank] = ranks[parts[0]], ranks[parts[1]]
    return pairs


class Finder:
    """The merges whose tokens stand in words, by a hash of each run of bytes. A run of the same hash as a token's
    would only add a merge that finds its pair nowhere or is right to be made."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        tokens = [t for t in ranks if len(t) > 1]
        self.longest = max(map(len, tokens), default=0)
        size, self.base = np.fromiter(map(len, tokens), np.int64, len(tokens)), np.uint64(0x9E3779B97F4A7C15)
        x, starts = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size
        while True:
            keys = np.zeros(len(tokens), np.uint64)
            for n in range(self.longest):
                more = np.flatnonzero(size > n)
                keys[more] = self._next(keys[more], x[starts[more] + n])
            if len(np.unique(keys)) == len(keys):          # no two tokens of one hash
                break
            self.base += np.uint64(2)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([ranks[t] for t in tokens], np.int64)[order]
        #: the token (its place in ``keys``) of each slot, and which slots have more than one
        self.bits = np.uint64(64 - max(10, (16 * len(tokens)).bit_length()))
        slot = self._slot(self.keys)
        self.at = np.full(1 << (64 - int(self.bits)), -1, np.int32)
        self.at[slot] = np.arange(len(slot))
        self.crowded = np.bincount(slot, minlength=len(self.at)) > 1

    def _next(self, keys: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The hashes of runs that are one byte longer."""
        return keys * self.base + (x + np.uint64(1))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0xD6E8FEB86659FD93) >> self.bits).astype(np.int64)

    def merges(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ranks): of each word, ascending, the ranks of the tokens of two bytes or more that stand in it."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        x = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), size)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(x))  # bytes from here to the word's end
        at, keys, found = np.arange(len(x)), self._next(np.zeros(len(x), np.uint64), x), []
        for n in range(1, self.longest):
            more = np.flatnonzero(left > n)
            if not len(more):
                break
            at, left = at[more], left[more]
            keys = self._next(keys[more], x[at + n])
            slot = self._slot(keys)
            token = self.at[slot]
            hit = (token >= 0) & (self.keys[token] == keys)
            odd = np.flatnonzero(~hit & self.crowded[slot])
            token[odd] = np.minimum(np.searchsorted(self.keys, keys[odd]), len(self.keys) - 1)
            hit[odd] = self.keys[token[odd]] == keys[odd]
            found.append(word[at[hit]] << 32 | self.ranks[token[hit]])
        found = np.sort(np.concatenate([*found, np.zeros(0, np.int64)]))
        found = found[np.diff(found, prepend=-1) > 0]      # each once
        return np.bincount(found >> 32, minlength=len(words)), found & 0xFFFFFFFF


@lru_cache(maxsize=2)
def finder(path: str) -> Finder:
    return Finder(read_ranks(path))


def _tables(spark: SparkSession, table: PairTable, pairs: dict[int, tuple[int, int]] | None) -> DataFrame:
    """One row: by rank the pairs and what they make (pairs, made), or the rank map (cells, shift)."""
    if pairs is None:
        arrays, of = zip(("cells", "shift"), table.cells()), pa.int64()
    else:
        signs = [(sign(pairs[i][0]) + sign(pairs[i][1]), sign(i)) if i in pairs else (None, None) for i in range(table.size)]
        arrays, of = zip(("pairs", "made"), map(list, zip(*signs))), pa.string()
    return spark.createDataFrame(pa.table({name: pa.array([values], pa.list_(of)) for name, values in arrays}))


def fold_merges(word: Column, merges: Column, table: PairTable, pairs: Column, made: Column) -> Column:
    """array<int>: the ids of one part, given as the string of its bytes' signs and the ranks of the merges to try, ascending."""
    folded = F.aggregate(merges, word, lambda s, rank: F.replace(s, F.get(pairs, rank), F.get(made, rank)))
    ids = F.transform(F.split(folded, ""), F.ascii)
    return ids if table.size <= SURROGATE else F.transform(ids, lambda i: F.when(i < SURROGATE, i).otherwise(i - SURROGATES))


def encode_bytes(word: Column, table: PairTable, cells: Column, shift: Column) -> Column:
    """array<int>: the ids of one part, given as array<bigint> of its bytes' codes (at least two, at most LONG)."""
    bits, above = table.bits, PLACE + table.bits
    ids, places, below = (1 << bits) - 1, ((1 << PLACE) - 1) << bits, (1 << above) - 1
    none = F.lit(table.none)

    def part(x: Column, mask: int) -> Column:
        return x.bitwiseAND(F.lit(mask))

    def rank(left: Column, right: Column) -> Column:
        cell = F.get(cells, (F.get(shift, left.cast("int")) + right).cast("int"))
        return F.shiftleft(F.least(cell.bitwiseXOR(F.shiftleft(left, bits)), none), above)

    def merge(codes: Column, low: Column, made: Column, k: Column) -> Column:
        """Tokens k and k + 1 (from 1) become one; the token before them has a new pair too."""
        after = F.coalesce(part(F.get(codes, k + 1), ids), F.lit(table.size))
        mine = rank(made, after).bitwiseOR(part(low, places)).bitwiseOR(made)
        left = F.get(codes, k - 2)                         # twice is cheaper than a name
        before = rank(part(left, ids), made).bitwiseOR(part(left, below))
        rest = F.slice(codes, k + 2, F.size(codes))
        return F.when(k > 1, F.concat(F.slice(codes, F.lit(1), k - 2), F.array(before, mine), rest)).otherwise(F.concat(F.array(mine), rest))

    def at(codes: Column, low: Column) -> Column:
        """The index of ``low`` from 1, told by the places before it (``array_position`` throws to end its loop)."""
        return F.size(F.filter(codes, lambda c: part(c, places) <= part(low, places)))

    def step(codes: Column, _: Column) -> Column:
        return let(F.array_min(codes), lambda low: F.when(low >= F.lit(table.none << above), codes).otherwise(
            let(at(codes, low), lambda k: merge(codes, low, F.shiftright(low, above), k))))

    return F.transform(F.aggregate(F.sequence(F.lit(2), F.size(word)), word, step), lambda c: part(c, ids).cast("int"))


def _blocks(b: pa.RecordBatch, text_at: int, pattern: str, table: PairTable, block_words: int):
    """(distinct words as bytes, first row, per row the word numbers) for blocks of consecutive rows of
    about ``block_words`` pre-tokens; a longer text is one block, its repeats held as numbers.
    The parts of a long pre-token stand for it as words of their own."""
    words: dict[str | bytes, int] = {}
    rows: list[np.ndarray] = []
    first, held = 0, 0
    for i, t in enumerate(b.column(text_at)):
        numbers = []
        for group in piece_groups(t.as_py() or "", pattern):
            unseen = dict.fromkeys(group)
            if unseen and len(max(unseen, key=len)) > CUT_OVER:
                group = [p for w in group for p in ([w] if len(w) <= CUT_OVER else table.parts(w.encode()))]
                unseen = dict.fromkeys(group)
            unseen = [w for w in unseen if w not in words]
            words.update(zip(unseen, range(len(words), len(words) + len(unseen))))
            numbers.append(np.fromiter(map(words.__getitem__, group), np.int32, len(group)))
        rows.append(np.concatenate(numbers) if numbers else np.empty(0, np.int32))
        held += len(rows[-1])
        if held >= block_words or i + 1 == b.num_rows:
            block, words = [w.encode() if isinstance(w, str) else w for w in words], {}
            yield block, first, rows
            rows, first, held = [], i + 1, 0


def _list(sizes: list[int] | np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)


def _words(words: list[bytes], ranks: dict[bytes, int], table: PairTable, most: int, find: Finder | None) -> pa.StructArray:
    """(ids: of a word that is a token itself, or a part over ``most`` bytes; of a word to be folded what the fold starts with:
    its signs and merges, or its codes without ``find``) of each word."""
    done, sizes = array("i"), []
    for w in words:
        before, rank = len(done), ranks.get(w)
        if rank is not None:
            done.append(rank)
        elif len(w) > most:
            done.frombytes(table.merged(w).astype(np.int32).tobytes())
        sizes.append(len(done) - before)
    ids = _list(sizes, pa.array(np.array(done, np.int32)))
    todo = [b"" if n else w for n, w in zip(sizes, words)]
    if find is None:
        n_codes, codes = table.codes(todo)
        return pa.StructArray.from_arrays([ids, _list(n_codes, pa.array(codes))], names=["ids", "codes"])
    signs = [sign(i) for i in table.byte_id.tolist()]
    text = pa.array([w.decode("latin-1").translate(signs) for w in todo], pa.string())
    merges = [find.merges(todo[i:i + FIND_WORDS]) for i in range(0, len(todo), FIND_WORDS)]
    n, found = (np.concatenate([m[k] for m in merges] or [np.zeros(0, np.int64)]) for k in (0, 1))
    return pa.StructArray.from_arrays([ids, text, _list(n, pa.array(found.astype(np.int32)))], names=["ids", "signs", "merges"])


def encode(df: DataFrame, path: str, pattern: str, *, text_col: str = "text", ids_col: str = "ids",
           keep: list[str] | None = None, block_words: int = 1_000_000,
           most_folded: int = LONG) -> DataFrame:
    """The columns ``keep`` (all if None) of ``df`` and ``ids_col`` array<int>: the ids of every
    row's whole text (null or empty: no ids), each match of ``pattern`` encoded on its own,
    without special tokens.

    The kept columns stay as they are; an existing column named ``ids_col`` is replaced.
    Repeated rows are encoded each; an empty table gives no rows; a pre-token may be as long as a
    text. ``block_words`` bounds the pre-tokens whose distinct words are encoded together, ``most_folded``
    (up to LONG) the bytes of a part that is folded; both change the plan only."""
    rest = [c for c in (df.columns if keep is None else keep) if c != ids_col]
    fields = [df.schema[c] for c in rest]
    at = rest.index(text_col) if text_col in rest else len(rest)
    src = df.select(*[F.col(f"`{c}`") for c in rest], *([] if text_col in rest else [F.col(f"`{text_col}`")]))
    numbers_name = free_name(src, "numbers")
    record = T.StructType([*fields, T.StructField(numbers_name, T.ArrayType(T.IntegerType()))])
    table, pairs = pair_table(path), token_pairs(path)
    ordered = pairs is not None
    starts = "signs string, merges array<int>" if ordered else "codes array<bigint>"
    blocked = T.StructType([T.StructField("words", T.ArrayType(T.StructType.fromDDL(f"ids array<int>, {starts}"))),
                            T.StructField("records", T.ArrayType(record))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        ranks, table, find = read_ranks(path), pair_table(path), finder(path) if ordered else None
        for b in batches:
            for words, first, rows in _blocks(b, at, pattern, table, block_words):
                part = b.select(list(range(len(rest)))).slice(first, len(rows))
                offsets = pa.array(np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32))
                numbers = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rows), pa.int32()))
                records = pa.StructArray.from_arrays([*part.columns, numbers], names=record.names)
                yield pa.RecordBatch.from_arrays([one(_words(words, ranks, table, min(most_folded, LONG), find)), one(records)], names=["words", "records"])
                del words, rows, part, numbers, records
                pa.default_memory_pool().release_unused()

    def deal(coded: Column) -> Column:
        """The block's records with the ids of their words in place of the word numbers."""
        def one(r: Column) -> Column:
            ids = F.flatten(F.transform(r[numbers_name], lambda n: F.get(coded, n)))
            return F.struct(*[r[c].alias(c) for c in rest], ids.alias(ids_col))
        return F.transform("records", one)

    def coded(*tables: Column) -> Column:
        def one(w: Column) -> Column:                      # a pre-token that is a token needs no merges
            folded = fold_merges(w["signs"], w["merges"], table, *tables) if ordered else encode_bytes(w["codes"], table, *tables)
            return F.when(F.size(w["ids"]) > 0, w["ids"]).otherwise(folded)
        return let(F.transform("words", one), deal)
    # made into arrays of objects once a block, so that the fold's reads box nothing
    sent = _tables(df.sparkSession, table, pairs)
    maps = [F.transform(name, lambda x: x) for name in sent.columns]
    bound = let(maps[0], lambda one: let(maps[1], lambda other: coded(one, other)))
    return src.mapInArrow(cut, blocked).crossJoin(F.broadcast(sent)).select(F.inline(bound))


def _joined(ids_col: str, pieces: list[str]) -> Column:
    """The pieces of a row's ids (null: none), concatenated. Their table is a constant by the time the query runs."""
    table = F.from_json(F.lit(json.dumps(pieces, separators=(",", ":"))), "array<string>")
    ids = F.coalesce(F.col(f"`{ids_col}`"), F.array().cast("array<int>"))
    return F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")


def decode(df: DataFrame, path: str, *, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with ``bytes_col`` binary: the byte pieces of the row's ids, concatenated
    (null or no ids: empty). An existing column named ``bytes_col`` is replaced."""
    ranks = read_ranks(path)
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        pieces[i] = token.decode("latin-1")
    return df.withColumn(bytes_col, F.encode(_joined(ids_col, pieces), "ISO-8859-1"))


def pack_ids(df: DataFrame, path: str, *, ids_col: str = "ids", bytes_col: str = "packed") -> DataFrame:
    """``df`` with ``bytes_col`` binary: the row's ids as little-endian unsigned 32-bit integers."""
    n = max(read_ranks(path).values(), default=-1) + 1
    return df.withColumn(bytes_col, F.unhex(_joined(ids_col, [i.to_bytes(4, "little").hex() for i in range(n)])))
