"""Token-id output: best-fit-decreasing packing into fixed rows.

Documents are tokenised where they are read. Each task gathers about ``group_tokens``
tokens of consecutive documents, cuts texts longer than a row into whole rows and a
remainder, and packs the remainders longest first, each into the row with the least
room that still fits it (found in a segment tree over capacities). A row comes out as
a line of the id matrix with its cumulative segment lengths, the positions that restart
at every segment, and where each segment comes from, so every document can be restored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts are given to the tokenizer in stretches of about this many characters.
STRETCH = 1 << 18


class CapacityTree:
    """A segment tree over the capacities 0..top that answers which smallest capacity of at
    least ``need`` has an open row."""

    def __init__(self, top: int) -> None:
        self.size = 1 << top.bit_length()
        self.rows: list[list[int]] = [[] for _ in range(top + 1)]
        self.some = bytearray(2 * self.size)

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        i = capacity + self.size
        while i and not self.some[i]:
            self.some[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, row) with the least capacity that is enough."""
        i = need + self.size
        if not self.some[i]:
            while i > 1 and (i & 1 or not self.some[i + 1]):      # up until a right neighbour has some
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.some[2 * i] else 2 * i + 1
        capacity = i - self.size
        row = self.rows[capacity].pop()
        if not self.rows[capacity]:
            self.some[i] = 0
            i >>= 1
            while i and not (self.some[2 * i] or self.some[2 * i + 1]):
                self.some[i] = 0
                i >>= 1
        return capacity, row


def best_fit_decreasing(lengths: list[int], top: int) -> list[list[int]]:
    """Rows (lists of item numbers) of items of 1..top, packed longest first."""
    tree, rows = CapacityTree(top), []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[item]
        found = tree.take(n)
        if found is None:
            found = top, len(rows)
            rows.append([])
        capacity, row = found
        rows[row].append(item)
        if capacity > n:
            tree.add(capacity - n, row)
    return rows


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """``text`` in stretches of about ``size`` characters, cut before a space that follows a
    letter and precedes one: there every pre-token ends, so the ids are those of the whole."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut > 0 and not (text[cut - 1].isalpha() and text[cut + 1:cut + 2].isalpha()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def _ids(text: str, enc: tiktoken.Encoding) -> np.ndarray:
    return np.array([i for part in stretches(text) for i in enc.encode_ordinary(part)], np.uint32)


def pack(docs: list[tuple[int | None, np.ndarray]], row_len: int) -> list[list[tuple[int, int, int]]]:
    """Rows of segments (document number, first token, length) for documents' ids."""
    rows, rest = [], []
    for d, (_, ids) in enumerate(docs):
        whole = len(ids) // row_len * row_len
        rows += [[(d, at, row_len)] for at in range(0, whole, row_len)]
        if len(ids) > whole:
            rest.append((d, whole, len(ids) - whole))
    return rows + [[rest[i] for i in r] for r in best_fit_decreasing([n for _, _, n in rest], row_len)]


SCHEMA = ("pack_id string, row_no int, n_tokens int, n_segments int, input_ids binary, position_ids binary, "
          "cu_seqlens array<int>, doc_ids array<bigint>, first_tokens array<int>")


def packed_rows(df: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text",
                row_len: int = 2048, pad_id: int = 50256, group_tokens: int = 2_000_000) -> DataFrame:
    """One row per line of the packed matrices: pack_id and row_no (a pack is one group of
    a task, named by its first document and its place), n_tokens, n_segments, input_ids
    and position_ids (``row_len`` little-endian uint32 values each, padded with ``pad_id``
    and 0), cu_seqlens (0, ends of the segments), doc_ids and first_tokens (the document
    of each segment and the place in it at which the segment starts).

    Null or empty texts have no tokens and no segment; repeated rows are packed each; a
    null id stays null; an empty table gives no rows; other columns are ignored."""
    src = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
                    F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.spark_partition_id().alias("part"))

    def emit(docs, name: str) -> Iterator[pa.RecordBatch]:
        rows = pack(docs, row_len)
        for lo in range(0, len(rows), 256):
            out = {k: [] for k in ("pack_id", "row_no", "n_tokens", "n_segments", "input_ids", "position_ids",
                                   "cu_seqlens", "doc_ids", "first_tokens")}
            for r, segments in enumerate(rows[lo:lo + 256], lo):
                ids, pos = np.full(row_len, pad_id, "<u4"), np.zeros(row_len, "<u4")
                ends = [0]
                for d, first, n in segments:
                    ids[ends[-1]:ends[-1] + n] = docs[d][1][first:first + n]
                    pos[ends[-1]:ends[-1] + n] = np.arange(n)
                    ends.append(ends[-1] + n)
                for k, v in zip(out, (name, r, ends[-1], len(segments), ids.tobytes(), pos.tobytes(), ends,
                                      [docs[d][0] for d, _, _ in segments], [f for _, f, _ in segments])):
                    out[k].append(v)
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(),
                     pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(path, pattern)
        docs, held, packs = [], 0, 0
        for b in batches:
            for doc, text, part in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("part")):
                ids = _ids(text.as_py(), enc)
                docs.append((doc, ids))
                held += len(ids)
                if held >= group_tokens:
                    yield from emit(docs, f"{part}-{packs}-{docs[0][0]}")
                    docs, held, packs = [], 0, packs + 1
                last = part
        if held:
            yield from emit(docs, f"{last}-{packs}-{docs[0][0]}")
    return src.mapInArrow(run, SCHEMA)


def write_packed(rows: DataFrame, path: str) -> None:
    """Write packed rows as Parquet; each binary cell is one line of the matrix."""
    rows.write.mode("overwrite").parquet(path)
