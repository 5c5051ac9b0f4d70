"""Helpers that several operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters outside the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")

#: Python's ``bytes.split()`` cuts at exactly the ASCII white space of WORD, and
#: ``bytes.lower()`` changes exactly A-Z.


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Ship the package to the Python workers and point Spark at the shared folder."""
    from tessera.session import ensure_checkpoint_dir, ship_package

    ship_package(spark)
    ensure_checkpoint_dir(spark)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once: a one-element transform binds it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """A 64-bit hash of all columns of a row, nulls told from any value. Two of them with different
    seeds (ROW) are a row's identity: 128 bits, so that no two rows of a corpus share one."""
    cells = [x for c in df.columns for x in (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.col(f"`{c}`").isNull())]
    return F.xxhash64(F.lit(seed), *cells)


#: The columns of a row's identity, and how they are made.
ROW = ("row_key", "row_key2")


def row_keys(df: DataFrame, names: tuple[str, ...] = ROW) -> list[Column]:
    return [row_hash(df, seed).alias(name) for seed, name in enumerate(names)]


def free_keys(df: DataFrame) -> tuple[str, ...]:
    """The names of ROW as ``free_name`` gives them."""
    first = free_name(df, ROW[0])
    return first, free_name(df.withColumn(first, F.lit(0)), ROW[1])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (in any case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 1024) -> DataFrame:
    """Apply ``fn`` to each Arrow batch of ``df``, at most ``rows`` rows at a time (no shuffle)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                for at in range(0, b.num_rows, rows):
                    yield fn(b.slice(at, rows))
        finally:
            pa.default_memory_pool().release_unused()      # an idle worker gives back what it held
    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _runs(words: list[bytes], n: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``n`` of the words (at least n), joined by one space, as uint64."""
    m = len(words)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, m) + 1)
    starts = np.concatenate(([0], ends[:m - n])).tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[s:e], seed) for s, e in zip(starts, (ends[n - 1:] - 1).tolist())], np.uint64)


def shingle_hashes(text: bytes, n: int, seed: int, part: int = 1 << 22) -> Iterator[np.ndarray]:
    """XXH64 of each run of ``n`` words of ``text`` (A-Z lower-cased, joined by one space),
    repeats included, as uint64 arrays: one for a usual text, one for each ``part`` bytes
    of a very long one. Fewer words: one hash of them all; none: nothing."""
    at, words, some = 0, [], False
    while at < len(text):
        end = len(text)
        if end - at > part:                        # cut at white space
            found = _SPACE.search(text, at + part)
            end = found.start() if found else end
        words += text[at:end].lower().split()
        at = end
        if len(words) >= n:
            some = True
            yield _runs(words, n, seed)
            words = words[len(words) - n + 1:]
    if words and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in ``spark.checkpoint.dir`` (cuts the lineage, survives lost executors)."""
    return df.checkpoint(eager=True)
