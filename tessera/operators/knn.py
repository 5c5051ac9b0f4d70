"""JOIN-1 ``vector_score_join``: exact top-k of a query table against a corpus.

* Queries that fit ``max_query_bytes`` (row count x vector width, both measured) are
  broadcast as one matrix; the corpus is scored where it lies (``mapInArrow``, no
  exchange) and every task sends its top k per query.
* More queries: equal vectors are scored once on both sides (see ``_of_distinct``). If the distinct
  ones still do not fit, they are cut into hash blocks of at most ``block_bytes`` and
  ``cogroup``ed on ``(qblock, cblock)``, a blocked matrix product as an equi-join.
  Data moved: ``|Q| * Cb + |C| * Qb`` rows of distinct vectors.
* Both ways use one kernel: scores of a chunk of records, a running top k per query.
  A window on ``query_id`` (with a partial ``WindowGroupLimit`` before its exchange)
  keeps the global top k.

Null vectors and NaN scores only lose themselves. Ties are broken by the corpus key
ascending. Scores may be rounded (``decimals``) before ranking so that float noise
cannot reorder equal ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.rank import topk_per_query

_PAIR_BUDGET = 1_000_000  # score-matrix cells held at once in a worker
_ROWS = 1024  # records of an Arrow batch that are turned into a matrix at once
#: Documented bounds: the largest query matrix that is broadcast, and the vectors of a block.
MAX_QUERY_BYTES, BLOCK_BYTES = 64 << 20, 32 << 20


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    """(rows, width) of a list column without nulls; all lists must be of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    if len(column) == 0:
        return np.zeros((0, 0), dtype)
    if len(values) % len(column) or len(set(np.diff(column.offsets.to_numpy()))) > 1:
        raise ValueError("vectors of different lengths")
    return values.reshape(len(column), -1)


class TopK:
    """Running top k per query over chunks of records. Memory: the query matrix, one chunk of
    ``_PAIR_BUDGET`` scores, and candidates that are cut back to k per query."""

    def __init__(self, queries: np.ndarray, k: int, threshold: float | None, decimals: int | None, kind: str) -> None:
        self.q, self.k, self.decimals, self.kind = queries, k, decimals, kind
        self.floor = np.full(len(queries), -np.inf if threshold is None else threshold)
        self.norm = np.linalg.norm(queries, axis=1) if kind == "cosine" else None
        self.rows, self.scores, self.keys, self.held = [], [], [], 0
        self.postings: list[tuple[np.ndarray, np.ndarray]] | None = None

    def _score(self, c: np.ndarray) -> np.ndarray:
        if self.kind == "agree":
            return self._agree(c)
        s = self.q @ c.T
        return s / (np.outer(self.norm, np.linalg.norm(c, axis=1)) + 1e-9) if self.kind == "cosine" else s

    def _agree(self, c: np.ndarray) -> np.ndarray:
        """The share of equal positions, counted from postings: a position's value leads to the queries
        that have it there, so the work grows with the matches and not with all pairs."""
        if self.postings is None:
            order = [np.argsort(v, kind="stable") for v in self.q.T]
            self.postings = [(v[o], o) for v, o in zip(self.q.T, order)]
        cells = []
        for (values, owners), mine in zip(self.postings, c.T):
            first = np.searchsorted(values, mine)
            many = np.searchsorted(values, mine, "right") - first
            hit = np.flatnonzero(many)
            if len(hit):
                many = many[hit]
                ends = np.cumsum(many)
                at = np.arange(ends[-1]) - np.repeat(ends - many - first[hit], many)
                cells.append(owners[at] * len(c) + np.repeat(hit, many))
        same = np.bincount(np.concatenate(cells), minlength=len(self.q) * len(c)) if cells else np.zeros(len(self.q) * len(c))
        return same.reshape(len(self.q), len(c)) / float(self.q.shape[1])

    def add(self, keys: np.ndarray, c: np.ndarray) -> None:
        n = len(self.q)
        if not n or not len(c):
            return
        if c.shape[1] != self.q.shape[1]:
            raise ValueError(f"query vectors have {self.q.shape[1]} values, records {c.shape[1]}")
        step = max(1, _PAIR_BUDGET // n)
        for i in range(0, len(c), step):
            s = self._score(c[i:i + step])
            if self.decimals is not None:
                s = np.round(s, self.decimals)
            s = np.where(np.isnan(s), -np.inf, s)
            floor = self.floor
            if s.shape[1] > self.k:
                floor = np.maximum(floor, -np.partition(-s, self.k - 1, axis=1)[:, self.k - 1])
            r, col = np.nonzero((s >= floor[:, None]) & (s > -np.inf))
            self.rows.append(r)
            self.scores.append(s[r, col])
            self.keys.append(keys[i + col])
            self.held += len(r)
            if self.held > max(_PAIR_BUDGET // 4, 2 * n * self.k):
                self._cut()

    def _cut(self) -> None:
        """Keep the best k candidates of each query by (score desc, key asc)."""
        if not self.rows:
            return
        r, s, keys = (np.concatenate(x) for x in (self.rows, self.scores, self.keys))
        _, order = np.unique(keys, return_inverse=True)
        best = np.lexsort((order, -s, r))
        r, s, keys = r[best], s[best], keys[best]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(r)])
        pos = np.arange(len(r)) - np.repeat(first, size)
        kth = pos == self.k - 1
        self.floor[r[kth]] = np.maximum(self.floor[r[kth]], s[kth])
        keep = pos < self.k
        self.rows, self.scores, self.keys, self.held = [r[keep]], [s[keep]], [keys[keep]], int(keep.sum())

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query rows, keys, scores)."""
        self._cut()
        if not self.rows:
            return np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)
        return self.rows[0], self.keys[0], self.scores[0]


def _plain(keys: pa.Array) -> np.ndarray:
    """Keys as numbers where they are whole numbers without nulls, which rank much faster than objects."""
    if pa.types.is_integer(keys.type) and not keys.null_count:
        return keys.to_numpy(zero_copy_only=False)
    return np.asarray(keys.to_pylist(), object)


def _dtype(kind: str):
    return np.int64 if kind == "agree" else np.float64


def _in_place(queries: DataFrame, corpus: DataFrame, schema: str, names: tuple[str, str], **how) -> DataFrame:
    """The corpus scored where it lies, against the broadcast query matrix."""
    table = queries.toArrow()
    dtype, (query_id, key) = _dtype(how["kind"]), names
    table = table.filter(pc.is_valid(table.column(1)))
    sent = queries.sparkSession.sparkContext.broadcast((table.column(0).combine_chunks(), _matrix(table.column(1), dtype)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        top = TopK(q, **how)
        kind = None
        for b in (x.slice(i, _ROWS) for x in batches for i in range(0, x.num_rows, _ROWS)):
            kind = b.column(0).type
            b = b.filter(pc.is_valid(b.column(1)))
            top.add(_plain(b.column(0)), _matrix(b.column(1), dtype))
        r, keys, s = top.result()
        if len(r):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), pa.array(keys.tolist(), kind), pa.array(s)],
                                             names=[query_id, key, "score"])
        pa.default_memory_pool().release_unused()          # an idle worker gives back what it held
    return corpus.mapInArrow(run, schema)


def _in_blocks(queries: DataFrame, corpus: DataFrame, schema: str, names: tuple[str, str], qb: int, cb: int, **how) -> DataFrame:
    """Hash blocks of both sides, cogrouped pair by pair of blocks."""
    (query_id, key), dtype = names, _dtype(how["kind"])
    q = (queries.withColumn("qblock", F.pmod(F.xxhash64(query_id, "__v"), F.lit(qb)))
         .withColumn("cblock", F.explode(F.sequence(F.lit(0), F.lit(cb - 1)))))
    c = (corpus.withColumn("cblock", F.pmod(F.xxhash64(key, "__v"), F.lit(cb)))
         .withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)))))

    def cell(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        qpdf, cpdf = (x[x["__v"].notna()] for x in (qpdf, cpdf))
        stack = lambda v: np.stack([np.asarray(x, dtype=dtype) for x in v]) if len(v) else np.zeros((0, 0), dtype)
        top = TopK(stack(qpdf["__v"]), **how)
        top.add(cpdf[key].to_numpy(object), stack(cpdf["__v"]))
        r, keys, s = top.result()
        return pd.DataFrame({query_id: qpdf[query_id].to_numpy()[r], key: keys, "score": s})
    return q.groupBy("qblock", "cblock").cogroup(c.groupBy("qblock", "cblock")).applyInPandas(cell, schema=schema)


def _digest(v: str) -> Column:
    """A vector's name: 128 bits of hash, so that no two vectors share one."""
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), v)), 16, "0") for seed in (0, 1)])


def _of_distinct(queries: DataFrame, corpus: DataFrame, names: tuple[str, str], row_bytes: int, max_query_bytes: int,
                 block_bytes: int, **how) -> DataFrame:
    """The top k per query where equal vectors are scored once. The distinct vectors of the corpus are
    numbered by their smallest key; a row among the best k has one of the best k vectors by (score, number), so
    these are found first, then give way to their k smallest keys each, and the best k of those are every query's
    with that vector. Sides that many rows share are joined by sort and merge: their sizes are not what Catalyst expects."""
    (query_id, key), k = names, how["k"]
    asked = queries.select("__v").distinct().select(_digest("__v").alias("__q"), "__v").checkpoint()
    stored = (corpus.groupBy("__v").agg(F.min(key).alias("__first")).orderBy("__first")
              .select(F.monotonically_increasing_id().alias("__c"), "__v").checkpoint())
    n, args = asked.count(), ("__q string, __c long, score double", ("__q", "__c"))
    if n * row_bytes <= max_query_bytes:
        cells = _in_place(asked, stored, *args, **how)
    else:
        per_block = max(1, block_bytes // row_bytes)
        qb, cb = (max(1, math.ceil(x / per_block)) for x in (n, stored.count()))
        cells = _in_blocks(asked, stored, *args, qb, cb, **how)
    best = topk_per_query(cells, k, group="__q", tie="__c").select("__q", "__c", "score")
    few = Window.partitionBy("__d").orderBy(key)
    keys = corpus.select(_digest("__v").alias("__d"), key).withColumn("__n", F.row_number().over(few)).where(F.col("__n") <= k).drop("__n")
    owners = keys.hint("merge").join(stored.select(_digest("__v").alias("__d"), "__c"), "__d").select("__c", key)
    top = topk_per_query(best.hint("merge").join(owners, "__c"), k, group="__q", tie=key).select("__q", key, "score", "rank")
    members = queries.select(query_id, _digest("__v").alias("__q"))
    out = members.hint("merge").join(top, "__q").select(query_id, key, "score", "rank")
    if queries.select(query_id).distinct().count() == queries.count():
        return out
    return topk_per_query(out.drop("rank"), k, group=query_id, tie=key)


def knn_topk(
    queries: DataFrame,
    corpus: DataFrame,
    *,
    k: int,
    threshold: float | None = None,
    query_id: str = "query_id",
    query_vec: str = "embedding",
    key: str = "key",
    corpus_vec: str = "embedding",
    kind: str = "dot",
    decimals: int | None = 6,
    max_query_bytes: int = MAX_QUERY_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Top-``k`` corpus rows per query with ``score >= threshold``.

    ``kind``: ``dot`` (unit vectors, MTH-2), ``cosine`` (MTH-3, with 1e-9),
    ``agree`` (share of equal positions of two int arrays: the MinHash estimate).
    Returns ``(query_id, key, score double, rank int)`` with the input id names. The two
    byte bounds choose the plan only; both plans give the same rows.
    """
    if query_id == key:
        raise ValueError("query and corpus id columns must have different names")
    # null vectors are dropped in the tasks: a filter here would be pushed below an exchange and run an encoder twice
    q = queries.select(F.col(query_id), F.col(query_vec).alias("__v"))
    c = corpus.select(F.col(key), F.col(corpus_vec).alias("__v"))
    schema = f"{query_id} {queries.schema[query_id].dataType.simpleString()}, {key} {corpus.schema[key].dataType.simpleString()}, score double"
    how = {"k": k, "threshold": threshold, "decimals": decimals, "kind": kind}
    # the count needs no vectors, the width those of some queries: neither encodes all queries
    n, some = queries.count(), q.select(F.size("__v")).limit(64).collect()
    row_bytes = 8 * max([1, *(r[0] for r in some if r[0])]) + 64
    if n * row_bytes <= max_query_bytes:
        return topk_per_query(_in_place(q, c, schema, (query_id, key), **how), k, group=query_id, tie=key)
    return _of_distinct(q, c, (query_id, key), row_bytes, max_query_bytes, block_bytes, **how)
