"""ANN-2 ``ivfpq_build`` / ANN-3 ``ivfpq_search`` (Jégou et al. 2011), as tables.

Build: about sqrt(n) coarse centroids and one codebook of at most 256 codes per
sub-space of the residuals. Both are trained by a fixed number of Lloyd rounds on a
bounded sample (the rows with the smallest key hashes, about ``train_rows``), each round one job that sums per
centroid in the tasks; all sub-spaces train together. Every row is then assigned and
encoded. ``nprobe`` is measured: the exact neighbours of a few sample queries must lie
in the probed lists with ``target_recall``.

Search: a query picks its nearest lists; (query, list) pairs meet the members in a
``cogroup`` on (list, member block, query block). Long lists and lists that many queries
probe are both cut into blocks, by the index's table of list headers and the probes'
counts. A cell looks distances up in chunks with a running best; a window keeps the
shortlist, which is re-ranked with the exact vectors (JOIN-6). A stored index is
partitioned by list: the table of probed lists (at most ``max_lists`` rows) is broadcast and
prunes codes and vectors to those lists.

On the driver: centroids (at most ``max_lists`` x d), codebooks (at most 256 x d) and the
bounded calibration queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.vector import dot_product
from tessera.operators.knn import _matrix, knn_topk

#: name: dims per sub-space.
PROFILES = {"low-ram": 8, "medium": 4, "fast": 4}
#: Bounds of the training sample (rows), the lists, and the calibration queries.
TRAIN_ROWS, MAX_LISTS, CALIBRATION_QUERIES = 262_144, 16_384, 256
_CELLS = 4_000_000


@dataclass
class IvfPqIndex:
    centroids: np.ndarray   # (K, d)
    codebooks: np.ndarray   # (m, n_codes, dsub); the last sub-space is padded with zeros
    lists: DataFrame        # list_id int, key, codes binary
    headers: DataFrame      # list_id int, n_rows bigint: lists that have members
    vectors: DataFrame      # list_id int, key, embedding (for re-ranking)
    nprobe: int

    @property
    def n_lists(self) -> int:
        return self.centroids.shape[0]


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2.0 * x @ c.T + (c * c).sum(1)[None, :]


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    step = max(1, _CELLS // max(1, len(c)))
    return np.concatenate([_distances(x[i:i + step], c).argmin(axis=1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def _split(x: np.ndarray, dsub: int) -> np.ndarray:
    """(n, m, dsub) from (n, d); the last sub-space is padded with zeros."""
    m = math.ceil(x.shape[1] / dsub)
    return np.pad(x, ((0, 0), (0, m * dsub - x.shape[1]))).reshape(len(x), m, dsub)


def _residuals(x: np.ndarray, coarse: np.ndarray, dsub: int) -> tuple[np.ndarray, np.ndarray]:
    lid = _nearest(x, coarse)
    return lid, _split(x - coarse[lid], dsub)


def _lloyd(sample: DataFrame, books: np.ndarray, parts, rounds: int) -> np.ndarray:
    """``rounds`` of k-means for all books (m, c, ds) at once. ``parts`` turns a batch's
    vectors into (n, m, ds). A task sums per (book, code); the sums of the tasks are added
    per cell in Spark. A code without a member keeps its place; rounding makes the result
    independent of the order of the sums."""
    m, c, ds = books.shape

    # a cell has one partial sum per task
    total = F.aggregate(F.slice("t", F.lit(2), F.size("t")), F.get("t", F.lit(0)), lambda a, x: F.zip_with(a, x, lambda u, v: u + v))
    for _ in range(rounds):
        sent = sample.sparkSession.sparkContext.broadcast(books)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = sent.value
            total, n = np.zeros((m, c, ds)), np.zeros((m, c), np.int64)
            for b in batches:
                x = parts(_matrix(b.column(0), np.float64))
                for j in range(m):
                    code = _nearest(x[:, j], now[j])
                    np.add.at(total[j], code, x[:, j])
                    n[j] += np.bincount(code, minlength=c)
            cell = np.flatnonzero(n.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(n.ravel()[cell], pa.int64()),
                                              pa.array(list(total.reshape(-1, ds)[cell]), pa.list_(pa.float64()))],
                                             names=["cell", "n", "total"])
        sums = sample.mapInArrow(run, "cell long, n long, total array<double>").groupBy("cell").agg(
            F.sum("n").alias("n"), F.collect_list("total").alias("t")).select("cell", "n", total.alias("total"))
        books = books.copy()
        for r in sums.collect():                            # m x c rows
            books[r["cell"] // c, r["cell"] % c] = np.round(np.array(r["total"]) / r["n"], 6)
    return books


def ivfpq_build(vectors: DataFrame, *, key: str = "key", vec: str = "embedding", profile: str = "low-ram",
                n_lists: int | None = None, dims_per_sub: int | None = None, n_codes: int = 256, rounds: int = 5,
                seed: int = 1, train_rows: int = TRAIN_ROWS, max_lists: int = MAX_LISTS, target_recall: float = 0.97,
                nprobe: int | None = None, k: int = 5) -> IvfPqIndex:
    """Train, encode every row (null vectors are left out) and measure ``nprobe``. Sample and
    lists are checkpointed in ``spark.checkpoint.dir``. An empty table has one empty list."""
    from tessera.session import ensure_checkpoint_dir
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    kept = vectors.select(F.col(key).alias("key"), F.col(vec).alias("embedding"))
    base = kept.select("*", F.col("embedding").cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    n = base.count()
    h = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 30))
    sample = base.where(h < min(1 << 30, math.ceil((1 << 30) * train_rows / max(1, n)))).checkpoint()
    first, n_sample = sample.orderBy(h, "key"), sample.count()
    K = max(1, min(n_lists or round(math.sqrt(n)), max_lists, n_sample))
    seeds = np.array([r[0] for r in first.select("v").limit(max(K, min(n_codes, n_sample))).collect()], np.float64)
    if not n:
        none = base.select(F.lit(0).alias("list_id"), "key", F.lit(b"").alias("codes"))
        return IvfPqIndex(np.zeros((1, 1)), np.zeros((1, 1, 1)), none, headers_of(none), kept.select(F.lit(0).alias("list_id"), "key", "embedding"), 1)
    dsub = min(dims_per_sub or PROFILES[profile], seeds.shape[1])
    coarse = _lloyd(sample.select("v"), seeds[None, :K], lambda x: x[:, None, :], rounds)[0]
    start = np.ascontiguousarray(_residuals(seeds[:min(n_codes, n_sample)], coarse, dsub)[1].transpose(1, 0, 2))
    books = _lloyd(sample.select("v"), start, lambda x: _residuals(x, coarse, dsub)[1], rounds)
    sent = spark.sparkContext.broadcast((coarse, books))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse, books = sent.value
        for b in batches:
            if b.num_rows:
                lid, x = _residuals(_matrix(b.column("v"), np.float64), coarse, dsub)
                codes = np.stack([_nearest(x[:, j], books[j]) for j in range(len(books))], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(lid, pa.int32()), b.column("key"), pa.array([r.tobytes() for r in codes], pa.binary()),
                                                  b.column("embedding")], names=["list_id", "key", "codes", "embedding"])
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    coded = base.select("key", "v", F.col("embedding")).mapInArrow(
        code, f"list_id int, key {kinds['key']}, codes binary, embedding {kinds['embedding']}").checkpoint()
    lists = coded.select("list_id", "key", "codes")
    index = IvfPqIndex(coarse, books, lists, headers_of(lists).checkpoint(), coded.select("list_id", "key", "embedding"), nprobe or K)
    if nprobe is None:
        index.nprobe = calibrate(index, first.limit(min(n_sample, CALIBRATION_QUERIES)), k, target_recall)
    return index


def headers_of(lists: DataFrame) -> DataFrame:
    """(list_id, n_rows) of the lists that have members."""
    return lists.groupBy("list_id").agg(F.count(F.lit(1)).alias("n_rows"))


def calibrate(index: IvfPqIndex, queries: DataFrame, k: int, target_recall: float) -> int:
    """The fewest lists to probe so that ``target_recall`` of the exact top k of ``queries`` (key,
    v) lie in them: how far down a query's order of lists each neighbour's list stands."""
    q = queries.select(F.col("key").alias("qid"), F.col("v").alias("embedding")).toPandas()
    near = knn_topk(queries.select(F.col("key").alias("qid"), F.col("v").alias("embedding")), index.vectors.drop("list_id"), k=k, query_id="qid")
    found = near.join(index.lists.select("key", "list_id"), "key").select("qid", "list_id").toPandas()     # at most queries x k rows
    order = np.argsort(_distances(np.stack(q["embedding"]), index.centroids), axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    at = {x: i for i, x in enumerate(q["qid"])}
    depth = np.sort([rank[at[x], lid] for x, lid in zip(found["qid"], found["list_id"])])
    return int(depth[min(len(depth) - 1, math.ceil(target_recall * len(depth)) - 1)]) + 1 if len(depth) else index.n_lists


def write_index(index: IvfPqIndex, spark: SparkSession, root: str) -> None:
    """Persist as tables: model (centroids, codebooks, nprobe), list headers, and codes and vectors by list_id."""
    rows = [("centroid", 0, i, c.tolist()) for i, c in enumerate(index.centroids)]
    rows += [("code", j, i, c.tolist()) for j, book in enumerate(index.codebooks) for i, c in enumerate(book)]
    rows.append(("nprobe", 0, 0, [float(index.nprobe)]))
    spark.createDataFrame(rows, "kind string, sub int, no int, v array<double>").write.mode("overwrite").parquet(f"{root}/ivf/model")
    index.headers.write.mode("overwrite").parquet(f"{root}/ivf/headers")
    for name, part in (("lists", index.lists), ("vectors", index.vectors)):
        part.hint("rebalance", "list_id").write.mode("overwrite").partitionBy("list_id").parquet(f"{root}/ivf/{name}")


def read_index(spark: SparkSession, root: str) -> IvfPqIndex:
    """The index that ``write_index`` stored under ``root``."""
    rows = spark.read.parquet(f"{root}/ivf/model").orderBy("kind", "sub", "no").collect()
    pick = lambda kind: [r for r in rows if r["kind"] == kind]
    m = 1 + max(r["sub"] for r in pick("code"))
    books = np.array([[r["v"] for r in pick("code") if r["sub"] == j] for j in range(m)])
    lists, vectors = (spark.read.parquet(f"{root}/ivf/{name}") for name in ("lists", "vectors"))
    return IvfPqIndex(np.array([r["v"] for r in pick("centroid")]), books, lists, spark.read.parquet(f"{root}/ivf/headers"), vectors,
                      int(pick("nprobe")[0]["v"][0]))


def _look_up(q: np.ndarray, codes: np.ndarray, books: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, member row, distance) of the k nearest members of each query: distances from
    per-query tables, members in chunks, the best k kept as it goes."""
    m, width, _ = books.shape
    table = np.stack([_distances(q[:, j], books[j]) for j in range(m)], 1)           # (nq, m, codes)
    best_d, best_i = np.full((len(q), 0), np.inf), np.zeros((len(q), 0), np.int64)
    step = max(1, _CELLS // max(1, len(q)))
    for i in range(0, len(codes), step):
        part = codes[i:i + step]
        d = np.zeros((len(q), len(part)))
        for j in range(m):
            d += table[:, j, part[:, j]]
        d = np.concatenate([best_d, d], 1)
        at = np.concatenate([best_i, np.broadcast_to(np.arange(i, i + len(part)), (len(q), len(part)))], 1)
        pick = np.argpartition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else np.broadcast_to(np.arange(d.shape[1]), d.shape)
        best_d, best_i = np.take_along_axis(d, pick, 1), np.take_along_axis(at, pick, 1)
    row = np.repeat(np.arange(len(q)), best_d.shape[1])
    return row, best_i.ravel(), best_d.ravel()


def ivfpq_search(index: IvfPqIndex, queries: DataFrame, k_cand: int, *, query_id: str = "query_id",
                 vec: str = "embedding", nprobe: int | None = None, members_per_block: int = 65536,
                 queries_per_block: int = 1024, decimals: int | None = 6) -> DataFrame:
    """Shortlist of ``k_cand`` keys per query, re-ranked by exact dot product.
    Returns ``(query_id, key, score)``."""
    probe = min(nprobe or index.nprobe, index.n_lists)
    sent = queries.sparkSession.sparkContext.broadcast((index.centroids, index.codebooks))
    dsub = index.codebooks.shape[2]
    qid_type, key_type = queries.schema[query_id].dataType.simpleString(), index.lists.schema["key"].dataType.simpleString()
    q = queries.select(F.col(query_id).alias("qid"), F.col(vec).cast("array<double>").alias("qv")).where(F.col("qv").isNotNull())

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cents = sent.value[0]
        for b in batches:
            if b.num_rows:
                d = _distances(_matrix(b.column("qv"), np.float64), cents)
                order = np.argsort(d, axis=1, kind="stable")[:, :probe].astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("qv"), pa.array(list(order), pa.list_(pa.int32()))],
                                                 names=["qid", "qv", "near"])
    pairs = q.mapInArrow(probes, f"qid {qid_type}, qv array<double>, near array<int>").select("qid", "qv", F.explode("near").alias("list_id"))
    n_blocks = lambda n, per: F.ceil(F.col(n) / per).cast("int")
    asked = pairs.groupBy("list_id").agg(F.count(F.lit(1)).alias("n_queries"))
    # one row per probed list; the filter after the checkpoint is what dynamic pruning looks for
    probed = (index.headers.join(asked, "list_id").select("list_id", n_blocks("n_rows", members_per_block).alias("mb"),
                                                          n_blocks("n_queries", queries_per_block).alias("qb")).checkpoint().where("qb > 0"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (pairs.join(F.broadcast(probed), "list_id").withColumn("qblock", F.pmod(F.xxhash64("qid"), F.col("qb")).cast("int"))
            .withColumn("mblock", each("mb")).drop("mb", "qb"))
    right = (index.lists.join(F.broadcast(probed), "list_id").withColumn("mblock", F.pmod(F.xxhash64("key"), F.col("mb")).cast("int"))
             .withColumn("qblock", each("qb")).drop("mb", "qb"))

    def cell(qpdf: pd.DataFrame, mpdf: pd.DataFrame) -> pd.DataFrame:
        if qpdf.empty or mpdf.empty:
            return pd.DataFrame({"qid": qpdf["qid"].iloc[:0], "list_id": mpdf["list_id"].iloc[:0], "key": mpdf["key"].iloc[:0], "adc": np.zeros(0)})
        cents, books = sent.value
        x = _split(np.stack(qpdf["qv"]) - cents[int(qpdf["list_id"].iat[0])], dsub)
        codes = np.frombuffer(b"".join(mpdf["codes"]), np.uint8).reshape(len(mpdf), -1)
        r, i, d = _look_up(x, codes, books, k_cand)
        return pd.DataFrame({"qid": qpdf["qid"].to_numpy()[r], "list_id": mpdf["list_id"].to_numpy()[i], "key": mpdf["key"].to_numpy()[i],
                             "adc": np.round(d, 9)})

    at = ["list_id", "qblock", "mblock"]
    cands = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(cell, schema=f"qid {qid_type}, list_id int, key {key_type}, adc double")
    w = Window.partitionBy("qid").orderBy(F.col("adc").asc(), F.col("key").asc())
    short = cands.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k_cand).drop("__r", "adc")
    s = dot_product(F.col("qv"), F.col("embedding"))
    if decimals is not None:
        s = F.round(s, decimals)
    vectors = index.vectors.join(F.broadcast(probed.select("list_id")), "list_id", "left_semi")
    return short.join(q, "qid").join(vectors, ["list_id", "key"]).select(F.col("qid").alias(query_id), "key", s.alias("score"))
