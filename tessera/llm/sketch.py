"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch keeps the k smallest distinct XXH64 values of a text's word shingles. The
sketch of a whole is the k smallest of its parts' sketches, so sketches merge across
parts of a text, documents and tasks. Two sketches give the resemblance and the
containment of the shingle sets, one gives the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, checkpoint, free_name, shingle_hashes, texts

K, SHINGLE, SEED = 128, 5, 5


def merge(parts: list[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of the union: the k smallest distinct hashes of sketches or hash arrays, ascending."""
    if not parts:
        return np.empty(0, np.uint64)
    both = np.concatenate(parts)
    if len(both) > 8 * k:                                  # most hashes cannot be among the smallest
        low = np.unique(both[both <= np.partition(both, 4 * k)[4 * k]])
        if len(low) >= k:
            return low[:k]
    return np.unique(both)[:k]


def sketch(text: bytes, k: int = K, shingle: int = SHINGLE) -> np.ndarray:
    """The sketch of a text; a very long one is sketched in parts. No words: empty."""
    kept = np.empty(0, np.uint64)
    for h in shingle_hashes(text, shingle, SEED):
        kept = merge([kept, h], k)
    return kept


def distinct_count(s: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles (exact below k)."""
    return float(len(s)) if len(s) < k else (k - 1) / ((float(s[k - 1]) + 1) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the shingle sets; two empty sets are equal (1)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge([a, b], k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; an empty set is contained (1). Both
    sketches are complete up to the smaller of their largest hashes (a short one fully)."""
    if not len(a):
        return 1.0
    ends = [x[-1] for x in (a, b) if len(x) == k]
    known = a[a <= min(ends)] if ends else a
    return float(np.isin(known, b).mean()) if len(known) else 0.0


def to_text(s: np.ndarray) -> str:
    """The sketch as a string (base64 of its hashes, big-endian, ascending)."""
    return base64.b64encode(s.astype(">u8").tobytes()).decode()


def from_text(t: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(t), ">u8").astype(np.uint64)


def sketch_documents(df: DataFrame, *, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``df`` with ``out_col``: the sketch of each row's whole text as a string (null or blank: '')."""
    def make(t: pa.Array) -> pa.Array:
        return pa.array([to_text(sketch(x)) for x in texts(t)], pa.string())
    return df.withColumn(out_col, F.arrow_udf(make, "string")(F.col(f"`{text_col}`")))


def merge_sketches(df: DataFrame, by: str, *, out_col: str = "fingerprint") -> DataFrame:
    """(by, out_col, n_distinct): the merged sketch per value of ``by`` (null is a value) and
    the distinct shingles it stands for. Each task first merges what it has of a value, so a
    hot value meets as one sketch per task."""
    src = df.select(F.col(f"`{by}`").alias("g"), F.col(f"`{out_col}`").alias("s"))
    group = src.schema["g"].dataType.simpleString()

    def part(batches):
        for b in batches:
            for g, rows in pd.DataFrame({"g": b.column("g").to_pylist(), "s": b.column("s").to_pylist()}).groupby("g", dropna=False):
                kept = to_text(merge([from_text(x) for x in rows["s"] if x]))
                yield pa.RecordBatch.from_arrays([pa.array([None if pd.isna(g) else g], b.schema.field("g").type), pa.array([kept])],
                                                 names=["g", "s"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = merge([from_text(x) for x in pdf["s"] if x])
        return pd.DataFrame({"g": pdf["g"].iloc[:1], "s": [to_text(kept)], "n": [distinct_count(kept)]})
    merged = src.mapInArrow(part, f"g {group}, s string").groupBy("g").applyInPandas(whole, f"g {group}, s string, n double")
    return merged.select(F.col("g").alias(by), F.col("s").alias(out_col), F.col("n").alias("n_distinct"))


def with_next(df: DataFrame, order: str, value: str, out_col: str, *, per_partition: int = 4) -> DataFrame:
    """``df`` with ``out_col``: the ``value`` of the next row by descending ``order`` (null
    last; equal ones by a hash of the value); after the last row comes the first.

    Rows are dealt into ranges of ``order`` by quantiles (``per_partition`` ranges a shuffle
    partition); each range also gets the first row of the range after it, so a window
    per range sees every neighbour. Only the range borders reach the driver."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) * per_partition
    rng, ghost, tie, num = (free_name(df, x) for x in ("range_no", "ghost", "tie", "order_num"))
    col, val = F.col(f"`{order}`"), F.col(f"`{value}`")
    share = [i / n for i in range(1, n)]
    cuts = df.agg(F.percentile_approx(col.cast("double"), share, F.lit(max(10_000, 10 * n)))).first()[0] or []
    split = [-float("inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]
    ranged = Bucketizer(splits=split, inputCol=num, outputCol=rng, handleInvalid="keep").transform(
        df.withColumn(num, col.cast("double")).withColumn(tie, F.xxhash64(val)))
    ranged = ranged.withColumn(rng, F.when(col.isNull(), -1).otherwise(F.col(rng).cast("int"))).drop(num)
    last = F.struct(col.isNotNull(), col, F.col(tie))
    heads = checkpoint(ranged.groupBy(rng).agg(F.max_by(F.struct(*ranged.drop(rng).columns), last).alias("head")))
    have = sorted((r[0] for r in heads.select(rng).collect()), reverse=True)
    if not have:
        return df.withColumn(out_col, val)
    after = F.create_map(*[F.lit(x) for i, r in enumerate(have) for x in (r, have[i - 1])])     # whose next range is r
    ghosts = heads.select(after[F.col(rng)].alias(rng), "head.*").withColumn(ghost, F.lit(1))
    rows = ranged.withColumn(ghost, F.lit(0)).unionByName(ghosts)
    w = Window.partitionBy(rng).orderBy(ghost, F.col(f"`{order}`").desc_nulls_last(), F.col(tie).desc())
    return rows.withColumn(out_col, F.lead(val).over(w)).where(F.col(ghost) == 0).drop(rng, ghost, tie)


def edited_report(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, contained_edited, contained_next, n_distinct: the resemblance of the text to the edited
    one and to the next, the share of its shingles they have and how many it has. The edited text: the last floor(n/2) code points replaced by the first as
    many (or all) of the next document's (by descending id; after the last the first).

    A null text is empty; a null id comes last; equal ids are ordered by a hash of the text;
    a table of one row is its own next; an empty table gives no rows."""
    src = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    pairs = with_next(src, "doc_id", "text", "following")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = {k: [] for k in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
                                "contained_edited", "contained_next", "n_distinct")}
        was, its = None, None                              # the row before had this row's text as its next one
        for text, nxt in zip(b.column("text").to_pylist(), b.column("following").to_pylist()):
            half = len(text) // 2
            edited = (text[:len(text) - half] + nxt[:half]).encode()
            own = its if text == was else sketch(text.encode())
            was, its = nxt, sketch(nxt.encode())
            new = sketch(edited)
            for k, v in zip(out, (len(text), hashlib.sha256(edited).hexdigest(), to_text(own), to_text(new),
                                  resemblance(own, new), resemblance(own, its), containment(own, new),
                                  containment(own, its), distinct_count(own))):
                out[k].append(v)
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *[pa.array(v, pa.int64() if k == "n_chars" else None) for k, v in out.items()]],
            names=["doc_id", *out])
    return arrow_map(pairs, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double, "
                                 "contained_edited double, contained_next double, n_distinct double")
