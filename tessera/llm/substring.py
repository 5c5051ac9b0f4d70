"""Substring dedup by content-defined chunks.

A gear rolling hash over the last 16 bytes is taken at every byte; a byte whose
hash is the largest within ``reach`` bytes on both sides ends a chunk. A cut so
depends only on the bytes around it, and an insertion moves the chunks without
changing those after it. Long stretches without a cut (one byte repeated) are cut
every ``max_chunk`` bytes. Chunks are matched by a 128-bit digest over the whole
table; runs of adjacent repeated chunks of at least ``min_run`` bytes are removed
everywhere but at their first occurrence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, arrow_map, checkpoint, free_keys, free_name, row_keys, texts

REACH, MAX_CHUNK, MIN_RUN = 24, 512, 96
#: The gear table: one 32-bit word per byte value, from XXH32.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([i]), 7) for i in range(256)], np.uint32)


def _slide(a: np.ndarray, width: int) -> np.ndarray:
    """out[i] = max(a[i : i + width]), by doubling; shorter at the end."""
    out, have = a, 1
    while have < width:
        step = min(have, width - have)
        out = np.maximum(out, np.concatenate((out[step:], np.zeros(min(step, len(out)), a.dtype))))
        have += step
    return out


def cut_points(text: bytes, reach: int = REACH, max_chunk: int = MAX_CHUNK) -> np.ndarray:
    """The ends of the chunks of ``text``, ascending; the last is its length."""
    n = len(text)
    h = GEAR[np.frombuffer(text, np.uint8)]
    for s in (1, 2, 4, 8):                       # after these, h[i] covers the bytes i-15 .. i
        h[s:] = h[s:] + (h[:-s] << np.uint32(s)) if n > s else h[s:]
    ends = np.empty(0, np.int64)
    if n > 2 * reach:
        after = _slide(h, reach)                 # largest of h[i : i + reach]
        at = np.arange(reach, n - reach)
        top = (h[at] > after[at - reach]) & (h[at] >= after[at + 1])
        ends = at[top] + 1
    edges = np.concatenate(([0], ends, [n]))
    wide = np.flatnonzero(np.diff(edges) > max_chunk)
    if len(wide):
        more = [np.arange(edges[i] + max_chunk, edges[i + 1], max_chunk) for i in wide]
        edges = np.sort(np.concatenate([edges, *more]))
    return edges[1:]


def chunks(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ROW, start, end, d1, d2): the chunks of every text in byte offsets of
    its UTF-8 form, with a 128-bit digest. Null or empty texts have none."""
    src = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), *row_keys(df),
                    F.col(f"`{text_col}`").alias("text")).where(F.length("text") > 0)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        counts, starts, ends, digests = [], [], [], []
        for t in texts(b.column("text")):
            cut = cut_points(t)
            begin = np.concatenate(([0], cut[:-1]))
            counts.append(len(cut))
            starts.append(begin)
            ends.append(cut)
            digests.extend(xxhash.xxh3_128_digest(t[i:j]) for i, j in zip(begin.tolist(), cut.tolist()))
        row = pa.array(np.repeat(np.arange(b.num_rows), counts))
        d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [*(b.column(c).take(row) for c in ("doc_id", *ROW)), pa.array(np.concatenate(starts).astype(np.int32)),
             pa.array(np.concatenate(ends).astype(np.int32)), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())],
            names=["doc_id", *ROW, "start", "end", "d1", "d2"])
    return arrow_map(src, run, "doc_id long, row_key long, row_key2 long, start int, end int, d1 long, d2 long")


def repeated_spans(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, ROW, start, end, first_doc_id): the byte spans of at least ``min_run``
    bytes whose chunks all occur earlier. The order is by doc_id (null last), then the
    row's hash, then the offset: of equal passages the first in this order stays;
    ``first_doc_id`` is the smallest document that holds a first occurrence of the span's
    chunks. Fully equal rows count as one document."""
    found = chunks(df, id_col=id_col, text_col=text_col)
    # document order as one number: the id, then 32 bits of the row's hash (a hash aggregate can keep its minimum)
    order = (F.coalesce("doc_id", F.lit(2**63 - 1)).cast("decimal(20,0)") * F.lit(2**32).cast("decimal(12,0)")
             + F.col("row_key").bitwiseAND(F.lit(2**32 - 1))).cast("decimal(34,0)")
    keyed = found.withColumn("k", order)
    firsts = checkpoint(keyed.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k1"))
                        .where("n > 1").select("d1", "d2", "k1"))
    seen = keyed.join(firsts, ["d1", "d2"]).select(
        "doc_id", *ROW, "start", "end", "d1", "d2", (F.col("k") == F.col("k1")).alias("own"),
        F.expr("(k1 - pmod(k1, 4294967296BD)) div 4294967296BD").alias("first_doc_id"))
    seen = seen.repartition("doc_id", *ROW)        # a document's chunks meet once for all that follows
    doc = Window.partitionBy("doc_id", *ROW).orderBy("start")
    nth = F.row_number().over(Window.partitionBy("doc_id", *ROW, "d1", "d2").orderBy("start", "end"))
    late = seen.dropDuplicates(["doc_id", *ROW, "start"]).withColumn("nth", nth).where(~F.col("own") | (F.col("nth") > 1))
    run = late.withColumn("new", (F.coalesce(F.lag("end").over(doc), F.lit(-1)) != F.col("start")).cast("int")) \
              .withColumn("run", F.sum("new").over(doc))
    first = F.when(F.col("first_doc_id") == 2**63 - 1, None).otherwise(F.col("first_doc_id"))
    return (run.groupBy("doc_id", *ROW, "run")
            .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(first).alias("first_doc_id"))
            .where(F.col("end") - F.col("start") >= min_run)
            .select("doc_id", *ROW, "start", "end", "first_doc_id"))


def repeat_report(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  min_run: int = MIN_RUN) -> DataFrame:
    """One row per document that repeats an earlier passage: doc_id, n_spans,
    removed_bytes, spans (array of start, end, first_doc_id in text order) and
    first_doc_ids (the documents that keep the passages; not the document itself).
    Documents without a repeat have no row; neither have null or empty texts."""
    spans = repeated_spans(df, id_col=id_col, text_col=text_col, min_run=min_run)
    listed = spans.groupBy("doc_id", *ROW).agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "first_doc_id"))).alias("spans"),
        F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("end") - F.col("start")).alias("removed_bytes"))
    firsts = F.array_sort(F.array_distinct(F.filter(F.transform("spans", lambda s: s["first_doc_id"]), lambda x: x.isNotNull())))
    return listed.select("doc_id", "n_spans", "removed_bytes", "spans",
                         F.filter(firsts, lambda x: F.coalesce(x != F.col("doc_id"), F.lit(True))).alias("first_doc_ids"))


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans; a span is first narrowed to whole characters."""
    out, at = [], 0
    for start, end in spans:
        while start < end and text[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        out.append(text[at:start])
        at = end
    return b"".join([*out, text[at:]]).decode("utf-8")


def drop_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars",
                 min_run: int = MIN_RUN) -> DataFrame:
    """The rows of ``df`` (same columns) with repeated spans cut out of the text and
    ``chars_col``, where there is one, set to the new length. A row of which nothing but
    white space is left goes; rows without a repeat, null and empty texts stay as they are."""
    keys, cut, new = free_keys(df), free_name(df, "cuts"), free_name(df, "cut_text")
    spans = repeated_spans(df, id_col=id_col, text_col=text_col, min_run=min_run)
    listed = checkpoint(spans.groupBy(*[F.col(r).alias(n) for r, n in zip(ROW, keys)]).agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias(cut)))
    joined = df.select("*", *row_keys(df, keys)).join(listed, list(keys), "left")

    def run(text: pa.Array, cuts: pa.Array) -> pa.Array:
        done = [None if t is None else cut_spans(t, [(c["start"], c["end"]) for c in cs]) if cs else t.decode("utf-8")
                for t, cs in zip(text.cast(pa.binary()).to_pylist(), cuts.to_pylist())]
        return pa.array(done, pa.string())
    cutter = F.arrow_udf(run, "string")
    whole = F.col(f"`{text_col}`")
    # a row without cuts keeps its column as it is; only the others go through Python
    named = joined.withColumn(new, F.when(F.col(cut).isNull(), whole).otherwise(
        cutter(F.when(F.col(cut).isNotNull(), whole), F.col(cut))))
    left = named.where(F.col(cut).isNull() | F.col(new).rlike(r"[^\x20\x09-\x0D]"))
    pick = []
    for c in df.columns:
        if c == text_col:
            pick.append(F.col(new).alias(c))
        elif c == chars_col:
            pick.append(F.when(F.col(cut).isNull(), F.col(f"`{c}`")).otherwise(F.length(new).cast(df.schema[c].dataType)).alias(c))
        else:
            pick.append(F.col(f"`{c}`"))
    return left.select(*pick)
