"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most ``2 r`` bits share a word within
``r`` bits of both. Every distinct fingerprint therefore stands for its ball: all
words with at most ``r`` bits flipped (2081 for r = 2). Equal words of two balls
collide, and every pair that collides lies within ``2 r`` bits.

The exchange key is the top ``k`` bits of the variant, so a fingerprint is sent
once to each prefix its ball reaches (1 + k + k(k-1)/2 rows, not 2081) and the
receiver forms the variants that fall there. A prefix whose variants exceed
``max_variants`` is split into slices by a hash of the variant, so a dense group of
near-copies spreads over many tasks. Within a slice all members of a colliding
word link to one of them (their mutual distance is within ``2 r`` anyway), never
pair by pair, and a slice reports one spanning link per member.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, arrow_map, checkpoint, free_keys, row_keys, shingle_hashes, texts

SEED = 42


def simhash64(text: bytes, shingle: int = 4) -> int:
    """The fingerprint of a text: bit b is 1 if it is set in over half the XXH64
    hashes of its shingles. No words: zero."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, shingle, SEED):
        n += len(h)
        for i in range(0, len(h), 1 << 16):
            bits = h[i:i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int((np.uint64(1) << np.arange(64, dtype=np.uint64))[2 * ones > n].sum(dtype=np.uint64)) if n else 0


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, ROW, fp): the fingerprint of each row's whole text (null: zero)
    as a signed 64-bit integer; ROW is the row's identity."""
    src = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), *row_keys(df),
                    F.col(f"`{text_col}`").alias("text"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.fromiter((simhash64(t, shingle) for t in texts(b.column("text"))), np.uint64, b.num_rows)
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", *ROW)), pa.array(fp.view(np.int64))],
                                          names=["doc_id", *ROW, "fp"])
    return arrow_map(src, run, "doc_id long, row_key long, row_key2 long, fp long")


def _flips(bits: int, most: int) -> np.ndarray:
    """All words of ``bits`` bits with at most ``most`` ones, fewest ones first."""
    return np.array([sum(1 << i for i in c) for n in range(most + 1) for c in itertools.combinations(range(bits), n)],
                    np.uint64)


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For n nodes and links a-b: the smallest node that each node reaches."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _collide(fps: np.ndarray, used: np.ndarray, low_bits: int, radius: int, slice_no: int, slices: int,
             chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) between fingerprints whose balls share a variant in one
    prefix. ``used``: the bits that each fingerprint spends to reach the prefix."""
    low = fps & np.uint64((1 << low_bits) - 1)
    words, owners = [], []
    for d in range(radius + 1):
        mine = np.flatnonzero(used == d)
        masks = _flips(low_bits, radius - d)
        step = max(1, chunk // len(masks))
        for i in range(0, len(mine), step):
            rows = mine[i:i + step]
            z = low[rows, None] ^ masks[None, :]
            own = np.repeat(rows.astype(np.int32), len(masks))
            z = z.ravel()
            if slices > 1:
                keep = (z * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(slices) == np.uint64(slice_no)
                z, own = z[keep], own[keep]
            words.append(z)
            owners.append(own)
    z, own = np.concatenate(words), np.concatenate(owners)
    del words, owners
    ordered = np.sort(z)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    none = np.empty(0, np.int64)
    if not len(shared):
        return none, none
    del ordered
    at = np.searchsorted(shared, z).astype(np.int32)
    at[at == len(shared)] = 0
    hit = shared[at] == z
    group, own = at[hit], own[hit]
    del z, at, hit
    order = np.lexsort((own, group))
    group, own = group[order], own[order]
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    first = np.repeat(own[head], np.diff(np.r_[head, len(own)]))
    pair = np.unique(np.stack([own, first], 1)[own != first], axis=0)
    near = np.bitwise_count(fps[pair[:, 0]] ^ fps[pair[:, 1]]) <= 2 * radius       # verified, link by link
    a, b = pair[near, 0], pair[near, 1]
    if not len(a):
        return none, none
    root = _spanning(a, b, len(fps))
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return moved, root[moved]


def ball_links(nodes: DataFrame, *, max_bits: int = 4, per_prefix: int = 256, max_variants: int = 1_000_000) -> DataFrame:
    """(a, b): links that join exactly the distinct fingerprints ``nodes.fp`` which are
    connected by steps of at most ``max_bits`` bits (``max_bits`` even). ``per_prefix``
    sets the mean number of fingerprints of a prefix, ``max_variants`` the variants that
    one task forms at a time; both change the plan only, never the links."""
    spark, radius = nodes.sparkSession, max_bits // 2
    if max_bits % 2:
        raise ValueError("max_bits must be even: the ball has half the radius")
    n = nodes.count()
    k = min(24, max(4, (max(1, n) // per_prefix).bit_length()))
    low_bits = 64 - k
    masks = [(int(m), int(m).bit_count()) for m in _flips(k, radius)]
    volume = [len(_flips(low_bits, radius - d)) for d in range(radius + 1)]
    flip = F.array(*[F.struct(F.lit(m).cast("bigint").alias("m"), F.lit(d).alias("d")) for m, d in masks])
    at = nodes.select("fp", F.shiftrightunsigned("fp", low_bits).alias("prefix"))
    reach = at.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).select("prefix", "n", F.inline(flip)).select(
        "prefix", "d", "n", F.col("prefix").bitwiseXOR(F.col("m")).alias("bucket"))
    weight = F.element_at(F.array(*[F.lit(v).cast("bigint") for v in volume]), F.col("d") + 1) * F.col("n")
    slices = reach.groupBy("bucket").agg(F.ceil(F.sum(weight) / max_variants).cast("int").alias("slices"))
    targets = reach.select("prefix", "d", "bucket").join(slices, "bucket")
    sent = (at.join(targets, "prefix")
            .select("fp", "d", "bucket", "slices", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf["fp"].to_numpy().view(np.uint64)
        order = np.argsort(fps)
        a, b = _collide(fps[order], pdf["d"].to_numpy()[order], low_bits, radius, int(pdf["slice"].iat[0]),
                        int(pdf["slices"].iat[0]))
        s = fps[order].view(np.int64)
        return pd.DataFrame({"a": s[a], "b": s[b]})

    return sent.groupBy("bucket", "slice").applyInPandas(meet, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node that
    it reaches. Large-star / small-star rounds; each round's links are checkpointed, a
    round aggregates before it joins, so a hot node splits like any skewed join key."""
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = checkpoint(pairs)

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    seen = mark(pairs)
    while seen[0]:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = checkpoint(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = mark(nxt)
        pairs = nxt
        if now == seen:
            break
        seen = now
    return (pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct())


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    max_bits: int = 4) -> DataFrame:
    """(doc_id, ROW, fp, component_id): one row per input row. ``component_id`` is
    the smallest id that the row reaches over links of at most ``max_bits`` differing
    bits, itself included.

    Null or blank texts have fingerprint zero and link like any other; a row with a
    null id counts for reaching others but never names a component (null if the whole
    component has no id); repeated rows share a component; an empty table gives no rows;
    other columns are ignored."""
    fps = checkpoint(fingerprints(df, id_col=id_col, text_col=text_col, shingle=shingle))
    nodes = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("low_id")))
    roots = checkpoint(components(ball_links(nodes.select("fp"), max_bits=max_bits)))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "low_id", F.coalesce("root", "fp").alias("root"))
    names = checkpoint(rooted.groupBy("root").agg(F.min("low_id").alias("component_id")))
    named = checkpoint(rooted.join(names, "root").select("fp", "component_id"))
    return fps.join(named, "fp").select("doc_id", *ROW, "fp", "component_id")


def keep_one(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
             max_bits: int = 4) -> DataFrame:
    """The rows of ``df`` (same columns) with one row left of each component: the one
    with the smallest id (null last), then the smallest row hash; of fully equal rows
    one stays."""
    found = near_duplicates(df, id_col=id_col, text_col=text_col, shingle=shingle, max_bits=max_bits)
    rooted = found.select(*ROW, "fp", F.coalesce("component_id", "fp").alias("c"),
                          F.col("component_id").isNull().alias("unnamed"),
                          F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"))
    first = rooted.groupBy("c", "unnamed").agg(F.min("d").alias("d"))
    of_id = rooted.join(first, ["c", "unnamed", "d"]).select("c", "unnamed", *ROW)
    low = of_id.groupBy("c", "unnamed").agg(F.min(ROW[0]).alias(ROW[0]))
    kept = of_id.join(low, ["c", "unnamed", ROW[0]]).groupBy("c", "unnamed", ROW[0]).agg(F.min(ROW[1]).alias(ROW[1]))
    names = free_keys(df)
    keys = checkpoint(kept.select(*[F.col(r).alias(n) for r, n in zip(ROW, names)]).distinct())
    out = df.select("*", *row_keys(df, names)).join(keys, list(names), "left_semi").dropDuplicates(list(names))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
