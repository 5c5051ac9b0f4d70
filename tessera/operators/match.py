"""Key matching: JOIN-3 exact key lookup, AGG-10 normalised-key table,
JOIN-4 exact-match boost, JOIN-5 one-edit (fuzzy) boost, WIN-4 first fuzzy key.

The one-edit join never compares all pairs: both sides are expanded into block
hashes that strings within one edit share (``edit_blocks``), joined on them, and
every candidate is verified with ``levenshtein(a, b, 1)``. A popular term or key is
one join key; Spark's skew join splits it. The joins are by sort and merge: all their sides
grow with the queries or the records, more than Catalyst expects of exploded rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import RetrievalConfig
from tessera.functions.text import extract_query_term, normalize_text


#: Up to this length a string is blocked by its deletion variants, from it on by its halves.
_LONG = 64


def edit_blocks(s: Column) -> Column:
    """Hashes such that two strings within one edit share one. Up to 64 characters: of the
    string and of every string made by deleting one character. From 64 on: of the first and
    of the last m // 2 characters with m, where m is the shorter length of a pair (the
    string's own or one less): the edit leaves one of the two alone. A string costs at most
    a constant plus its length."""
    n = F.length(s)
    dels = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                       lambda i: F.xxhash64(F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1))))
    none = F.array().cast("array<bigint>")
    halves = []
    for m in (n, n - 1):
        h = F.floor(m / 2).cast("int")
        halves += [F.xxhash64(F.lit("first"), m, F.substr(s, F.lit(1), h)), F.xxhash64(F.lit("last"), m, F.substr(s, n - h + 1))]
    short = F.when(n <= _LONG, F.array_union(F.array(F.xxhash64(s)), F.when(n > 0, dels).otherwise(none))).otherwise(none)
    return F.array_union(short, F.when(n >= _LONG, F.array(*halves)).otherwise(none))


def with_query_terms(queries: DataFrame, query: str = "query") -> DataFrame:
    """Add ``term`` (STR-2) and ``norm_term`` (STR-1 of the term; empty when no term)."""
    term = extract_query_term(F.col(query))
    return (queries.withColumn("term", term)
            .withColumn("norm_term", F.when(F.col("term") != "", normalize_text(F.col("term"))).otherwise(F.lit(""))))


def normalised_keys(records: DataFrame, key: str = "key", ord_col: str = "ord") -> DataFrame:
    """AGG-10: one row per normalised key. ``last_ord`` is the record a lookup
    resolves to (a later duplicate wins); ``first_ord`` is the key's position in
    insertion order (a dict keeps the first insertion position)."""
    keys = records.groupBy(key).agg(F.max(ord_col).alias("last_ord"), F.min(ord_col).alias("first_ord"))  # a key is normalised once
    return (keys.withColumn("norm_key", normalize_text(F.col(key)))
            .groupBy("norm_key")
            .agg(F.max("last_ord").alias("last_ord"), F.min("first_ord").alias("first_ord")))


def exact_key_lookup(queries: DataFrame, records: DataFrame, *, query: str = "query",
                     key: str = "key") -> DataFrame:
    """JOIN-3: a raw query equal to a stored key gives that record with score 1.0."""
    return (queries.join(records, queries[query] == records[key], "inner")
            .withColumn("score", F.lit(1.0)))


def fuzzy_key_candidates(terms: DataFrame, nkeys: DataFrame, min_len: int) -> DataFrame:
    """JOIN-5 candidates: (norm_term, norm_key) pairs within one edit, terms of at
    least ``min_len`` characters. ``terms`` holds distinct ``norm_term`` values."""
    t = (terms.filter(F.length("norm_term") >= min_len)
         .select("norm_term", F.explode(edit_blocks(F.col("norm_term"))).alias("h")))
    k = (nkeys.filter(F.length("norm_key") >= min_len - 1)
         .select("norm_key", "first_ord", "last_ord", F.explode(edit_blocks(F.col("norm_key"))).alias("h")))
    pairs = t.join(k.hint("merge"), "h").drop("h").dropDuplicates(["norm_term", "norm_key"])
    return pairs.filter(F.levenshtein("norm_term", "norm_key", 1).between(0, 1))


def key_boosts(queries: DataFrame, records: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), *,
               query_id: str = "query_id", query: str = "query", key: str = "key",
               ord_col: str = "ord") -> DataFrame:
    """Boost table of the embedding-cache tier (``fuzzy="first"``, D12):
    per query at most one row ``(query_id, ord, match_kind, boost)``:
    the exact normalised key (+exact_boost), else the first key in insertion
    order within one edit (+fuzzy_boost), both resolved to the key's last record.
    Matching runs on distinct terms, then joins back to the queries."""
    q = with_query_terms(queries.select(query_id, query), query).filter(F.col("norm_term") != "")
    nkeys = normalised_keys(records, key, ord_col)
    terms = q.select("norm_term").distinct()
    # one left join decides: a term with a key is exact, the misses go on to the one-edit join
    found = terms.join(nkeys.hint("merge"), terms.norm_term == nkeys.norm_key, "left").select("norm_term", F.col("last_ord").alias("ord"))
    exact = found.where("ord IS NOT NULL").select("norm_term", "ord", F.lit("exact").alias("match_kind"),
                                                  F.lit(cfg.exact_boost).alias("boost"))
    no_exact = found.where("ord IS NULL").select("norm_term")
    fuzzy = (fuzzy_key_candidates(no_exact, nkeys, cfg.fuzzy_min_len)
             .groupBy("norm_term")
             .agg(F.min_by("last_ord", "first_ord").alias("ord"))
             .select("norm_term", "ord", F.lit("fuzzy").alias("match_kind"), F.lit(cfg.fuzzy_boost).alias("boost")))
    per_term = exact.unionByName(fuzzy)
    return q.join(per_term.hint("merge"), "norm_term").select(query_id, "ord", "match_kind", "boost")


def boost_shortlist(cands: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), *,
                    key: str = "key", score: str = "score") -> DataFrame:
    """Tier-0 boost (``fuzzy="all"``) on a shortlist that carries ``norm_term``:
    every exact key gets +exact_boost, every other key within one edit of a term
    of ``fuzzy_min_len``+ characters gets +fuzzy_boost; clamped at 1.0 (PRJ-8
    keeps the raw score and the boost apart)."""
    nk = normalize_text(F.col(key))
    nt = F.col("norm_term")
    boost = (F.when(nt == "", F.lit(0.0))
             .when(nk == nt, F.lit(cfg.exact_boost))
             .when((F.length(nt) >= cfg.fuzzy_min_len) & (F.levenshtein(nt, nk, 1).between(0, 1)),
                   F.lit(cfg.fuzzy_boost))
             .otherwise(F.lit(0.0)))
    return (cands.withColumn("raw_score", F.col(score)).withColumn("boost", boost)
            .withColumn(score, F.when(F.col("boost") > 0, F.least(F.lit(1.0), F.col("raw_score") + F.col("boost")))
                        .otherwise(F.col("raw_score"))))
