"""Host-level quality rules, in DataFrame functions only.

Every document gets word statistics and rule failures. Failures are summed per
host (a map-side sum, so a hot host costs one row per task), each rule's host
rates are shrunk with a beta prior fitted to all hosts by the method of moments,
and a host whose shrunk rate of any rule passes ``host_limit`` is rejected with
all its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, checkpoint, free_name, let

RULES = ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length")


def _covered(hashes: Column) -> Column:
    """Words covered by the 3-word windows whose hash occurs twice or more."""
    tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def count(s: Column) -> Column:
        def twice(x: Column, j: Column) -> Column:
            return F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | \
                F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
        at = F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"]))
        zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(at, zero, lambda acc, p: F.struct(
            (acc["n"] + p + 3 - F.greatest(p, acc["end"])).alias("n"), (p + 3).alias("end")))["n"]
    return let(tagged, count)


def _repeat_words(words: Column) -> Column:
    def windows(w: Column) -> Column:
        h = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(
            F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return let(h, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint"))
                   .otherwise(_covered(h)))
    return F.when(F.size(words) < 4, F.lit(0).cast("bigint")).otherwise(windows(words))


def word_stats(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words), all
    long, of a text (null: as empty). ``n_repeat_words`` counts the words that lie in
    a 3-word window found at least twice, the first occurrence included."""
    text = F.coalesce(text, F.lit(""))

    def stats(w: Column) -> Column:
        return F.struct(F.size(w).cast("bigint").alias("n_words"),
                        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
                        _repeat_words(w).alias("n_repeat_words"))

    def lines(s: Column) -> Column:
        return F.struct(F.size(s).cast("bigint").alias("n_lines"),
                        (F.size(s) - F.size(F.array_distinct(s))).cast("bigint").alias("n_dup_lines"))
    by_word = let(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), stats)
    by_line = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), lines)
    return let(F.struct(by_word.alias("w"), by_line.alias("l")), lambda s: F.struct(
        s["w"]["n_words"].alias("n_words"), s["w"]["word_chars"].alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        s["l"]["n_lines"].alias("n_lines"), s["l"]["n_dup_lines"].alias("n_dup_lines"),
        s["w"]["n_repeat_words"].alias("n_repeat_words")))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def rule_failures(s: Column) -> dict[str, Column]:
    """The rules of a document, as 0/1 columns, from its ``word_stats``."""
    hit = {"few_words": s["n_words"] < 50,
           "repeated_words": 100 * s["n_repeat_words"] > 50 * s["n_words"],
           "symbols": 10 * s["n_symbols"] > s["word_chars"],
           "repeated_lines": 10 * s["n_dup_lines"] > 3 * s["n_lines"],
           "word_length": (s["word_chars"] < 2 * s["n_words"]) | (s["word_chars"] > 20 * s["n_words"])}
    return {k: v.cast("int") for k, v in hit.items()}


def host_rates(failures: DataFrame) -> DataFrame:
    """(host, n_docs, worst_rate): per host the largest shrunk failure rate of RULES.
    ``failures`` has ``host`` and one 0/1 column per rule; a null host is a host.

    With mu the mean rate over all documents and v the variance of the host rates
    beyond what sampling explains, the beta prior has mean mu and weight
    m = mu (1 - mu) / v - 1 (1 to 10^6); a host's rate is (failed + m mu) / (n + m)."""
    hosts = checkpoint(failures.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(r).alias(r) for r in RULES]))
    total = hosts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("h"), *[F.sum(r).alias(r) for r in RULES]).first()
    if not total["n"]:
        return hosts.select("host", F.col("n").alias("n_docs"), F.lit(0.0).alias("worst_rate"))
    mean = {r: total[r] / total["n"] for r in RULES}
    spread = hosts.agg(*[F.sum(F.col("n") * F.pow(F.col(r) / F.col("n") - mean[r], 2)).alias(r) for r in RULES]).first()
    rates = []
    for r in RULES:
        mu = mean[r]
        between = spread[r] / total["n"] - mu * (1 - mu) * (total["h"] - 1) / total["n"]
        weight = min(1e6, max(1.0, mu * (1 - mu) / between - 1)) if between > 0 else 1e6
        rates.append((F.col(r) + weight * mu) / (F.col("n") + weight))
    return hosts.select("host", F.col("n").alias("n_docs"), F.greatest(*rates).alias("worst_rate"))


#: Host lists up to this many rows (of a host name each) may be broadcast.
MAX_BROADCAST_HOSTS = 100_000


def _with_hosts(df: DataFrame, host: str, hosts: DataFrame) -> DataFrame:
    small = hosts.limit(MAX_BROADCAST_HOSTS + 1).count() <= MAX_BROADCAST_HOSTS
    side = F.broadcast(hosts) if small else hosts
    return df.join(side, df[host].eqNullSafe(side["host"]), "left")


def quality_report(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                   host_limit: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, host, the ``word_stats``, base_failed,
    host_rate (the host's worst shrunk rate) and kept (false if base_failed or the
    host's rate is over ``host_limit``).

    A null or blank text has no words (base_failed); a null host is one host; repeated
    rows count each time; an empty table gives no rows; other columns are ignored."""
    s = F.col("s")
    rows = checkpoint(df.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{host_col}`").alias("doc_host"),
        word_stats(F.col(f"`{text_col}`")).alias("s"))
        .select("doc_id", "doc_host", "s.*", base_failed(s).alias("base_failed"),
                *[c.alias(r) for r, c in rule_failures(s).items()]))
    hosts = checkpoint(host_rates(rows.select(F.col("doc_host").alias("host"), *RULES)))
    out = _with_hosts(rows, "doc_host", hosts)
    return out.select("doc_id", F.col("doc_host").alias("host"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", F.round("worst_rate", 9).alias("host_rate"),
                      (~F.col("base_failed") & (F.col("worst_rate") <= host_limit)).alias("kept"))


def drop_rejected(df: DataFrame, *, text_col: str = "text", host_col: str = "source",
                  host_limit: float = 0.5) -> DataFrame:
    """The rows of ``df`` (same columns) that ``quality_report`` keeps."""
    name = free_name(df, "s")
    s = F.col(name)
    stated = df.withColumn(name, word_stats(F.col(f"`{text_col}`")))
    fails = stated.select(F.col(f"`{host_col}`").alias("host"), *[c.alias(r) for r, c in rule_failures(s).items()])
    bad = checkpoint(host_rates(fails).where(F.col("worst_rate") > host_limit).select(F.col("host")))
    small = bad.limit(MAX_BROADCAST_HOSTS + 1).count() <= MAX_BROADCAST_HOSTS
    side = F.broadcast(bad) if small else bad
    passed = stated.where(~base_failed(s))
    return passed.join(side, passed[host_col].eqNullSafe(side["host"]), "left_anti").select(
        *[F.col(f"`{c}`") for c in df.columns])
