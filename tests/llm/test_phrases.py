"""Phrase collocations against counting every phrase in plain Python, and against DuckDB."""
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import phrases
from tessera.llm.registry import ORACLE_SQL, op11_phrase_collocations

SCHEMA = "doc_id long, text string, lang string"
COLS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, max_words=5, min_count=100, absorb=100, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for i in range(len(w)) for k in range(1, max_words + 1) if i + k <= len(w))
    out = []
    for lang in n:
        here = {p: c for (x, p), c in f.items() if x == lang and c >= min_count and len(p) > 1}
        gone = {p[i:j] for p, c in here.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                if j - i < len(p) and 100 * c >= absorb * here[p[i:j]]}
        rows = []
        for p, a in here.items():
            if p not in gone:
                cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rows.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i + 1, ph.decode(), -a, l, r, n[lang], -s) for i, (s, a, ph, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit(1)).withColumn("phrase", F.lit("own")).repartition(3)
    got = phrases.collocations(df, **kw)
    assert got.columns == COLS
    return sorted(map(tuple, got.collect()))


def table(sf):
    return duckdb.sql(f"SELECT doc_id, text, lang FROM read_parquet('{sf}/documents.parquet')").fetchall()


def test_query_matches_plain_counts_and_sql(spark, sf):
    df = op11_phrase_collocations(spark, sf)
    assert dict(df.dtypes) == {"lang": "string", "phrase": "string", **dict.fromkeys(["rank", "a", "l", "r", "n", "score"], "bigint")}
    got = sorted(map(tuple, df.collect()))
    assert got == brute(table(sf)) and got
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    rel = con.sql(ORACLE_SQL["op11_phrase_collocations"])
    assert rel.columns == COLS and sorted(rel.fetchall()) == got


@pytest.mark.parametrize("budget,max_top", [(1 << 22, 1 << 18), (40, 6), (4000, 0)])
def test_small_budget_splits_prefixes_and_counts_alike(spark, sf, budget, max_top):
    """A budget of a few suffixes forces every round of splitting; ``max_top`` leaves words to the bit table."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(12)] + ["Été", "漢"]
    rows = [(i, " ".join(rng.choice([" ", " ", " ", ", ", "\t", "\n", "."]).join(rng.choices(words, range(14, 0, -1), k=3)) for _ in range(12)),
             rng.choice(["en", "fr", None, "und"])) for i in range(150)]
    rows += [(200 + i, "a b c d e f g. " * 3 + "x y z", "en") for i in range(30)]
    assert mined(spark, rows, min_count=3, absorb=90, budget=budget, max_top=max_top, top=50) == brute(rows, min_count=3, absorb=90, top=50)
    assert mined(spark, rows, min_count=5, max_words=3, budget=budget, max_top=max_top) == brute(rows, min_count=5, max_words=3)


def test_long_texts_are_cut_without_loss():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "b.", "c", "dddd", ";", "e,f"]) for _ in range(400)).encode() for _ in range(3)] + [b"", b"z" * 500, b"a b"]
    want, got = Counter(), Counter()
    for size in (1 << 22, 40):
        out = Counter()
        for words, own in phrases._chunks(iter(texts), 4, size):
            distinct, ids = phrases._numbered(words)
            windows, n = phrases._suffixes(ids, own, 5)
            names = [b""] + distinct[1:]
            out.update({tuple(names[i] for i in w): c for w, c in zip(windows.tolist(), n.tolist())})
        want, got = got, out
    assert got == want and sum(got.values()) > 500


@pytest.mark.parametrize("depth", [2, 3, 4, 5, 7])
def test_windows_by_doubling(depth):
    rng = np.random.default_rng(depth)
    for size, n in ((4, 60), (7000, 2000), (1 << 20, 500), (1, 9), (3, 1), (3, 0)):
        ids = rng.integers(0, size, n)
        ids = np.concatenate((ids, ids[:n // 2]))
        own = len(ids) * 3 // 4
        windows, counts = phrases._suffixes(ids, own, depth)
        want = Counter()
        for i in range(own):
            w = []
            for x in ids[i:i + depth].tolist():
                if not x:
                    break
                w.append(x)
            if len(w) > 1:
                want[tuple(w + [0] * (depth - len(w)))] += 1
        got = list(map(tuple, windows.tolist()))
        assert got == sorted(want) and counts.tolist() == [want[w] for w in got]


def test_odd_rows(spark, sf):
    assert mined(spark, []) == []
    rows = [(1, None, None), (2, "", "en"), (3, " ,\t.", "en"), (4, "A b " * 20000, "en"), (4, "A b " * 20000, "en"), (5, "a B c\x1c d", None)]
    assert mined(spark, rows, min_count=1, absorb=100) == brute(rows, min_count=1)
    copies = [(7, "one two three", None)] * 120
    assert mined(spark, copies) == brute(copies) == [("und", 1, "one two three", 120, 120, 120, 360, 3000)]
