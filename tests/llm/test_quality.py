"""Quality rules against a plain-Python count and the oracle SQL."""
import re

import duckdb
from llm.conftest import ODD, words

from tessera.llm import quality
from tessera.llm.registry import ORACLE_SQL, op10_quality_rules


def brute(text):
    t = text or ""
    w = words(t)
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    hit = {j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if words(x)]
    return (len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))


def test_counts_match_brute_force(spark, sf, corpus):
    for r in op10_quality_rules(spark, sf).collect():
        want = brute(corpus[r.doc_id][0])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_oracle(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    rel = con.sql(ORACLE_SQL["op10_quality_rules"])
    df = op10_quality_rules(spark, sf)
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(map(tuple, df.select(*rel.columns).collect())) == sorted(rel.fetchall())


def test_odd_rows(spark, docs):
    odd = ODD + [(8, "a b c a b c a b c d\n\nx\nx\n x", None), (9, "aa bb cc aa bb cc " * 10, "a")]
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
                  for r in quality.quality_report(docs(odd, extra=["s", "host", "kept"])).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t, _ in odd), key=str)
    assert quality.quality_report(docs([])).count() == 0
    assert quality.drop_rejected(docs([])).count() == 0


def good(i):
    return " ".join(f"w{i}x{j}" for j in range(60))


def test_bad_host_goes_and_small_one_is_shrunk(spark, docs):
    rows = [(i, good(i), "fine") for i in range(60)] + [(100 + i, "short one", "bad") for i in range(40)]
    rows += [(150, good(150), "bad"), (200, "short", "small"), (201, good(201), "small"), (300, good(300), None)]
    df = docs(rows, extra=["s", "host"])
    kept = {r.doc_id for r in quality.quality_report(df).where("kept").collect()}
    assert kept == {*range(60), 201, 300}                  # the clean page of the bad host goes with it
    out = quality.drop_rejected(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == kept
