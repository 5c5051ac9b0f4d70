"""SRC-1 contract errors, PRJ-1/2, record store, AGG-10 + JOIN-4/5 against worked cases."""
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import match as M
from tessera.sources import corpus as C
from tessera.sources.store import StoreCatalog, keyed_records, read_records, store_stats, write_records

DEMO = [
    {"id": "001", "lemma": "huevo", "definition": "Alimento de las aves."},
    {"id": "002", "lemma": "huevo frito", "definition": "Huevo cocinado en aceite."},
    {"id": "003", "lemma": "efímero", "definition": "Que dura poco."},
    {"id": "004", "lemma": "Efimero", "definition": "Duplicado con otra grafía."},
    {"id": "005", "lemma": "serendipia", "definition": "Hallazgo afortunado."},
    {"id": "006", "term": "sin lema", "text": "solo texto"},
    {"id": "", "lemma": "", "term": ""},
]


def _write(tmp, obj):
    p = os.path.join(tmp, "c.json")
    with open(p, "w", encoding="utf-8") as f:
        json.dump(obj, f, ensure_ascii=False, indent=1)
    return p


def test_json_scan_contract(spark):
    with pytest.raises(FileNotFoundError):
        C.json_corpus_scan(spark, "/nonexistent/corpus.json")
    tmp = tempfile.mkdtemp()
    with pytest.raises(ValueError):
        C.json_corpus_scan(spark, _write(tmp, {"lemma": "x"}))
    df = C.json_corpus_scan(spark, _write(tempfile.mkdtemp(), DEMO))
    assert df.count() == len(DEMO) and sorted(r.ord for r in df.collect()) == list(range(len(DEMO)))


def test_projections_and_store(spark):
    df = C.json_corpus_scan(spark, _write(tempfile.mkdtemp(), DEMO))
    rows = {r.ord: r for r in df.select("ord", C.record_key().alias("k"), C.record_to_text().alias("t")).collect()}
    assert rows[0].k == "huevo" and rows[0].t == "huevo: Alimento de las aves."
    assert rows[5].k == "006" and rows[5].t == "sin lema: solo texto"
    assert rows[6].k is None
    store = keyed_records(df, 4)
    assert store.count() == 6
    root = tempfile.mkdtemp()
    write_records(store, root)
    back = read_records(spark, root)
    assert back.count() == 6
    assert store_stats(back).filter(F.col("bucket").isNull()).first().n_records == 6
    assert StoreCatalog.open(spark, root).tier == "exact"
    parsed = back.select(C.parse_record_or_wrap("value").alias("r")).select("r.lemma").collect()
    assert {"huevo", "serendipia"} <= {r.lemma for r in parsed}


def test_unknown_fields_survive(spark):
    rows = [{"id": "1", "lemma": "faro", "category": "mar", "tags": ["a", "b"], "n": 5, "deep": {"x": None, "y": "z\"q"}},
            {"category": "solo", "weight": 2.5}, {"id": 3, "text": "plain", "odd \"key\"": True}]
    df = C.json_corpus_scan(spark, _write(tempfile.mkdtemp(), rows))
    back = {r.ord: json.loads(r.v) for r in df.select("ord", C.to_json_record().alias("v")).collect()}
    assert back == {0: rows[0], 1: rows[1], 2: rows[2] | {"id": "3"}}
    store = keyed_records(df, 4).select("key", C.parse_record_or_wrap("value").alias("r")).collect()
    got = {r.key: r.r for r in store}
    assert set(got) == {"faro", "3"} and got["faro"].lemma == "faro"
    assert {k: json.loads(v) for k, v in got["faro"].extra.items()} == {
        "category": "mar", "tags": ["a", "b"], "n": 5, "deep": {"x": None, "y": "z\"q"}}
    wrapped = spark.createDataFrame([("not json",), ("[1]",)], "value string").select(C.parse_record_or_wrap("value").alias("r")).collect()
    assert [r.r.text for r in wrapped] == ["not json", "[1]"]


def test_key_boosts_by_hand(spark):
    keys = ["faro", "brújula", "Brujula", "ancla", "anclas", "marejada", "vela"]
    recs = spark.createDataFrame(list(enumerate(keys)), "ord long, key string")
    want = {"que es el faro": (0, "exact"), "qué significa brujula": (2, "exact"),      # the later spelling wins
            "define brujola": (2, "fuzzy"), "que es la anclaz": (3, "fuzzy"),             # first key in order, of two near ones
            "que es la vela": (6, "exact"), "define velaa": (6, "fuzzy"), "define vel": None,   # too short for an edit
            "otra cosa distinta": None, "significado de marejades": None}
    q = spark.createDataFrame(list(enumerate(want)), "query_id long, query string")
    got = {r.query_id: (r.ord, r.match_kind) for r in M.key_boosts(q, recs).collect()}
    assert got == {i: w for i, w in enumerate(want.values()) if w}


def test_one_edit_join_equals_levenshtein(spark):
    """Against DuckDB's edit distance, with strings on both sides of the block border."""
    import random

    import duckdb
    rng = random.Random(9)
    words = {"".join(rng.choice("ab") for _ in range(rng.choice([5, 6, 7, 62, 63, 64, 65, 66, 67]))) for _ in range(120)}
    for w in list(words):
        i = rng.randrange(len(w))
        words |= {w[:i] + w[i + 1:], w[:i] + "c" + w[i:], w[:i] + "c" + w[i + 1:]}
    rows = [(w,) for w in sorted(words)]
    terms = spark.createDataFrame(rows, "norm_term string")
    keys = spark.createDataFrame(rows, "norm_key string").selectExpr("norm_key", "0L AS first_ord", "0L AS last_ord")
    got = {(r.norm_term, r.norm_key) for r in M.fuzzy_key_candidates(terms, keys, 5).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE w (a VARCHAR)")
    con.executemany("INSERT INTO w VALUES (?)", rows)
    want = set(con.sql("SELECT x.a, y.a FROM w x JOIN w y ON abs(length(x.a) - length(y.a)) <= 1 AND levenshtein(x.a, y.a) <= 1 "
                       "WHERE length(x.a) >= 5 AND length(y.a) >= 4").fetchall())
    assert got == want
