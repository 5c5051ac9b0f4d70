"""SYN-5 rewrite cases, SYN-6 routing, SET-3 grounding audit (the "oregano test")."""
from pyspark.sql import functions as F

from tessera.functions.constants import CONNECTORS, NOTHING_FOUND
from tessera.operators import synth as SY
from tessera.operators.audit import grounding_audit
from tessera.plans.answer import answer

EGG = ("Para freír el huevo se calienta aceite en la sartén y se deja unos instantes hasta que cuaje la clara. "
       "Conviene añadir sal al gusto antes de servirlo")


def qf(spark, rows):
    return spark.createDataFrame(rows, "query_id long, query string")


def fr(spark, rows):
    return spark.createDataFrame(rows, "query_id long, rank int, source_id string, text string, score double")


def test_rewrite_cases(spark):
    q = qf(spark, [(1, "cómo freír un huevo en aceite"), (2, "nada")])
    f = fr(spark, [(1, 1, "huevo frito", EGG, 0.8)])
    out = {r.query_id: r.response for r in SY.rewrite(q, f).collect()}
    assert out[1] and out[1].endswith(".")
    shared = set(out[1].lower().split()) & set(EGG.lower().split())
    assert len(shared) >= 2
    assert 2 not in out  # no fragment -> no rewrite row; answer() turns it into the fallback


def test_rewrite_two_fragments_and_connector(spark):
    q = qf(spark, [(1, "huevo aceite sal")])
    f = fr(spark, [(1, 1, "a", "El huevo se fríe en aceite caliente. Se añade sal al gusto al final", 0.9),
                   (1, 2, "b", "Otra cosa muy distinta sobre el tema", 0.5)])
    resp = SY.rewrite(q, f).first().response
    assert len(resp) > 10 and CONNECTORS[0] in resp


def test_focus_prefers_key_match(spark):
    q = qf(spark, [(1, "qué es el huevo hervido")])
    f = fr(spark, [(1, 1, "huevo frito", "Huevo frito: freír el huevo en aceite caliente", 0.9),
                   (1, 2, "huevo hervido", "Huevo hervido: cocer el huevo en agua hirviendo", 0.7)])
    resp = SY.rewrite(q, f).first().response
    assert "agua" in resp and "aceite" not in resp


def test_answer_fallback_and_modes(spark):
    q = qf(spark, [(1, "freír huevo aceite"), (2, "sin resultados")])
    f = fr(spark, [(1, 1, "x", EGG, 0.8)])
    got = {r.query_id: (r.mode, r.response) for r in answer(q, f).collect()}
    assert got[1][0] == "statistical" and got[1][1].endswith(".")
    assert got[2] == ("empty", NOTHING_FOUND)


def test_generator_routing(spark):
    q = qf(spark, [(1, "freír huevo"), (2, "hola"), (3, "algo")])
    f = fr(spark, [(1, 1, "x", EGG, 0.8), (3, 1, "y", "texto de baja relevancia aquí", 0.35)])
    r = {x.query_id: x.mode for x in SY.route_and_prompt(q, f, has_generator=True).collect()}
    assert r == {1: "guided", 2: "free", 3: "free"}
    msgs = {x.query_id: [(m.role, m.content) for m in x.messages] for x in SY.route_and_prompt(q, f, has_generator=True).collect()}
    assert [r for r, _ in msgs[1]] == ["system", "user"] and EGG in msgs[1][1][1] and msgs[1][1][1].endswith("freír huevo")
    assert msgs[2][1] == ("user", "hola") and msgs[3][1] == ("user", "algo")

    def echo():
        return lambda messages: "eco: " + messages[-1]["content"]
    gen = {x.query_id: (x.mode, x.response) for x in answer(q, f, make_generator=echo).collect()}
    assert gen[2] == ("free", "eco: hola") and gen[3] == ("free", "eco: algo")
    assert gen[1][0] == "guided" and gen[1][1].startswith("eco: ") and EGG in gen[1][1]


def test_oregano(spark):
    f = fr(spark, [(1, 1, "x", EGG, 0.8)])
    a = spark.createDataFrame([(1, "Freír el huevo en aceite. Además, añadir orégano."),
                               (2, "")], "query_id long, response string")
    got = {r.query_id: (r.grounded, r.offending) for r in grounding_audit(a, f).collect()}
    assert got[1] == (False, ["orégano"])
    assert got[2] == (True, [])
