"""STR-1..11, SYN-1 on worked cases, as column expressions."""
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as TX


def one(spark, expr, *vals):
    df = spark.createDataFrame([tuple(vals)], [f"c{i}" for i in range(len(vals))])
    return df.select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("raw,want", [
    ("MAREA", "marea"), ("Brújula", "brujula"), ("señal", "senal"), ("  vela  ", "vela"),
    ("", ""), (" Puñal\t", "punal"), ("Glaçon", "glacon"),
])
def test_normalize(spark, raw, want):
    assert one(spark, TX.normalize_text(F.col("c0")), raw) == want


@pytest.mark.parametrize("q,want", [
    ("que significa barlovento", "barlovento"), ("qué es la marea", "marea"), ("que es el faro?", "faro"),
    ("define sextante", "sextante"), ("definición de sotavento", "sotavento"), ("significado de bitácora", "bitácora"),
    ("Qué significa cabotaje, por favor", "cabotaje"), ("astrolabio", "astrolabio"), ("que es la uz", ""),
    ("¿Qué es la quilla?", "¿Qué es la quilla"),
])
def test_extract_query_term(spark, q, want):
    assert one(spark, TX.extract_query_term(F.col("c0")), q) == want


@pytest.mark.parametrize("a,b,want", [
    ("quilla", "quilla", True), ("quilla", "quella", True), ("quilla", "quillas", True),
    ("quilla", "uilla", True), ("", "", True), ("quilla", "puella", False), ("mar", "marea", False),
])
def test_within_one_edit(spark, a, b, want):
    assert one(spark, TX.within_one_edit(F.col("c0"), F.col("c1")), a, b) is want


def test_keywords_spanish(spark):
    kws = set(one(spark, TX.extract_keywords(F.col("c0")), "¿Dónde guardo velas mojadas con sal para la regata?"))
    assert {"guardo", "velas", "mojadas", "sal", "regata"} <= kws
    assert not kws & {"con", "para", "la"}


def test_tokenize_unicode(spark):
    assert one(spark, TX.tokenize_words(F.col("c0")), "Qué pasó_ya 12") == ["qué", "pasó_ya", "12"]


@pytest.mark.parametrize("a,b,lo,hi", [
    ("mar en calma", "mar en calma", 1.0, 1.0), ("a b", "c d", 0.0, 0.0),
    ("a b c", "a b d", 0.01, 0.99), ("", "", 0.0, 0.0),
])
def test_jaccard(spark, a, b, lo, hi):
    v = one(spark, TX.jaccard_words(F.col("c0"), F.col("c1")), a, b)
    assert lo <= v <= hi


def test_sentence_helpers(spark):
    assert one(spark, TX.decapitalize(F.col("c0")), "Hola mundo") == "hola mundo"
    assert one(spark, TX.ensure_period(F.col("c0")), "hola") == "hola."
    assert one(spark, TX.ensure_period(F.col("c0")), "hola.") == "hola."
    assert one(spark, TX.prefix_match(F.col("c0"), F.col("c1")), "Sotavento: lado opuesto al viento", "sotavento") is True
    parts = one(spark, TX.sentence_parts(F.col("c0")), "Uno. Dos!! Tres; 3.5")
    assert parts == ["Uno", " Dos", " Tres", " 3", "5"]


def test_marks_of_every_code_point(spark):
    """Equal to NFD without Mn, between plain letters and alone."""
    import unicodedata
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(c, "a" + chr(c) + "b" + chr(c)) for c in points if c < 0x32000 or c >= 0xE0000 and c < 0xE0400], "c long, t string")
    bad = []
    for r in df.select("c", "t", TX.strip_marks(F.col("t")).alias("s")).collect():
        want = "".join(x for x in unicodedata.normalize("NFD", r.t) if unicodedata.category(x) != "Mn")
        if r.s != want:
            bad.append((hex(r.c), r.s, want))
    assert not bad, (len(bad), bad[:5])
    assert one(spark, TX.normalize_text(F.col("c0")), " \ud55c\uae00 \uac00 É ") == "\u1112\u1161\u11ab\u1100\u1173\u11af \u1100\u1161 e"
