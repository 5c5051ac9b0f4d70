"""Bottom-k sketches against exact shingle sets."""
import base64
import hashlib

import numpy as np
from llm.conftest import ODD, words
from pyspark.sql import functions as F

from tessera.llm import sketch
from tessera.llm.registry import op5_document_fingerprints


def shingles(text, n=5):
    w = [x.lower() for x in words(text)]
    return {b" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rows):
    """(id, text, edited, next text) by descending id, null last, ties by nothing but the given order."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        h = len(t) // 2
        yield i, t, t[:len(t) - h] + nxt[:h], nxt


def test_query(spark, sf, corpus):
    got = {r.doc_id: r for r in op5_document_fingerprints(spark, sf).collect()}
    wrong = []
    for i, t, e, nxt in edited([(i, t) for i, (t, _) in corpus.items()]):
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        wrong += [abs(r.near_edited - jaccard(shingles(t), shingles(e))), abs(r.near_next - jaccard(shingles(t), shingles(nxt)))]
    assert len(got) == len(corpus) and max(wrong) < 0.2 and np.mean(wrong) < 0.03
    by_text = {}
    for i, (t, _) in corpus.items():
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint


def test_odd_rows(spark, docs):
    rows = [r for r in ODD if r[0] != 6]
    got = {r.doc_id: r for r in sketch.edited_report(docs(rows, extra=["range_no", "ghost", "tie", "following"])).collect()}
    for i, t, e, nxt in edited([(i, t or "") for i, t, _ in rows]):
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert abs(got[i].near_next - jaccard(shingles(t), shingles(nxt))) < 1e-9
    assert got[1].near_next in (0.0, 1.0) and got[1].fingerprint == ""
    assert sketch.edited_report(docs([])).count() == 0
    one = sketch.edited_report(docs([(9, "a b c d e f", "s")])).first()
    assert one.near_next == 1.0
    assert sketch.edited_report(docs(ODD)).count() == len(ODD)       # repeated ids and rows


def test_next_crosses_every_range(spark, docs):
    rows = [(7 * i % 1009, f"t{7 * i % 1009}", "s") for i in range(1009)]
    df = sketch.with_next(docs(rows).select("doc_id", "text"), "doc_id", "text", "following")
    got = {r.doc_id: r.following for r in df.collect()}
    assert got == {i: f"t{(i - 1) % 1009}" for i in range(1009)}


def test_merge_and_estimates(spark):
    rng = np.random.default_rng(8)
    a, b = (" ".join(f"w{x}" for x in rng.integers(0, 10**6, n)) for n in (4000, 9000))
    sa, sb, both = (sketch.sketch(t.encode()) for t in (a, b, a + " " + b))
    assert len(np.setdiff1d(sketch.merge([sa, sb]), both)) <= 1        # but for the shingles over the joint
    assert abs(sketch.distinct_count(sa) / 3996 - 1) < 0.3 and abs(sketch.distinct_count(sketch.merge([sa, sb])) / 12992 - 1) < 0.3
    assert sketch.containment(sa, sketch.merge([sa, sb])) > 0.9 and sketch.resemblance(sa, sb) < 0.05
    assert (sketch.from_text(sketch.to_text(sa)) == sa).all()
    part = "abc def " * 3 + a
    assert (sketch.sketch(part.encode()) == sketch.merge([h for h in sketch.shingle_hashes(part.encode(), 5, sketch.SEED, part=500)])).all()


def test_merge_by_key(spark, docs):
    texts = [" ".join(f"w{(i * 37 + j) % 5000}" for j in range(200)) for i in range(60)]
    df = sketch.sketch_documents(docs([(i, t, [None, "a", "b"][i % 3]) for i, t in enumerate(texts)]).repartition(5))
    got = {r.source: r for r in sketch.merge_sketches(df, "source").collect()}
    for k, s in enumerate([None, "a", "b"]):
        whole = set().union(*(shingles(t) for t in texts[k::3]))
        want = np.sort(sketch.merge([h for t in texts[k::3] for h in sketch.shingle_hashes(t.encode(), 5, sketch.SEED)]))
        assert got[s].fingerprint == base64.b64encode(want.astype(">u8").tobytes()).decode()
        assert abs(got[s].n_distinct / len(whole) - 1) < 0.3
    assert df.where(F.col("fingerprint").isNull()).count() == 0


def test_query_gives_containment_and_counts(spark, sf, corpus):
    got = {r.doc_id: r for r in op5_document_fingerprints(spark, sf).collect()}
    wrong, counts = [], []
    for i, t, e, nxt in edited([(i, t) for i, (t, _) in corpus.items()]):
        own = shingles(t)
        for other, share in ((e, got[i].contained_edited), (nxt, got[i].contained_next)):
            wrong.append(abs(share - (len(own & shingles(other)) / len(own) if own else 1.0)))
        counts.append(abs(got[i].n_distinct / len(own) - 1) if own else got[i].n_distinct)
    assert max(wrong) < 0.4 and np.mean(wrong) < 0.04 and max(counts) < 0.4 and np.mean(counts) < 0.06
