"""Substring dedup against brute-force word runs, and its invariants."""
import numpy as np
from llm.conftest import ODD

from tessera.llm import substring
from tessera.llm.registry import op1_substring_dedup

RNG = np.random.default_rng(3)


def prose(n, rng=RNG):
    letters = list("abcdefghijklmnopqrstuvwxyzéñ")
    return " ".join("".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(n))


def test_cuts_resist_shifts():
    a = prose(400).encode()
    b = b"An insertion. " + a[:900] + b"xyz" + a[900:]
    cut = lambda t: {t[i:j] for i, j in zip([0, *substring.cut_points(t)[:-1].tolist()], substring.cut_points(t).tolist())}
    assert len(cut(a) & cut(b)) >= len(cut(a)) - 5
    for t in (b"", b"x", b"a" * 5000, a):
        ends = substring.cut_points(t).tolist()
        assert ends[-1] == len(t) and all(0 < y - x <= substring.MAX_CHUNK for x, y in zip([0, *ends], ends)) or not t


def test_planted_passages_are_found(spark, docs):
    passages = [prose(55) for _ in range(12)]
    rows, holders = [], {}
    for i in range(120):
        text = prose(150)
        if i % 4 == 1:
            p = (i // 4) % 12
            text = f"{prose(20)} {passages[p]} {prose(30)}"
            holders.setdefault(p, []).append(i)
        rows.append((i, text, "s"))
    got = {r.doc_id: r for r in substring.repeat_report(docs(rows)).collect()}
    late = {i: h[0] for h in holders.values() for i in h[1:]}
    assert set(got) == set(late)
    for i, r in got.items():
        assert r.first_doc_ids == [late[i]]
        assert r.removed_bytes >= 0.4 * len(passages[(i // 4) % 12].encode())
    left = {r.doc_id: r.text for r in substring.drop_repeats(docs(rows)).collect()}
    assert len(left) == 120 and all(left[i] == t for i, t, _ in rows if i not in late)
    assert all(len(left[i]) < len(rows[i][1]) for i in late)


def test_query_finds_every_long_repeat(spark, sf, corpus):
    """Every document with a run of 51 words that an earlier one has is reported; no
    document without a run of 10 repeated words is."""
    got = {r.doc_id for r in op1_substring_dedup(spark, sf).collect()}

    def repeats(n):
        seen, out = set(), set()
        for i in sorted(corpus):
            w = corpus[i][0].split()
            own = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
            if own & seen:
                out.add(i)
            if len(own) < len(w) - n + 1:
                out.add(-i)
            seen |= own
        return out
    assert {i for i in repeats(51) if i > 0} <= got
    assert {i for i in got} <= {abs(i) for i in repeats(10)}


def test_odd_rows(spark, docs):
    same = prose(60)
    odd = ODD + [(20, same, "a"), (21, same, None), (None, same, "a"), (22, f"{same} {same}", "a")]
    extra = ["row_key", "cuts", "cut_text", "start"]
    df = docs(odd, extra=extra)
    out = substring.drop_repeats(df)
    assert out.columns == df.columns
    left = out.collect()
    by_id = {}
    for r in left:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[1][0].text is None and by_id[2][0].text == "" and by_id[3][0].text == " \n\t "
    assert by_id[20][0].text == same                        # the first keeps the passage
    assert 21 not in by_id                                   # a whole copy has nothing left
    assert len(by_id[6]) == 2
    assert all(r.text is None or r.n_chars == len(r.text) for r in left)
    assert substring.drop_repeats(docs([])).count() == 0 and substring.repeat_report(docs([])).count() == 0


def test_spans_keep_characters_whole():
    t = "ééé漢字abc".encode()
    for i in range(len(t)):
        for j in range(i, len(t) + 1):
            substring.cut_spans(t, [(i, j)])                 # never breaks the UTF-8
