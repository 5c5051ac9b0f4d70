"""Token counts, byte-level BPE and packing against the public libraries."""
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from llm.conftest import ODD
from tokenizers import Tokenizer

from tessera.llm import byte_bpe, packing, token_counts
from tessera.llm.registry import digests, op2_token_counts, op3_byte_bpe, op7_token_packing

MULTI, JSON, RANKS = (P.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
HARD = ["", " ", "  a  b", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "it's we'll I'VE", "<|endoftext|>", "x<|endoftext|><|endoftext|> y",
        "naïve café́ 漢字かな 한국어", "\U0001f600\U0001f468‍\U0001f469", "1234567 ٣٤٥ Ⅷ", "a b　c\r\n\r\n\td", "\u0000\u0001\x7f",
        "՘ ࢏\U00016ea0", "=" * 300, "ab" * 3000, "The quick brown fox " * 500, "퟿�", "fooBarBAZ_qux-1.5e10"]


def fuzz(n=300):
    rng = np.random.default_rng(5)
    pools = ["abc ", "eE'st ", "0123 ,.", " \n\t ", "éüñçß", "漢字仮名", "\U0001f600\U0001f1e6", "thereinonatan "]
    return ["".join(rng.choice(list("".join(rng.choice(pools, 2))), rng.integers(1, 80))) for _ in range(n)]


def test_counts_equal_the_library(spark, docs):
    texts = HARD + fuzz()
    lib = Tokenizer.from_file(JSON)
    want = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    df = docs([(i, t, "s") for i, t in enumerate(texts)], extra=["n_tokens", "n_bytes"])
    got = {r.doc_id: r for r in token_counts.count_tokens(df, JSON, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (want[i], len(t.encode()), want[i] > 1024), t


def test_ids_equal_the_library(spark, docs):
    texts = HARD + fuzz()
    lib = packing.tokenizer(MULTI, P.PATTERN)
    df = docs([(i, t, "s") for i, t in enumerate(texts)], extra=["words", "numbers", "records", "decoded"])
    out = byte_bpe.decode(byte_bpe.encode(df, MULTI, P.PATTERN, block_words=500), MULTI)
    assert set(out.columns) == {*df.columns, "ids", "decoded"}
    for r in out.collect():
        assert r.ids == lib.encode_ordinary(texts[r.doc_id]) and bytes(r.decoded) == texts[r.doc_id].encode(), r.text
        assert r.words == "own words" and r.source == "s"
    only = byte_bpe.encode(df, MULTI, P.PATTERN, keep=["words", "doc_id"])
    assert only.columns == ["words", "doc_id", "ids"]
    assert all(r.ids == lib.encode_ordinary(texts[r.doc_id]) for r in only.collect())


def test_the_plan_does_not_spell_the_rank_map(spark, docs):
    """The driver keeps descriptions of a plan: the rank map in them is megabytes each."""
    coded = byte_bpe.encode(docs([(1, "some text", "s")]), MULTI, P.PATTERN)
    assert len(coded._jdf.queryExecution().toString()) < 100_000


def test_long_words_are_merged_rank_by_rank(spark, docs):
    texts = [t for t in HARD if len(t) < 600] + fuzz(60)
    lib = packing.tokenizer(MULTI, P.PATTERN)
    rows = byte_bpe.encode(docs([(i, t, "s") for i, t in enumerate(texts)]), MULTI, P.PATTERN, most_folded=3).collect()
    assert all(r.ids == lib.encode_ordinary(r.text) for r in rows) and len(rows) == len(texts)


def test_parts_and_ranks_of_a_long_word():
    rng = np.random.default_rng(8)
    lib, table = packing.tokenizer(MULTI, P.PATTERN), byte_bpe.pair_table(MULTI)
    for pool, n in (("ab", 900), ("thereinonatan", 900), ("etaoinshrdlucmfwypvbgkjqxz", 5000), ("漢字仮名中国人大小", 700), ("é", 500)):
        word = "".join(rng.choice(list(pool), n))
        parts = table.parts(word.encode())
        assert b"".join(parts) == word.encode()
        assert [i for p in parts for i in table.merged(p)] == table.merged(word.encode()).tolist() == lib.encode_ordinary(word)
    cells, shift = table.cells()
    left, right = rng.integers(0, table.size, (2, 100_000))
    assert (np.minimum(cells[shift[left] + right] ^ left << table.bits, table.none) == table.rank(left, right)).all()
    left, right = table.keys[:-1] >> table.bits, table.keys[:-1] & table.none
    assert (cells[shift[left] + right] == left << table.bits | table.ranks[:-1]).all()
    with pytest.raises(ValueError, match="no token for byte"):
        byte_bpe.PairTable({b"a": 0})


def test_a_pre_token_of_a_million_letters(spark, docs):
    rng = np.random.default_rng(9)
    texts = ["a" * 1_000_000, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 1_000_000)), "".join(rng.choice(list("ab"), 40_000))]
    rows = byte_bpe.decode(byte_bpe.encode(docs([(i, t, "s") for i, t in enumerate(texts)]), MULTI, P.PATTERN), MULTI).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in rows} == dict(enumerate(texts))


def test_odd_rows(spark, docs):
    df = docs(ODD)
    n = sorted(((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(df, JSON, P.PATTERN).collect()), key=str)
    lib = Tokenizer.from_file(JSON)
    assert n == sorted(((i, len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in ODD), key=str)
    coded = digests(byte_bpe.encode(df, MULTI, P.PATTERN), MULTI).collect()
    assert sorted((r.decoded_sha256 for r in coded)) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, _ in ODD)
    assert token_counts.count_tokens(docs([]), JSON, P.PATTERN).count() == 0
    assert byte_bpe.decode(byte_bpe.encode(docs([]), MULTI, P.PATTERN), MULTI).count() == 0


def test_long_texts_are_cut_in_groups(monkeypatch):
    from tessera.llm import pretokens
    text = " ".join(HARD) * 3
    whole = [p for g in pretokens.piece_groups(text, P.PATTERN) for p in g]
    monkeypatch.setattr(pretokens, "LONG_TEXT", 10)
    parts = list(pretokens.piece_groups(text, P.PATTERN, group=7))
    assert [p for g in parts for p in g] == whole and max(map(len, parts)) == 7 and "".join(whole) == text


def test_ascii_texts_are_cut_the_same():
    from tessera.llm import pretokens
    rng = np.random.default_rng(3)
    assert pretokens._ascii(P.PATTERN) is not None
    for pool in ([chr(x) for x in range(128)], list("abs'tlld 12 \t\n\r\x0b\x0c\x1c\x1f.,"), list(" \n'rveAZ09@[`{/:")):
        for n in rng.integers(0, 60, 500):
            text = "".join(rng.choice(pool, n))
            assert [p for g in pretokens.piece_groups(text, P.PATTERN) for p in g] == pretokens._compiled(P.PATTERN).findall(text)
    for odd in (r"(?i:'s)|\p{L}+", r"\p{Lu}+", r"a{2}", r"\s++", r"\w+", r"."):
        assert pretokens._ascii(odd) is None


def test_characters_newer_than_the_libraries_are_found():
    from tessera.llm import pretokens
    assert pretokens.HIGH.pattern[1] == chr(min(a for a, _ in pretokens.NEWER))
    for a, b in pretokens.NEWER:
        for c in (a, b):
            assert pretokens._first_newer("é" * 50 + "漢" + chr(c)).start() == 51
    assert not pretokens._first_newer("é漢\U0001f600\U0010ffff") and not pretokens._first_newer("plain")


def test_words_are_folded_once_a_batch(spark, sf, monkeypatch):
    """The fold is what costs: the words of a usual Arrow batch of the query stand in one block."""
    held, real = [], byte_bpe.encode
    monkeypatch.setattr(byte_bpe, "encode", lambda *a, **k: held.append(k) or real(*a, **k))
    op3_byte_bpe(spark, sf)
    assert held[0]["block_words"] >= 4_000_000


def test_a_word_starts_with_the_ranks_of_its_byte_pairs():
    table = byte_bpe.pair_table(MULTI)
    words = [b"", b"the", b"", b"x", "é漢".encode()]
    sizes, codes = table.codes(words)
    assert sizes.tolist() == [0, 3, 0, 1, 5]
    for w, got in zip(words, np.split(codes, np.cumsum(sizes)[:-1])):
        ids = table.byte_id[np.frombuffer(w, np.uint8)]
        rank = np.append(table.rank(ids[:-1], ids[1:]), np.full(min(len(w), 1), table.none))
        assert (got == (rank << byte_bpe.PLACE + table.bits | np.arange(len(w)) << table.bits | ids)).all()
    assert not len(table.codes([b"", b""])[1]) and not len(table.codes([])[1])


def test_a_fold_goes_over_the_merges_of_its_word_only():
    """One step for each token that stands in the word, in the order of their ranks; there were as many as bytes, each of some fifty operations."""
    ranks, find = byte_bpe.read_ranks(MULTI), byte_bpe.finder(MULTI)
    words = [b"", b"x", *(t.encode() for t in HARD if t), *(t.encode() for t in fuzz(200)), *ranks]
    assert find.crowded.any()
    sizes, merges = find.merges(words)
    for w, got in zip(words, np.split(merges, np.cumsum(sizes)[:-1])):
        runs = {w[i:i + n] for n in range(2, find.longest + 1) for i in range(len(w) - n + 1)}
        assert got.tolist() == sorted(ranks[t] for t in runs if t in ranks)
    assert not len(find.merges([])[0]) and not len(find.merges([b""])[1])


def test_each_token_is_made_by_the_pair_of_its_bytes():
    ranks, pairs = byte_bpe.read_ranks(MULTI), byte_bpe.token_pairs(MULTI)
    tokens = {i: t for t, i in ranks.items()}
    assert {i: tokens[a] + tokens[b] for i, (a, b) in pairs.items()} == {i: t for t, i in ranks.items() if len(t) > 1}
    assert [ord(byte_bpe.sign(i)) for i in (0, 0xd7ff, 0xd800, 70_000)] == [0, 0xd7ff, 0xe000, 70_000 + 0x800]


def vocabulary(path, merged, at=256):
    """A file of the bytes and the tokens ``merged`` after them, ids from ``at`` on."""
    import base64
    tokens = {bytes([x]): x for x in range(256)} | {t: at + i for i, t in enumerate(merged)}
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for t, i in tokens.items()))
    return tokens


@pytest.mark.parametrize("merged, at, ordered", [
    ([b"ab", b"bc", b"aa", b"abc", b"aaaa", b"cab"], 256, True),
    ([b"ab", b"bc", b"aa", b"abc", b"aaaa", b"cab"], 0xd7fe, True),    # ids on both sides of the surrogates
    ([b"abc", b"ab", b"cab", b"abca", b"aa", b"bb"], 256, False)])    # "abc" comes up after "ab", of a higher rank
def test_any_vocabulary(spark, docs, tmp_path, merged, at, ordered):
    path = str(tmp_path / "v.tiktoken")
    ranks = vocabulary(tmp_path / "v.tiktoken", merged, at)
    assert (byte_bpe.token_pairs(path) is not None) == ordered
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abc"), n)) for n in rng.integers(1, 30, 300)] + ["a" * n for n in range(1, 20)]

    def plain(parts):
        while (best := min(((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 40, 0)))[0] < 1 << 40:
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [ranks[p] for p in parts]
    for r in byte_bpe.encode(docs([(i, w, "s") for i, w in enumerate(words)]), path, P.PATTERN).collect():
        assert r.ids == plain([bytes([x]) for x in r.text.encode()]), r.text


@pytest.mark.parametrize("query", [op2_token_counts, op3_byte_bpe])
def test_queries(spark, sf, corpus, query):
    lib = {op2_token_counts: Tokenizer.from_file(JSON), op3_byte_bpe: packing.tokenizer(MULTI, P.PATTERN)}[query]
    for r in query(spark, sf).collect():
        text = corpus[r.doc_id][0]
        if query is op2_token_counts:
            assert r.n_tokens == len(lib.encode(text, add_special_tokens=False).ids)
        else:
            ids = lib.encode_ordinary(text)
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def restore(rows, row_len):
    got = {}
    for r in rows:
        ids, pos = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == len(pos) == row_len and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= row_len
        for d, first, a, b in zip(r.doc_ids, r.first_tokens, r.cu_seqlens, r.cu_seqlens[1:]):
            assert (pos[a:b] == np.arange(b - a)).all() and b > a
            got.setdefault(d, []).append((first, ids[a:b]))
        assert (ids[r.n_tokens:] == 50256).all() and (pos[r.n_tokens:] == 0).all()
    return {d: np.concatenate([x for _, x in sorted(parts, key=lambda p: p[0])]).tolist() for d, parts in got.items()}


def test_packing_round_trip(spark, sf, corpus):
    rows = op7_token_packing(spark, sf).collect()
    lib = packing.tokenizer(RANKS, P.PATTERN)
    assert restore(rows, 2048) == {i: lib.encode_ordinary(t) for i, (t, _) in corpus.items() if t}
    assert len({(r.pack_id, r.row_no) for r in rows}) == len(rows)
    assert sum(r.n_tokens for r in rows) / (2048 * len(rows)) > 0.95


def test_packing_odd_rows(spark, docs):
    lib = packing.tokenizer(RANKS, P.PATTERN)
    rows = packing.packed_rows(docs([r for r in ODD if r[0] != 6]), RANKS, P.PATTERN, row_len=16, group_tokens=40).collect()
    want = {i: lib.encode_ordinary(t or "") for i, t, _ in ODD if t and i != 6}
    assert restore(rows, 16) == want
    assert packing.packed_rows(docs([]), RANKS, P.PATTERN).count() == 0


def test_best_fit_decreasing_equals_a_plain_search():
    rng = np.random.default_rng(2)
    for top in (1, 7, 64, 100):
        lengths = rng.integers(1, top + 1, 300).tolist()
        rows = packing.best_fit_decreasing(lengths, top)
        assert sorted(i for r in rows for i in r) == list(range(300))
        room = []
        for n in sorted(lengths, reverse=True):
            fits = [j for j, c in enumerate(room) if c >= n]
            if fits:
                room[min(fits, key=lambda j: room[j])] -= n
            else:
                room.append(top - n)
        assert len(rows) == len(room) and sorted(top - sum(lengths[i] for i in r) for r in rows) == sorted(room)


def test_stretches_keep_the_ids():
    lib = packing.tokenizer(RANKS, P.PATTERN)
    text = "Some words, 'and' more 12 words  with\nlines " * 50 + " ".join(fuzz(50))
    assert [i for s in packing.stretches(text, 37) for i in lib.encode_ordinary(s)] == lib.encode_ordinary(text)
