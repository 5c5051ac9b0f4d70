"""Conversation repair against an exhaustive search over edit strings."""
import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import conversations
from tessera.llm.registry import op12_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string"
COLS = [f.split()[0] for f in conversations.RESULT.split(", ")]


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        mine += [(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    for mine in out.values():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = text.strip(" \t\n\x0b\x0c\r")[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, fault):
    """(cost, audit, lines) over all edit strings with up to two inserted rows at any place."""
    def follow(done, role):                 # the roles written so far, as what the pattern allows next
        return role in {"": "su", "s": "u", "u": "a", "a": "u"}[done]

    @lru_cache(maxsize=None)
    def best(i, done, inserted):
        found = [(0, "", ())] if i == len(rows) and done in ("", "a") else []
        if inserted < 2:
            for role in "ua":
                if follow(done, role):
                    rest = best(i, role, inserted + 1)
                    if rest:
                        found.append((3 + rest[0], "I" + rest[1], ({"u": "user:", "a": "assistant:"}[role], *rest[2])))
        if i < len(rows):
            _, name, text = rows[i]
            rest = best(i + 1, done, 0)
            if rest:
                found.append((4 + rest[0], "D" + rest[1], rest[2]))
            if fault[i] not in ("blank", "duplicate"):
                late = 3 if fault[i] == "truncated" else 0
                options = [(late, "K", name[:1], name)] + [(late + 3, "R", x[0], x) for x in ("user", "assistant")]
                for cost, letter, role, full in options:
                    if role and follow(done, role):
                        rest = best(i + 1, role, 0)
                        if rest:
                            found.append((cost + rest[0], letter + rest[1], (f"{full}:{text}", *rest[2])))
        return min(found, default=None)
    return best(0, "", 0)


def brute(rows):
    out = {}
    for conv, mine in damaged(rows).items():
        fault = faults(mine)
        turns = [t for t, _, _ in mine if t is not None]
        cost, audit, lines = cheapest(mine, fault)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(fault.count(x) for x in ("blank", "duplicate", "truncated")),
                     illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("later", F.lit("own")).withColumn("said", F.lit(0)).repartition(3)
    got = conversations.repair(conversations.damage(df), **kw)
    assert got.columns == COLS
    return {r[0]: tuple(r[1:]) for r in got.collect()}


def test_table_matches_exhaustive_search(spark, sf):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM read_parquet('{sf}/conversations.parquet')").fetchall()
    got = {r[0]: tuple(r[1:]) for r in op12_conversation_repair(spark, sf).select(*COLS).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("most", [0, 1000])
def test_random_conversations(spark, sf, most):
    rng = random.Random(most)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "user", "assistant"]
    texts = ["a.", "b", "c!", "", " \n", None, "d?\t", "é", "e. ", "f "]
    rows = [(c if c else None, rng.choice([None, *range(9)]), rng.choice(roles[c % 4:]), rng.choice(texts) or rng.choice(texts))
            for c in range(150) for _ in range(rng.randrange(12))]
    assert repaired(spark, rows, max_broadcast_rows=most) == brute(rows)


def test_odd_rows(spark, sf):
    assert repaired(spark, []) == {}
    gone = next(t for t in range(99) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repaired(spark, [(5, gone, "user", "x")]) == {5: nothing}
    rows = [(1, None, None, None), (1, None, "user", "x" * 300_000 + "."), (2, 3, "assistant", "only."), (2, 3, "assistant", "only."),
            (None, 2**62, "user", "u."), (None, -5, "system", "s."), (3, 1, "system", "s."), (3, 2, "s2", "t.")]
    assert repaired(spark, rows) == brute(rows)


def edits(roles):
    search = conversations.Repair()
    for i, r in enumerate(roles):
        search.add(r, f"{i}.", False, False)
    return search, search.finish()


def test_survivors_coalesce():
    rng = random.Random(3)
    search, (_, audit, _) = edits(rng.choice(["user", "assistant", "system"]) for _ in range(50_000))
    assert len(audit) >= 50_000 and search.most_held < 400            # a long conversation is not held


def test_ties_compare_whole_suffixes():
    """One role all through: the two survivors never meet, so every tie hangs on the whole suffix."""
    for n in range(1, 14):
        rows = [(i, "user", f"{i}.") for i in range(n)]
        cost, audit, lines = cheapest(tuple(rows), [""] * n)
        search, got = edits(["user"] * n)
        assert got == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
