"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a batch are held as one ragged array of symbol ids. Each
round finds every sequence's lowest-rank adjacent pair and merges all its occurrences
in all sequences at once; sequences without a pair leave. The count of a pre-token is
the number of symbols that survive. No text leaves its task and nothing is shuffled.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .pretokens import piece_groups

NO_RANK = np.iinfo(np.int32).max
#: Pre-tokens whose counts a worker remembers between batches.
REMEMBERED = 400_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: the
    byte's own where it is printable in Latin-1, else the next unused one from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class MergeTable:
    """The ranked merges of a byte-level BPE ``.json`` file, as sorted arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.byte_id = np.array([vocab[c] for c in byte_alphabet()], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        # a merge after which a pair of lower rank can appear must be applied one occurrence at a time
        first_use = np.full(max(vocab.values()) + 1, NO_RANK, np.int64)
        np.minimum.at(first_use, left, np.arange(len(merges)))
        np.minimum.at(first_use, right, np.arange(len(merges)))
        self.single = first_use[made] < np.arange(len(merges))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK).astype(np.int32)


@lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def surviving_symbols(pieces: list[bytes], table: MergeTable) -> np.ndarray:
    """The number of symbols left of each (non-empty) piece after all merges."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    count = size.copy()
    ids = table.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
    seq = np.repeat(np.arange(len(pieces)), size)
    rank = np.full(len(ids), NO_RANK, np.int32)               # rank[i]: of the pair (i, i + 1) within a sequence
    inner = np.flatnonzero(seq[:-1] == seq[1:])
    rank[inner] = table.rank(ids[inner], ids[inner + 1])
    while len(ids):
        head = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        size = np.diff(np.r_[head, len(ids)])
        best = np.minimum.reduceat(rank, head)
        live = best < NO_RANK
        count[seq[head[~live]]] = size[~live]
        if not live.all():                                    # finished sequences leave
            stay = np.repeat(live, size)
            ids, seq, rank, size, best = ids[stay], seq[stay], rank[stay], size[live], best[live]
            if not len(ids):
                break
        want = np.repeat(best, size)
        at = np.flatnonzero(rank == want)
        # in a row of overlapping pairs (a a a) every second one is merged, from the left
        begin = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) > 1], np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - begin) % 2 == 0]
        once = table.single[want[at]]
        if once.any():
            first = np.r_[True, seq[at][1:] != seq[at][:-1]]
            at = at[~once | first]
        ids[at] = table.made[want[at]]
        stay = np.ones(len(ids), bool)
        stay[at + 1] = False
        ids, seq, rank = ids[stay], seq[stay], rank[stay]
        at = at - np.arange(len(at))                          # where the merged symbols are now
        near = np.unique(np.concatenate((at, at[at > 0] - 1)))
        rank[near] = NO_RANK
        near = near[near < len(ids) - 1]
        near = near[seq[near] == seq[near + 1]]
        rank[near] = table.rank(ids[near], ids[near + 1])
    return count


_SEEN: dict[tuple[str, str], dict[str, int]] = {}


def _count_texts(texts: list[str], path: str, pattern: str) -> list[int]:
    table = merge_table(path)
    seen = _SEEN.setdefault((path, pattern), {})

    def total(groups: list[list[str]]) -> list[int]:
        new = list({p for g in groups for p in g if p not in seen})
        if len(seen) + len(new) > REMEMBERED:
            seen.clear()
            new = list({p for g in groups for p in g})
        if new:
            seen.update(zip(new, surviving_symbols([p.encode() for p in new], table).tolist()))
        return [sum(map(seen.__getitem__, g)) for g in groups]

    counts, waiting, owners, held = [0] * len(texts), [], [], 0
    for i, text in enumerate(texts):
        parts = [text]
        for s in table.special:                               # a special string in the text is one token
            counts[i] += sum(p.count(s) for p in parts)
            parts = [q for p in parts for q in p.split(s)]
        for part in parts:
            for group in piece_groups(part, pattern):
                waiting.append(group)
                owners.append(i)
                held += len(group)
                if held >= 400_000:
                    for o, n in zip(owners, total(waiting)):
                        counts[o] += n
                    waiting, owners, held = [], [], 0
    for o, n in zip(owners, total(waiting)):
        counts[o] += n
    return counts


def count_tokens(df: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of every row's whole
    text, in the vocabulary of the byte-level BPE file ``path`` (the same place on every
    machine). A null text counts as empty (0 tokens); repeated rows count each; an empty
    table gives no rows; other columns are ignored."""
    src = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
                    F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column("text").to_pylist()
        n = np.array(_count_texts(texts, path, pattern), np.int64)
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return arrow_map(src, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
