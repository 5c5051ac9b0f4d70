"""Conversation structure repair by a survivor-coalescence Viterbi search.

A conversation is repaired by the cheapest edits (keep, re-role, delete, insert) that
give the roles ``(system? (user assistant)+)?``. The search runs over the rows in
order with one survivor for each state of that pattern. Survivors are tips of a tree of
backpointers whose nodes count their children: a tip that no survivor extends is
released up to the fork, and once all survivors share an ancestor its edits are emitted,
hashed and forgotten. What is held is the stretch since that ancestor, not the
conversation. Of equal costs the least edit string wins. Strings of one row that reach
different states differ before their ends, so survivors keep the rank of their complete
unresolved suffix and a tie compares that rank, then the new edits.

In Spark, repeated messages are found by one narrow sum and a join; the rows are then
dealt by conversation and sorted, and a task streams over them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
LEGAL = frozenset(("su", "ua", "au"))
DELETE, CHANGE, INSERT, UNFINISHED = 4, 3, 3, 3

#: States: nothing written, a system row, a user row, an assistant row written last.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
AFTER_INSERT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What may follow each state, by role initial.
AFTER_ROLE = {EMPTY: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: ``BOUND[p][q]``: a survivor of state q that costs more than one of p by over this can not win:
#: whatever completes it completes p too with a deleted system row or an inserted turn.
BOUND = {SYSTEM: {EMPTY: 6}, USER: {EMPTY: 7, SYSTEM: 3, ASSISTANT: 3}, ASSISTANT: {EMPTY: 4, SYSTEM: 0, USER: 3}}


@lru_cache(maxsize=None)
def _moves(initial: str, must_go: bool, unfinished: bool) -> tuple[tuple[tuple[int, int, str], ...], ...]:
    """For each state before a row: (state after it, cost, edits) for the cheapest, then least, edits."""
    extra = UNFINISHED if unfinished else 0
    table = []
    for start in range(4):
        best: dict[int, tuple[int, str]] = {}

        def offer(state: int, cost: int, edits: str) -> None:
            if state not in best or (cost, edits) < best[state]:
                best[state] = (cost, edits)
        at = start
        for inserted in range(3):                          # more inserted rows only repeat a state
            before, spent = "I" * inserted, INSERT * inserted
            offer(at, spent + DELETE, before + "D")
            if not must_go:
                for role, state in AFTER_ROLE[at].items():
                    if role == initial:
                        offer(state, spent + extra, before + "K")
                    elif state != SYSTEM:
                        offer(state, spent + CHANGE + extra, before + "R")
            at = AFTER_INSERT[at]
        table.append(tuple((s, c, e) for s, (c, e) in best.items()))
    return tuple(table)


class Node:
    """A row's edits on one survivor's way: its parent, how many ways lead on, the row."""
    __slots__ = ("parent", "edits", "ways", "row")

    def __init__(self, parent: Node | None, edits: str, row: tuple[str, str] | None) -> None:
        self.parent, self.edits, self.row, self.ways = parent, edits, row, 0


class Repair:
    """The search over one conversation: ``add`` its rows in order, then ``finish``."""

    def __init__(self) -> None:
        self.root = Node(None, "", None)
        self.tips: dict[int, tuple[int, int, Node]] = {EMPTY: (0, 0, self.root)}   # state: cost, rank, node
        self.state, self.lines, self.held, self.most_held = EMPTY, 0, 0, 0
        self.audit: list[str] = []
        self.hash = hashlib.sha256()

    def add(self, role: str, text: str, must_go: bool, unfinished: bool) -> None:
        best: dict[int, tuple[int, int, str, Node]] = {}
        moves = _moves(role[:1], must_go, unfinished)
        for start, (cost, rank, node) in self.tips.items():
            for state, more, edits in moves[start]:
                old = best.get(state)
                total = cost + more
                if old is None or total < old[0] or total == old[0] and (rank, edits) < old[1:3]:
                    best[state] = (total, rank, edits, node)
        for p, bounds in BOUND.items():
            if p in best:
                for q, bound in bounds.items():
                    if q in best and best[q][0] > best[p][0] + bound:
                        del best[q]
        before = [node for _, _, node in self.tips.values()]
        row = (role, text)
        self.tips = {}
        for rank, (state, (cost, _, edits, parent)) in enumerate(sorted(best.items(), key=lambda x: x[1][1:3])):
            self.tips[state] = (cost, rank, Node(parent, edits, row))
            parent.ways += 1
        self.held += len(self.tips)
        for node in before:                                # ways that no survivor took
            while node is not self.root and not node.ways:
                node = node.parent
                node.ways -= 1
                self.held -= 1
        self.most_held = max(self.most_held, self.held)
        if self.root.ways == 1:
            self._emit(next(iter(self.tips.values()))[2])

    def _emit(self, tip: Node) -> None:
        """Write the edits from the root to the last node that all survivors share."""
        line = []
        while tip is not self.root:
            line.append(tip)
            tip = tip.parent
        while line and self.root.ways == 1:
            self.root = line.pop()
            self.root.parent = None
            self.held -= 1
            self._write(self.root.edits, self.root.row)
            self.root.row = None

    def _write(self, edits: str, row: tuple[str, str] | None) -> None:
        self.audit.append(edits)
        for e in edits:
            if e == "D":
                continue
            if e == "K":
                self.state, (role, text) = AFTER_ROLE[self.state][row[0][:1]], row
            else:
                self.state = AFTER_INSERT[self.state]
                role, text = ROLE[self.state], row[1] if e == "R" else ""
            if self.lines:
                self.hash.update(b"\n")
            self.hash.update(f"{role}:{text}".encode())
            self.lines += 1

    def finish(self) -> tuple[int, str, str]:
        """(cost, audit, SHA-256 of the repaired lines)."""
        ends = [(cost + more, rank, edits, node) for state, more, edits in
                ((EMPTY, 0, ""), (SYSTEM, 2 * INSERT, "II"), (USER, INSERT, "I"), (ASSISTANT, 0, ""))
                if state in self.tips for cost, rank, node in [self.tips[state]]]
        cost, _, edits, node = min(ends, key=lambda x: x[:3])
        line = []
        while node is not self.root:
            line.append(node)
            node = node.parent
        for node in reversed(line):
            self._write(node.edits, node.row)
        self._write(edits, None)
        return cost, "".join(self.audit), self.hash.hexdigest()


class Conversation:
    """The counts and the repair of one conversation, from its rows by turn."""

    def __init__(self) -> None:
        self.repair = Repair()
        self.low = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last: tuple | None = None

    def add(self, turn: int | None, role: str, text: str, later: bool) -> None:
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.turn = turn
            self.turns += 1
        if self.last and self.last[1][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        end = text.rstrip(SPACE)[-1:]
        blank, again = not end, later or self.last == (turn, role, text)
        unfinished = not blank and not again and end not in ENDS
        self.blank += blank
        self.duplicate += not blank and again
        self.truncated += unfinished
        self.repair.add(role, text, blank or again, unfinished)
        self.last = (turn, role, text)

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.turn - self.low + 1 - self.turns
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.finish())


def damage(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, gone): the rows after damage by crc32(``conv_id:turn``) % 20 (nulls
    stand as one space): 0 drops the row (``gone``, its text emptied), 1 empties its text, 2 takes its ``.!?``,
    3 repeats it, 4 makes it a user's."""
    def text_of(c: str) -> Column:
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat(text_of(conv_col), F.lit(":"), text_of(turn_col)).cast("binary")), F.lit(20)).cast("int")
    rows = df.select(F.col(f"`{conv_col}`").cast("bigint").alias("conv_id"), F.col(f"`{turn_col}`").cast("bigint").alias("turn"),
                     text_of(role_col).alias("role"), text_of(text_col).alias("text"), code.alias("code"))
    text = F.when(F.col("code") <= 1, "").when(F.col("code") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("code") == 0).alias("gone"),
                       F.explode(copies).alias("copy")).drop("copy")


#: Repeated messages up to this many rows (48 bytes each) may be broadcast.
MAX_BROADCAST_ROWS = 100_000


def mark_repeats(rows: DataFrame, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``rows`` and ``later``: whether an earlier turn of the conversation has the same role and text.
    Copies within one turn stand side by side after sorting and are left to the reader."""
    rows = rows.withColumn("said", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))))
    spoken = rows.where(~F.col("gone") & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    first = spoken.groupBy("conv_id", "said").agg(
        F.count(F.lit(1)).alias("n"), F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("unnumbered"))
    repeated = checkpoint(first.where("n > 1").select(F.col("conv_id").alias("c"), F.col("said").alias("s"), "first", "unnumbered"))
    small = repeated.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows
    joined = rows.join(F.broadcast(repeated) if small else repeated,
                       F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
    later = F.col("turn").isNotNull() & (F.col("unnumbered") | (F.col("turn") > F.col("first")))
    return joined.select("conv_id", "turn", "role", "text", "gone", F.coalesce(later, F.lit(False)).alias("later"))


RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string")


def repair(rows: DataFrame, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """One row of RESULT for each conversation of ``rows`` (conv_id, turn, role, text, gone), taken by
    turn (nulls first), then role, then text; ``gone`` rows only make their conversation known.

    A blank text, a role and text said before, and a text whose last character is not one of
    ``.!?`` are faults, the first of them counts. A null conv_id is one conversation; null roles
    and texts must be given as one space; equal rows are repeats of one another; a
    conversation without rows left has zeros, an empty audit and the hash of nothing; an
    empty table gives no rows. A task holds one row and the unresolved stretch of the search."""
    marked = mark_repeats(rows, max_broadcast_rows)
    dealt = marked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, now = None, None
        names = [f.split()[0] for f in RESULT.split(", ")]
        types = [pa.int64()] * 7 + [pa.string()] * 2

        def batch() -> pa.RecordBatch:
            cols = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=names)
        for b in batches:
            for c, turn, role, text, gone, later in zip(*(b.column(i).to_pylist() for i in range(6))):
                if now is None or c != conv:
                    if now is not None:
                        out.append((conv, *now.result()))
                    conv, now = c, Conversation()
                if not gone:
                    now.add(turn, role, text, later)
            if len(out) >= 1024:
                yield batch()
        if now is not None:
            out.append((conv, *now.result()))
        yield batch()
    return dealt.mapInArrow(run, RESULT)
