"""SRC-1: a JSON array file of any size, read by many tasks.

The file is read in byte ranges, as texts that end at a ``}``. Where a range begins, neither
the depth of brackets nor whether a string is open is known, so a first pass works out
both cases: how a range changes the state, and how many records would end in it for each
depth at its start. Composing the ranges of a file in order (one row each) gives every
range its true state and its first ordinal. The second pass cuts the records; only those
that cross a border of ranges are put together by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ESCAPE = re.compile(r"\\.", re.S)
_BLANK = " \t\r\n﻿"


def _change(text: str) -> tuple[int, int, int]:
    """(quotes, depth change if it starts outside a string, depth change if inside) of a text without its last ``}``."""
    parts = (_ESCAPE.sub("", text) if "\\" in text else text).split('"')
    deltas = []
    for own in ("".join(parts[0::2]), "".join(parts[1::2])):
        deltas.append(own.count("{") + own.count("[") - own.count("}") - own.count("]"))
    return len(parts) - 1, deltas[0], deltas[1]


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): the texts between the ``}`` of each byte range, in order within it."""
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for b in batches:
        yield from zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), b.column(2).to_pylist())


def _summaries(ranges: DataFrame) -> DataFrame:
    """One row per range: its first character, whether it flips the string state, and for both states at its start
    the depth change, and the number of ``}`` outside strings by relative depth."""
    names = ["file", "start", "first", "flips", "rise", "ends"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            ends = [[state, depth, n] for state in (0, 1) for depth, n in counts[state].items()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*at, first, flips, rise, ends), types)], names=names)
        at, first, flips, rise, counts = None, "", 0, [0, 0], ({}, {})
        for key, text in _by_range(batches):
            if key != at:
                if at:
                    yield row()
                at, first, flips, rise, counts = key, "", 0, [0, 0], ({}, {})
            first = first or text.lstrip(_BLANK)[:1] or "}"
            quotes, outside, inside = _change(text)
            for state in (0, 1):
                here = (state + flips) % 2
                rise[state] += (outside, inside)[here]
                if (here + quotes) % 2 == 0:
                    rise[state] -= 1
                    counts[state][rise[state]] = counts[state].get(rise[state], 0) + 1
            flips = (flips + quotes) % 2
        if at:
            yield row()
    return ranges.mapInArrow(run, "file string, start long, first string, flips long, rise array<long>, ends array<array<long>>")


def _states(summaries: list, path: str) -> dict[tuple[str, int], tuple[int, int, int]]:
    """(string state, depth, records that ended before) at the start of each range."""
    out: dict[tuple[str, int], tuple[int, int, int]] = {}
    state = depth = ended = 0
    file = None
    for r in sorted(summaries, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            if r["first"] != "[":
                raise ValueError(f"{path} does not hold a JSON array")
            if file is not None and (state, depth) != (0, -1):
                raise ValueError(f"{file} does not end its JSON array")
            file, state, depth = r["file"], 0, 0
        out[r["file"], r["start"]] = (state, depth, ended)
        ended += sum(n for s, rel, n in r["ends"] if s == state and depth + rel == 1)
        state, depth = (state + r["flips"]) % 2, depth + r["rise"][state]
    # the text after the last ``}`` counts one that is not there
    if file is None:
        raise ValueError(f"{path} does not hold a JSON array")
    if (state, depth) != (0, -1):
        raise ValueError(f"{file} does not end its JSON array")
    return out


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """(ord, raw): the records of the JSON array files at ``path`` as text, numbered from 0 in file order (several
    files: by their paths). A file whose top level is no array, or that ends too early: ``ValueError``; an
    element that is no object stops the query. A record is one row; nothing else is held whole."""
    ranges = _ranges(spark, path)
    sent = spark.sparkContext.broadcast(_states(_summaries(ranges).collect(), path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, bool, str]] = []
        at, state, depth, ended, held, whole = None, 0, 0, 0, [], True

        def batch() -> pa.RecordBatch:
            cols = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.string()))]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=["ord", "at", "whole", "raw"])
        for key, text in _by_range(batches):
            if key != at:
                if held:
                    out.append((ended, at[1], False, "}".join([*held, ""])))
                at, held = key, []
                state, depth, ended = sent.value[key]
                whole = depth <= 1 and not state           # else the range begins within a record
            quotes, outside, inside = _change(text)
            depth += (outside, inside)[state]
            state = (state + quotes) % 2
            held.append(text)
            if not state:
                depth -= 1
                if depth == 1:
                    out.append((ended, key[1], whole, "}".join([*held, ""])))
                    ended, held, whole = ended + 1, [], True
                    if len(out) >= 1024:
                        yield batch()
        if held:
            out.append((ended, at[1], False, "}".join([*held, ""])))
        yield batch()
    pieces = ranges.mapInArrow(run, "ord long, at long, whole boolean, raw string")
    crossing = pieces.where("NOT whole").groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("at", "raw"))).alias("p"))
    joined = crossing.select("ord", F.array_join(F.transform("p", lambda x: x["raw"]), "").alias("raw"))
    record = F.regexp_replace("raw", "\\A[\\s,\\[﻿]+", "")
    found = pieces.where("whole").select("ord", "raw").unionByName(joined).select("ord", record.alias("raw"))
    rest = F.col("raw").rlike("\\A\\]?[\\s}]*\\z")           # what stands after the last record of a file
    # the case of the rest comes first: filters of the caller may be evaluated before one on it
    checked = F.when(rest, F.lit(None)).when(F.col("raw").startswith("{"), F.col("raw")).otherwise(
        F.raise_error(F.concat(F.lit("an element of the array is not an object: "), F.substring("raw", 1, 40))))
    return found.select("ord", checked.alias("raw")).where(F.col("raw").isNotNull())
