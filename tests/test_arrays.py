"""SRC-1 by byte ranges against json.loads, with ranges of a few bytes."""
import json
import os
import random
import tempfile

import pytest

from tessera.sources.arrays import array_records
from tessera.sources.corpus import json_corpus_scan


@pytest.fixture
def ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def size(n):
        spark.conf.set(names[0], str(n))
        spark.conf.set(names[1], "1")
    yield size
    for n, b in zip(names, before):
        spark.conf.set(n, b)


def write(text):
    path = os.path.join(tempfile.mkdtemp(prefix="array-"), "corpus.json")
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def some(rng, depth=0):
    text = lambda: "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", "é", "漢", "a", " ", "\n", "\\\\", '\\"']) for _ in range(rng.randrange(9)))
    out = {"lemma": text(), "definition": text(), "n": rng.choice([1, -2.5, None, True])}
    if depth < 3 and rng.random() < 0.5:
        out[text() or "k"] = rng.choice([[some(rng, depth + 1)], some(rng, depth + 1), [], {}, [[1], "}"]])
    return out


@pytest.mark.parametrize("bytes_a_range", [40, 300, 1 << 20])
def test_records_and_ordinals_equal_json(spark, ranges, bytes_a_range):
    rng = random.Random(bytes_a_range)
    ranges(bytes_a_range)
    records = [some(rng) for _ in range(120)]
    for text in (json.dumps(records), " \n" + json.dumps(records, ensure_ascii=False, indent=2) + "\n "):
        df = array_records(spark, write(text))
        got = sorted((r.ord, json.loads(r.raw)) for r in df.collect())
        assert got == list(enumerate(records))
        if bytes_a_range == 300:
            from tessera.sources.arrays import _ranges
            assert _ranges(spark, write(text)).rdd.getNumPartitions() > 8      # one file, many tasks


def test_scan_keeps_fields_in_any_range(spark, ranges):
    ranges(64)
    records = [{"id": i, "lemma": f"w{i}", "definition": 'a "quoted" } brace', "more": {"x": [i, "]"]}, "none": None} for i in range(40)]
    rows = sorted(json_corpus_scan(spark, write(json.dumps(records))).collect(), key=lambda r: r.ord)
    assert [(r.ord, r.id, r.lemma, r.definition) for r in rows] == [(i, str(i), f"w{i}", 'a "quoted" } brace') for i in range(40)]
    assert [{k: json.loads(v) for k, v in r.extra.items()} for r in rows] == [{"more": {"x": [i, "]"]}} for i in range(40)]


def test_errors_and_empty_arrays(spark, ranges):
    ranges(50)
    assert array_records(spark, write("[]")).count() == 0 and array_records(spark, write(" [ ] \n")).count() == 0
    assert [r.raw for r in array_records(spark, write("[{}]")).collect()] == ["{}"]
    for text in ("", "  \n", '{"a": 1}', '"[]"', "3"):
        with pytest.raises(ValueError, match="does not hold"):
            array_records(spark, write(text))
    for text in ('[{"a": 1}', '[{"a": "x', '[{"a": 1}, {"b": ['):
        with pytest.raises(ValueError, match="does not end"):
            array_records(spark, write(text))
    with pytest.raises(Exception, match="not an object"):
        array_records(spark, write('[{"a": 1}, 5, {"b": 2}]')).collect()
    with pytest.raises(FileNotFoundError):
        json_corpus_scan(spark, "/tmp/no-such-file.json")


def test_several_files_are_one_corpus(spark, ranges):
    ranges(30)
    root = tempfile.mkdtemp(prefix="arrays-")
    parts = [[{"lemma": f"{f}{i}"} for i in range(5)] for f in "ab"]
    for name, part in zip(("1.json", "2.json"), parts):
        with open(os.path.join(root, name), "w") as f:
            json.dump(part, f)
    assert sorted((r.ord, json.loads(r.raw)) for r in array_records(spark, root).collect()) == list(enumerate(parts[0] + parts[1]))
