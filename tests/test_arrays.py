"""JSON arrays read by many tasks against the one-task reader and Python's json module."""

import json
import random

import pytest

from wardline.sources.arrays import measure, read_json_split
from wardline.sources.readers import BAD, bad_count, good_rows, read_json


@pytest.fixture
def small_ranges(spark):
    """Short ranges, so elements reach over several of them."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "2500")
    spark.conf.set(keys[1], "1")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def as_rows(df, names):
    return sorted((tuple(r[c] for c in names) for r in good_rows(df).collect()), key=str)


def test_many_ranges_give_the_elements_of_the_json_module(small_ranges, tmp_path):
    rng = random.Random(5)
    texts = ["plain", 'q"uote', "back\\slash\\", "{[", "}]}", "é}ü", "", "line\nend", "}" * 900, '\\"}', "x" * 4000]
    items = []
    for i in range(60):
        inner = {"t": rng.choice(texts), "deep": [{"u": rng.choice(texts)}, [], {}]}
        items.append({"id": i, "a": rng.choice(texts), "b": rng.choice([None, inner, [inner, 3]])})
        if i % 7 == 0:
            items.append(rng.choice([5, "s}{", None, [1, {"x": "}"}]]))
    (tmp_path / "one.json").write_text(json.dumps(items, indent=1, ensure_ascii=False))
    (tmp_path / "two.json").write_text(json.dumps([{"id": 1000, "a": "last"}, 7]))
    found = read_json_split(small_ranges, str(tmp_path), ["id", "a", "b"])
    rows = as_rows(found, ["id", "a", "b"])
    assert rows == as_rows(read_json(small_ranges, str(tmp_path), ["id", "a", "b"]), ["id", "a", "b"])
    want = {str(x["id"]): x["a"] for x in items if isinstance(x, dict)} | {"1000": "last"}
    assert {r[0]: r[1] for r in rows} == want
    assert {r[0]: r[2] and json.loads(r[2]) for r in rows if r[0] != "1000"} == {str(x["id"]): x["b"] for x in items if isinstance(x, dict)}


def test_broken_elements_and_odd_files(spark, tmp_path):
    files = ["", "[]", " [ ] \n", '﻿[{"a":1}]', '{"a":2}', '[{"a":3},{"a":4 5},{"a":6}]\n', '[7,"x"]', '[{"a":8}, 9 ]']
    for i, text in enumerate(files):
        (tmp_path / f"{i}.json").write_text(text)
    found = read_json_split(spark, str(tmp_path))
    assert as_rows(found, ["a"]) == [("1",), ("2",), ("3",), ("6",), ("8",)]
    assert sorted(r[BAD].strip() for r in found.filter(f"{BAD} is not null").collect()) == ["7", "9", "x", '{"a":4 5}']


def test_an_open_text_makes_bad_fragments_only(small_ranges, tmp_path):
    (tmp_path / "a.json").write_text('[{"a":1},{"a":"open},' + '{"a":3},' * 900 + '{"a":4}]')
    (tmp_path / "b.json").write_text('[{"a":5}]')
    found = read_json_split(small_ranges, str(tmp_path), ["a"], longest=1000)
    assert {("1",), ("5",)} <= set(as_rows(found, ["a"]))
    assert bad_count(found).first()["bad"] >= 1


@pytest.mark.parametrize("part, outside, inside", [
    (b'{"a":1', (0, 0), (1, -0)), (b'{"a":"', (1, 1), (0, -1)), (b'", "b":[{', (1, 0), (0, 1)), (b'"a\\"', (1, 0), (1, 0)), (b"]", (0, -2), (1, 0)),
])
def test_measure(part, outside, inside):
    assert measure(part, False) == outside
    if part.count(b'"') != 2:
        assert measure(part, True) == inside
