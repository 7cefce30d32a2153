"""CSV read by many tasks against the one-task reader and against Python's csv module."""

import csv
import io
import random

import pytest

from wardline.sources.quoted import end_state, read_csv_split
from wardline.sources.readers import BAD, bad_count, good_rows, read_csv


@pytest.fixture
def small_ranges(spark):
    """Short ranges, so quoted cells reach over several of them."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "2500")
    spark.conf.set(keys[1], "1")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def cells(rng):
    words = ["plain", "two\nlines", 'a "quote" in it', "comma, here", "", "é" * 40, "x\r\ny", 'ends with "', '"', "a\n\n\nb", "line\n" * 700]
    return [rng.choice(words) for _ in range(3)]


def as_rows(df, names):
    return sorted((tuple(r[c] for c in names) for r in good_rows(df).collect()), key=str)


def test_many_ranges_give_the_rows_of_the_csv_module(small_ranges, tmp_path):
    rng = random.Random(7)
    rows = [[str(i), *cells(rng)] for i in range(60)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["id", "a", "b", "c"], *rows])
    (tmp_path / "one.csv").write_text(out.getvalue(), newline="")
    found = read_csv_split(small_ranges, str(tmp_path))
    names = ["id", "a", "b", "c"]
    want = sorted((tuple(x or None for x in r) for r in rows), key=str)
    assert as_rows(found, names) == want
    assert as_rows(read_csv(small_ranges, str(tmp_path)), names) == want
    assert small_ranges.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 8


def test_headers_encodings_and_bad_rows_per_file(small_ranges, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿id,name\r\n1,"Jörg\r\nK."\r\n\r\n2\r\n3,x,y\r\n'.encode())
    (tmp_path / "b.csv").write_bytes("name,id\nZoë,4\n5\" pipe,6\n\"done\" late,7\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes(b"")
    (tmp_path / "d.csv").write_bytes(b"id,other\n")
    found = read_csv_split(small_ranges, str(tmp_path), ["id", "name"])
    assert as_rows(found, ["id", "name"]) == sorted(
        [("1", "Jörg\nK."), ("2", None), ("4", "Zoë"), ("6", '5" pipe'), ("7", '"done" late')], key=str
    )
    assert [r[BAD] for r in found.filter(f"{BAD} is not null").collect()] == ["3,x,y"]
    assert sorted(read_csv_split(small_ranges, str(tmp_path)).columns) == sorted(["id", "name", "other", BAD])


def test_an_open_quote_makes_bad_lines_and_harms_no_other_file(small_ranges, tmp_path):
    (tmp_path / "a.csv").write_text('1,ok\n2,"never closed\n' + "3,inside\n" * 200)
    (tmp_path / "b.csv").write_text("4,ok\n")
    found = read_csv_split(small_ranges, str(tmp_path), ["id", "v"], header=False, longest=1000)
    assert as_rows(found, ["id", "v"]) == [("1", "ok"), ("4", "ok")]
    assert bad_count(found).first()["bad"] == 201


def test_empty_folder_columns_and_separators(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert read_csv_split(spark, str(tmp_path), ["a"]).count() == 0
    (tmp_path / "b.csv").write_text('a;b\n"1;2";3\n')
    assert as_rows(read_csv_split(spark, str(tmp_path), sep=";"), ["a", "b"]) == [("1;2", "3")]
    with pytest.raises(ValueError):
        read_csv_split(spark, str(tmp_path), header=False)
    with pytest.raises(ValueError):
        read_csv_split(spark, str(tmp_path), sep='"')


@pytest.mark.parametrize("line, outside, inside", [
    ('a,b', False, True), ('"a,b', True, False), ('a"b,c', False, False), ('"a""', True, False), ('"a"""', False, False),
    ('""', False, True), ('"', True, False), ('a,"b', True, False), ('x","y', True, True), ('x","y"', False, False), ('"a"b"c,d', False, False),
])
def test_states_of_a_line(line, outside, inside):
    state = end_state()
    assert (state(line.encode(), False), state(line.encode(), True)) == (outside, inside)


def test_lines_are_not_dealt_out_to_meet_their_range_or_header(spark, tmp_path):
    """States of ranges and headers come to the lines: only lines of records with line ends are shuffled."""
    (tmp_path / "a.csv").write_text('id,name\n1,"two\nlines"\n2,x\n')
    (tmp_path / "b.csv").write_text("name,id\ny,3\n")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if tables were large
    try:
        found = read_csv_split(spark, str(tmp_path), ["id", "name"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert as_rows(found, ["id", "name"]) == [("1", "two\nlines"), ("2", "x"), ("3", "y")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin [file" in plan and "SortMergeJoin [file#" in plan  # the sizes of records alone are joined by shuffles
    assert "SortMergeJoin [file" not in "".join(x for x in plan.splitlines() if "block" in x.split("],")[0])
