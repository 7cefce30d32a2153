"""Sinks: results of several batches, repeats and broken batches."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from wardline.sources import store


def rows(spark, *values):
    return spark.createDataFrame(list(values), "k long, z string, n long")


def content(spark, path):
    return sorted(store.read_store(spark, path).collect(), key=str)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if "bucket=" in d and f.endswith(".parquet")}


def test_append_is_idempotent(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert store.append_batch(rows(spark, (1, "a", 1), (1, "a", 1), (None, "a", 2), (2, None, 3)), path, ["k", "z"], "one", 4)
    assert store.append_batch(rows(spark, (1, "a", 9), (3, "c", 4), (None, "a", 8), (2, None, 7)), path, ["k", "z"], "two", 4)
    want = content(spark, path)
    assert sorted((r.k or 0, r.z or "", r.n) for r in want) == [(0, "a", 2), (1, "a", 1), (2, "", 3), (3, "c", 4)]
    assert not store.append_batch(rows(spark, (5, "x", 1)), path, ["k", "z"], "two", 4)
    shutil.rmtree(f"{path}/_batches/two")  # broken off after its rows, before its mark
    assert store.append_batch(rows(spark, (1, "a", 9), (3, "c", 4)), path, ["k", "z"], "two", 4)
    assert content(spark, path) == want


def test_replacement_rewrites_only_its_partitions(spark, tmp_path):
    path = f"{tmp_path}/t"
    base = spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("z"), F.col("id").alias("n"))
    store.replace_batch(base, path, ["k"], "base", buckets=16)
    before = files(path)
    change = rows(spark, (7, "b", 1), (7, "c", 5), (7, "a", 3), (900, "new", 0), (None, "null", 1))
    assert store.replace_batch(change, path, ["k"], "change", order="n", buckets=16)
    after, got = files(path), {r.k: (r.z, r.n) for r in content(spark, path)}
    assert got[7] == ("c", 5) and got[900] == ("new", 0) and got[None] == ("null", 1) and len(got) == 202
    untouched = {f for f in before if after.get(f) == before[f]}
    assert len({os.path.dirname(f) for f in untouched}) >= 13
    shutil.rmtree(f"{path}/_batches/change")
    assert store.replace_batch(change, path, ["k"], "change", order="n", buckets=16)
    assert {r.k: (r.z, r.n) for r in content(spark, path)} == got
    assert not store.replace_batch(change.withColumn("z", F.lit("no")), path, ["k"], "change", buckets=16)


@pytest.mark.parametrize("force", [False, True])
def test_backfill(spark, tmp_path, force):
    path = f"{tmp_path}/t"
    compute = lambda name: lambda df: df.select("k", F.lit(name).alias("z"), "n")
    assert store.backfill_batch(rows(spark, (1, "", 1), (2, "", 2)), path, ["k"], "a", compute("first"))
    assert store.backfill_batch(rows(spark, (1, "", 1), (2, "", 2), (3, "", 3)), path, ["k"], "b", compute("second"), force)
    assert {r.k: r.z for r in content(spark, path)} == {1: "second" if force else "first", 2: "second" if force else "first", 3: "second"}


def test_empty_batches(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert store.read_store(spark, path) is None
    assert store.append_batch(rows(spark, (1, "a", 1)).limit(0), path, ["k"], "empty")
    assert store.replace_batch(rows(spark, (1, "a", 1)), path, ["k"], "one")
    assert store.replace_batch(rows(spark, (1, "a", 1)).limit(0), path, ["k"], "none")
    assert [tuple(r) for r in content(spark, path)] == [(1, "a", 1)]
