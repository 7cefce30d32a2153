"""The parallel helpers give what a single-task computation gives."""

import random

from pyspark.sql import functions as F

from wardline.plans import scale


def test_running_totals_and_ranks_match_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.randint(0, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, g string, v int").repartition(7)
    got = {r["k"]: r["s"] for r in scale.running_totals(df, [F.col("k").asc()], {"s": F.col("v")}).collect()}
    total, want = 0, {}
    for k, _, v in rows:
        total += v
        want[k] = total
    assert got == want
    grouped = {r["k"]: r["n"] for r in scale.ranked(df, [F.col("k").desc()], "n", ["g"]).collect()}
    for g in "ab":
        keys = sorted((k for k, x, _ in rows if x == g), reverse=True)
        assert [grouped[k] for k in keys] == list(range(1, len(keys) + 1))


def test_count_ids_counts_each_id_once(spark):
    rows = [("hot", i % 50, i % 3 == 0) for i in range(1000)] + [("cold", 1, False), ("cold", None, True)]
    df = spark.createDataFrame(rows, "g string, i int, f boolean")
    got = {r["g"]: (r["incidents"], r["flagged"]) for r in scale.count_ids(df, ["g"], "i", {"flagged": F.col("f")}).collect()}
    assert got == {"hot": (50, 50), "cold": (1, 0)}


def test_top_k_keeps_ties_by_the_second_key(spark):
    df = spark.createDataFrame([("a", "x", 2), ("a", "y", 2), ("a", "z", 1), ("b", "q", 1)], "g string, v string, n int")
    got = sorted((r["g"], r["v"], r["rank"]) for r in scale.top_k(df, 2, [F.col("n").desc(), F.col("v").asc()], ["g"]).collect())
    assert got == [("a", "x", 1), ("a", "y", 2), ("b", "q", 1)]


def test_costly_columns_run_once(spark):
    df = scale.once(spark.range(3), v=F.col("id") * 2).filter("v > 2")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate")
