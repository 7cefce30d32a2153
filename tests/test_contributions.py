"""Path contributions of boosted trees, hash trees of snapshots and mergeable distinct counts."""

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from wardline.operators import training as tr
from wardline.operators.bitmaps import distinct_cube, distinct_totals, merge_cubes
from wardline.operators.contributions import boosted_contributions, tree_nodes


@pytest.fixture(scope="module")
def model_and_rows(spark):
    rows = [(i, Vectors.dense([i % 5, (i * 7) % 11, float(i % 2)]), float((i % 5 > 2) ^ (i % 11 == 3))) for i in range(200)]
    df = spark.createDataFrame(rows, ["id", "x", "label"])
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=4, maxDepth=3, seed=1).fit(df)
    return model, df


def walk(nodes, root, values):
    """Gains per feature of one path, node by node."""
    gains, at = {}, root
    while nodes[at]["left"] >= 0:
        n = nodes[at]
        value = values[n["feature"]]
        small = value in n["split"] if n["kinds"] >= 0 else value <= n["split"][0]
        child = n["left"] if small else n["right"]
        gains[n["feature"]] = gains.get(n["feature"], 0) + nodes[child]["value"] - n["value"]
        at = child
    return gains


def test_contributions_equal_a_walk_and_add_up(spark, model_and_rows):
    model, df = model_and_rows
    names = ["a", "b", "c"]
    found = {}
    for r in boosted_contributions(df, model, "id", "x", names).collect():
        found.setdefault(r.id, {})[r.feature] = r
    nodes, roots, _ = tree_nodes(model, spark)
    raw = {r.id: r.v for r in model.transform(df).select("id", vector_to_array("rawPrediction")[1].alias("v")).collect()}
    for r in df.collect():
        want = {}
        for root in roots:
            for f, g in walk(nodes, root, r.x.toArray()).items():
                want[names[f]] = want.get(names[f], 0) + g
        assert set(found[r.id]) == set(want)
        assert all(found[r.id][k].contribution == pytest.approx(v, abs=1e-9) for k, v in want.items())
        bias = next(iter(found[r.id].values())).bias
        assert bias + sum(v.contribution for v in found[r.id].values()) == pytest.approx(raw[r.id], abs=1e-9)
        assert all(found[r.id][k].active == (r.x[names.index(k)] != 0) for k in want)


def test_constant_labels_and_no_rows(spark, model_and_rows):
    model, df = model_and_rows
    assert boosted_contributions(df.filter("id < 0"), model, "id", "x", ["a", "b", "c"]).count() == 0
    still = GBTClassifier(featuresCol="x", labelCol="label", maxIter=1).fit(df.withColumn("label", F.lit(1.0)))
    assert boosted_contributions(df, still, "id", "x", ["a", "b", "c"]).count() == 0


def manifest(spark, rows):
    return tr.snapshot(spark.createDataFrame(rows, "i long, y int, s string"), "i", "y", "s")


def test_hash_tree_names_what_changed(spark):
    rows = [(i, i % 2, "real") for i in range(500)]
    old = manifest(spark, rows)
    tree = tr.hash_tree(old, 2)
    same = tr.hash_tree(manifest(spark, rows[::-1]).repartition(3), 2)
    assert sorted(tree.collect()) == sorted(same.collect())
    assert tree.filter("level = 0").first()["rows"] == 500
    new = manifest(spark, [*rows[1:7], (7, 0, "real"), *rows[8:], (500, 1, "real"), (9, 1, "real")])
    after = tr.hash_tree(new, 2)
    found = {tuple(r) for r in tr.changed_rows(old, new, tree, after, 2).collect()}
    assert found == {(0, "removed"), (7, "changed"), (500, "added"), (9, "changed")}
    differ = tree.filter("level = 2").join(after.filter("level = 2"), ["bucket", "digest"], "left_anti").count()
    assert 1 <= differ <= 4
    assert tr.hash_tree(old.filter("false"), 2).count() == 0
    assert tr.changed_rows(old, old, tree, tree, 2).count() == 0


def test_bitmaps_merge(spark):
    rows = [(k, i) for i in range(0, 90_000, 7) for k in ("a", "b") if (i + len(k)) % 3 or k == "a"] * 2 + [("a", None), (None, 5)]
    df = spark.createDataFrame(rows, "k string, i long")
    cube = distinct_cube(df, ["k"], "i")
    want = {k: len({i for q, i in rows if q == k and i is not None}) for k in ("a", "b", None)}
    assert {r[0]: r[1] for r in distinct_totals(cube, ["k"]).collect()} == want
    assert distinct_totals(cube).first()[0] == len({i for _, i in rows if i is not None})
    parts = [distinct_cube(df.filter(c), ["k"], "i") for c in ("i < 50000", "i >= 30000")]
    merged = merge_cubes(*parts, ["k"])
    assert {r[0]: r[1] for r in distinct_totals(merged, ["k"]).collect()} == want
    assert distinct_totals(distinct_cube(df.filter("false"), ["k"], "i")).first()[0] == 0
