"""Registered model queries run their operators whole."""

import inspect

import pytest
from pyspark.ml.feature import VectorAssembler

from wardline import queries as registry
from wardline.operators import similarity as sim
from wardline.operators import training as tr

registry.load()
FOLDER = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


def passed(monkeypatch, spark, module, operator, query):
    """Arguments by name that the query gives the operator."""
    signature = inspect.signature(getattr(module, operator))

    def stop(*args, **named):
        raise Seen(signature.bind(*args, **named).arguments)

    monkeypatch.setattr(module, operator, stop)
    with pytest.raises(Seen) as seen:
        registry.QUERIES[query](spark, FOLDER)
    return seen.value.args[0]


@pytest.mark.parametrize("module,operator,query,cuts", [
    (sim, "embed", "k3_embed", {"features"}), (tr, "baselines", "l5_baselines", {"features", "max_iter"}),
    (tr, "train_boosted", "t6_out_of_fold", {"depths", "steps", "trees", "folds"}),
])
def test_defaults_hold(monkeypatch, spark, module, operator, query, cuts):
    assert not cuts & set(passed(monkeypatch, spark, module, operator, query))


def test_boosted_trees_see_text_and_structure(monkeypatch, spark):
    given = passed(monkeypatch, spark, tr, "train_boosted", "t6_out_of_fold")
    row = given["df"].select(given["features"], "fold").first()
    assert row[0].size > 2 * 4096 and given["df"].agg({"fold": "max"}).first()[0] == 4


def test_scores_see_text_and_structure(monkeypatch, spark):
    model = passed(monkeypatch, spark, tr, "score", "t9_score")["model"]
    assert model.stages[-1].numFeatures > 2 * 4096 and model.stages[-1].getMaxIter() == 100


def labelled_texts(spark):
    rows = [(i, f"pump {'leak' if i % 3 else 'fine'} number {i % 7}", "ab"[i % 2], f"g{i % 5}", i % 3 % 2) for i in range(60)]
    return spark.createDataFrame(rows, "id int, t string, kind string, grp string, y int")


def test_out_of_fold_models_are_fitted_once(monkeypatch, spark):
    fits, fit = [], tr.GBTClassifier._fit
    monkeypatch.setattr(tr.GBTClassifier, "_fit", lambda self, df: fits.append(1) or fit(self, df))
    df = VectorAssembler(inputCols=["id", "y"], outputCol="x").transform(labelled_texts(spark))
    df = tr.fold(tr.class_weight(df.selectExpr("id", "cast(y as double) as label", "x")), "id", 2)
    best, held_out, chosen = tr.train_boosted(df, "x", depths=(2, 3), steps=(0.1,), trees=(2,), folds=2)
    assert len(fits) == 2 * 2 + 1 and best.getNumTrees == 2
    got = {r.id: r.oof_score for r in held_out.collect()}
    again = tr.GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", seed=42, **chosen)
    want = {}
    for k in range(2):
        scored = again.fit(df.filter(f"fold <> {k}")).transform(df.filter(f"fold = {k}"))
        want |= {r.id: r.s for r in scored.select("id", tr.probability().alias("s")).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_baselines_make_words_once(monkeypatch, spark):
    fitted, fit = [], tr.Pipeline._fit
    monkeypatch.setattr(tr.Pipeline, "_fit", lambda self, df: fitted.extend(map(type, self.getStages())) or fit(self, df))
    out = tr.baselines(labelled_texts(spark), "id", "t", ["kind"], "y", "grp", features=16, max_iter=2)
    assert out.count() == 8 and out.select("split", "model").distinct().count() == 8
    assert tr.IDF in fitted and not {tr.RegexTokenizer, tr.HashingTF} & set(fitted)
