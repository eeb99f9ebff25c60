"""Forests on all rows."""

import inspect
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoofscope.operators import forest, ml
from spoofscope.plans import models


@pytest.fixture(scope="module")
def rows(spark):
    """x decides the class, but for one row in ten; one value in seven of z is missing."""
    df = spark.range(900).selectExpr("id", "cast(id * 7919 % 1000 as double) AS x", "cast(id * 104729 % 13 as double) AS d",
                                     "if(id % 7 = 0, null, cast(id * 31 % 900 as double)) AS z")
    return df.withColumn("y", F.when(F.col("id") % 10 == 3, F.col("x") <= 400).otherwise(F.col("x") > 400).cast("int")).checkpoint()


def asked(model, df):
    return {r.id: r.p for r in model.probabilities(df, "p").select("id", "p").collect()}


def test_no_fit_is_bounded():
    assert re.search(r"^FIT_ROWS.*= None$", inspect.getsource(models), re.M)


@pytest.mark.parametrize("n", [400, 4000])
def test_a_fit_takes_every_row_that_has_a_class(spark, monkeypatch, n):
    seen = []

    class Learner:
        def fit(self, rows):
            seen.append(rows.count())

    monkeypatch.setattr(models, "FIT_ROWS", None)
    monkeypatch.setattr(ml, "forest_pipeline", lambda *a, **k: Learner())
    monkeypatch.setattr(models, "Forest", lambda rows, *a: seen.append(rows.count()))
    df = spark.range(n).selectExpr("id % 20 AS g", "if(id = 1, null, cast(id % 2 AS int)) AS y", "cast(id % 50 AS double) AS x")
    models.fitted(df, "g", ["x"])
    assert seen == [n - 1]


def test_a_forest_is_the_same_in_any_partitions_groups_and_levels(rows, monkeypatch):
    train, test = rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0")

    def grown(df):
        model = forest.Forest(df, ["x", "d", "z"], n_trees=5)
        return asked(model, test), model.importances()

    monkeypatch.setattr(forest, "SUBTREE_ROWS", 150)  # the first levels from summed counts
    first, gains = grown(train)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 64)
    monkeypatch.setattr(forest, "GROUP_BYTES", 9000)
    again, gains_again = grown(train.repartition(5, "z"))
    assert first == again and len(first) == 300 and gains == pytest.approx(gains_again)
    monkeypatch.undo()
    whole, _ = grown(train)  # other features are tried, so other trees of the same kind
    sure = [i for i in whole if i % 10 != 3]
    right = {r.id: r.y for r in test.collect()}
    for p in (first, whole):
        assert np.mean([(p[i] >= 0.5) == right[i] for i in sure]) > 0.85


def test_a_forest_is_as_good_as_the_learner_of_spark(rows):
    train, test, features = rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0"), ["x", "d", "z"]
    other = ml.forest_pipeline(features, impute=True, n_trees=40).fit(ml.class_balanced_weights(train))
    mine = forest.Forest(train, features, impute=True, n_trees=40)
    a, b = (ml.evaluate(ml.score(m, test)).first() for m in (mine, other))
    assert a.roc_auc == pytest.approx(b.roc_auc, abs=0.03) and a.accuracy == pytest.approx(b.accuracy, abs=0.04)
    spark = rows.sparkSession
    imp = [{r.feature: r.importance for r in ml.feature_importance(m, features, spark).collect()} for m in (mine, other)]
    assert imp[0] == pytest.approx(imp[1], abs=0.06) and sum(imp[0].values()) == pytest.approx(1)


@pytest.mark.parametrize("only", [0, 1])
def test_a_forest_of_one_class_scores(rows, only):
    model = forest.Forest(rows.withColumn("y", F.lit(only)), ["x", "z"], n_trees=3)
    assert set(asked(model, rows).values()) == {float(only)} and model.importances() == [0.0, 0.0]


def test_equal_rows_are_drawn_apart_and_equal_rows_asked_are_all_scored(rows):
    twice = rows.union(rows).select("id", "y", "x")
    model = forest.Forest(twice, ["x"], n_trees=2)
    ids = np.concatenate([np.frombuffer(b.ids, np.uint64) for b in model.train.collect()])
    assert len(ids) == len(set(ids.tolist())) == 1800
    assert model.probabilities(twice, "p").filter("p IS NOT NULL").count() == 1800


def test_folds_are_fitted_on_every_row_several_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(models, "FIT_ROWS", None)
    monkeypatch.setattr(models, "FEW_ROWS", 50)
    monkeypatch.setattr(ml, "N_TREES", 2)
    seen, first = [], forest.Forest.__init__

    def init(self, train, *a, **k):
        first(self, train, *a, **k)
        seen.append(self.n)

    monkeypatch.setattr(forest.Forest, "__init__", init)
    df = spark.range(400).selectExpr("id", "id % 8 AS g", "cast(id % 2 AS int) AS y", "cast(id % 9 AS double) AS x")
    table, _ = models.cross_validate(df, "g", ["x"])
    assert sorted(seen) == sorted(r.train_rows for r in table.collect()) == [300] * 4


def test_draws_are_poisson():
    w = forest.drawn(forest._mix(np.arange(200_000, dtype=np.uint64)), 5, 42)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)


def test_splits_have_the_largest_gain():
    rng, weight = np.random.default_rng(3), np.array([0.7, 1.9])
    hist = rng.integers(0, 4, (2, 40, 3, forest.BINS)).astype(float)
    hist[:, :, 1] = hist[:, :, 2] = 0
    hist[:, :, 1, 4] = hist[:, :, 0].sum(2)  # a feature with one value
    hist[:, :, 2] = hist[:, :, 0, ::-1]
    feature, cut, gain = forest.best_splits(hist, np.tile([5, 6, 7], (40, 1)), weight)

    def impurity(c):
        m = c * weight
        return m.sum() - (m * m).sum() / m.sum() if m.sum() else 0.0

    for i in range(40):
        found = {(5 + j, k): impurity(hist[:, i, 0].sum(1)) - impurity(hist[:, i, j, :k + 1].sum(1)) - impurity(hist[:, i, j, k + 1:].sum(1))
                 for j in (0, 2) for k in range(forest.BINS - 1)}
        assert gain[i] == pytest.approx(max(found.values())) == pytest.approx(found[int(feature[i]), int(cut[i])])


def test_a_tree_grows_until_its_leaves_are_pure():
    x = np.array([[i, j] for i in range(20) for j in range(20)], np.uint8)
    y = (x[:, 0].astype(int) * 3 + x[:, 1] > 40).astype(np.uint8)
    p, gains = forest.grow(x, y, np.ones(400, np.uint8), x, np.ones(2), np.random.default_rng(1), 30)
    assert (p == y).all() and (gains > 0).all()
    p, _ = forest.grow(x, y, np.ones(400, np.uint8), x, np.ones(2), np.random.default_rng(1), 1)
    assert len(set(p.tolist())) <= 2 and p.mean() == pytest.approx(y.mean())


def test_few_values_have_a_bin_each_and_missing_ones_the_last(spark):
    df = spark.createDataFrame([(float(i % 3), None if i % 2 else float(i)) for i in range(400)], "a double, b double")
    a, b = forest.thresholds(df, ["a", "b"])
    assert a.tolist() == [0.5, 1.5] and len(b) == forest.BINS - 1 and (np.diff(b) > 0).all()
    assert np.searchsorted(b, np.nan) == forest.BINS - 1
    assert [len(t) for t in forest.thresholds(df.limit(0), ["a"])] == [0]
