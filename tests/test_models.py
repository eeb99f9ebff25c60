"""What the model queries return, from the forests at their full size."""

import pytest
from pyspark.sql import functions as F

from spoofscope.operators import ml
from spoofscope.plans import models
from spoofscope.plans.registry import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def got(spark):
    """Results of the queries; the fits read fewer rows here, the forests are whole."""
    cache = {}
    models.FIT_ROWS = 300

    def run(name):
        if name not in cache:
            cache[name] = QUERIES[name](spark, SF).toPandas()
        return cache[name]
    return run


def test_forests_are_not_cut():
    assert (ml.N_TREES, ml.MAX_DEPTH) == (300, 30)
    assert not hasattr(models, "QUERY_TREES")


def test_cross_validation(got):
    cv, table, total = got("cv_results"), got("fold_table"), got("cv_summary")
    both = cv.merge(table, on="fold", suffixes=("", "_t"))
    assert len(both) == len(cv) == 4 and all((both[c] == both[c + "_t"]).all() for c in ("train_rows", "test_rows", "test_clean", "test_spoofed"))
    assert ((cv[["accuracy", "f1", "roc_auc"]] >= 0) & (cv[["accuracy", "f1", "roc_auc"]] <= 1)).all().all()
    assert total.accuracy[0] == pytest.approx(cv.accuracy.mean(), abs=1e-5)


def test_scores_and_the_evaluation_agree(got):
    s, e, r = got("score"), got("holdout_eval"), got("train_signal").iloc[0]
    assert s.spoof_probability.between(0, 1).all() and (s.y_pred == (s.spoof_probability >= 0.5)).all()
    assert (s.correct == (s.y_true == s.y_pred)).all() and len(s) == r.test_rows
    assert s.correct.mean() == pytest.approx(r.accuracy, abs=1e-5)
    cells = e[e.part == "confusion"].set_index(["name", "metric"]).value
    assert cells.sum() == len(s)
    assert cells.get(("true_1", "predicted_1"), 0) == ((s.y_true == 1) & (s.y_pred == 1)).sum()
    by = e[(e.part == "label") & (e.metric == "accuracy")].set_index("name").value
    assert by.to_dict() == pytest.approx(s.groupby("label").correct.mean().to_dict(), abs=1e-5)
    assert (e.part == "mistake").sum() == min(20, (~s.correct).sum())


def test_summary_records(got):
    m = got("model_summary").set_index("model_name")
    assert set(m.index) == {"trajectory", "signal"}
    assert {"model_type", "task", "validation_method", "selected_threshold", "accuracy", "attack_precision", "attack_recall", "attack_f1",
            "roc_auc", "train_rows", "test_rows", "description"} <= set(m.columns)
    assert m.test_clear_sky["signal"] + m.test_spoofed["signal"] == m.test_rows["signal"]
    assert m.selected_threshold.to_dict() == {"trajectory": 0.3, "signal": 0.5}
    assert set(got("model_overview").model_name) == set(m.index)


def test_importance(got):
    i = got("feature_importance")
    assert 0 < len(i) <= 20 and i.importance.is_monotonic_decreasing and i.description.str.len().min() > 0


def sampled(spark, groups, most):
    """groups: (group, class, rows); (class, group) -> rows of the sample."""
    rows = spark.createDataFrame([(g, y, k) for g, y, n in groups for k in range(n)], "group_id int, y int, k int")
    fit = ml.fit_rows(rows, "group_id", most)
    assert fit.columns == rows.columns and fit.count() <= most and fit.distinct().count() == fit.count()
    return {(r.y, r.group_id): r["count"] for r in fit.groupBy("y", "group_id").count().collect()}


def test_the_fit_sample_holds_both_classes_and_all_groups(spark):
    # groups of one class each, one of them or all larger than the bound
    assert sampled(spark, [(0, 0, 3000), (1, 1, 3000)], 500) == {(0, 0): 250, (1, 1): 250}
    assert sampled(spark, [(0, 0, 40), (1, 0, 900), (2, 0, 900), (3, 1, 5)], 600) == {(0, 0): 40, (0, 1): 130, (0, 2): 130, (1, 3): 5}
    six = sampled(spark, [(g, g % 2, 1014) for g in range(6)], 2000)
    assert set(six) == {(g % 2, g) for g in range(6)} and set(six.values()) == {333}
    # within the bound all rows stay; with more groups than rows, as many groups as fit
    assert sampled(spark, [(0, 0, 30), (1, 1, 20)], 2000) == {(0, 0): 30, (1, 1): 20}
    many = sampled(spark, [(g, g % 2, 3) for g in range(90)], 20)
    assert sorted(many.values()) == [1] * 20 and sum(y for y, _ in many) == 10


def test_the_sample_does_not_depend_on_partitions_and_survives_odd_rows(spark):
    rows = spark.createDataFrame([(g, g % 2, k) for g in range(5) for k in range(300)] + [(None, 1, 1), (None, None, 2)], "group_id int, y int, k int")
    a, b = (sorted(map(str, ml.fit_rows(x, "group_id", 100, key=["group_id", "k"]).collect())) for x in (rows.repartition(7), rows.coalesce(1)))
    assert a == b and 3 < len(a) <= 100
    assert ml.fit_rows(rows.limit(0), "group_id", 100).count() == 0


def test_weights_come_from_the_rows_that_are_fitted(spark):
    rows = spark.createDataFrame([(g, k, int(g < 3)) for g in range(10) for k in range(10 * g + 5)], "group_id int, k int, y int")
    for most in (60, 10_000):
        w = ml.class_balanced_weights(ml.fit_rows(rows, "group_id", most)).groupBy("y").agg(F.sum("weight").alias("w")).collect()
        assert len({round(r.w, 6) for r in w}) == 1


def test_signal_groups_of_five_times_the_rows_fit_on_both_classes(spark):
    """Every receiver file has one label; blown up, each is larger than the bound's share."""
    rows = models.signal_rows(spark, SF).select("group_id", "y", *models.WINDOW_KEY)
    blown = rows.crossJoin(spark.range(200).withColumnRenamed("id", "copy")).withColumn("window_id", F.col("window_id") * 200 + F.col("copy"))
    sizes = blown.groupBy("group_id").count().agg(F.min("count")).first()[0]
    fit = ml.fit_rows(blown, "group_id", 200, key=models.WINDOW_KEY).groupBy("y", "group_id").count().collect()
    assert sizes > 200 and {r.y for r in fit} == {0, 1} and len(fit) == rows.select("group_id").distinct().count()


@pytest.mark.parametrize("only", [0, 1])
def test_a_model_of_one_class_scores(spark, only):
    rows = spark.createDataFrame([(float(k), only) for k in range(30)], "x double, y int")
    model = ml.forest_pipeline(["x"], weight=None, n_trees=3, max_depth=2).fit(rows)
    assert {r.spoof_probability for r in ml.score(model, rows).collect()} == {float(only)}


def test_a_changed_table_is_fitted_anew(spark, tmp_path):
    made = []
    def fit():
        return models.once("t", spark, str(tmp_path), "embeddings", lambda: made.append(1) or len(made))
    spark.range(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert (fit(), fit()) == (1, 1)
    spark.range(6).write.mode("overwrite").parquet(str(tmp_path / "embeddings.parquet"))
    assert (fit(), fit()) == (2, 2)


def test_no_fold_with_both_classes_is_an_error(spark):
    rows = spark.createDataFrame([(g, 1) for g in range(8) for _ in range(3)], "group_id int, y int")
    with pytest.raises(ValueError):
        models.holdout_split(rows, "group_id")


def test_a_fit_is_in_few_tasks_however_many_the_table_has(spark, monkeypatch):
    seen = []

    class Learner:
        def fit(self, rows):
            seen.append((rows.rdd.getNumPartitions(), rows.count(), sorted(rows.columns)))

    monkeypatch.setattr(ml, "forest_pipeline", lambda *a, **k: Learner())
    monkeypatch.setattr(models, "FIT_ROWS", 300)
    rows = spark.range(0, 4000, 1, 100).selectExpr("id % 20 AS g", "cast(id % 2 AS int) AS y", "id AS k", "cast(id AS double) AS x")
    models.fitted(rows, "g", ["x"], key=["k"])
    (tasks, n, columns), = seen
    assert tasks <= models.FIT_TASKS and n == 300 and columns == ["weight", "x", "y"]


def test_the_windows_of_the_signal_model_are_built_once(spark, monkeypatch, tmp_path):
    built = spark.sparkContext.accumulator(0)

    def value(k):
        built.add(1)
        return float(k)

    rows = spark.range(50).select("id", F.udf(value, "double")("id").alias(models.trk.FEATURE_COLUMNS[0]))
    spark.range(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(models, "signal_rows", lambda *a: rows)
    monkeypatch.setattr(models, "holdout_model", lambda rows, *a, **k: (rows,))
    read, features = models.signal_holdout(spark, str(tmp_path))
    assert features == models.trk.FEATURE_COLUMNS[:1] and read.agg(F.sum(features[0])).first()[0] == 1225.0
    assert built.value == 50


def test_a_fold_is_scored_once(spark, monkeypatch):
    scored = spark.sparkContext.accumulator(0)

    def value(k):
        scored.add(1)
        return k / 400

    rows = spark.range(400).selectExpr("id", "id % 8 AS g", "cast(id % 2 AS int) AS y")
    monkeypatch.setattr(models, "fitted", lambda *a: None)
    monkeypatch.setattr(ml, "score", lambda model, df, threshold: df.withColumn("spoof_probability", F.udf(value, "double")("id"))
                        .withColumn("y_pred", (F.col("spoof_probability") >= threshold).cast("int")))
    table, _ = models.cross_validate(rows, "g", ["id"])
    assert table.agg(F.sum("test_rows")).first()[0] == 400 and scored.value <= 800
