"""Committed batches: readers see whole batches only, whatever happened to the writer."""

import os
import random

import pytest
from pyspark.sql import functions as F

from spoofscope.operators import metrics as mt
from spoofscope.operators import trajectory as tr
from spoofscope.sources import readers as rd
from spoofscope.sources.committed import BatchTables
from spoofscope.streaming import live


def scored(spark, n, seed=1):
    r = random.Random(seed)
    rows = [(i, f"a{i % 17}", 100 + i // 10, r.choice([None, r.random()])) for i in range(n)]
    df = spark.createDataFrame(rows, "seq long, icao24 string, time long, attack_probability double")
    return df.withColumn("predicted_anomaly", F.when(F.col("attack_probability") >= tr.ANOMALY_THRESHOLD, 1).otherwise(0))


def broken(df):
    return df.withColumn("seq", F.raise_error(F.lit("lost")).cast("long"))


def test_a_batch_that_died_is_never_read(spark, tmp_path):
    t, df = BatchTables(spark, str(tmp_path)), scored(spark, 30)
    assert t.newest() is None and t.read("predictions") is None and rd.read_predictions(spark, str(tmp_path)) is None
    assert t.commit(3, {"predictions": df.limit(10), "alerts": df.limit(1)})
    with pytest.raises(Exception):
        t.commit(4, {"predictions": df, "alerts": broken(df)})  # predictions are written, alerts are not
    assert os.path.isdir(tmp_path / "predictions" / "batch_id=4")
    assert t.newest() == 3 and rd.read_predictions(spark, str(tmp_path)).count() == 10
    assert t.commit(4, {"predictions": df, "alerts": df.limit(2)})  # the retry
    assert t.newest() == 4 and rd.read_predictions(spark, str(tmp_path)).count() == 30
    assert rd.read_predictions(spark, str(tmp_path), "alerts").count() == 2 and t.read("predictions", 3).count() == 10


def test_a_manifest_cut_short_does_not_count(spark, tmp_path):
    t, df = BatchTables(spark, str(tmp_path)), scored(spark, 5)
    t.commit(0, {"predictions": df})
    (tmp_path / "_commits" / f"{1:020d}.json").write_text('{"batch_id": 1, "tables": {"predictions"')
    assert t.batches() == [0, 1] and t.newest() == 0
    assert t.commit(1, {"predictions": df.limit(2)}) and t.newest() == 1 and t.read("predictions").count() == 2


def test_a_replay_changes_nothing(spark, tmp_path):
    t, df = BatchTables(spark, str(tmp_path)), scored(spark, 20)
    assert live.commit_scored(t, df.limit(12), 0) and live.commit_scored(t, df.filter("seq >= 12"), 1)
    before = t.read("running").collect()
    assert not live.commit_scored(t, df.filter("seq >= 12"), 1)
    assert t.read("running").collect() == before and before[0].total_aircraft == 20


def test_retention_drops_old_batches_and_leftovers(spark, tmp_path):
    t, df = BatchTables(spark, str(tmp_path)), scored(spark, 5)
    for k in range(4):
        t.commit(k, {"predictions": df.limit(k + 1)})
    os.makedirs(tmp_path / "alerts" / "batch_id=1" / "attempt=lost")
    assert t.expire(2) == [0, 1] and t.batches() == [2, 3]
    assert sorted(x for x in os.listdir(tmp_path / "predictions") if x.startswith("batch")) == ["batch_id=2", "batch_id=3"]
    assert os.listdir(tmp_path / "alerts") == [] and t.read("predictions", 1) is None and t.read("predictions").count() == 4


@pytest.mark.parametrize("seed", [1, 2])
def test_running_tables_equal_the_batch_after_any_split(spark, tmp_path, seed):
    df = scored(spark, 200, seed).cache()
    cuts = [0, *sorted(random.Random(seed).sample(range(1, 200), 3)), 200, 200]  # the last batch is empty
    t = BatchTables(spark, str(tmp_path))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        live.commit_scored(t, df.filter((F.col("seq") >= a) & (F.col("seq") < b)), k, top=7)
    got, want = live.running_summary(t.read("running")).first(), mt.prediction_summary(df).first()
    assert got.asDict() == pytest.approx(want.asDict())
    best = mt.top_predictions(df.select("seq", "icao24", "attack_probability", "predicted_anomaly"), n=7, tie=("icao24", "seq"))
    assert t.read("running_top").orderBy("seq").collect() == best.orderBy("seq").collect()
    assert t.read("predictions").count() == 0 and t.read("alerts", 0).count() == df.filter(f"seq < {cuts[1]} and attack_probability > 0.6").count()
