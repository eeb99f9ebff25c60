"""Sources and sinks: iq16 reader, CSV readers, parquet/JSON round trips,
model persistence."""

import json
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoofscope.operators import iq
from spoofscope.sources import iq16, readers


def test_iq16_reader(spark):
    d = tempfile.mkdtemp(prefix="iq-")
    rng = np.random.default_rng(1)
    raw = rng.integers(-32768, 32767, size=2 * 5000 + 1, dtype=np.int16)  # odd trailing item
    raw.astype("<i2").tofile(os.path.join(d, "rec.bin"))
    iq16.register(spark)
    df = (spark.read.format("iq16").option("samples_per_partition", 1200)
          .load(os.path.join(d, "*.bin")))
    assert df.rdd.getNumPartitions() == 5
    rows = df.orderBy("idx").collect()
    assert len(rows) == 5000
    assert [r["i"] for r in rows[:5]] == raw[0:10:2].tolist()
    got_q = np.array([r["q"] for r in rows])
    assert np.array_equal(got_q, raw[1:10000:2])
    pref = (spark.read.format("iq16").option("max_samples", 100).load(os.path.join(d, "*.bin")))
    assert pref.count() == 100


def test_iq_stats_match_numpy(spark):
    rng = np.random.default_rng(2)
    i = rng.integers(-2000, 2000, 4096).astype(np.int16)
    q = rng.integers(-2000, 2000, 4096).astype(np.int16)
    df = spark.createDataFrame([("r", k, int(a), int(b)) for k, (a, b) in enumerate(zip(i, q))],
                               "source string, idx long, i smallint, q smallint")
    s = iq.iq_stats(df).first()
    x = i.astype(np.float64) + 1j * q.astype(np.float64)
    assert s["i_std"] == pytest.approx(np.std(x.real)) and s["power_max"] == pytest.approx(np.max(np.abs(x) ** 2))
    assert s["amplitude_std"] == pytest.approx(np.std(np.abs(x)))


def test_welch_matches_numpy_and_parseval(spark):
    rng = np.random.default_rng(3)
    n, seg, hop, fs = 2048, 256, 128, 1000.0
    i = rng.integers(-500, 500, n)
    q = rng.integers(-500, 500, n)
    df = spark.createDataFrame([("r", k, int(a), int(b)) for k, (a, b) in enumerate(zip(i, q))],
                               "source string, idx long, i smallint, q smallint")
    got = iq.welch_psd(df, nperseg=seg, hop=hop, fs=fs).orderBy("freq_index").collect()
    x = i + 1j * q
    w = iq.hann_periodic(seg)
    ps = []
    for s in range(0, n - seg + 1, hop):
        y = x[s:s + seg] - x[s:s + seg].mean()
        ps.append(np.abs(np.fft.fft(y * w)) ** 2 / (fs * np.sum(w ** 2)))
    ref = np.fft.fftshift(np.mean(ps, axis=0))
    assert np.allclose([r["psd_db"] for r in got], 10 * np.log10(ref + 1e-12), atol=1e-9)
    # Parseval per segment: sum of |FFT|^2 / N equals the windowed energy
    y = (x[:seg] - x[:seg].mean()) * w
    assert np.isclose(np.sum(np.abs(np.fft.fft(y)) ** 2) / seg, np.sum(np.abs(y) ** 2))


def test_tracking_csv_reader_keeps_file_names(spark):
    d = tempfile.mkdtemp(prefix="trk-")
    for name, prn in (("tracking_ch_0.csv", 3), ("tracking_ch_1.csv", 4)):
        with open(os.path.join(d, name), "w") as fh:
            fh.write("PRN,PRN_start_sample_count,Prompt_I,Prompt_Q,abs_E,abs_L,abs_P\n")
            for k in range(5):
                fh.write(f"{prn},{10 + k},100,50,200,190,300\n")
            fh.write(f"{prn},bad,100,50,200,190,300\n")
    df = readers.read_tracking_csv(spark, os.path.join(d, "tracking*.csv"))
    assert dict(df.dtypes)["PRN"] == "string"
    assert sorted(r[0] for r in df.select("tracking_file").distinct().collect()) == \
        ["tracking_ch_0.csv", "tracking_ch_1.csv"]
    from spoofscope.operators.tracking import clean_tracking
    assert clean_tracking(df).count() == 10  # the 'bad' rows are dropped
    empty = readers.read_tracking_csv(spark, os.path.join(d, "missing", "tracking*.csv"))
    assert empty.count() == 0


def test_sinks_round_trip(spark):
    from spoofscope.operators import metrics as mt
    d = tempfile.mkdtemp(prefix="sink-")
    df = spark.createDataFrame([(0, 0.1, "a"), (1, 0.8, "b"), (1, 0.3, "a")],
                               "y_true int, spoof_probability double, label string")
    sweep = mt.threshold_sweep(df)
    sweep.write.mode("overwrite").parquet(os.path.join(d, "sweep"))
    sweep.coalesce(1).write.mode("overwrite").option("header", True).csv(os.path.join(d, "sweep_csv"))
    df.write.mode("overwrite").partitionBy("label").parquet(os.path.join(d, "scores"))
    assert spark.read.parquet(os.path.join(d, "sweep")).count() == 5
    back = spark.read.parquet(os.path.join(d, "scores"))
    assert sorted(back.select("label").distinct().toPandas()["label"]) == ["a", "b"]
    summary = mt.prediction_summary(df.withColumnRenamed("spoof_probability", "attack_probability")
                                      .withColumn("predicted_anomaly", F.col("y_true")))
    summary.coalesce(1).write.mode("overwrite").json(os.path.join(d, "summary"))
    rec = spark.read.json(os.path.join(d, "summary")).first()
    assert rec["total_aircraft"] == 3 and rec["predicted_anomalies"] == 2


def test_empty_prediction_summary(spark):
    from spoofscope.operators import metrics as mt
    empty = spark.createDataFrame([], "icao24 string")
    r = mt.prediction_summary(empty).first()
    assert (r["total_aircraft"], r["predicted_anomalies"], r["anomaly_rate"],
            r["average_attack_probability"], r["max_attack_probability"]) == (0, 0, 0.0, 0.0, 0.0)


def test_model_save_load(spark):
    from pyspark.ml import PipelineModel
    from spoofscope.operators import ml
    rng = np.random.default_rng(4)
    rows = [(int(k % 6), int(y), float(a), float(b), None if k % 7 == 0 else float(a * b))
            for k, (y, a, b) in enumerate(zip(rng.integers(0, 2, 300), rng.normal(size=300), rng.normal(size=300)))]
    df = spark.createDataFrame(rows, "group_id int, y int, f1 double, f2 double, f3 double")
    df = ml.class_balanced_weights(df)
    feats = ml.usable_features(df, ["f1", "f2", "f3", "absent"])
    assert feats == ["f1", "f2", "f3"]
    model = ml.forest_pipeline(feats, impute=True, n_trees=10, max_depth=4).fit(df)
    path = os.path.join(tempfile.mkdtemp(prefix="model-"), "forest")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    a = ml.score(model, df).select("spoof_probability").collect()
    b = ml.score(again, df).select("spoof_probability").collect()
    assert a == b
    imp = ml.feature_importance(again, feats, spark)
    assert imp.count() == 3 and abs(sum(r[1] for r in imp.collect()) - 1.0) < 1e-9


def test_group_split_keeps_groups_whole(spark):
    from spoofscope.operators import ml
    df = spark.createDataFrame([(k % 17, k) for k in range(500)], "g int, v int")
    s = ml.group_split(df, "g")
    assert s.groupBy("g").agg(F.countDistinct("is_test").alias("n")).filter("n > 1").count() == 0
    assert s.select("g").filter("is_test").distinct().count() == 4  # ceil(0.2 * 17)


def test_folds_whole_groups(spark):
    from spoofscope.operators import ml
    df = spark.createDataFrame([(k % 13, int(k % 13 < 6)) for k in range(400)], "g int, y int")
    f = ml.stratified_group_folds(df, "g", "y")
    assert f.select("g").distinct().count() == 13 and f.count() == 13
    assert sorted(r[0] for r in f.select("fold").distinct().collect()) == [1, 2, 3, 4]


def test_result_reads(spark):
    d = tempfile.mkdtemp(prefix="res-")
    with open(os.path.join(d, "model_summary.json"), "w") as fh:
        json.dump({"model": "signal", "threshold": 0.5, "accuracy": 0.95, "test_rows": 996}, fh, indent=2)
    with open(os.path.join(d, "cm.csv"), "w") as fh:
        fh.write("236,43\n6,711\n")
    s = readers.read_model_summary(spark, os.path.join(d, "model_summary.json")).first()
    assert s["model"] == "signal" and s["test_rows"] == 996
    cm = {(r[0], r[1]): r[2] for r in readers.read_confusion_csv(spark, os.path.join(d, "cm.csv")).collect()}
    assert cm == {(0, 0): 236, (0, 1): 43, (1, 0): 6, (1, 1): 711}
    assert readers.read_model_summary(spark, os.path.join(d, "absent.json")) is None


def test_fit_all_and_availability(spark):
    from pyspark.ml import PipelineModel
    from spoofscope.operators import ml
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(int(y), float(a)) for y, a in zip(rng.integers(0, 2, 100), rng.normal(size=100))],
                               "y int, f1 double")
    avail, missing = ml.feature_availability(df, ["f1", "f2"])
    assert (avail, missing) == (["f1"], ["f2"])
    path = os.path.join(tempfile.mkdtemp(prefix="fit-"), "m")
    ml.fit_all(df, avail, path=path, n_trees=5, max_depth=3)
    assert PipelineModel.load(path).stages[0].getInputCols() == ["f1"]


def test_bbox_filter_and_pruning_reach_the_scan(spark):
    """On stored state rows the area predicate is pushed to the parquet scan
    and only the needed columns are read."""
    from spoofscope.operators import trajectory as tr
    d = tempfile.mkdtemp(prefix="states-")
    rows = [(f"a{k % 7}", 1_700_000_000 + k, 45.0 + (k % 100) / 10, 10.0 + (k % 50) / 10, float(k), "x")
            for k in range(2000)]
    spark.createDataFrame(rows, "icao24 string, time long, lat double, lon double, velocity double, callsign string") \
         .write.mode("overwrite").parquet(d)
    q = tr.bbox_filter(spark.read.parquet(d), 49.0, 14.0, 55.0, 24.0).select("icao24", "lat")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(lat" in plan
    assert "ReadSchema: struct<icao24:string,lat:double,lon:double>" in plan
    assert q.count() == spark.read.parquet(d).filter("lat between 49 and 55 and lon between 14 and 24").count()
