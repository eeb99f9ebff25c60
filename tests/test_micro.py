"""Hand-worked micro-fixtures (expected values computed by hand)."""

import math

import pytest
from pyspark.sql import functions as F

from spoofscope.functions.coerce import bool_flag, coerce_numeric
from spoofscope.functions.timefmt import iso_epoch
from spoofscope.operators import gps as gp
from spoofscope.operators import metrics as mt
from spoofscope.operators import tracking as trk
from spoofscope.operators import trajectory as tr


def _tracking(spark, n, prn=5.0):
    rows = [("f.bin", "t.csv", "clear_sky", prn, float(10 + k), 100.0 + (k % 7), 50.0 + (k % 3),
             200.0, 190.0, 300.0 + k % 11) for k in range(n)]
    return spark.createDataFrame(rows, "source_file string, tracking_file string, label string, PRN double, "
                                       "PRN_start_sample_count double, Prompt_I double, Prompt_Q double, "
                                       "abs_E double, abs_L double, abs_P double")


@pytest.mark.parametrize("n,ids", [(299, []), (300, [0]), (549, [0]), (550, [0, 1]),
                                   (1000, [0, 1, 2]), (1050, [0, 1, 2, 3])])
def test_window_bounds(spark, n, ids):
    f = trk.signal_features(_tracking(spark, n))
    got = sorted(r["window_id"] for r in f.select("window_id").collect())
    assert got == ids
    for r in f.collect():
        assert r["window_end_row"] == min(r["window_start_row"] + 500, n)


def test_window_bounds_range_path(spark):
    f = trk.signal_features(_tracking(spark, 1050), chunk_samples=100)
    assert sorted(r["window_id"] for r in f.collect()) == [0, 1, 2, 3]


def test_quantiles_and_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    r = df.agg(F.percentile("x", F.lit(0.95)).alias("p95"), F.median("x").alias("m"),
               F.stddev_samp("x").alias("s")).first()
    assert r["p95"] == pytest.approx(8.95) and r["m"] == 2.5 and r["s"] == pytest.approx(4.0824829)
    one = spark.createDataFrame([(1.0,)], "x double").agg(F.stddev_samp("x")).first()[0]
    assert one is None


@pytest.mark.parametrize("iq,expected_null", [([(3.0, 4.0)] * 6, True),
                                              ([(0.0, 0.0)] * 4 + [(5 ** 0.5, 0.0)], True),
                                              ([(1.0, 2.0)] * 4, True)])
def test_cn0_missing_branches(spark, iq, expected_null):
    df = spark.createDataFrame(iq, "i double, q double")
    p = F.col("i") * F.col("i") + F.col("q") * F.col("q")
    v = df.agg(trk.cn0_estimate(p).alias("c")).first()["c"]
    assert (v is None) == expected_null


def _states(spark, rows):
    return spark.createDataFrame(rows, "seq long, icao24 string, time long, lat double, lon double, "
                                       "velocity double, heading double, baroaltitude double, "
                                       "geoaltitude double, lastposupdate double, lastcontact double")


def test_rate_dt_zero_and_first_row(spark):
    s = _states(spark, [(1, "a", 100, 50.0, 10.0, 200.0, 90.0, 1000.0, 1010.0, 99.0, 100.0),
                        (2, "a", 100, 50.1, 10.1, 210.0, 95.0, 1000.0, 1010.0, 99.0, 100.0),
                        (3, "b", 100, 50.0, 10.0, 200.0, 90.0, 1000.0, 1010.0, 99.0, 100.0)])
    f = {r["seq"]: r for r in tr.trajectory_features(tr.prepare_states(s)).collect()}
    assert f[2]["velocity_change_rate"] == 0.0 and f[2]["delta_velocity"] == 10.0
    assert all(f[k][c] == 0.0 for k in (1, 3) for c in tr.DERIVED_FEATURES if c.startswith("delta"))


def test_null_key_gets_no_deltas(spark):
    s = _states(spark, [(1, None, 100, 50.0, 10.0, 200.0, 90.0, 1.0, 1.0, 99.0, 100.0),
                        (2, None, 160, 51.0, 11.0, 250.0, 99.0, 2.0, 2.0, 159.0, 160.0)])
    f = tr.trajectory_features(tr.prepare_states(s)).collect()
    assert all(r["delta_lat"] == 0.0 and r["delta_time"] == 0.0 for r in f)


def test_boolean_text(spark):
    df = spark.createDataFrame([(x,) for x in ["True", "FALSE", "1", "0", "nan", "1.0", "x"]], "v string")
    got = [r[0] for r in df.select(bool_flag(F.col("v"))).collect()]
    assert got == [1, 0, 1, 0, 0, 0, 0]
    got2 = [r[0] for r in df.select(bool_flag(F.col("v"), accept_numeric_text=True)).collect()]
    assert got2 == [1, 0, 1, 0, 0, 1, 0]


def test_numeric_text(spark):
    df = spark.createDataFrame([(x,) for x in [" 1.5 ", "1d", "0x1p3", "inf", "nan", "-2e3", ".5", "abc"]],
                               "v string")
    got = [r[0] for r in df.select(coerce_numeric(F.col("v"))).collect()]
    assert got == [1.5, None, None, None, None, -2000.0, 0.5, None]


def test_colour_index(spark):
    df = spark.createDataFrame([("0c20b6",), ("abc",), (None,), ("  ",)], "k string")
    got = [r[0] for r in df.select(tr.aircraft_color(F.col("k"))).collect()]
    assert got == [tr.PALETTE[13], tr.PALETTE[2], "gray", "gray"]


def test_iso_time(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T02:00:00+02:00",), ("junk",),
                                (None,), ("1704067200.9",)], "t string")
    got = [r[0] for r in df.select(iso_epoch(F.col("t"))).collect()]
    assert got == [1704067200, 1704067200, 0, 0, 1704067200]


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)],
                               "spoof_probability double, y_true int")
    assert mt.roc_auc(df).first()[0] == pytest.approx(0.75)
    neg = df.withColumn("spoof_probability", -F.col("spoof_probability"))
    assert mt.roc_auc(neg).first()[0] == pytest.approx(0.25)


def test_single_class_auc(spark):
    df = spark.createDataFrame([(0.1, 1), (0.4, 1)], "spoof_probability double, y_true int")
    assert mt.roc_auc(df).first()[0] is None


def test_downsample_19_8(spark):
    rows = [("d", 0, k, 1.0, 1.0) for k in range(19)]
    df = spark.createDataFrame(rows, "device_id string, is_spoofed int, seq long, lat double, lon double") \
        .withColumn("timestamp", F.timestamp_seconds(F.col("seq")))
    got = sorted(r["rn"] for r in gp.even_downsample(df).collect())
    assert got == [0, 2, 5, 7, 10, 12, 15, 18]


def test_histogram_right_edge(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    r = df.agg(F.min("x").alias("mn"), F.max("x").alias("mx")).first()
    w = (r["mx"] - r["mn"]) / 5
    b = F.least(F.floor((F.col("x") - r["mn"]) / w), F.lit(4))
    counts = {x["b"]: x["n"] for x in df.groupBy(b.alias("b")).agg(F.count("*").alias("n")).collect()}
    assert [counts.get(i, 0) for i in range(5)] == [2, 2, 0, 0, 1]


def test_group_key_null(spark):
    df = spark.createDataFrame([("x", None), ("x", "")], "a string, b string")
    got = sorted(r[0] for r in df.select(mt.group_key(["a", "b"])).collect())
    assert got == ["x__", "x__nan"]


def test_segments(spark):
    rows = [("d", k + 1, s) for k, s in enumerate([0, 0, 1, 1, 0])]
    path = spark.createDataFrame(rows, "device_id string, path_index long, is_spoofed int")
    got = [r["segment"] for r in gp.track_segments(path).orderBy("from_index").collect()]
    assert got == ["normal", "transition", "spoofed", "spoofed"]


def test_short_state_row(spark):
    doc = spark.createDataFrame([('{"time": 5, "states": [["b"]]}',), ('{"time": 6, "states": []}',)],
                                "value string")
    rows = tr.snapshot_rows(doc).collect()
    assert len(rows) == 1 and rows[0]["icao24"] == "b"
    assert all(rows[0][f] is None for f in tr.STATE_FIELDS[1:]) and rows[0]["api_time"] == 5


@pytest.mark.parametrize("cells,expected", [
    ((1881, 701, 372, 1313), (0.748535270681978, 0.6519364448857994, 0.7792284866468843, 0.7099216004325494)),
    ((236, 43, 6, 711), (0.9508032128514057, 0.9429708222811671, 0.9916317991631799, 0.9666893269884432)),
])
def test_published_matrices(spark, cells, expected):
    df = spark.createDataFrame([cells], "tn long, fp long, fn long, tp long")
    r = mt.metrics_from_cells(df).first()
    for got, want in zip((r["accuracy"], r["precision"], r["recall"], r["f1"]), expected):
        assert math.isclose(got, want, rel_tol=0, abs_tol=1e-15)


def test_confusion_always_2x2(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "y_true int, y_pred int")
    cm = {(r[0], r[1]): r[2] for r in mt.confusion_matrix(df).collect()}
    assert cm == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 2}


@pytest.mark.parametrize("chunk", [trk.CHUNK_SAMPLES, 200])
def test_block_path_equals_explode_path(spark, chunk):
    from spoofscope.sources import adapters as ad
    rows = trk.clean_tracking(ad.tracking_raw(spark, "/root/testdata/sf0.001"))
    idx = trk.numbered(rows, trk.GROUP_KEYS, ad.TRACKING_ORDER, chunk)
    a = trk.block_features(idx)                                                     # block merge
    b = trk.window_features(trk.tracking_windows(rows, order=ad.TRACKING_ORDER, chunk_samples=chunk))  # explode
    key = ["source_file", "tracking_file", "prn", "window_id"]
    pa, pb = a.toPandas().sort_values(key).reset_index(drop=True), b.toPandas().sort_values(key).reset_index(drop=True)
    assert len(pa) == len(pb) > 0
    for c in pa.columns:
        if pa[c].dtype.kind == "f":
            close = (pa[c] - pb[c]).abs() <= 1e-9 * (1 + pb[c].abs())
            assert (close | (pa[c].isna() & pb[c].isna())).all(), c
        else:
            assert (pa[c] == pb[c]).all(), c


def test_history_cap_keeps_the_newest(spark):
    df = spark.range(20000).select((F.col("id") * 7919 % 20011).alias("seq"))
    want = sorted((r.seq for r in df.collect()), reverse=True)[:5000]
    assert sorted((r.seq for r in tr.history_cap(df, 5000).collect()), reverse=True) == want


def test_gps_label_from_file_name_and_aliases(spark):
    raw = spark.createDataFrame(
        [(1, "Normal-Data-1.csv", "2024-01-01 00:00:00", "50.1", "14.2"),
         (2, "Attack-2.csv", "2024-01-01 00:00:01", "50.2", "14.3"),
         (3, "Attack-2.csv", "bad", "50.3", None)],
        "seq long, source_file string, `Date Time` string, `GPS Lat` string, `Longitude` string")
    t = {r["seq"]: r for r in gp.normalize_gps(raw).collect()}
    assert set(t) == {1, 2}                          # missing position dropped
    assert t[1]["is_spoofed"] == 0 and t[2]["is_spoofed"] == 1
    assert t[1]["device_id"] == "Normal-Data-1"
    assert gp.resolve_columns(["GPS-Lat", "Lng ", "Speed (m/s)"])["speed"] is None
    assert gp.resolve_columns(["GPS-Lat", "Lng "])["lat"] == "GPS-Lat"
