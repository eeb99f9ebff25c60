"""Faults of earlier versions, each with a test that the old code fails."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from spoofscope.operators import iq
from spoofscope.operators import tracking as trk
from spoofscope.operators import trajectory as tr
from spoofscope.sources import readers


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_each_csv_files_own_header_names_its_columns(spark):
    d = tempfile.mkdtemp(prefix="csv-")
    put(d, "tracking_a.csv", "PRN,abs_E,abs_P\n1,10,100\n")
    put(d, "tracking_b.csv", "abs_P,PRN,abs_E\n200,2,20\n201,2,21\n")
    put(d, "tracking_c.csv", "PRN,abs_P\n3,300\n")
    got = {(r.tracking_file, r.PRN, r.abs_E, r.abs_P) for r in readers.read_tracking_csv(spark, os.path.join(d, "tracking*.csv")).collect()}
    assert got == {("tracking_a.csv", "1", "10", "100"), ("tracking_b.csv", "2", "20", "200"), ("tracking_b.csv", "2", "21", "201"),
                   ("tracking_c.csv", "3", None, "300")}
    picked = readers.read_csv_text(spark, d, ["abs_P", "PRN", "absent"], with_file=False)
    assert picked.columns == ["abs_P", "PRN", "absent"] and {r.absent for r in picked.collect()} == {None}


def test_paths_that_only_spark_reads(spark):
    d = tempfile.mkdtemp(prefix="store-")
    put(d, "cm.csv", "236,43\n6,711\n")
    put(d, "model_summary.json", '{"model": "signal"}')
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.fixes.link./in", f"file://{d}")
    base = "viewfs://fixes/in"
    cm = {(r[0], r[1]): r[2] for r in readers.read_confusion_csv(spark, f"{base}/cm.csv").collect()}
    assert cm == {(0, 0): 236, (0, 1): 43, (1, 0): 6, (1, 1): 711}
    assert readers.read_model_summary(spark, f"{base}/model_summary.json").first()["model"] == "signal"
    assert readers.read_model_summary(spark, f"{base}/absent.json") is None
    assert readers.read_tracking_csv(spark, f"{base}/none*.csv").count() == 0


def test_gps_logs_of_several_files(spark):
    d = tempfile.mkdtemp(prefix="gps-")
    put(d, "dev1_normal.csv", "Date Time,Latitude,Longitude\n2024-01-01 00:00:00,1.0,2.0\n2024-01-01 00:00:01,1.1,2.1\n")
    put(d, "dev2_attack.csv", "lon,lat\n4.0,3.0\n4.1,3.1\n")
    got = readers.read_gps_csv(spark, os.path.join(d, "*.csv")).orderBy("device_id", "timestamp").collect()
    assert [(r.device_id, r.lat, r.is_spoofed) for r in got] == [
        ("dev1_normal", 1.0, 0), ("dev1_normal", 1.1, 0), ("dev2_attack", 3.0, 1), ("dev2_attack", 3.1, 1)]


def test_sinks(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, k string")
    for kind in ("parquet", "csv", "json"):
        path = os.path.join(tempfile.mkdtemp(prefix="sink-"), kind)
        readers.write_table(df, path, kind, partition_by=["k"])
        back = (spark.read.option("header", True).csv(path) if kind == "csv" else spark.read.format(kind).load(path))
        assert sorted((int(r.n), r.k) for r in back.collect()) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        readers.write_table(df, "x", "orc")


def test_sums_of_squares_do_not_overflow(spark):
    big = (1 << 31) - 1
    df = spark.createDataFrame([("s", k, big, big) for k in range(5)], "source string, idx long, i bigint, q bigint")
    r = df.groupBy("source").agg(*iq._exact_moments(F.col("i"), F.col("q"))[:6]).first()
    assert int(r["_sii"]) == 5 * big * big > (1 << 63) and int(r["_sp"]) == 10 * big * big


def test_histogram_and_spectrogram_read_whole_recordings(spark):
    df = spark.range(350_000).select(F.lit("s").alias("source"), F.col("id").alias("idx"), (F.col("id") % 100).cast("smallint").alias("i"),
                                     F.lit(1).cast("smallint").alias("q"))
    assert iq.iq_histogram(df).agg(F.sum("n")).first()[0] == 350_000
    segs = iq.periodograms(df, iq.tukey_periodic(iq.SPEC_NPERSEG), iq.SPEC_NPERSEG - iq.SPEC_OVERLAP, iq.FS)
    assert segs.agg(F.max("seg")).first()[0] == (350_000 - 2048) // 1024


def test_group_gate_counts_rows_once(spark):
    cols = {c: F.lit(5.0) for c in trk.REQUIRED_COLUMNS}
    df = spark.range(500).select(F.lit("f").alias("source_file"), F.lit("t").alias("tracking_file"), F.lit("clear_sky").alias("label"),
                                 *[v.alias(c) for c, v in cols.items() if c != "PRN_start_sample_count"],
                                 (F.col("id") + 10).cast("double").alias("PRN_start_sample_count"))
    for size in (500, 2000):  # copied windows, merged blocks
        got = trk.signal_features(df, size=size, step=250, min_group_rows=600)
        assert got.count() == 0, size
    assert trk.signal_features(df, size=500, step=250, min_group_rows=500).count() > 0


def test_snapshot_utc_and_aircraft_predicate(spark):
    doc = '{"time": 1700000000, "states": [["ABC ", "CS1", "X", 1, 2], ["def"]]}'
    s = tr.normalize_states(tr.snapshot_rows(spark.createDataFrame([(doc,)], "value string")))
    assert {r.snapshot_utc for r in s.collect()} == {"2023-11-14T22:13:20Z"}
    assert [r.icao24 for r in tr.aircraft_filter(s, " abc").collect()] == ["ABC "]
