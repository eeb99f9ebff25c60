"""Tracking windows as a stream: the same rows and features as the batch operators."""

import os
import random
import tempfile

from pyspark.sql import functions as F

from spoofscope.operators import tracking as trk
from spoofscope.streaming import channels

KEYS = ["source_file", "tracking_file", "prn"]
SIZE, STEP = 20, 10
COLUMNS = ("source_file string, tracking_file string, label string, PRN double, PRN_start_sample_count double, Prompt_I double, Prompt_Q double, "
           "abs_E double, abs_L double, abs_P double, CN0_SNV_dB_Hz double, carrier_doppler_hz double, event_time timestamp_ltz")


def tracking(spark, seed=1):
    r = random.Random(seed)
    rows = []
    for file, prn, n in (("a", 3.0, 95), ("a", 4.0, 20), ("b", 3.0, 7), ("c", 9.0, 61)):
        for i in range(n):
            p, e = [r.uniform(50, 900) for _ in range(2)], [r.uniform(10, 500) for _ in range(3)]
            rows.append(("f" + file, "t" + file, "clear_sky" if file == "a" else "x", prn, 10.0 + i, *p, *e, r.choice([None, 40.0 + r.random()]), r.gauss(0, 900), None))
    df = spark.createDataFrame(rows, COLUMNS).withColumn("event_time", F.timestamp_seconds(1_700_000_000 + F.col("PRN_start_sample_count").cast("long")))
    return trk.clean_tracking(df)


def stream_out(spark, batches, ckpt=None, out=None, base=None, first=0, **kw):
    """The windows of ``batches`` (lists of DataFrames), one micro-batch each."""
    base, out, ckpt = (x or tempfile.mkdtemp(prefix="chan-") for x in (base, out, ckpt))
    for k, b in enumerate(batches, first):
        path = os.path.join(base, f"b{k:04d}")
        b.coalesce(1).write.parquet(path)
        for f in os.listdir(path):
            os.utime(os.path.join(path, f), (1_700_000_000 + k, 1_700_000_000 + k))
    rows = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(base)
    q = (channels.window_stream(rows, SIZE, STEP, **kw).writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(600)
    return spark.read.parquet(out), q


def cut(df, seed):
    """Rows by sample count, cut into batches at random, each shuffled."""
    r = random.Random(seed)
    places = sorted(r.sample(range(11, 104), 5))
    count = F.col("PRN_start_sample_count")
    return [df.filter((count >= a) & (count < b)).orderBy(F.rand(seed)) for a, b in zip([0, *places], [*places, 1000])]


def ended(df):
    """A row of another channel, far later, so that all others are over."""
    return df.limit(1).withColumns({"source_file": F.lit("end"), "event_time": F.timestamp_seconds(F.lit(1_800_000_000))})


def rows_of(df, cols):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()), key=repr)


def test_windows_and_features_of_any_cut_equal_the_batch(spark):
    df = tracking(spark).cache()
    want = trk.tracking_windows(df, SIZE, STEP)
    cols = [c for c in want.columns if c != "group_rows"]
    got, q = stream_out(spark, [*cut(df, 7), ended(df)])
    others = got.filter("source_file <> 'end'")
    assert got.filter("late").count() == 0
    assert rows_of(others, cols) == rows_of(want, cols)
    # every window in one micro-batch: the batch operator reduces what a sink gets
    features = trk.window_features(others, min_rows=5, min_group_rows=5, step=STEP)
    assert rows_of(features, features.columns) == rows_of(trk.window_features(want, min_rows=5, min_group_rows=5, step=STEP), features.columns)
    held = q.recentProgress[-1]["stateOperators"][0]["customMetrics"]
    assert held  # RocksDB reports its own


def test_each_window_comes_whole_and_once(spark):
    df = tracking(spark, 2).cache()
    got, _ = stream_out(spark, [*cut(df, 3), ended(df)])
    per = got.withColumn("file", F.input_file_name()).groupBy(*KEYS, "window_id").agg(F.countDistinct("file").alias("files"), F.count("*").alias("n"), F.countDistinct("rn").alias("d"))
    assert per.filter("files > 1 or n <> d").count() == 0


def test_restart_goes_on_from_the_checkpoint_and_late_rows_come_out_marked(spark):
    df = tracking(spark, 3).filter("source_file = 'fa' and prn = 3").cache()
    count = F.col("PRN_start_sample_count")
    base, out, ckpt = (tempfile.mkdtemp(prefix="chan-") for _ in range(3))
    stream_out(spark, [df.filter((count < 60) & (count != 15))], ckpt, out, base)
    got, _ = stream_out(spark, [df.filter(count >= 60), df.filter(count == 15), ended(df)], ckpt, out, base, first=1)
    late = got.filter("late").collect()
    assert [(r.PRN_start_sample_count, r.rn, r.window_id) for r in late] == [(15.0, None, None)]
    want = trk.tracking_windows(df.filter(count != 15), SIZE, STEP)
    cols = [c for c in want.columns if c != "group_rows"]
    assert rows_of(got.filter("not late and source_file = 'fa'"), cols) == rows_of(want, cols)


def test_nothing_of_a_silent_channel_stays_in_state(spark):
    df = tracking(spark, 4).cache()
    ckpt = tempfile.mkdtemp(prefix="chan-")
    stream_out(spark, [*cut(df, 5), ended(df)], ckpt)
    left = spark.read.format("statestore").option("stateVarName", "place").load(ckpt).select("key.source_file").collect()
    assert [r.source_file for r in left] == ["end"]
