"""Structured Streaming: landed poll documents -> stateful per-aircraft
deltas, compared with the batch operator on the same rows."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from spoofscope.operators import trajectory as tr
from spoofscope.plans.trajectory import snapshot_documents
from spoofscope.sources import adapters as ad
from spoofscope.streaming import live

SF = "/root/testdata/sf0.001"


def _land(spark, base):
    """One JSON document per poll, written oldest first (file mtime order)."""
    raw = ad.adsb_raw(spark, SF)
    docs = (raw.groupBy("snap").agg(F.max("time").alias("t"))
               .join(snapshot_documents(raw).withColumn("t", F.get_json_object("value", "$.time").cast("long")), "t")
               .orderBy("t").select("t", "value").collect())
    for k, row in enumerate(docs):
        with open(os.path.join(base, f"poll_{k:05d}.json"), "w") as fh:
            fh.write(row["value"])
        os.utime(os.path.join(base, f"poll_{k:05d}.json"), (1_700_000_000 + k, 1_700_000_000 + k))
    return len(docs)


def _batch_features(spark, base):
    """The batch twin over the same documents."""
    rows = tr.snapshot_rows(spark.read.text(base, wholetext=True))
    states = tr.prepare_states(tr.normalize_states(rows.withColumn("_seq", F.col("api_time") * 1_000_000 + F.col("state_index"))))
    return tr.trajectory_features(states)


def _forest(features):
    from spoofscope.operators import ml
    labelled = ml.class_balanced_weights(features.withColumn("y", (F.col("seq") % 2).cast("int")))
    return ml.forest_pipeline(tr.MODEL_FEATURES, "y", n_trees=5, max_depth=5).fit(labelled)


def _rows(df, cols):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()), key=repr)


def test_live_features_equal_the_batch_column_by_column(spark):
    """One poll per micro-batch: every aircraft has one row a batch, so all
    deltas come from state."""
    base = tempfile.mkdtemp(prefix="polls-")
    assert _land(spark, base) > 3
    out, ckpt = tempfile.mkdtemp(prefix="stream-out-"), tempfile.mkdtemp(prefix="stream-ckpt-")
    feats = live.live_features(live.snapshot_stream(spark, base, max_files_per_trigger=1), watermark="2000 days")
    q = (feats.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(600)
    got, want = spark.read.parquet(out), _batch_features(spark, base)
    assert got.filter("late = 1").count() == 0
    assert want.filter("icao24 is null").count() > 0 and want.filter("delta_velocity <> 0").count() > 0
    cols = [c for c in want.columns if c in got.columns]
    assert set(tr.MODEL_FEATURES) <= set(cols) and set(want.columns) == set(cols)
    assert _rows(got, cols) == _rows(want, cols)


def test_live_scores_alerts_and_summary_of_the_newest_poll(spark):
    base = tempfile.mkdtemp(prefix="polls-")
    n = _land(spark, base)
    want = _batch_features(spark, base)
    model = _forest(want)
    out, ckpt = tempfile.mkdtemp(prefix="live-out-"), tempfile.mkdtemp(prefix="live-ckpt-")
    feats = live.live_features(live.snapshot_stream(spark, base, max_files_per_trigger=2), watermark="2000 days")
    q = (feats.writeStream.foreachBatch(live.live_batch_writer(out, model, high_risk=0.5)).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination(600)
    preds = spark.read.parquet(os.path.join(out, "predictions"))
    # a batch of two polls scores the later one alone
    times = sorted({r.snapshot_time for r in want.select("snapshot_time").distinct().collect()})
    assert len(times) == n
    assert {r.snapshot_time for r in preds.select("snapshot_time").distinct().collect()} == set(times[1::2]) | {times[-1]}
    scored = live.score_newest(want, model)
    last = preds.filter(F.col("snapshot_time") == times[-1])
    cols = ["seq", *tr.MODEL_FEATURES, "attack_probability", "predicted_anomaly"]
    assert _rows(last, cols) == _rows(scored, cols) and last.count() > 0
    alerts, summary = (spark.read.parquet(os.path.join(out, k)) for k in ("alerts", "summary"))
    assert _rows(alerts, ["seq", "attack_probability"]) == _rows(preds.filter("attack_probability > 0.5"), ["seq", "attack_probability"])
    assert summary.agg(F.sum("total_aircraft")).first()[0] == preds.count()
    assert summary.agg(F.sum("predicted_anomalies")).first()[0] == preds.filter("predicted_anomaly = 1").count()


def _reports(spark, base, k, rows):
    """Land one poll of plain reports (icao24, time, velocity)."""
    states = [[i, "CS", "X", t, t, 10.0, 50.0, 1000.0, False, v, 90.0, 0.0, None, 1000.0, "1000", False, 0] for i, t, v in rows]
    path = os.path.join(base, f"poll_{k:05d}.json")
    with open(path, "w") as fh:
        json.dump({"time": max(t for _, t, _ in rows), "states": states}, fh)
    os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))


def _deltas(spark, base, out, ckpt, make=None, watermark="2 minutes"):
    make = make or (lambda s: live.stateful_deltas(s, watermark))
    q = (make(live.snapshot_stream(spark, base)).writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(600)
    return spark.read.parquet(out)


def test_a_restart_goes_on_from_state_and_late_reports_are_marked(spark):
    base, out, ckpt = (tempfile.mkdtemp(prefix="live-") for _ in range(3))
    _reports(spark, base, 0, [("aa", 1000, 100.0), ("bb", 1000, 50.0)])
    _reports(spark, base, 1, [("aa", 1010, 110.0)])
    _deltas(spark, base, out, ckpt)
    _reports(spark, base, 2, [("aa", 1030, 125.0), ("bb", 1030, 40.0)])
    _reports(spark, base, 3, [("bb", 1040, None)])
    _reports(spark, base, 4, [("aa", 1020, 1.0)])  # a poll that arrives late
    got = _deltas(spark, base, out, ckpt)
    assert {(r.icao24, r.time): (r.late, r.delta_velocity, r.delta_time) for r in got.collect()} == {
        ("aa", 1000): (0, None, None), ("bb", 1000): (0, None, None), ("aa", 1010): (0, 10.0, 10.0), ("aa", 1030): (0, 15.0, 20.0),
        ("bb", 1030): (0, -10.0, 30.0), ("aa", 1020): (1, None, None), ("bb", 1040): (0, None, 10.0)}
    types = dict(got.dtypes)
    assert types["time"] == "bigint" and types["delta_time"] == "double" and types["late"] == "int"


def test_a_vanished_aircraft_leaves_no_state_after_the_stated_time(spark):
    for make, state in ((lambda s: live.stateful_deltas(s, "2 minutes"), "last"), (lambda s: live.stateful_tails(s, watermark="2 minutes"), "tail")):
        base, out, ckpt = (tempfile.mkdtemp(prefix="live-") for _ in range(3))
        _reports(spark, base, 0, [("aa", 1000, 1.0), ("bb", 1000, 1.0)])
        _reports(spark, base, 1, [("aa", 1010, 1.0)])
        _reports(spark, base, 2, [("bb", 1100, 1.0)])
        _deltas(spark, base, out, ckpt, make)

        def held(var):
            df = spark.read.format("statestore").option("stateVarName", var).load(ckpt)
            return {r[0] for r in df.select(F.col("key").getItem(0) if "array" in dict(df.dtypes)["key"] else "key.*").collect()}
        assert held(state) == {"aa", "bb"}
        _reports(spark, base, 3, [("bb", 1131, 1.0)])  # 2 minutes and a second after aa's last
        _deltas(spark, base, out, ckpt, make)
        assert held(state) == {"bb"} and held("due") == {"bb"}


def test_dedup_drops_re_sent_reports(spark):
    base = tempfile.mkdtemp(prefix="polls-")
    _land(spark, base)
    out, ckpt = tempfile.mkdtemp(prefix="dedup-out-"), tempfile.mkdtemp(prefix="dedup-ckpt-")
    states = live.dedup_stream(live.snapshot_stream(spark, base, max_files_per_trigger=4))
    q = (states.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination(600)
    got = spark.read.parquet(out)
    assert got.count() > 0 and got.groupBy(*live.DEDUP_KEYS).count().filter("count > 1").count() == 0


def test_stateful_tails_match_batch(spark):
    base = tempfile.mkdtemp(prefix="polls-")
    _land(spark, base)
    out = tempfile.mkdtemp(prefix="tails-out-")
    ckpt = tempfile.mkdtemp(prefix="tails-ckpt-")
    q = (live.stateful_tails(live.snapshot_stream(spark, base, max_files_per_trigger=3)).writeStream
         .format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(600)
    got = spark.read.parquet(out)
    # tails only grow to 30 points and the newest point only moves forward,
    # so the final tail of an aircraft has the largest size and last point
    final = got.groupBy("icao24").agg(F.max("n_points").alias("n"),
                                      F.max(F.when(F.col("is_last"), F.col("seq"))).alias("last_seq"))
    docs = spark.read.text(base, wholetext=True)
    rows = tr.snapshot_rows(docs).withColumn("_seq", F.col("api_time") * 1_000_000 + F.col("state_index"))
    b = tr.prepare_states(tr.normalize_states(rows))
    batch = tr.trajectory_tail(b)
    n_stream = {r[0]: (r[1], r[2]) for r in final.collect()}
    n_batch = {r[0]: (r[1], r[2]) for r in batch.groupBy("icao24").agg(
        F.max("n_points"), F.max(F.when(F.col("is_last"), F.col("seq")))).collect()}
    assert n_stream == n_batch and len(n_batch) > 0
