"""Structured Streaming version of the live pipeline.

Landed poll documents (one JSON file per poll) -> state rows -> keyed
per-aircraft deltas with state (arrival order, late rows flagged) -> features
-> scoring of the newest poll and per-batch sinks.  A micro-batch's tables
become visible by one commit, and a replayed batch changes nothing; progress
lives in the query's checkpoint location on shared storage.
"""

from __future__ import annotations

from typing import Any, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spoofscope.operators import metrics as mt
from spoofscope.operators import trajectory as tr
from spoofscope.session import ship_package
from spoofscope.sources.committed import BatchTables
from spoofscope.streaming.state import timer, use_rocksdb

SNAPSHOT_SCHEMA = "value STRING"
DEDUP_KEYS = ["icao24", "lastposupdate", "lat", "lon"]
STATE_TTL = "10 minutes"
DELTA_STATE_COLS = ["time", "lat", "lon", "velocity", "heading", "baroaltitude", "geoaltitude"]
_LAST_SCHEMA = "time bigint, " + ", ".join(f"{c} double" for c in DELTA_STATE_COLS[1:])


def snapshot_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1) -> DataFrame:
    """X1: one micro-batch per landed poll document (oldest first)."""
    raw = (spark.readStream.schema(SNAPSHOT_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
           .option("latestFirst", "false").text(path, wholetext=True))
    rows = tr.snapshot_rows(raw)
    # arrival order: poll time, then position inside the poll
    seq = F.col("api_time") * F.lit(1_000_000) + F.col("state_index")
    states = tr.prepare_states(tr.normalize_states(rows.withColumn("_seq", seq)))
    return (states.withColumn("event_time", F.timestamp_seconds(F.col("time"))))


def dedup_stream(states: DataFrame, watermark: str = STATE_TTL) -> DataFrame:
    """X2: drop re-sent reports (same aircraft, position time and position)
    within the watermark.  Streaming keeps the *first* copy."""
    return states.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(DEDUP_KEYS)


class _Keyed(StatefulProcessor):
    """A processor with one timer per key: at the key's newest time.  The
    watermark is behind the newest time of all keys by the allowed silence,
    so the timer fires, and the state goes, when a key has been silent for
    that long."""

    def _start(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at bigint")

    def _silent_from(self, seconds: int) -> None:
        before = self.due.get()[0] if self.due.exists() else None
        at = max(seconds * 1000, before or seconds * 1000)
        if at != before:
            timer(self.handle, before, at)
            self.due.update((at,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.due.clear()
        self._forget()
        return iter(())

    def close(self) -> None:
        pass


class Deltas(_Keyed):
    """One aircraft's reports in time order, each with its differences to the
    report before, which may be of an earlier micro-batch.

    A report older than the state's is late: it comes out with ``late = 1``
    and no differences, and does not move the state.  Reports without an id
    have no differences and leave no state.
    """

    def __init__(self, names: list[str]) -> None:
        self.names = names
        self.out = Row(*names, "late", *[f"delta_{c}" for c in DELTA_STATE_COLS])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._start(handle)
        self.last = handle.getValueState("last", _LAST_SCHEMA)

    def _forget(self) -> None:
        self.last.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        named = not key[0].startswith("\0")
        before = self.last.get() if named and self.last.exists() else None
        newest = None
        for r in sorted(rows, key=lambda r: (r["time"], r["seq"])):
            now = (int(r["time"]), *[r[c] for c in DELTA_STATE_COLS[1:]])
            late = before is not None and now[0] < before[0]
            known = named and not late and before is not None
            deltas = [None if not known or a is None or b is None else float(b - a) for a, b in zip(before or now, now)]
            yield self.out(*[r[n] for n in self.names], int(late), *deltas)
            if named and not late:
                before = newest = now
        if newest is not None:
            self.last.update(newest)
            self._silent_from(newest[0])


def stateful_deltas(states: DataFrame, watermark: str = STATE_TTL) -> DataFrame:
    """X3/X9: every report with its per-aircraft deltas across micro-batches
    (those of the batch ``trajectory_features`` when polls arrive in time
    order) and the ``late`` flag.  Reports without an id stay, each a group of
    its own.  Columns keep their types; state is in RocksDB."""
    use_rocksdb(states.sparkSession)
    ship_package(states.sparkSession)
    kept = [f for f in states.schema.fields if f.name != "event_time"]
    names = [f.name for f in kept]
    s = states.withWatermark("event_time", watermark).select(
        F.coalesce("icao24", F.concat(F.lit("\0"), F.col("seq").cast("string"))).alias("_key"), *names, "event_time")
    out = T.StructType([*kept, T.StructField("late", T.IntegerType()), *[T.StructField(f"delta_{c}", T.DoubleType()) for c in DELTA_STATE_COLS]])
    return s.groupBy("_key").transformWithState(Deltas(names), out, "append", "EventTime")


def live_features(states: DataFrame, watermark: str = STATE_TTL) -> DataFrame:
    """X5: the model's features of every report, with the deltas fed from
    keyed state; the stream twin of ``trajectory_features``."""
    return tr.derived_features(stateful_deltas(states, watermark))


TAIL_OUT_SCHEMA = ("icao24 string, point_index int, n_points int, time long, seq long, "
                   "lat double, lon double, is_last boolean")
_POINT = ["time", "seq", "lat", "lon"]


class Tails(_Keyed):
    """The newest positions of one aircraft, a bounded list in state; its
    current tail comes out whenever it has at least two."""

    def __init__(self, points: int) -> None:
        self.points = points

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._start(handle)
        self.tail = handle.getListState("tail", "time bigint, seq bigint, lat double, lon double")

    def _forget(self) -> None:
        self.tail.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = [tuple(r) for r in self.tail.get()] if self.tail.exists() else []
        tail = sorted(held + [tuple(r[c] for c in _POINT) for r in rows], key=lambda p: p[:2])[-self.points:]
        self.tail.put(tail)
        self._silent_from(tail[-1][0])
        out = Row("icao24", "point_index", "n_points", *_POINT, "is_last")
        if len(tail) > 1:
            for i, p in enumerate(tail, 1):
                yield out(key[0], i, len(tail), *p, i == len(tail))


def stateful_tails(states: DataFrame, points: int = tr.TRAJECTORY_POINTS, watermark: str = STATE_TTL) -> DataFrame:
    """X4: per aircraft, the last ``points`` valid and fresh positions kept in
    bounded state; every update emits the aircraft's current tail (the last
    emission per aircraft equals the batch ``trajectory_tail``)."""
    use_rocksdb(states.sparkSession)
    ship_package(states.sparkSession)
    pts = tr.fresh_positions(tr.valid_position(states)).filter(F.col("icao24").isNotNull())
    pts = pts.withWatermark("event_time", watermark).select(
        "icao24", F.col("time").cast("long").alias("time"), F.col("seq").cast("long").alias("seq"),
        "lat", "lon", "event_time")
    return pts.groupBy("icao24").transformWithState(Tails(points), TAIL_OUT_SCHEMA, "append", "EventTime")


def score_newest(features: DataFrame, model=None, threshold: float = tr.ANOMALY_THRESHOLD) -> DataFrame:
    """The newest poll's reports with attack_probability and
    predicted_anomaly beside all their features.  Without a model the
    probability is 0."""
    newest = tr.latest_snapshot(features, "snapshot_time" if "snapshot_time" in features.columns else "time")
    if model is None:
        scored = newest.withColumn("attack_probability", F.lit(0.0))
    else:
        from pyspark.ml.functions import vector_to_array
        own = [c for c in newest.columns if c not in tr.MODEL_FEATURES]
        kept = model.transform(tr.model_input(newest, keep=own))
        scored = kept.withColumn("attack_probability", F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0))).select(*own, *tr.MODEL_FEATURES, "attack_probability")
    return scored.withColumn("predicted_anomaly", F.when(F.col("attack_probability") >= threshold, 1).otherwise(0))


RUNNING_TOP = 20


def summary_partial(scored: DataFrame) -> DataFrame:
    """One row that sums up scored rows, and can be merged with others."""
    p = F.col("attack_probability")
    return scored.agg(F.count(F.lit(1)).alias("total_aircraft"), F.coalesce(F.sum("predicted_anomaly"), F.lit(0)).cast("bigint").alias("predicted_anomalies"),
                      F.count(p).alias("n_probabilities"), F.coalesce(F.sum(p), F.lit(0.0)).alias("probability_sum"), F.max(p).alias("probability_max"))


def merged_summary(partials: DataFrame) -> DataFrame:
    """Any number of ``summary_partial`` rows as one."""
    sums = ("total_aircraft", "predicted_anomalies", "n_probabilities", "probability_sum")
    return partials.agg(*[F.sum(c).alias(c) for c in sums], F.max("probability_max").alias("probability_max"))


def running_summary(partial: DataFrame) -> DataFrame:
    """The columns of ``prediction_summary`` from one merged row."""
    share = lambda c, n: F.coalesce(F.col(c).cast("double") / F.nullif(F.col(n), F.lit(0)), F.lit(0.0))
    return partial.select("total_aircraft", "predicted_anomalies", share("predicted_anomalies", "total_aircraft").alias("anomaly_rate"),
                          share("probability_sum", "n_probabilities").alias("average_attack_probability"),
                          F.coalesce("probability_max", F.lit(0.0)).alias("max_attack_probability"))


def commit_scored(tables: BatchTables, scored: DataFrame, batch_id: int, high_risk: float = tr.HIGH_RISK_THRESHOLD, top: int = RUNNING_TOP,
                  more: dict[str, DataFrame] | None = None) -> bool:
    """X6-X8: one batch's predictions, alerts and summary, and the running
    summary and the ``top`` most suspicious reports of all batches so far,
    committed together.  The running tables are those of the batch before,
    merged with this batch's part, so they cost the same at every length of
    the stream; a replayed batch is not counted twice."""
    ranked = ["seq", "icao24", "attack_probability", "predicted_anomaly"]
    running, best = summary_partial(scored), scored.select(*ranked)
    before = tables.newest(batch_id)
    if before is not None:
        running = running.unionByName(tables.read("running", before))
        best = best.unionByName(tables.read("running_top", before))
    return tables.commit(batch_id, {
        "predictions": scored, "alerts": tr.high_risk(scored, high_risk),
        "summary": mt.prediction_summary(scored).withColumn("batch_id", F.lit(batch_id)),
        "running": merged_summary(running), "running_top": mt.top_predictions(best, n=top, tie=("icao24", "seq")), **(more or {})})


def live_batch_writer(out_dir: str, model=None, threshold: float = tr.ANOMALY_THRESHOLD,
                      high_risk: float = tr.HIGH_RISK_THRESHOLD):
    """X5-X8 in ``foreachBatch`` over a stream of ``live_features``: score the
    newest poll once, then commit its tables (``commit_scored``) under
    ``out_dir``, from which ``readers.read_predictions`` takes the newest."""
    def write(batch: DataFrame, batch_id: int) -> None:
        scored = score_newest(batch, model, threshold).persist()  # several tables read it
        try:
            late = {"late": batch.filter("late = 1")} if "late" in batch.columns else {}
            commit_scored(BatchTables(batch.sparkSession, out_dir), scored, batch_id, high_risk, more=late)
        finally:
            scored.unpersist()
    return write
