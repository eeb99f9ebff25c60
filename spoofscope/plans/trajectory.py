"""Trajectory-level queries over aircraft state rows (adapter B1)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoofscope.functions.coerce import NUMERIC_TEXT, bool_flag, coerce_numeric
from spoofscope.functions.timefmt import iso_epoch
from spoofscope.operators import trajectory as tr
from spoofscope.plans.registry import register, rounded
from spoofscope.session import ensure_checkpoint_dir, stored
from spoofscope.sources import adapters as ad
from spoofscope.sources.clustered import read_area, write_by_place
from spoofscope.sources.committed import BatchTables
from spoofscope.sources.history import History
from spoofscope.streaming import live

_RAW = ad.cte("adsb_raw", ad.ADSB_RAW)
_NUM = lambda c: (f"CASE WHEN regexp_matches(trim({c}), '{NUMERIC_TEXT}') "  # noqa: E731
                  f"THEN TRY_CAST(trim({c}) AS DOUBLE) END")
_BOOL = lambda c: f"CASE WHEN upper(trim({c})) IN ('TRUE', '1') THEN 1 ELSE 0 END"
_STATES = f"""{_RAW},
states AS (
  SELECT seq, snap, icao24, time, lat, lon, {_NUM('velocity')} AS velocity, heading, vertrate,
         {_BOOL('onground')} AS onground, {_BOOL('spi')} AS spi, {_NUM('squawk')} AS squawk,
         baroaltitude, geoaltitude, lastposupdate, lastcontact,
         trim(coalesce(callsign, '')) AS callsign, origin_country, position_source, category, label,
         cast(time AS double) - lastposupdate AS position_age_seconds,
         cast(time AS double) - lastcontact AS contact_age_seconds
  FROM adsb_raw
)"""
_LAG = "{c} - lag({c}) OVER (PARTITION BY icao24 ORDER BY time, seq)"
_DELTAS = ",\n         ".join(
    f"CASE WHEN icao24 IS NULL THEN NULL ELSE {_LAG.format(c=('cast(time AS double)' if c == 'time' else c))} END AS d_{c}"
    for c in tr.DELTA_COLUMNS)
_FEAT = f"""{_STATES},
lagged AS (
  SELECT *, {_DELTAS}
  FROM states
),
feat AS (
  SELECT *, geoaltitude - baroaltitude AS r_altitude_diff, lastcontact - lastposupdate AS r_contact_delay,
         sqrt(d_lat * d_lat + d_lon * d_lon) AS r_position_change,
         d_velocity / nullif(d_time, 0) AS r_velocity_change_rate,
         d_heading / nullif(d_time, 0) AS r_heading_change_rate,
         d_geoaltitude / nullif(d_time, 0) AS r_altitude_change_rate
  FROM lagged
)"""
_Z = lambda e, name: f"round(coalesce({e}, 0), 6) AS {name}"


def states_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.adsb_raw(spark, sf_dir)


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.prepare_states(states_raw(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the adapter emits at most two state rows per event
    return tr.trajectory_features(states(spark, sf_dir))


# ------------------------------------------------------------ P1 / P2
@register("coerce_numeric", oracle=f"""WITH {_RAW}
SELECT seq, velocity AS velocity_text, {_NUM('velocity')} AS velocity,
       {_NUM('squawk')} AS squawk FROM adsb_raw""")
def q_coerce_numeric(spark, sf_dir):
    r = states_raw(spark, sf_dir)
    return r.select("seq", F.col("velocity").alias("velocity_text"),
                    coerce_numeric(F.col("velocity")).alias("velocity"),
                    coerce_numeric(F.col("squawk")).alias("squawk"))


@register("bool_map", oracle=f"""WITH {_RAW}
SELECT onground AS onground_text, {_BOOL('onground')} AS onground,
       CASE WHEN upper(trim(onground)) IN ('TRUE', '1')
              OR TRY_CAST(CASE WHEN regexp_matches(trim(onground), '{NUMERIC_TEXT}') THEN trim(onground) END AS DOUBLE) = 1
            THEN 1 ELSE 0 END AS onground_numeric,
       count(*) AS n_rows
FROM adsb_raw GROUP BY 1, 2, 3""")
def q_bool_map(spark, sf_dir):
    r = states_raw(spark, sf_dir)
    return (r.groupBy(F.col("onground").alias("onground_text"),
                      bool_flag(F.col("onground")).alias("onground"),
                      bool_flag(F.col("onground"), accept_numeric_text=True).alias("onground_numeric"))
             .agg(F.count(F.lit(1)).alias("n_rows")))


# ------------------------------------------------------- S3 + P4..P6
def snapshot_documents(raw: DataFrame) -> DataFrame:
    """Re-create poll documents from state rows (one JSON text per poll).

    One poll holds one feed response, so ``collect_list`` per poll is bounded
    by the feed's page size, not by the data volume.  Rows with seq % 31 = 0
    are sent one field short to exercise padding."""
    fields = [F.col("icao24"), F.col("callsign"), F.col("origin_country"),
              F.col("lastposupdate").cast("string"), F.col("lastcontact").cast("string"),
              F.col("lon").cast("string"), F.col("lat").cast("string"),
              F.col("baroaltitude").cast("string"), F.col("onground"), F.col("velocity"),
              F.col("heading").cast("string"), F.col("vertrate").cast("string"), F.lit(None).cast("string"),
              F.col("geoaltitude").cast("string"), F.col("squawk"), F.col("spi"),
              F.col("position_source").cast("string"), F.col("category").cast("string")]
    full = F.array(*fields)
    arr = F.when(F.col("seq") % 31 == 0, F.slice(full, 1, 17)).otherwise(full)
    return (raw.groupBy("snap")
               .agg(F.max("time").alias("time"), F.collect_list(arr).alias("states"))
               .select(F.to_json(F.struct("time", "states")).alias("value")))


@register("snapshot_explode", oracle=f"""WITH {_RAW}
SELECT max(time) OVER (PARTITION BY snap) AS snapshot_time, max(time) OVER (PARTITION BY snap) AS time,
       strftime(make_timestamp(max(time) OVER (PARTITION BY snap) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS snapshot_utc,
       icao24, lat, lon, TRY_CAST(velocity AS DOUBLE) AS velocity, heading, vertrate,
       trim(coalesce(callsign, '')) AS callsign, onground, spi, squawk, baroaltitude, geoaltitude,
       lastposupdate, lastcontact,
       cast(max(time) OVER (PARTITION BY snap) AS double) - lastposupdate AS position_age_seconds,
       cast(max(time) OVER (PARTITION BY snap) AS double) - lastcontact AS contact_age_seconds,
       origin_country, position_source, CASE WHEN seq % 31 = 0 THEN NULL ELSE category END AS category
FROM adsb_raw""")
def q_snapshot_explode(spark, sf_dir):
    return tr.normalize_states(tr.snapshot_rows(snapshot_documents(states_raw(spark, sf_dir))))


@register("normalize_states", oracle=f"""WITH {_STATES}
SELECT seq, icao24, time, callsign, onground, spi, squawk, round(velocity, 6) AS velocity,
       position_age_seconds, contact_age_seconds FROM states""")
def q_normalize_states(spark, sf_dir):
    s = states(spark, sf_dir)
    return rounded(s.select("seq", "icao24", "time", "callsign", "onground", "spi", "squawk", "velocity",
                            "position_age_seconds", "contact_age_seconds"))


# --------------------------------------------------------- W1 .. W3, P7
_DELTA_OUT = ", ".join(_Z(f"d_{c}", f"delta_{c}") for c in tr.DELTA_COLUMNS)


@register("trajectory_deltas", oracle=f"""WITH {_FEAT}
SELECT seq, icao24, time, {_DELTA_OUT} FROM feat""")
def q_trajectory_deltas(spark, sf_dir):
    f = features(spark, sf_dir)
    return rounded(f.select("seq", "icao24", "time", *[f"delta_{c}" for c in tr.DELTA_COLUMNS]))


@register("live_predictions", oracle=f"""WITH {_FEAT},
scored AS (SELECT *, 0.6 * least(abs(coalesce(d_velocity, 0)) / 100, 1) + 0.4 * least(abs(coalesce(d_heading, 0)) / 180, 1) AS p
           FROM feat WHERE snap = (SELECT max(snap) FROM feat))
SELECT seq, icao24, time, {_DELTA_OUT}, round(p, 6) AS attack_probability, CASE WHEN p >= 0.3 THEN 1 ELSE 0 END AS predicted_anomaly
FROM scored""")
def q_live_predictions(spark, sf_dir):
    """The newest poll, scored over real features by a fixed formula in the model's place."""
    s = formula_scores(tr.latest_snapshot(features(spark, sf_dir), "snap"))
    return rounded(s.select("seq", "icao24", "time", *[f"delta_{c}" for c in tr.DELTA_COLUMNS], "attack_probability", "predicted_anomaly"))


def formula_scores(f):
    p = 0.6 * F.least(F.abs("delta_velocity") / 100, F.lit(1.0)) + 0.4 * F.least(F.abs("delta_heading") / 180, F.lit(1.0))
    return f.withColumn("attack_probability", p).withColumn("predicted_anomaly", F.when(p >= tr.ANOMALY_THRESHOLD, 1).otherwise(0))


#: Batches that the committed tables of a query are made in.
COMMITTED_BATCHES = 3


def committed_polls(spark, sf_dir):
    """All polls, scored and committed in a few batches of consecutive polls; the last batch is the newest poll."""
    s = formula_scores(features(spark, sf_dir)).select("seq", "icao24", "time", "snap", "attack_probability", "predicted_anomaly")
    s = stored(s)
    tables = BatchTables(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/committed-{uuid.uuid4().hex}")
    low, high = s.agg(F.min("snap"), F.max("snap")).first()
    if low is None:
        live.commit_scored(tables, s, 0)
        return tables
    part = F.when(F.col("snap") == high, COMMITTED_BATCHES - 1).otherwise(((F.col("snap") - low) * (COMMITTED_BATCHES - 1) / F.lit(max(high - low, 1))).cast("int"))
    for k in range(COMMITTED_BATCHES):
        live.commit_scored(tables, s.filter(F.coalesce(part, F.lit(0)) == k), k)
    return tables


@register("latest_predictions", oracle=f"""WITH {_FEAT},
scored AS (SELECT *, 0.6 * least(abs(coalesce(d_velocity, 0)) / 100, 1) + 0.4 * least(abs(coalesce(d_heading, 0)) / 180, 1) AS p
           FROM feat WHERE snap = (SELECT max(snap) FROM feat))
SELECT seq, icao24, time, round(p, 6) AS attack_probability, CASE WHEN p >= 0.3 THEN 1 ELSE 0 END AS predicted_anomaly FROM scored""")
def q_latest_predictions(spark, sf_dir):
    """The newest committed batch, named by the commit log."""
    return rounded(committed_polls(spark, sf_dir).read("predictions").select("seq", "icao24", "time", "attack_probability", "predicted_anomaly"))


@register("running_summary", oracle=f"""WITH {_FEAT},
scored AS (SELECT 0.6 * least(abs(coalesce(d_velocity, 0)) / 100, 1) + 0.4 * least(abs(coalesce(d_heading, 0)) / 180, 1) AS p FROM feat)
SELECT count(*) AS total_aircraft, cast(coalesce(sum(CASE WHEN p >= 0.3 THEN 1 ELSE 0 END), 0) AS bigint) AS predicted_anomalies,
       round(coalesce(avg(CASE WHEN p >= 0.3 THEN 1.0 ELSE 0.0 END), 0), 6) AS anomaly_rate,
       round(coalesce(avg(p), 0), 6) AS average_attack_probability, round(coalesce(max(p), 0), 6) AS max_attack_probability
FROM scored""")
def q_running_summary(spark, sf_dir):
    """The summary of all polls, merged batch by batch."""
    return rounded(live.running_summary(committed_polls(spark, sf_dir).read("running")))


_RATES = ["velocity_change_rate", "heading_change_rate", "altitude_change_rate"]


@register("change_rates", oracle=f"""WITH {_FEAT}
SELECT seq, icao24, {', '.join(_Z('r_' + c, c) for c in _RATES)} FROM feat""")
def q_change_rates(spark, sf_dir):
    return rounded(features(spark, sf_dir).select("seq", "icao24", *_RATES))


_TF = ["altitude_diff", "contact_delay", "position_change"]
_ZF = ["lat", "lon", "velocity", "squawk", "baroaltitude", "lastposupdate"]


@register("trajectory_features", oracle=f"""WITH {_FEAT}
SELECT seq, icao24, onground, spi, {', '.join(_Z('r_' + c, c) for c in _TF)},
       {', '.join(_Z(c, c) for c in _ZF)},
       round(position_age_seconds, 6) AS position_age_seconds FROM feat""")
def q_trajectory_features(spark, sf_dir):
    f = features(spark, sf_dir)
    return rounded(f.select("seq", "icao24", "onground", "spi", *_TF, *_ZF, "position_age_seconds"))


# ------------------------------------------------------ P11 .. P15, S4
@register("valid_position", oracle=f"""WITH {_STATES}
SELECT seq, icao24, round(lat, 6) AS lat, round(lon, 6) AS lon FROM states
WHERE lat IS NOT NULL AND lon IS NOT NULL AND lat <> 0 AND lon <> 0""")
def q_valid_position(spark, sf_dir):
    return rounded(tr.valid_position(states(spark, sf_dir)).select("seq", "icao24", "lat", "lon"))


@register("fresh_positions", oracle=f"""WITH {_STATES}
SELECT seq, icao24, position_age_seconds FROM states
WHERE lat IS NOT NULL AND lon IS NOT NULL AND lat <> 0 AND lon <> 0
  AND position_age_seconds IS NOT NULL AND position_age_seconds <= 60""")
def q_fresh_positions(spark, sf_dir):
    s = tr.fresh_positions(tr.valid_position(states(spark, sf_dir)))
    return s.select("seq", "icao24", "position_age_seconds")


@register("latest_snapshot", oracle=f"""WITH {_STATES}
SELECT seq, icao24, time FROM states WHERE time = (SELECT max(time) FROM states)""")
def q_latest_snapshot(spark, sf_dir):
    return tr.latest_snapshot(states(spark, sf_dir)).select("seq", "icao24", "time")


_AREA_SQL = f"""WITH {_STATES}
SELECT seq, icao24, round(lat, 6) AS lat, round(lon, 6) AS lon FROM states
WHERE lat BETWEEN 49.0 AND 55.0 AND lon BETWEEN 14.0 AND 24.0"""


@register("area_scan", oracle=_AREA_SQL)
def q_area_scan(spark, sf_dir):
    """The area read from states stored by place."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/places-{uuid.uuid4().hex}"
    write_by_place(states(spark, sf_dir), path)
    return rounded(read_area(spark, path, 49.0, 14.0, 55.0, 24.0).select("seq", "icao24", "lat", "lon"))


@register("bbox_filter", oracle=_AREA_SQL)
def q_bbox_filter(spark, sf_dir):
    s = tr.bbox_filter(states(spark, sf_dir), 49.0, 14.0, 55.0, 24.0)
    return rounded(s.select("seq", "icao24", "lat", "lon"))


@register("binary_label", oracle=f"""WITH {_STATES}
SELECT label, CASE WHEN coalesce(label, 0) <> 0 THEN 1 ELSE 0 END AS binary_label, count(*) AS n_rows
FROM states GROUP BY 1, 2""")
def q_binary_label(spark, sf_dir):
    b = tr.binary_label(states(spark, sf_dir))
    return b.groupBy("label", "binary_label").agg(F.count(F.lit(1)).alias("n_rows"))


@register("model_input", oracle=f"""WITH {_FEAT}
SELECT seq, {_Z('velocity', 'velocity')}, {_Z('heading', 'heading')}, {_Z('vertrate', 'vertrate')},
       cast(onground AS double) AS onground, cast(spi AS double) AS spi, {_Z('squawk', 'squawk')},
       {_Z('baroaltitude', 'baroaltitude')}, {_Z('geoaltitude', 'geoaltitude')},
       {', '.join(_Z('d_' + c, 'delta_' + c) for c in tr.DELTA_COLUMNS)},
       {', '.join(_Z('r_' + c, c) for c in _TF + _RATES)},
       cast(0 AS double) AS rss
FROM feat""")
def q_model_input(spark, sf_dir):
    feats = tr.MODEL_FEATURES + ["rss"]  # 'rss' is absent -> filled with 0
    return rounded(tr.model_input(features(spark, sf_dir), feats, keep=["seq"]))


# ------------------------------------------------------ W6 .. W10, F1
_TAIL = f"""{_STATES},
pts AS (
  SELECT *, row_number() OVER (PARTITION BY icao24 ORDER BY time DESC, seq DESC) AS rd
  FROM states
  WHERE lat IS NOT NULL AND lon IS NOT NULL AND lat <> 0 AND lon <> 0
    AND position_age_seconds IS NOT NULL AND position_age_seconds <= 60 AND icao24 IS NOT NULL
),
tail AS (
  SELECT *, count(*) OVER (PARTITION BY icao24) AS n_points FROM pts WHERE rd <= 30
)"""


@register("trajectory_tail", oracle=f"""WITH {_TAIL}
SELECT icao24, time, seq, round(lat, 6) AS lat, round(lon, 6) AS lon, callsign,
       cast(n_points - rd + 1 AS integer) AS point_index, cast(n_points AS integer) AS n_points,
       rd = 1 AS is_last, CASE WHEN rd = 1 THEN 5 ELSE 3 END AS radius,
       CASE WHEN rd = 1 THEN cast(0.9 AS double) ELSE cast(0.6 AS double) END AS opacity
FROM tail WHERE n_points >= 2""")
def q_trajectory_tail(spark, sf_dir):
    t = tr.trajectory_tail(states(spark, sf_dir))
    return rounded(t)


@register("last_callsign", oracle=f"""WITH {_TAIL}
SELECT icao24, arg_max(trim(callsign), (time, seq)) AS last_callsign
FROM tail WHERE n_points >= 2 AND callsign IS NOT NULL GROUP BY icao24""")
def q_last_callsign(spark, sf_dir):
    return tr.last_callsign(tr.trajectory_tail(states(spark, sf_dir)))


@register("state_dedup", oracle=f"""WITH {_STATES},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY icao24, lastposupdate, lat, lon ORDER BY seq DESC) AS rk
  FROM states
)
SELECT seq, icao24, time, lastposupdate, round(lat, 6) AS lat, round(lon, 6) AS lon FROM ranked WHERE rk = 1""")
def q_state_dedup(spark, sf_dir):
    d = tr.state_dedup(states(spark, sf_dir))
    return rounded(d.select("seq", "icao24", "time", "lastposupdate", "lat", "lon"))


HISTORY = 5_000  # fewer rows than the sf0.01 table has


@register("history_cap", oracle=f"""WITH {_STATES}
SELECT seq, icao24, time FROM states ORDER BY seq DESC LIMIT {HISTORY}""")
def q_history_cap(spark, sf_dir):
    return tr.history_cap(states(spark, sf_dir), HISTORY).select("seq", "icao24", "time")


_PAL = ", ".join(f"'{c}'" for c in tr.PALETTE)


@register("aircraft_color", oracle=f"""WITH {_STATES}
SELECT DISTINCT icao24,
  CASE WHEN icao24 IS NULL OR lower(trim(icao24)) = '' THEN 'gray'
       ELSE [{_PAL}][instr('0123456789abcdef', right(md5(lower(trim(icao24))), 1))] END AS color
FROM states""")
def q_aircraft_color(spark, sf_dir):
    return states(spark, sf_dir).select("icao24", tr.aircraft_color(F.col("icao24")).alias("color")).distinct()


@register("iso_epoch", oracle="""
SELECT event_id,
  CASE WHEN event_id % 5 = 0 THEN cast(floor(epoch(ts)) AS bigint)
       WHEN event_id % 5 = 1 THEN cast(floor(epoch(ts)) AS bigint) - 7200
       WHEN event_id % 5 = 2 THEN cast(floor(epoch(ts)) AS bigint)
       WHEN event_id % 5 = 3 THEN cast(trunc(value * 1000) AS bigint)
       ELSE 0 END AS epoch_seconds
FROM events""")
def q_iso_epoch(spark, sf_dir):
    ev = ad.read_table(spark, sf_dir, "events")
    iso = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss")
    text = (F.when(F.col("event_id") % 5 == 0, F.concat(iso, F.lit("Z")))
             .when(F.col("event_id") % 5 == 1, F.concat(iso, F.lit("+02:00")))
             .when(F.col("event_id") % 5 == 2, F.concat(iso, F.lit(".5")))
             .when(F.col("event_id") % 5 == 3, (F.col("value") * 1000).cast("string"))
             .otherwise(F.lit("not a time")))
    return ev.select("event_id", iso_epoch(text).alias("epoch_seconds"))


# ------------------------------------------------------------ S2, A27, U2
def flight_documents_from(rows):
    """Group flight reports into feed documents of the three accepted shapes
    (50 reports per document: bounded)."""
    obj = F.to_json(F.struct(F.col("ts_text").alias("timestamp"), "icao_address", "latitude", "longitude",
                             "speed", "heading", "vertical_rate", "callsign", "on_ground", "squawk",
                             "altitude_baro", "altitude_gnss"))
    # epoch times travel as JSON numbers, ISO times as strings
    obj = F.when(F.col("seq") % 4 == 0,
                 F.regexp_replace(obj, '"timestamp":"([0-9]+)"', '"timestamp":$1')).otherwise(obj)
    r = rows.withColumn("_o", obj)
    single = r.filter(F.col("doc_id") % 3 == 2).select(F.col("_o").alias("value"))
    grouped = (r.filter(F.col("doc_id") % 3 != 2).groupBy("doc_id")
                .agg(F.concat(F.lit("["), F.array_join(F.collect_list("_o"), ","), F.lit("]")).alias("_l")))
    docs = grouped.select(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"flights": '), F.col("_l"), F.lit("}")))
                           .otherwise(F.col("_l")).alias("value"))
    return docs.unionByName(single)


@register("flights_normalize", oracle=f"""WITH {ad.cte('fl', ad.flights_sql('duckdb').replace('{events}', 'events'))}
SELECT CASE WHEN seq % 4 IN (0, 1) THEN cast(floor(epoch(ts)) AS bigint) ELSE 0 END AS time,
       icao_address AS icao24, round(latitude, 6) AS lat, round(longitude, 6) AS lon, round(speed, 6) AS velocity,
       heading, round(vertical_rate, 6) AS vertrate, callsign,
       CASE WHEN on_ground THEN 'true' ELSE 'false' END AS onground, 'False' AS spi, squawk,
       round(altitude_baro, 6) AS baroaltitude, round(altitude_gnss, 6) AS geoaltitude,
       cast(CASE WHEN seq % 4 IN (0, 1) THEN cast(floor(epoch(ts)) AS bigint) ELSE 0 END AS double) AS lastposupdate,
       cast(CASE WHEN seq % 4 IN (0, 1) THEN cast(floor(epoch(ts)) AS bigint) ELSE 0 END AS double) AS lastcontact
FROM fl JOIN events ON fl.seq = events.event_id""")
def q_flights_normalize(spark, sf_dir):
    from spoofscope.sources import readers as rd
    docs = flight_documents_from(ad.flight_rows(spark, sf_dir))
    return rounded(rd.normalize_flights(rd.flight_documents(docs)))


_PROFILE_COLS = ["icao24", "lat", "lon", "velocity", "squawk", "baroaltitude", "lastposupdate", "callsign",
                 "position_age_seconds", "contact_age_seconds", "heading", "geoaltitude"]


def null_profile(df, cols, top: int = 20):
    """NULL (and NaN) count per column, largest first (ties by name), with
    the row count — one aggregation pass, then an unpivot of one row."""
    def missing(c):
        t = dict(df.dtypes)[c]
        return F.col(c).isNull() | (F.isnan(c) if t in ("double", "float") else F.lit(False))
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(missing(c)).alias(c) for c in cols])
    long = one.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null"))
                                                for c in cols])).alias("_s"))
    return (long.select("_s.column_name", "_s.n_null", F.col("_n").alias("n_rows"))
                .orderBy(F.col("n_null").desc(), "column_name").limit(top))


@register("null_profile", oracle=f"WITH {_STATES}\nSELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, cast(count(*) - count({c}) AS bigint) AS n_null, count(*) AS n_rows FROM states"
    for c in _PROFILE_COLS) + ") ORDER BY n_null DESC, column_name LIMIT 20")
def q_null_profile(spark, sf_dir):
    return null_profile(states(spark, sf_dir), _PROFILE_COLS)


_HISTORY_SQL = f"""WITH {_STATES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY icao24, lastposupdate, lat, lon ORDER BY seq DESC) AS rk
           FROM states)
SELECT icao24, count(*) AS n_rows, max(seq) AS last_seq FROM ranked WHERE rk = 1 GROUP BY icao24"""


@register("history_append", oracle=_HISTORY_SQL)
def q_history_append(spark, sf_dir):
    """History (all but the newest poll) + newest poll, then keep-last dedup."""
    s = states(spark, sf_dir)
    newest = F.broadcast(s.agg(F.max("snap").alias("_newest")))  # one row
    polls = [s.join(newest, F.col("snap") == F.col("_newest"), how) for how in ("left_anti", "left_semi")]
    d = tr.state_dedup(polls[0].unionByName(polls[1]))
    return d.groupBy("icao24").agg(F.count(F.lit(1)).alias("n_rows"), F.max("seq").alias("last_seq"))


#: Appends that the history of a query is made in.
HISTORY_APPENDS = 4


@register("history_table", oracle=_HISTORY_SQL)
def q_history_table(spark, sf_dir):
    """The appendable history after a few appends of consecutive polls."""
    s = stored(states(spark, sf_dir))
    low, high = s.agg(F.min("snap"), F.max("snap")).first()
    part = F.floor((F.col("snap") - (low or 0)) * HISTORY_APPENDS / F.lit((high or 0) - (low or 0) + 1))
    table = History(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/history-{uuid.uuid4().hex}", buckets=16)
    for k in range(HISTORY_APPENDS):
        table.append(s.filter(F.coalesce(part, F.lit(0)) == k), k)
    return table.read().groupBy("icao24").agg(F.count(F.lit(1)).alias("n_rows"), F.max("seq").alias("last_seq"))
