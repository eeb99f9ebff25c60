"""Aircraft state vectors -> normalised states -> per-aircraft trajectory
features, trailing trajectories and live-map row sets."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoofscope.functions.coerce import bool_flag, coerce_columns, zero_fill
from spoofscope.operators.ordered import ordered_diff

# Live-feed limits and the positional layout of a state vector.
MAX_POSITION_AGE_SECONDS = 60
TRAJECTORY_POINTS = 30
HISTORY_ROWS = 50_000
HIGH_RISK_THRESHOLD = 0.6
ANOMALY_THRESHOLD = 0.3
STATE_FIELDS = ["icao24", "callsign", "origin_country", "time_position", "last_contact", "longitude",
                "latitude", "baro_altitude", "on_ground", "velocity", "true_track", "vertical_rate",
                "sensors", "geo_altitude", "squawk", "spi", "position_source", "category"]
NUMERIC_STATE_COLUMNS = ["time", "lat", "lon", "velocity", "heading", "vertrate", "squawk",
                         "baroaltitude", "geoaltitude", "lastposupdate", "lastcontact"]
REQUIRED_STATE_COLUMNS = ["time", "icao24", "lat", "lon", "velocity", "heading", "vertrate", "onground",
                          "spi", "squawk", "baroaltitude", "geoaltitude", "lastposupdate", "lastcontact"]
DELTA_COLUMNS = ["time", "lat", "lon", "velocity", "heading", "baroaltitude", "geoaltitude"]
DERIVED_FEATURES = [f"delta_{c}" for c in DELTA_COLUMNS] + [
    "altitude_diff", "contact_delay", "position_change",
    "velocity_change_rate", "heading_change_rate", "altitude_change_rate"]
BASE_MODEL_FEATURES = ["velocity", "heading", "vertrate", "onground", "spi", "squawk",
                       "baroaltitude", "geoaltitude"]
MODEL_FEATURES = BASE_MODEL_FEATURES + DERIVED_FEATURES
# Palette for per-aircraft colours (index = md5 digest mod 16).
PALETTE = ["blue", "purple", "orange", "darkred", "cadetblue", "darkgreen", "darkblue", "pink",
           "lightblue", "black", "gray", "darkpurple", "beige", "lightgreen", "red", "lightred"]


# ------------------------------------------------------------------ ingest
def snapshot_rows(snapshots: DataFrame, json_col: str = "value") -> DataFrame:
    """Poll documents ``{"time": t, "states": [[...18 fields...], ...]}`` ->
    one row per state with the 18 named fields (text) and ``api_time``.
    Short arrays are padded with NULL, long ones cut; an empty/absent
    ``states`` yields no rows."""
    doc = F.from_json(F.col(json_col), "time BIGINT, states ARRAY<ARRAY<STRING>>")
    s = snapshots.select(doc.alias("_d")).select(F.col("_d.time").alias("api_time"),
                                                 F.posexplode("_d.states").alias("state_index", "_s"))
    return s.select(*[F.get(F.col("_s"), i).alias(name) for i, name in enumerate(STATE_FIELDS)],
                    "api_time", "state_index")


def normalize_states(raw: DataFrame) -> DataFrame:
    """Positional snapshot fields -> the state table (callsign trimmed, ages)."""
    d = lambda c: F.col(c).try_cast("double")
    snap = F.col("api_time").cast("bigint")
    return raw.select(
        snap.alias("snapshot_time"), snap.alias("time"),
        F.date_format(F.timestamp_seconds(snap), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("snapshot_utc"), F.col("icao24"),
        d("latitude").alias("lat"), d("longitude").alias("lon"), d("velocity").alias("velocity"),
        d("true_track").alias("heading"), d("vertical_rate").alias("vertrate"),
        F.trim(F.coalesce(F.col("callsign"), F.lit(""))).alias("callsign"),
        F.col("on_ground").alias("onground"), F.col("spi").alias("spi"), F.col("squawk"),
        d("baro_altitude").alias("baroaltitude"), d("geo_altitude").alias("geoaltitude"),
        d("time_position").alias("lastposupdate"), d("last_contact").alias("lastcontact"),
        (snap.cast("double") - d("time_position")).alias("position_age_seconds"),
        (snap.cast("double") - d("last_contact")).alias("contact_age_seconds"),
        F.col("origin_country"), F.col("position_source").try_cast("int").alias("position_source"),
        F.col("category").try_cast("int").alias("category"),
        *([F.col("_seq").alias("seq")] if "_seq" in raw.columns else []),
    )


def prepare_states(df: DataFrame, accept_numeric_bool: bool = False,
                   snapshot_col: str | None = None) -> DataFrame:
    """Type the state table: booleans -> 0/1, numeric text -> DOUBLE (NULL
    when unparseable), absent required columns defaulted ('unknown' / 0),
    callsign trimmed, and position/contact ages when absent."""
    for c in REQUIRED_STATE_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("unknown") if c == "icao24" else F.lit(0))
    df = df.withColumns({c: bool_flag(F.col(c), accept_numeric_bool) for c in ("onground", "spi")})
    df = coerce_columns(df, [c for c in NUMERIC_STATE_COLUMNS if c != "time"])
    if "callsign" in df.columns:
        df = df.withColumn("callsign", F.trim(F.coalesce(F.col("callsign"), F.lit(""))))
    snap = F.col(snapshot_col or ("snapshot_time" if "snapshot_time" in df.columns else "time"))
    if "position_age_seconds" not in df.columns:
        df = df.withColumn("position_age_seconds", snap.cast("double") - F.col("lastposupdate"))
    if "contact_age_seconds" not in df.columns:
        df = df.withColumn("contact_age_seconds", snap.cast("double") - F.col("lastcontact"))
    return df


# ---------------------------------------------------------------- features
def _rate(d: Column, dt: Column) -> Column:
    return d / F.nullif(dt, F.lit(0.0))


def trajectory_features(states: DataFrame, key: str = "icao24", order: Sequence[str] = ("time", "seq"),
                        wrap_heading: bool = False, zero_fill_ages: bool = False,
                        chunk_seconds: int = 86_400) -> DataFrame:
    """Per-aircraft deltas (time, lat, lon, velocity, heading, altitudes),
    geo-baro altitude difference, contact delay, planar position change (in
    degrees) and change rates; then every numeric column's NULL/NaN/Inf -> 0.

    Rows are ordered by ``order`` inside each aircraft (pass a unique arrival
    sequence last).  Rows without an aircraft id get no deltas.  An aircraft's
    rows are compared in chunks of ``chunk_seconds`` of its ``order[0]``
    (``ordered_diff``).  Position/contact ages keep NULL unless
    ``zero_fill_ages``.
    """
    order = [c for c in order if c in states.columns]
    df = states.withColumn("_t", F.col("time").cast("double"))
    cols = ["_t"] + DELTA_COLUMNS[1:]
    df = ordered_diff(df, [key], order, cols, prefix="_d_",
                      chunk=F.floor(F.col(order[0]).cast("double") / chunk_seconds))
    keyed = F.col(key).isNotNull()
    deltas = {f"delta_{c}": F.when(keyed, F.col(f"_d_{'_t' if c == 'time' else c}")) for c in DELTA_COLUMNS}
    df = df.withColumns(deltas).drop(*[f"_d_{c}" for c in cols], "_t")
    return derived_features(df, wrap_heading, zero_fill_ages)


def derived_features(df: DataFrame, wrap_heading: bool = False, zero_fill_ages: bool = False) -> DataFrame:
    """What follows from the deltas, batch or stream: altitude difference,
    contact delay, position change, change rates, then NULL/NaN/Inf -> 0."""
    if wrap_heading:
        df = df.withColumn("delta_heading", F.pmod(F.col("delta_heading") + 180.0, F.lit(360.0)) - 180.0)
    df = df.withColumns({
        "altitude_diff": F.col("geoaltitude") - F.col("baroaltitude"),
        "contact_delay": F.col("lastcontact") - F.col("lastposupdate"),
        "position_change": F.sqrt(F.col("delta_lat") ** 2 + F.col("delta_lon") ** 2),
        "velocity_change_rate": _rate(F.col("delta_velocity"), F.col("delta_time")),
        "heading_change_rate": _rate(F.col("delta_heading"), F.col("delta_time")),
        "altitude_change_rate": _rate(F.col("delta_geoaltitude"), F.col("delta_time")),
    })
    skip = {"position_age_seconds", "contact_age_seconds"} if not zero_fill_ages else set()
    fill = {f.name: zero_fill(F.col(f.name)) for f in df.schema.fields
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in skip}
    return df.withColumns(fill)


def binary_label(df: DataFrame, col: str = "label", missing_as_attack: bool = False) -> DataFrame:
    """``binary_label`` = 1 for any non-zero attack type; a missing label is
    normal (0) unless ``missing_as_attack``."""
    lab = F.col(col)
    if missing_as_attack:
        v = F.when(lab.eqNullSafe(F.lit(0)), 0).otherwise(1)
    else:
        v = F.when(F.coalesce(lab, F.lit(0)) != 0, 1).otherwise(0)
    return df.withColumn("binary_label", v)


def model_input(df: DataFrame, features: Sequence[str] = tuple(MODEL_FEATURES),
                keep: Sequence[str] = ()) -> DataFrame:
    """Align to the model's feature list: missing features become 0.0,
    everything else is dropped, order fixed."""
    cols = [(F.col(c).cast("double") if c in df.columns else F.lit(0.0)).alias(c) for c in features]
    return df.select(*[F.col(k) for k in keep], *cols)


# ------------------------------------------------------------- row filters
def valid_position(df: DataFrame, zero_is_missing: bool = True) -> DataFrame:
    ok = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    if zero_is_missing:
        ok = ok & (F.col("lat") != 0) & (F.col("lon") != 0)
    return df.filter(ok)


def fresh_positions(df: DataFrame, max_age: float = MAX_POSITION_AGE_SECONDS) -> DataFrame:
    age = F.col("position_age_seconds")
    return df.filter(age.isNotNull() & (age <= max_age))


def bbox_filter(df: DataFrame, lamin: float, lomin: float, lamax: float, lomax: float) -> DataFrame:
    """Area predicate (pushed to the parquet scan when the input is a scan)."""
    return df.filter(F.col("lat").between(lamin, lamax) & F.col("lon").between(lomin, lomax))


def aircraft_filter(df: DataFrame, icao24: str) -> DataFrame:
    """One aircraft's rows; ids compare trimmed and in lower case."""
    return df.filter(F.lower(F.trim("icao24")) == icao24.strip().lower())


def latest_snapshot(df: DataFrame, time_col: str = "time") -> DataFrame:
    """Rows of the newest poll: ``time = max(time)`` (scalar subquery)."""
    m = df.agg(F.max(time_col).alias("_m"))
    return df.join(F.broadcast(m), F.col(time_col) == F.col("_m")).drop("_m")


def high_risk(scored: DataFrame, threshold: float = HIGH_RISK_THRESHOLD,
              prob_col: str = "attack_probability") -> DataFrame:
    return scored.filter(F.col(prob_col) > threshold)


# --------------------------------------------------------------- row sets
def state_dedup(df: DataFrame, subset: Sequence[str] = ("icao24", "lastposupdate", "lat", "lon"),
                arrival: str = "seq") -> DataFrame:
    """Keep the newest arrival of every duplicate group (NULLs compare equal).

    An aggregate (``max_by`` on arrival) rather than a window: it combines
    map-side, so a group of millions of copies never lands in one task.
    """
    others = [c for c in df.columns if c not in subset]
    agg = F.max_by(F.struct(*[F.col(c) for c in others]), F.col(arrival)).alias("_last")
    return df.groupBy(*subset).agg(agg).select(*subset, "_last.*").select(*df.columns)


def history_cap(df: DataFrame, n: int = HISTORY_ROWS, arrival: str = "seq") -> DataFrame:
    """The newest ``n`` rows by arrival: a top-n whose size the caller sets.
    Every task keeps its own newest ``n`` and one task merges them, so ``n``
    is for a bounded recent history; keep a whole one by time instead (the
    streaming state's TTL)."""
    return df.orderBy(F.col(arrival).desc()).limit(n)


def trajectory_tail(df: DataFrame, points: int = TRAJECTORY_POINTS, key: str = "icao24",
                    order: Sequence[str] = ("time", "seq")) -> DataFrame:
    """Last ``points`` valid, fresh positions per aircraft (aircraft with at
    least two), with point index, count, last flag and marker style.

    ``row_number() <= k`` is planned as a window group limit: every task keeps
    at most k rows per aircraft before the shuffle, so a busy aircraft costs
    k rows per task, not its whole history.
    """
    pts = fresh_positions(valid_position(df)).filter(F.col(key).isNotNull())
    desc = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    tail = pts.withColumn("_rd", F.row_number().over(desc)).filter(F.col("_rd") <= points)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    tail = tail.withColumn("n_points", n).filter(F.col("n_points") >= 2)
    idx = F.col("n_points") - F.col("_rd") + 1
    last = F.col("_rd") == 1
    return tail.select(
        key, *[c for c in order if c != key], "lat", "lon", "callsign",
        idx.cast("int").alias("point_index"), F.col("n_points").cast("int").alias("n_points"),
        last.alias("is_last"),
        F.when(last, 5).otherwise(3).alias("radius"),
        F.when(last, 0.9).otherwise(0.6).alias("opacity"),
    )


def last_callsign(tail: DataFrame, key: str = "icao24", order: Sequence[str] = ("time", "seq")) -> DataFrame:
    """Last non-NULL callsign (trimmed) of each aircraft's tail."""
    ordk = F.struct(*[F.col(c) for c in order])
    return (tail.filter(F.col("callsign").isNotNull())
                .groupBy(key).agg(F.max_by(F.trim("callsign"), ordk).alias("last_callsign")))


def aircraft_color(c: Column) -> Column:
    """Stable palette colour from md5(lower(trim(id))); NULL/empty -> gray.
    The palette has 16 entries, so the digest mod 16 is its last hex digit."""
    key = F.lower(F.trim(c))
    idx = F.conv(F.substring(F.md5(key), 32, 1), 16, 10).cast("int")
    pal = F.array(*[F.lit(x) for x in PALETTE])
    return F.when(key.isNull() | (key == ""), F.lit("gray")).otherwise(F.element_at(pal, idx + 1))


def prediction_status(prob: Column, pred: Column) -> list[Column]:
    """Status text, marker colour/radius and the probability rounded to 3."""
    anomalous = pred == 1
    return [
        F.when(anomalous, "Predicted anomaly").otherwise("Predicted normal").alias("status"),
        F.when(anomalous, "red").otherwise("green").alias("border_color"),
        F.when(anomalous, 8).otherwise(6).alias("radius"),
        F.format_number(prob, 3).alias("probability_text"),
    ]
