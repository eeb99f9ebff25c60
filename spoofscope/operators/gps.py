"""GPS tracks: header discovery, normalisation and spoof-segment row sets."""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoofscope.functions.coerce import coerce_numeric
from spoofscope.operators.ordered import ordered_index

# Accepted header spellings per field (first match wins) and
# the map/demo parameters.
ALIASES = {
    "lat": ["latitude", "lat", "gps_latitude", "gps_lat"],
    "lon": ["longitude", "lon", "lng", "gps_longitude", "gps_lon"],
    "altitude": ["altitude", "alt", "gps_altitude"],
    "speed": ["velocity", "speed", "gps_speed"],
    "heading": ["heading", "course", "yaw", "gps_heading"],
    "is_spoofed": ["data_type", "datatype", "label", "is_spoofed", "spoofed", "attack"],
    "timestamp": ["timestamp", "time", "gps_time", "datetime", "date_time"],
}
NORMAL_POINTS = 8
SPOOF_POINTS = 4
SPLIT_SHARE = 0.45
FALLBACK_START = "2026-01-01 00:00:00"


def normalize_name(name: str) -> str:
    """strip/lower; spaces, '-' and '/' -> '_'; parentheses removed."""
    n = name.strip().lower()
    n = re.sub(r"[ \-/]", "_", n)
    return n.replace("(", "").replace(")", "")


def resolve_columns(columns: Sequence[str]) -> dict[str, str | None]:
    """Map each target field to the first present header alias (metadata
    only — no data is read)."""
    norm = {}
    for c in columns:
        norm.setdefault(normalize_name(c), c)
    return {field: next((norm[a] for a in aliases if a in norm), None)
            for field, aliases in ALIASES.items()}


def normalize_gps(raw: DataFrame, source_col: str = "source_file", order_col: str = "seq",
                  device_col: str | None = None) -> DataFrame:
    """Vendor GPS log -> (timestamp, device_id, lat, lon, altitude, speed,
    heading, is_spoofed, source_file, seq).

    Timestamps parse as UTC (bad -> NULL); when no timestamp column exists or
    none parses in a file, a 1 s grid from the fixed start replaces it, in row
    order.  The label comes from a label column (numeric, default 0) or else
    from the file name ('normal' -> 0, otherwise 1).  Rows without time or
    position are dropped.
    """
    m = resolve_columns(raw.columns)
    if m["lat"] is None or m["lon"] is None:
        raise ValueError(f"latitude/longitude columns not found in {raw.columns}")
    num = lambda f: (coerce_numeric(F.col(f"`{m[f]}`")) if m[f] else F.lit(None).cast("double"))
    src = F.col(source_col)
    device = F.col(device_col) if device_col else F.regexp_replace(src, r"\.[^.]*$", "")
    if m["is_spoofed"]:
        label = F.coalesce(F.floor(coerce_numeric(F.col(f"`{m['is_spoofed']}`"))).cast("int"), F.lit(0))
    else:
        label = F.when(F.lower(src).contains("normal"), 0).otherwise(1)
    ts = F.try_to_timestamp(F.trim(F.col(f"`{m['timestamp']}`"))) if m["timestamp"] else F.lit(None).cast("timestamp")
    out = raw.select(ts.alias("timestamp"), device.alias("device_id"), num("lat").alias("lat"),
                     num("lon").alias("lon"), num("altitude").alias("altitude"), num("speed").alias("speed"),
                     num("heading").alias("heading"), label.alias("is_spoofed"), src.alias("source_file"),
                     F.col(order_col).alias("seq"))
    out = time_fallback(out)
    return out.dropna(subset=["timestamp", "lat", "lon"])


#: Rows of a file, and seconds of a track, that are numbered in one chunk.
CHUNK_ROWS, CHUNK_SECONDS = 1 << 20, 86_400


def _day(c: str = "timestamp") -> Column:
    return F.floor(F.unix_timestamp(c) / CHUNK_SECONDS)


def time_fallback(df: DataFrame, file_col: str = "source_file", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per file: if no timestamp parsed, number its rows by ``seq`` and use
    ``FALLBACK_START + row`` seconds."""
    parsed = df.groupBy(file_col).agg(F.count("timestamp").alias("_parsed")).withColumnRenamed(file_col, "_file")
    rows = ordered_index(df, [file_col], ["seq"], "_row", chunk=F.floor(F.col("seq") / chunk_rows))
    rows = rows.join(parsed, F.col(file_col).eqNullSafe(F.col("_file")))
    synth = F.timestamp_seconds(F.unix_timestamp(F.lit(FALLBACK_START)) + F.col("_row"))
    return rows.withColumn("timestamp", F.when(F.col("_parsed") == 0, synth).otherwise(F.col("timestamp"))).select(*df.columns)


def spoof_device(track: DataFrame) -> DataFrame:
    """The device with spoofed rows (ties -> smallest device id)."""
    g = track.groupBy("device_id").agg(F.max("is_spoofed").alias("max_spoofed"))
    return g.orderBy(F.col("max_spoofed").desc(), F.col("device_id")).limit(1)


def split_all_spoofed(track: DataFrame, share: float = SPLIT_SHARE) -> DataFrame:
    """Devices with no normal row: the first max(1, floor(share*n)) rows by
    time become normal (demo split); other devices are unchanged."""
    lowest = track.groupBy("device_id").agg(F.min("is_spoofed").alias("_min")).withColumnRenamed("device_id", "_device")
    idx = ordered_index(track, ["device_id"], ["timestamp", "seq"], "_r", chunk=_day(), count_col="_n")
    idx = idx.join(lowest, F.col("device_id").eqNullSafe(F.col("_device")))
    cut = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(share)))
    split = (F.col("_min") == 1) & (F.col("_r") < cut)
    return idx.withColumn("is_spoofed", F.when(split, 0).otherwise(F.col("is_spoofed"))).select(*track.columns)


def even_downsample(track: DataFrame, k_normal: int = NORMAL_POINTS, k_spoof: int = SPOOF_POINTS) -> DataFrame:
    """Keep rows at positions floor(i*(n-1)/(k-1)), i < k, of every (device,
    class) in time order — all rows when n <= k.  Adds ``rn``, ``n``."""
    keys = ["device_id", "is_spoofed"]
    idx = ordered_index(track, keys, ["timestamp", "seq"], "rn", chunk=_day(), count_col="n")
    k = F.when(F.col("is_spoofed") == 1, k_spoof).otherwise(k_normal)
    hit = F.exists(F.sequence(F.lit(0), k - 1),
                   lambda i: F.floor(i * (F.col("n") - 1) / (k - 1)) == F.col("rn"))
    return idx.filter((F.col("n") <= k) | hit)


def track_path(track: DataFrame, marker_every: int = 1) -> DataFrame:
    """Demo path per device: 45 % split for all-spoofed devices, even
    downsample per class, then normal points followed by spoofed points with
    ``path_index`` 1..n (bounded: at most k_normal + k_spoof rows per
    device), and a marker flag every ``marker_every`` points plus ends."""
    pts = even_downsample(split_all_spoofed(track))
    w = Window.partitionBy("device_id").orderBy("is_spoofed", "timestamp", "seq")
    p = pts.withColumn("path_index", F.row_number().over(w).cast("bigint")) \
           .withColumn("path_len", F.count(F.lit(1)).over(Window.partitionBy("device_id")))
    marker = ((F.col("path_index") - 1) % marker_every == 0) | (F.col("path_index").isin(1)) | \
             (F.col("path_index") == F.col("path_len"))
    return p.withColumn("is_marker", marker).drop("rn", "n")


def track_segments(path: DataFrame) -> DataFrame:
    """Consecutive path points -> segment class: normal->normal 'normal',
    normal->spoofed 'transition', anything from a spoofed point 'spoofed'."""
    w = Window.partitionBy("device_id").orderBy("path_index")
    nxt = F.col("_next")
    seg = (F.when((F.col("is_spoofed") == 0) & (nxt == 0), "normal")
             .when((F.col("is_spoofed") == 0) & (nxt == 1), "transition").otherwise("spoofed"))
    color = F.when(seg == "normal", "green").when(seg == "transition", "orange").otherwise("red")
    return (path.withColumn("_next", F.lead("is_spoofed").over(w)).filter(F.col("_next").isNotNull())
                .select("device_id", F.col("path_index").alias("from_index"),
                        (F.col("path_index") + 1).alias("to_index"), seg.alias("segment"),
                        color.alias("color")))


def track_markers(path: DataFrame) -> DataFrame:
    """Start, first spoofed and end point of every device's path."""
    pos = F.struct("lat", "lon")
    return path.groupBy("device_id").agg(
        F.min_by(pos, "path_index").alias("start"),
        F.min_by(pos, F.when(F.col("is_spoofed") == 1, F.col("path_index"))).alias("first_spoof"),
        F.max_by(pos, "path_index").alias("end"))


def map_center(df: DataFrame) -> DataFrame:
    return df.agg(F.avg("lat").alias("center_lat"), F.avg("lon").alias("center_lon"))
