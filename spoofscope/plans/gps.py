"""GPS-track queries (adapter: events -> vendor-style GPS logs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoofscope.operators import gps as gp
from spoofscope.plans.registry import register, rounded
from spoofscope.sources import adapters as ad

_TRACK = f"""{ad.cte('gps', ad.GPS_TRACK)},
track AS (
  SELECT date_trunc('second', ts) AS timestamp, device_id, lat, lon, altitude, speed, heading,
         is_spoofed, source_file, seq
  FROM gps WHERE lat IS NOT NULL AND lon IS NOT NULL
),
g AS (SELECT device_id, min(is_spoofed) AS mn, count(*) AS n FROM track GROUP BY device_id),
r AS (SELECT t.*, row_number() OVER (PARTITION BY device_id ORDER BY timestamp, seq) - 1 AS r0 FROM track t),
split AS (
  SELECT r.* EXCLUDE (is_spoofed, r0),
         CASE WHEN g.mn = 1 AND r.r0 < greatest(1, floor(g.n * 0.45)) THEN 0 ELSE r.is_spoofed END AS is_spoofed
  FROM r JOIN g USING (device_id)
),
ds AS (
  SELECT s.*, row_number() OVER (PARTITION BY device_id, is_spoofed ORDER BY timestamp, seq) - 1 AS rn,
         count(*) OVER (PARTITION BY device_id, is_spoofed) AS n,
         CASE WHEN is_spoofed = 1 THEN 4 ELSE 8 END AS k
  FROM split s
),
down AS (
  SELECT * FROM ds
  WHERE n <= k OR list_contains(list_transform(range(k), lambda i: (i * (n - 1)) // (k - 1)), rn)
),
path AS (
  SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY is_spoofed, timestamp, seq) AS path_index,
         count(*) OVER (PARTITION BY device_id) AS path_len
  FROM down
)"""
_EPOCH = "cast(epoch(timestamp) AS bigint) AS epoch_seconds"


def track(spark, sf_dir):
    return gp.normalize_gps(ad.gps_raw(spark, sf_dir))


@register("gps_normalize", oracle=f"""WITH {_TRACK}
SELECT device_id, seq, {_EPOCH}, round(lat, 6) AS lat, round(lon, 6) AS lon, round(altitude, 6) AS altitude,
       round(speed, 6) AS speed, round(heading, 6) AS heading, is_spoofed, source_file FROM track""")
def q_gps_normalize(spark, sf_dir):
    t = track(spark, sf_dir)
    return rounded(t.select("device_id", "seq", F.unix_timestamp("timestamp").alias("epoch_seconds"),
                            "lat", "lon", "altitude", "speed", "heading", "is_spoofed", "source_file"))


@register("gps_time_fallback", oracle=f"""WITH {ad.cte('gps', ad.GPS_TRACK)}
SELECT * FROM (
  SELECT device_id, seq, cast(epoch(TIMESTAMP '2026-01-01 00:00:00') AS bigint)
           + row_number() OVER (PARTITION BY source_file ORDER BY seq) - 1 AS epoch_seconds,
         lat
  FROM gps) t
WHERE lat IS NOT NULL""")
def q_gps_time_fallback(spark, sf_dir):
    raw = ad.gps_raw(spark, sf_dir).withColumn("Date Time", F.lit("not a timestamp"))
    t = gp.normalize_gps(raw)
    return rounded(t.select("device_id", "seq", F.unix_timestamp("timestamp").alias("epoch_seconds"), "lat")
                    .withColumn("lat", F.col("lat")))


@register("spoof_device", oracle=f"""WITH {_TRACK}
SELECT device_id, max(is_spoofed) AS max_spoofed FROM track GROUP BY device_id
ORDER BY max_spoofed DESC, device_id LIMIT 1""")
def q_spoof_device(spark, sf_dir):
    return gp.spoof_device(track(spark, sf_dir))


@register("track_split", oracle=f"""WITH {_TRACK}
SELECT device_id, is_spoofed, count(*) AS n_rows, min(seq) AS first_seq, max(seq) AS last_seq
FROM split GROUP BY device_id, is_spoofed""")
def q_track_split(spark, sf_dir):
    s = gp.split_all_spoofed(track(spark, sf_dir))
    return s.groupBy("device_id", "is_spoofed").agg(F.count(F.lit(1)).alias("n_rows"),
                                                    F.min("seq").alias("first_seq"),
                                                    F.max("seq").alias("last_seq"))


@register("even_downsample", oracle=f"""WITH {_TRACK}
SELECT device_id, is_spoofed, seq, rn, n FROM down""")
def q_even_downsample(spark, sf_dir):
    d = gp.even_downsample(gp.split_all_spoofed(track(spark, sf_dir)))
    return d.select("device_id", "is_spoofed", "seq", "rn", "n")


@register("track_path", oracle=f"""WITH {_TRACK}
SELECT device_id, path_index, seq, is_spoofed, round(lat, 6) AS lat, round(lon, 6) AS lon, {_EPOCH},
       (path_index - 1) % 5 = 0 OR path_index = count(*) OVER (PARTITION BY device_id) AS is_marker
FROM path""")
def q_track_path(spark, sf_dir):
    p = gp.track_path(track(spark, sf_dir), marker_every=5)
    return rounded(p.select("device_id", "path_index", "seq", "is_spoofed", "lat", "lon",
                            F.unix_timestamp("timestamp").alias("epoch_seconds"), "is_marker"))


@register("track_segments", oracle=f"""WITH {_TRACK},
seg AS (SELECT device_id, path_index, is_spoofed,
               lead(is_spoofed) OVER (PARTITION BY device_id ORDER BY path_index) AS nxt FROM path)
SELECT device_id, path_index AS from_index, path_index + 1 AS to_index,
       CASE WHEN is_spoofed = 0 AND nxt = 0 THEN 'normal' WHEN is_spoofed = 0 AND nxt = 1 THEN 'transition'
            ELSE 'spoofed' END AS segment,
       CASE WHEN is_spoofed = 0 AND nxt = 0 THEN 'green' WHEN is_spoofed = 0 AND nxt = 1 THEN 'orange'
            ELSE 'red' END AS color
FROM seg WHERE nxt IS NOT NULL""")
def q_track_segments(spark, sf_dir):
    return gp.track_segments(gp.track_path(track(spark, sf_dir)))


@register("track_markers", oracle=f"""WITH {_TRACK}
SELECT device_id, round(arg_min(lat, path_index), 6) AS start_lat, round(arg_min(lon, path_index), 6) AS start_lon,
       round(arg_min(lat, CASE WHEN is_spoofed = 1 THEN path_index END), 6) AS first_spoof_lat,
       round(arg_min(lon, CASE WHEN is_spoofed = 1 THEN path_index END), 6) AS first_spoof_lon,
       round(arg_max(lat, path_index), 6) AS end_lat, round(arg_max(lon, path_index), 6) AS end_lon
FROM path GROUP BY device_id""")
def q_track_markers(spark, sf_dir):
    m = gp.track_markers(gp.track_path(track(spark, sf_dir)))
    return rounded(m.select("device_id", F.col("start.lat").alias("start_lat"), F.col("start.lon").alias("start_lon"),
                            F.col("first_spoof.lat").alias("first_spoof_lat"),
                            F.col("first_spoof.lon").alias("first_spoof_lon"),
                            F.col("end.lat").alias("end_lat"), F.col("end.lon").alias("end_lon")))


@register("map_center", oracle=f"""WITH {_TRACK}
SELECT round(avg(lat), 6) AS center_lat, round(avg(lon), 6) AS center_lon FROM path""")
def q_map_center(spark, sf_dir):
    return rounded(gp.map_center(gp.track_path(track(spark, sf_dir))))


def pretty_name(stem):
    """File stem -> display name: '_' and '-' to spaces, words capitalised
    (``initcap``: a letter after a digit stays lower case)."""
    return F.initcap(F.translate(stem, "_-", "  "))


@register("pretty_name", oracle=f"""WITH {ad.cte('gps', ad.GPS_TRACK)}
SELECT DISTINCT source_file,
  array_to_string(list_transform(string_split(lower(replace(replace(regexp_replace(source_file, '\\.[^.]*$', ''),
      '_', ' '), '-', ' ')), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS name
FROM gps""")
def q_pretty_name(spark, sf_dir):
    raw = ad.gps_raw(spark, sf_dir).select("source_file").distinct()
    return raw.select("source_file", pretty_name(F.regexp_replace("source_file", r"\.[^.]*$", "")).alias("name"))
