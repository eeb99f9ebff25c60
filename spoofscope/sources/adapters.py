"""Adapters: the supplied benchmark tables re-shaped into the inputs the
operators consume.

No navigation data ships with the test corpus, so each input table of the
library is derived deterministically from a supplied table (see FIXTURES.md
part B).  Each adapter is one SQL text that is valid in Spark and in DuckDB;
only the epoch conversion differs between the engines.  Spark runs the text
with ``spark.sql(text, <table>=DataFrame)`` (no global temp views); the
oracle embeds the same text as a CTE.

Every adapter is a projection (plus one per-supplier ``row_number``) of its
source table, so its work grows linearly with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Epoch seconds of a TIMESTAMP (NTZ) column, per engine.
_UX = {
    "spark": "unix_timestamp(ts)",
    "duckdb": "cast(floor(epoch(ts)) as bigint)",
}
_SHIPUX = {
    "spark": "unix_timestamp(l_shipdate)",
    "duckdb": "cast(floor(epoch(l_shipdate)) as bigint)",
}
# Receiver rows of one PRN are ordered by the sample counter (ship day here),
# then by these columns, which make the order total.
TRACKING_ORDER = ["PRN_start_sample_count", "tie_order", "tie_line", "tie_part", "tie_price"]

# Scaling constant used by the synthetic features: it keeps averages of
# short decimals away from rounding ties so both engines agree to 1e-6.
# 1.0371923 and 1.03719237331

_K = "cast(regexp_extract(props, '([0-9]+)', 1) as int)"
_D = "cast(1.0371923 as double)"
# Altitudes use a longer factor: differences of altitudes would otherwise
# end exactly on a 7th-decimal 5 and the engines round such ties differently.
_DA = "cast(1.03719237331 as double)"

# B1: aircraft state rows (raw text columns where the live feed sends text).
ADSB_RAW = f"""
SELECT seq, snap, icao24, time, lat, lon, velocity, heading, vertrate,
       onground, spi, squawk, baroaltitude, geoaltitude, lastposupdate,
       lastcontact, callsign, origin_country, position_source, category, label
FROM (
  SELECT 2 * event_id AS seq,
         cast(floor(event_id / 200) AS bigint) AS snap,
         CASE WHEN event_id % 97 = 0 THEN NULL ELSE 'u' || cast(user_id AS string) END AS icao24,
         UX AS time,
         CASE WHEN event_id % 53 = 0 THEN NULL
              WHEN event_id % 59 = 0 THEN cast(0 AS double)
              ELSE cast(48.5 AS double) + cast(event_id * 7919 % 11000 AS double) / cast(1037.1923 AS double) END AS lat,
         CASE WHEN event_id % 53 = 0 THEN NULL
              ELSE cast(13.5 AS double) + cast(event_id * 104729 % 13500 AS double) / cast(1037.1923 AS double) END AS lon,
         CASE WHEN event_id % 41 = 0 THEN 'n/a' ELSE cast(value AS string) END AS velocity,
         cast(event_id * 37 % 360 AS double) AS heading,
         cast(event_id * 13 % 41 - 20 AS double) * {_D} AS vertrate,
         CASE event_type WHEN 'click' THEN 'True' WHEN 'view' THEN 'FALSE' WHEN 'error' THEN '1'
                         WHEN 'signup' THEN 'nan' ELSE 'maybe' END AS onground,
         CASE WHEN event_id % 7 = 0 THEN 'True' ELSE 'False' END AS spi,
         cast(1000 + event_id % 6777 AS string) AS squawk,
         CASE WHEN event_id % 11 = 0 THEN NULL
              ELSE cast(1000 + event_id * 31 % 9000 AS double) * {_DA} END AS baroaltitude,
         cast(1000 + event_id * 31 % 9000 + event_id * 17 % 300 AS double) * {_DA} AS geoaltitude,
         CASE WHEN {_K} % 17 = 0 THEN NULL ELSE cast(UX - {_K} % 90 AS double) END AS lastposupdate,
         cast(UX - {_K} % 20 AS double) AS lastcontact,
         CASE WHEN event_id % 13 = 0 THEN NULL ELSE ' CS' || cast(user_id AS string) || ' ' END AS callsign,
         'C' || cast(user_id % 5 AS string) AS origin_country,
         cast(event_id % 3 AS int) AS position_source,
         cast(event_id % 8 AS int) AS category,
         {_K} % 4 AS label
  FROM {{events}}
) base
UNION ALL
SELECT 2 * event_id + 401 AS seq,
       cast(floor(event_id / 200) AS bigint) + 1 AS snap,
       CASE WHEN event_id % 97 = 0 THEN NULL ELSE 'u' || cast(user_id AS string) END AS icao24,
       UX + 60 AS time,
       CASE WHEN event_id % 53 = 0 THEN NULL
            WHEN event_id % 59 = 0 THEN cast(0 AS double)
            ELSE cast(48.5 AS double) + cast(event_id * 7919 % 11000 AS double) / cast(1037.1923 AS double) END AS lat,
       CASE WHEN event_id % 53 = 0 THEN NULL
            ELSE cast(13.5 AS double) + cast(event_id * 104729 % 13500 AS double) / cast(1037.1923 AS double) END AS lon,
       CASE WHEN event_id % 41 = 0 THEN 'n/a' ELSE cast(value AS string) END AS velocity,
       cast(event_id * 37 % 360 AS double) AS heading,
       cast(event_id * 13 % 41 - 20 AS double) * {_D} AS vertrate,
       CASE event_type WHEN 'click' THEN 'True' WHEN 'view' THEN 'FALSE' WHEN 'error' THEN '1'
                       WHEN 'signup' THEN 'nan' ELSE 'maybe' END AS onground,
       CASE WHEN event_id % 7 = 0 THEN 'True' ELSE 'False' END AS spi,
       cast(1000 + event_id % 6777 AS string) AS squawk,
       CASE WHEN event_id % 11 = 0 THEN NULL
            ELSE cast(1000 + event_id * 31 % 9000 AS double) * {_DA} END AS baroaltitude,
       cast(1000 + event_id * 31 % 9000 + event_id * 17 % 300 AS double) * {_DA} AS geoaltitude,
       CASE WHEN {_K} % 17 = 0 THEN NULL ELSE cast(UX - {_K} % 90 AS double) END AS lastposupdate,
       cast(UX + 60 - {_K} % 20 AS double) AS lastcontact,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE ' CS' || cast(user_id AS string) || ' ' END AS callsign,
       'C' || cast(user_id % 5 AS string) AS origin_country,
       cast(event_id % 3 AS int) AS position_source,
       cast(event_id % 8 AS int) AS category,
       {_K} % 4 AS label
FROM {{events}}
WHERE event_id % 29 = 0
"""

# B2: receiver tracking rows, one row per (epoch, channel).
TRACKING_RAW = f"""
SELECT CASE l_suppkey % 4 WHEN 0 THEN 'clear_sky' WHEN 1 THEN 'spoof_1'
                          WHEN 2 THEN 'spoof_2' ELSE 'spoof_4' END || '.bin' AS source_file,
       'tracking_ch_' || cast(l_suppkey % 8 AS string) || '.csv' AS tracking_file,
       CASE l_suppkey % 4 WHEN 0 THEN 'clear_sky' WHEN 1 THEN 'spoof_1'
                          WHEN 2 THEN 'spoof_2' ELSE 'spoof_4' END AS label,
       cast(l_suppkey + 1 AS double) AS PRN,
       cast(floor(SHIPUX / 86400) AS double) + cast(2 AS double) AS PRN_start_sample_count,
       l_orderkey AS tie_order, l_linenumber AS tie_line, l_partkey AS tie_part,
       l_extendedprice AS tie_price,
       (l_extendedprice / cast(100 AS double) - cast(500 AS double)) * {_DA} AS Prompt_I,
       (l_quantity * cast(10 AS double) - cast(250 AS double)) * {_DA} AS Prompt_Q,
       cast(100 AS double) + l_quantity AS abs_E,
       cast(100 AS double) + l_quantity * (cast(1 AS double) + l_discount) AS abs_L,
       (cast(200 AS double) + l_extendedprice / cast(1000 AS double)) * {_DA} AS abs_P,
       CASE WHEN l_discount = 0 THEN cast(0 AS double)
            ELSE (cast(30 AS double) + l_tax * cast(100 AS double)) * {_DA} END AS CN0_SNV_dB_Hz,
       CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN NULL
            WHEN l_returnflag IN ('A', 'R') THEN cast(1 AS double)
            ELSE cast(0 AS double) END AS carrier_lock_test,
       (l_discount - cast(0.05 AS double)) * cast(103.719237331 AS double) AS carr_error_hz,
       (l_tax - cast(0.04 AS double)) * {_DA} AS code_error_chips,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE (l_discount - cast(0.05 AS double)) * cast(51.859618665 AS double) END AS carr_error_filt_hz,
       CASE WHEN l_linenumber = 6 THEN NULL ELSE (l_tax - cast(0.03 AS double)) * {_DA} END AS code_error_filt_chips,
       cast(l_partkey % 12000 - 6000 AS double) * {_DA} AS carrier_doppler_hz,
       cast(l_orderkey % 997 AS double) * {_DA} AS acc_carrier_phase_rad,
       cast(1023000 AS double) + cast(l_partkey % 101 - 50 AS double) * {_DA} AS code_freq_chips
FROM {{lineitem}}
"""


def sql_for(template: str, engine: str) -> str:
    """Render an adapter template for ``engine`` ('spark' or 'duckdb')."""
    text = template.replace("SHIPUX", _SHIPUX[engine]).replace("UX", _UX[engine])
    if engine == "duckdb":
        text = text.replace("{events}", "events").replace("{lineitem}", "lineitem") \
                   .replace("{embeddings}", "embeddings")
    return text


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def adsb_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw state rows (B1): text-typed ``velocity``/``onground``/``spi``/``squawk``."""
    return spark.sql(sql_for(ADSB_RAW, "spark"), events=read_table(spark, sf_dir, "events"))


def tracking_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking rows (B2) with file, label and the receiver's columns."""
    return spark.sql(sql_for(TRACKING_RAW, "spark"), lineitem=read_table(spark, sf_dir, "lineitem"))


def cte(name: str, template: str) -> str:
    """``name AS (...)`` for an oracle ``WITH`` clause."""
    return f"{name} AS ({sql_for(template, 'duckdb')})"


# B3: scored holdout rows (probability with ties, groups, labels).
SCORES = f"""
SELECT event_id AS seq, user_id AS group_id,
       'file_' || cast(user_id % 7 AS string) AS source_file,
       'track_' || cast(user_id AS string) AS tracking_file,
       'label_' || cast({_K} % 4 AS string) AS label,
       CASE WHEN {_K} % 4 <> 0 THEN 1 ELSE 0 END AS y_true,
       cast(event_id * 7919 % 1000 AS double) / cast(1000.37 AS double) AS spoof_probability
FROM {{events}}
"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(sql_for(SCORES, "spark"), events=read_table(spark, sf_dir, "events"))


# GPS track rows (device logs with mixed normal/spoofed segments).
GPS_TRACK = """
SELECT event_id AS seq, 'device_' || cast(user_id % 10 AS string) AS device_id,
       'device_' || cast(user_id % 10 AS string) || '.csv' AS source_file, ts,
       CASE WHEN event_id % 53 = 0 THEN NULL
            ELSE cast(48.5 AS double) + cast(event_id * 7919 % 11000 AS double) / cast(1037.1923 AS double) END AS lat,
       CASE WHEN event_id % 53 = 0 THEN NULL
            ELSE cast(13.5 AS double) + cast(event_id * 104729 % 13500 AS double) / cast(1037.1923 AS double) END AS lon,
       cast(event_id * 31 % 900 AS double) / cast(3.7 AS double) AS altitude,
       value AS speed,
       cast(event_id * 37 % 360 AS double) AS heading,
       CASE WHEN user_id % 10 IN (0, 1, 2) THEN 0 WHEN user_id % 10 = 9 THEN 1
            WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS is_spoofed
FROM {events}
"""


def gps_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GPS log rows under vendor-style headers (text timestamp and label)."""
    t = spark.sql(sql_for(GPS_TRACK, "spark"), events=read_table(spark, sf_dir, "events"))
    from pyspark.sql import functions as F
    return t.select(
        "seq", "source_file",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Date Time"),
        F.col("lat").cast("string").alias("GPS Latitude"), F.col("lon").cast("string").alias("Lng"),
        F.col("altitude").cast("string").alias("Alt"), F.col("speed").cast("string").alias("Speed"),
        F.col("heading").cast("string").alias("Course"),
        F.col("is_spoofed").cast("string").alias("Data Type"))


# Raw IQ samples (interleaved int16 pairs in a recording).
IQ_SAMPLES = """
SELECT 'recording_' || cast(event_id % 2 AS string) AS source,
       cast(floor(event_id / 2) AS bigint) AS idx,
       cast(event_id * 7919 % 65536 - 32768 AS smallint) AS i,
       cast(event_id * 104729 % 65536 - 32768 AS smallint) AS q
FROM {events}
"""


def iq_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(sql_for(IQ_SAMPLES, "spark"), events=read_table(spark, sf_dir, "events"))


# Observables (per epoch x PRN) from the same supplier stream as tracking rows.
OBSERVABLES = f"""
SELECT CASE l_suppkey % 4 WHEN 0 THEN 'clear_sky' WHEN 1 THEN 'spoof_1'
                          WHEN 2 THEN 'spoof_2' ELSE 'spoof_4' END || '.bin' AS source_file,
       CASE l_suppkey % 4 WHEN 0 THEN 'clear_sky' WHEN 1 THEN 'spoof_1'
                          WHEN 2 THEN 'spoof_2' ELSE 'spoof_4' END AS label,
       cast(l_suppkey + 1 AS double) AS PRN,
       CASE WHEN l_linenumber % 5 = 0 THEN cast(0 AS double) ELSE cast(1 AS double) END AS Flag_valid_pseudorange,
       cast(l_partkey % 12000 - 6000 AS double) * {_DA} AS Carrier_Doppler_hz,
       (cast(20000 AS double) + cast(l_orderkey % 5000 AS double)) * {_DA} AS Pseudorange_m,
       l_extendedprice / cast(10 AS double) * {_DA} AS Carrier_phase_cycles
FROM {{lineitem}}
"""


def observables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(sql_for(OBSERVABLES, "spark"), lineitem=read_table(spark, sf_dir, "lineitem"))


# Flight reports as a JSON feed (object, list or {"flights": [...]}).
FLIGHTS = f"""
SELECT event_id AS seq, cast(floor(event_id / 50) AS bigint) AS doc_id,
       CASE WHEN event_id % 4 = 0 THEN cast(UX AS string)
            WHEN event_id % 4 = 1 THEN strftime_placeholder
            WHEN event_id % 4 = 2 THEN 'unknown'
            ELSE NULL END AS ts_text,
       'u' || cast(user_id AS string) AS icao_address,
       cast(48.5 AS double) + cast(event_id * 7919 % 11000 AS double) / cast(1037.1923 AS double) AS latitude,
       cast(13.5 AS double) + cast(event_id * 104729 % 13500 AS double) / cast(1037.1923 AS double) AS longitude,
       value AS speed, cast(event_id * 37 % 360 AS double) AS heading,
       cast(event_id * 13 % 41 - 20 AS double) * {_D} AS vertical_rate,
       'CS' || cast(user_id AS string) AS callsign, event_type = 'click' AS on_ground,
       cast(1000 + event_id % 6777 AS string) AS squawk,
       cast(1000 + event_id * 31 % 9000 AS double) * {_DA} AS altitude_baro,
       cast(1000 + event_id * 31 % 9000 + event_id * 17 % 300 AS double) * {_DA} AS altitude_gnss
FROM {{events}}
"""
_ISO = {"spark": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")",
        "duckdb": "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"}


def flights_sql(engine: str) -> str:
    return sql_for(FLIGHTS.replace("strftime_placeholder", _ISO[engine]), engine)


def flight_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(flights_sql("spark"), events=read_table(spark, sf_dir, "events"))
