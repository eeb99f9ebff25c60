"""Signal-level queries: tracking rows -> windows -> features -> reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spoofscope.operators import tracking as trk
from spoofscope.operators.ordered import running, value_chunk
from spoofscope.operators.stats import percentile_at, unpivot
from spoofscope.plans.registry import register, round_half_away, rounded
from spoofscope.session import stored
from spoofscope.sources import adapters as ad

# ---------------------------------------------------------------- oracle SQL
_TRACK_CTE = ad.cte("tracking_raw", ad.TRACKING_RAW)
_CLEAN = """
clean AS (
  SELECT * EXCLUDE (PRN), cast(trunc(PRN) AS integer) AS prn FROM tracking_raw
  WHERE PRN IS NOT NULL AND PRN_start_sample_count IS NOT NULL AND Prompt_I IS NOT NULL
    AND Prompt_Q IS NOT NULL AND abs_E IS NOT NULL AND abs_L IS NOT NULL AND abs_P IS NOT NULL
    AND NOT (PRN <= 0 OR PRN_start_sample_count <= 1 OR abs_P <= 1
             OR (abs(Prompt_I) <= 1 AND abs(Prompt_Q) <= 1))
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source_file, tracking_file, prn
                               ORDER BY PRN_start_sample_count, tie_order, tie_line, tie_part, tie_price) - 1 AS rn
  FROM clean
),
exploded AS (
  SELECT *, unnest([cast(floor(rn / 250) AS bigint), cast(floor(rn / 250) AS bigint) - 1]) AS window_id
  FROM numbered
),
win AS (
  SELECT *, abs_P AS _p, (abs_E - abs_L) / (abs_E + abs_L + 1e-12) AS _bal,
         abs(abs_E - abs_L) / (abs_P + 1e-12) AS _asym,
         abs_P / ((abs_E + abs_L) / 2.0 + 1e-12) AS _dom,
         Prompt_I * Prompt_I + Prompt_Q * Prompt_Q AS _pow,
         nullif(CN0_SNV_dB_Hz, 0) AS _cn0
  FROM exploded WHERE window_id >= 0 AND rn < window_id * 250 + 500
)"""

_SQL_STAT = {
    "mean": "avg({x})", "std": "stddev_samp({x})", "median": "median({x})", "min": "min({x})",
    "max": "max({x})", "p95": "quantile_cont({x}, 0.95)", "abs_mean": "avg(abs({x}))",
}


def _s(x: str, prefix: str, stats: list[str]) -> str:
    return ",\n  ".join(f"cast({_SQL_STAT[s].format(x=x)} AS double) AS {prefix}_{s}" for s in stats)


_NULL = "cast(NULL AS double)"
_M2, _M4 = "avg(_pow)", "avg(_pow * _pow)"
_D = f"(2 * {_M2} * {_M2} - {_M4})"
_CN0_SQL = (f"CASE WHEN count(*) < 5 OR {_D} <= 0 OR {_M2} - sqrt(greatest({_D}, 0)) <= 0 THEN {_NULL} "
            f"ELSE 10 * log10(sqrt({_D}) / ({_M2} - sqrt({_D}))) + 30 END")

_FEATURES_SELECT = f"""
SELECT source_file, tracking_file, label,
  CASE WHEN label = 'clear_sky' THEN 'clear_sky' ELSE 'spoofed' END AS binary_label,
  CASE WHEN label = 'clear_sky' THEN 0 ELSE 1 END AS is_spoofed,
  1 AS tracking_valid, prn, count(*) AS n_epochs, window_id,
  window_id * 250 AS window_start_row, window_id * 250 + count(*) AS window_end_row,
  count(*) AS window_size,
  {_s('_cn0', 'cn0_original', ['mean', 'std', 'median', 'min', 'max'])},
  {_CN0_SQL} AS cn0_est_prompt,
  {_s('_p', 'prompt_abs', ['mean', 'std', 'median', 'min', 'max'])},
  {_s('Prompt_I', 'prompt_i', ['mean', 'std'])},
  {_s('Prompt_Q', 'prompt_q', ['mean', 'std'])},
  {_s('carrier_doppler_hz', 'doppler', ['mean', 'std', 'min', 'max'])},
  max(carrier_doppler_hz) - min(carrier_doppler_hz) AS doppler_range,
  avg(CASE WHEN carrier_lock_test = 1 THEN cast(1 AS double) ELSE cast(0 AS double) END) AS pll_lock_ratio,
  {_s('carr_error_hz', 'carrier_error', ['mean', 'std', 'abs_mean'])},
  cast(stddev_samp(acc_carrier_phase_rad) AS double) AS carrier_phase_std,
  {_s('carr_error_filt_hz', 'carrier_error_filt', ['mean', 'std'])},
  {_s('code_error_chips', 'code_error', ['mean', 'std', 'abs_mean'])},
  {_s('code_error_filt_chips', 'code_error_filt', ['mean', 'std', 'abs_mean'])},
  {_s('code_freq_chips', 'code_freq', ['mean', 'std'])},
  {_s('_bal', 'early_late_balance', ['mean', 'std', 'median', 'min', 'max'])},
  {_s('_asym', 'early_late_asymmetry', ['mean', 'std', 'median', 'p95', 'max'])},
  {_s('_dom', 'prompt_dominance', ['mean', 'std', 'median', 'p95', 'max'])}
FROM win
GROUP BY source_file, tracking_file, label, prn, window_id
HAVING count(*) >= 300"""

_FEATURES_CTE = f"WITH {_TRACK_CTE},{_CLEAN},\nfeatures AS ({_FEATURES_SELECT})\n"
_FEAT_COLS = ", ".join(["source_file", "tracking_file", "label", "binary_label", "is_spoofed",
                        "tracking_valid", "prn", "window_id", "window_start_row", "window_end_row",
                        "window_size"] + trk.FEATURE_COLUMNS)


def _round_sql(cols: list[str], doubles: set[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" if c in doubles else c for c in cols)


_FEATURE_DOUBLES = set(trk.FEATURE_COLUMNS) - {"n_epochs"}


# ---------------------------------------------------------------- Spark side
def tracking_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.tracking_raw(spark, sf_dir)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trk.signal_features(tracking_rows(spark, sf_dir), order=ad.TRACKING_ORDER)


@register("tracking_clean", oracle=f"""WITH {_TRACK_CTE},{_CLEAN}
SELECT source_file, tracking_file, label, prn, PRN_start_sample_count,
       round(Prompt_I, 6) AS Prompt_I, round(Prompt_Q, 6) AS Prompt_Q, round(abs_P, 6) AS abs_P,
       round(CN0_SNV_dB_Hz, 6) AS CN0_SNV_dB_Hz, carrier_lock_test
FROM clean""")
def q_tracking_clean(spark, sf_dir):
    c = trk.clean_tracking(tracking_rows(spark, sf_dir))
    return rounded(c.select("source_file", "tracking_file", "label", "prn", "PRN_start_sample_count",
                            "Prompt_I", "Prompt_Q", "abs_P", "CN0_SNV_dB_Hz", "carrier_lock_test"))


@register("tracking_windows", oracle=f"""WITH {_TRACK_CTE},{_CLEAN}
SELECT source_file, tracking_file, prn, window_id, window_id * 250 AS window_start_row,
       window_id * 250 + count(*) AS window_end_row, count(*) AS window_size,
       min(rn) AS first_row, max(rn) AS last_row,
       min(PRN_start_sample_count) AS first_sample, max(PRN_start_sample_count) AS last_sample
FROM win GROUP BY source_file, tracking_file, prn, window_id HAVING count(*) >= 300""")
def q_tracking_windows(spark, sf_dir):
    w = trk.tracking_windows(trk.clean_tracking(tracking_rows(spark, sf_dir)), order=ad.TRACKING_ORDER)
    return (w.groupBy("source_file", "tracking_file", "prn", "window_id")
             .agg(F.count(F.lit(1)).alias("window_size"), F.min("rn").alias("first_row"),
                  F.max("rn").alias("last_row"),
                  F.min("PRN_start_sample_count").alias("first_sample"),
                  F.max("PRN_start_sample_count").alias("last_sample"))
             .filter(F.col("window_size") >= trk.MIN_WINDOW_ROWS)
             .withColumn("window_start_row", F.col("window_id") * trk.WINDOW_STEP)
             .withColumn("window_end_row", F.col("window_start_row") + F.col("window_size")))


@register("window_features", oracle=_FEATURES_CTE +
          f"SELECT {_round_sql(_FEAT_COLS.split(', '), _FEATURE_DOUBLES)} FROM features")
def q_window_features(spark, sf_dir):
    return rounded(features(spark, sf_dir))


@register("cn0_estimate", oracle=_FEATURES_CTE +
          "SELECT source_file, tracking_file, prn, window_id, round(cn0_est_prompt, 6) AS cn0_est_prompt "
          "FROM features")
def q_cn0_estimate(spark, sf_dir):
    return rounded(features(spark, sf_dir).select("source_file", "tracking_file", "prn", "window_id",
                                                  "cn0_est_prompt"))


# ------------------------------------------------------------- reports (A4-A6)
REPORT_KEYS = ["source_file", "label", "binary_label", "is_spoofed"]
REPORT_EXCLUDE = {"tracking_valid", "is_spoofed", "prn", "window_id", "window_start_row", "window_end_row"}
REPORT_COLS = ["n_epochs", "window_size"] + [c for c in trk.FEATURE_COLUMNS if c != "n_epochs"]


def report_per_file(feats: DataFrame, digits: int | None = None) -> DataFrame:
    """Per dataset file: window count, distinct PRNs and mean/std/median/min/max
    of every numeric window column.

    The windows are read in long form, and their values counted per (file,
    column, value) — combined before the shuffle, so ties are one row.  The
    median comes from the running counts of the distinct values in value
    chunks, so a file with most of the windows is no task's alone; the mean
    comes from the chunks' sums, and the spread from distances to it.
    """
    gk = [*REPORT_KEYS, "_c"]
    v, n = F.col("_v"), F.col("_n")
    counts = unpivot(feats, REPORT_KEYS, [*REPORT_COLS, "prn"]).groupBy(*gk, "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(counts, gk, ["_v"], value_chunk(v), n, "_before", "_total", also={"_sum": v * n})
    low, high, part = percentile_at("_before", "_n", "_total", "_v", 0.5)
    mean, total = F.col("_sum") / F.col("_total"), F.max("_total")
    stats = ranked.groupBy(*gk).agg(
        F.max(mean).alias("mean"), F.when(total > 1, F.sqrt(F.sum(n * (v - mean) ** 2) / (total - 1))).alias("std"),
        (low + (high - low) * part).alias("median"), F.min("_v").alias("min"), F.max("_v").alias("max"), total.alias("rows"), F.count(F.lit(1)).alias("distinct"))
    names = ("mean", "std", "median", "min", "max")
    if digits is not None:  # round in long form: five expressions, not one per wide column
        stats = stats.select(*gk, *[round_half_away(F.col(c), digits).alias(c) for c in names], "rows", "distinct")
    # a map of the (fixed) columns instead of an aggregate per column and statistic
    wide = stats.groupBy(*REPORT_KEYS).agg(F.map_from_entries(F.collect_list(F.struct("_c", F.struct(*names, "rows", "distinct")))).alias("m"))
    wide = wide.select(*REPORT_KEYS, *[F.col("m")[c].alias(c) for c in [*REPORT_COLS, "prn"]])
    # every window has a PRN and an epoch count; PRNs are counted without NULLs
    return wide.select(*REPORT_KEYS, F.col("n_epochs.rows").alias("n_windows"), F.coalesce("prn.distinct", F.lit(0)).alias("n_prns"),
                       *[F.col(f"{c}.{s}").cast("double").alias(f"{c}_{s}") for c in REPORT_COLS for s in names])


def _report_sql() -> str:
    parts = ["count(window_id) AS n_windows", "count(DISTINCT prn) AS n_prns"]
    for c in REPORT_COLS:
        x = f"cast({c} AS double)"
        parts += [f"round(avg({x}), 6) AS {c}_mean", f"round(stddev_samp({x}), 6) AS {c}_std",
                  f"round(median({x}), 6) AS {c}_median", f"round(min({x}), 6) AS {c}_min",
                  f"round(max({x}), 6) AS {c}_max"]
    return (_FEATURES_CTE + "SELECT source_file, label, binary_label, is_spoofed,\n  "
            + ",\n  ".join(parts) + "\nFROM features GROUP BY source_file, label, binary_label, is_spoofed")


@register("report_per_file", oracle=_report_sql())
def q_report_per_file(spark, sf_dir):
    # written once: windows are a small part of the rows they come from, and two branches of the report read them
    return report_per_file(stored(features(spark, sf_dir)), digits=6)


def corpus_counts(feats: DataFrame) -> DataFrame:
    """Rows per label, per binary label and per file, and distinct PRNs per
    file, in one pass with GROUPING SETS."""
    return (feats.sparkSession.sql(
        """SELECT CASE WHEN grouping(binary_label) = 0 THEN 'binary_label'
                       WHEN grouping(source_file) = 0 THEN 'file' ELSE 'label' END AS level,
                  label, binary_label, source_file,
                  count(*) AS n_rows, count(DISTINCT prn) AS n_prns
           FROM {f}
           GROUP BY GROUPING SETS ((label), (binary_label), (source_file, label))""", f=feats))


@register("corpus_counts", oracle=_FEATURES_CTE + """
SELECT CASE WHEN grouping(binary_label) = 0 THEN 'binary_label'
            WHEN grouping(source_file) = 0 THEN 'file' ELSE 'label' END AS level,
       label, binary_label, source_file, count(*) AS n_rows, count(DISTINCT prn) AS n_prns
FROM features GROUP BY GROUPING SETS ((label), (binary_label), (source_file, label))""")
def q_corpus_counts(spark, sf_dir):
    return corpus_counts(features(spark, sf_dir))


SUMMARY_COLS = ["cn0_original_mean", "doppler_std", "doppler_range", "carrier_error_abs_mean",
                "code_error_abs_mean", "early_late_asymmetry_mean", "early_late_asymmetry_p95",
                "prompt_dominance_mean"]


@register("class_summary", oracle=_FEATURES_CTE + "SELECT binary_label, "
          + ", ".join(f"round(avg({c}), 6) AS {c}" for c in SUMMARY_COLS)
          + " FROM features GROUP BY binary_label")
def q_class_summary(spark, sf_dir):
    f = features(spark, sf_dir)
    cols = [c for c in SUMMARY_COLS if c in f.columns]
    return rounded(f.groupBy("binary_label").agg(*[F.avg(c).alias(c) for c in cols]))


def class_weights(df: DataFrame, target: str = "is_spoofed") -> DataFrame:
    """Balanced class weights n / (k * n_c) per class (k = number of classes)."""
    c = df.groupBy(target).agg(F.count(F.lit(1)).alias("n_class"))
    every = Window.partitionBy()  # over the per-class table: one row per class
    return c.select(target, "n_class", (F.sum("n_class").over(every)
                                        / (F.count(F.lit(1)).over(every) * F.col("n_class"))).alias("weight"))


@register("class_weights", oracle=_FEATURES_CTE + """
SELECT is_spoofed, count(*) AS n_class,
       round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
FROM features GROUP BY is_spoofed""")
def q_class_weights(spark, sf_dir):
    return rounded(class_weights(features(spark, sf_dir)))


# ------------------------------------------------------- A3, P16, U1, S9
_OBS_CTE = ad.cte("obs", ad.OBSERVABLES)
_OBS_STAT = lambda c, p: (f"round(avg({c}), 6) AS {p}_mean, round(stddev_samp({c}), 6) AS {p}_std")


@register("observables_features", oracle=f"""WITH {_OBS_CTE}
SELECT source_file, label, CASE WHEN label = 'clear_sky' THEN 'clear_sky' ELSE 'spoofed' END AS binary_label,
       CASE WHEN label = 'clear_sky' THEN 0 ELSE 1 END AS is_spoofed,
       cast(trunc(PRN) AS integer) AS prn, count(*) AS obs_n_epochs,
       {_OBS_STAT('Carrier_Doppler_hz', 'obs_doppler')}, {_OBS_STAT('Pseudorange_m', 'obs_pseudorange')},
       {_OBS_STAT('Carrier_phase_cycles', 'obs_carrier_phase')}
FROM obs WHERE Flag_valid_pseudorange = 1 AND PRN IS NOT NULL
GROUP BY source_file, label, cast(trunc(PRN) AS integer)""")
def q_observables_features(spark, sf_dir):
    return rounded(trk.observables_features(ad.observables(spark, sf_dir)))


@register("signal_label", oracle=f"""WITH {_TRACK_CTE}
SELECT DISTINCT label, CASE WHEN label = 'clear_sky' THEN 'clear_sky' ELSE 'spoofed' END AS binary_label,
       CASE WHEN label = 'clear_sky' THEN 0 ELSE 1 END AS is_spoofed FROM tracking_raw""")
def q_signal_label(spark, sf_dir):
    return tracking_rows(spark, sf_dir).select("label", *trk.signal_label(F.col("label"))).distinct()


@register("all_features", oracle=_FEATURES_CTE + """
SELECT source_file, label, binary_label, prn, window_id, n_epochs, round(prompt_abs_mean, 6) AS prompt_abs_mean
FROM features""")
def q_all_features(spark, sf_dir):
    """Features of all datasets in one scan: windows never mix files, so the
    concatenation of per-dataset features is the features of all rows."""
    return rounded(features(spark, sf_dir).select("source_file", "label", "binary_label", "prn", "window_id", "n_epochs",
                                                  "prompt_abs_mean"))


@register("ragged_arrays", oracle="""
SELECT vec_id, row_index, round(prompt, 6) AS prompt, round(doppler, 6) AS doppler FROM (
  SELECT vec_id, unnest(range(0, greatest(len(embedding), 8 + label))) AS row_index,
         unnest(list_transform(embedding, lambda x: cast(x AS double))) AS prompt,
         unnest(list_transform(embedding[1:8 + label], lambda x: cast(x AS double) * 2)) AS doppler
  FROM embeddings)""")
def q_ragged_arrays(spark, sf_dir):
    e = ad.read_table(spark, sf_dir, "embeddings")
    dump = e.select("vec_id",
                    F.transform("embedding", lambda x: x.cast("double")).alias("tracking/prompt"),
                    F.transform(F.slice("embedding", 1, F.col("label") + 8),
                                lambda x: x.cast("double") * 2).alias("tracking/doppler"))
    r = trk.ragged_rows(dump, "vec_id", ["tracking/prompt", "tracking/doppler"])
    return rounded(r.select("vec_id", F.col("row_index").cast("bigint").alias("row_index"),
                            F.col("tracking_prompt").alias("prompt"), F.col("tracking_doppler").alias("doppler")))
