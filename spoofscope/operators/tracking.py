"""Receiver tracking rows -> overlapping row windows -> per-window features.

Input: one row per (epoch, channel) with the receiver's correlator outputs.
``clean_tracking`` validates rows, ``tracking_windows`` assigns each row to the
(at most ``ceil(size/step)``) overlapping windows that contain it, and
``window_features`` reduces every window to one feature row with a single
``groupBy().agg()``.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoofscope.functions.coerce import coerce_columns, finite_or_null, is_finite, numeric
from spoofscope.operators.ordered import ordered_index

# Fixed values (receiver dump columns and defaults of the windowing scheme).
REQUIRED_COLUMNS = ["PRN", "PRN_start_sample_count", "Prompt_I", "Prompt_Q", "abs_E", "abs_L", "abs_P"]
OPTIONAL_COLUMNS = ["CN0_SNV_dB_Hz", "carrier_doppler_hz", "carrier_lock_test", "carr_error_hz",
                    "carr_error_filt_hz", "acc_carrier_phase_rad", "code_error_chips",
                    "code_error_filt_chips", "code_freq_chips"]
WINDOW_SIZE = 500
WINDOW_STEP = 250
MIN_WINDOW_ROWS = 300
MIN_TRACKING_ROWS = 100
CLEAR_LABEL = "clear_sky"
GROUP_KEYS = ["source_file", "tracking_file", "prn"]
BLOCK_MERGE_MIN_COPIES = 4
EPS = 1e-12


FEATURE_COLUMNS = [
    "n_epochs", "cn0_original_mean", "cn0_original_std", "cn0_original_median", "cn0_original_min",
    "cn0_original_max", "cn0_est_prompt", "prompt_abs_mean", "prompt_abs_std", "prompt_abs_median",
    "prompt_abs_min", "prompt_abs_max", "prompt_i_mean", "prompt_i_std", "prompt_q_mean", "prompt_q_std",
    "doppler_mean", "doppler_std", "doppler_min", "doppler_max", "doppler_range", "pll_lock_ratio",
    "carrier_error_mean", "carrier_error_std", "carrier_error_abs_mean", "carrier_phase_std",
    "carrier_error_filt_mean", "carrier_error_filt_std", "code_error_mean", "code_error_std",
    "code_error_abs_mean", "code_error_filt_mean", "code_error_filt_std", "code_error_filt_abs_mean",
    "code_freq_mean", "code_freq_std", "early_late_balance_mean", "early_late_balance_std",
    "early_late_balance_median", "early_late_balance_min", "early_late_balance_max",
    "early_late_asymmetry_mean", "early_late_asymmetry_std", "early_late_asymmetry_median",
    "early_late_asymmetry_p95", "early_late_asymmetry_max", "prompt_dominance_mean",
    "prompt_dominance_std", "prompt_dominance_median", "prompt_dominance_p95", "prompt_dominance_max",
]


def clean_tracking(df: DataFrame, coerce: bool = True) -> DataFrame:
    """Validate tracking rows.

    Every receiver column is coerced to DOUBLE (unparseable -> NULL), rows
    missing a required value are dropped, and so are rows with PRN <= 0,
    sample count <= 1, |P| <= 1, or both |I| <= 1 and |Q| <= 1.  When a
    required column is absent the result is empty (same schema).  Adds
    ``prn`` (INT, truncated).
    """
    # Spark resolves names case-insensitively (``prn`` replaces ``PRN``), so
    # presence is checked the same way; cleaning twice is a no-op.
    present = {c.lower(): c for c in df.columns}
    missing = [c for c in REQUIRED_COLUMNS if c.lower() not in present]
    if missing:
        return df.limit(0).withColumn("prn", F.lit(None).cast("int"))
    types = dict(df.dtypes)
    parsed = {present[c.lower()]: numeric(F.col(c), types[present[c.lower()]]) if coerce else F.col(c)
              for c in REQUIRED_COLUMNS + OPTIONAL_COLUMNS if c.lower() in present}
    value = {c: parsed[present[c.lower()]] for c in REQUIRED_COLUMNS}
    # The conditions stand on the raw columns, each read as few times as can
    # be: the optimizer would copy whole coerced columns into them, and a
    # filter of that size is too large for the JIT compiler.
    valid = (value["PRN"] > 0) & (value["PRN_start_sample_count"] > 1) & (value["abs_P"] > 1) & ((F.abs(value["Prompt_I"]) > 1) | (F.abs(value["Prompt_Q"]) > 1))
    for c in REQUIRED_COLUMNS:
        valid = valid & (is_finite(value[c]) if coerce else value[c].isNotNull())
    df = df.filter(valid)
    if coerce:
        df = df.withColumns({c: finite_or_null(v) for c, v in parsed.items()})
    return df.withColumn("prn", F.col("PRN").cast("int"))


#: Sample counts per chunk: about 86 s of a channel at 25 MS/s.
CHUNK_SAMPLES = 1 << 31


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence, chunk_samples: int) -> DataFrame:
    """Rows with ``rn``, their position in the channel, and ``group_rows``, the channel's rows."""
    chunk = F.floor(F.col("PRN_start_sample_count") / F.lit(chunk_samples))
    return ordered_index(df, list(keys), list(order), "rn", chunk=chunk, count_col="group_rows")


def tracking_windows(df: DataFrame, size: int = WINDOW_SIZE, step: int = WINDOW_STEP,
                     keys: Sequence[str] = GROUP_KEYS,
                     order: Sequence = ("PRN_start_sample_count",),
                     chunk_samples: int = CHUNK_SAMPLES) -> DataFrame:
    """Emit each row once per overlapping window that contains it.

    Windows start at 0, step, 2*step, ... within each key group (rows numbered
    by ``order``) and span ``size`` rows.  Adds ``rn`` (row position) and
    ``window_id``.  Rows are numbered in chunks of ``chunk_samples`` sample
    counts (``ordered_index``), so a long recording is spread over tasks.
    """
    copies = math.ceil(size / step)
    df = numbered(df, keys, order, chunk_samples)
    last = F.floor(F.col("rn") / F.lit(step))
    # plain array + filter (code-generated) rather than a lambda filter
    cands = F.array(*[last - F.lit(j) for j in range(copies)])
    w = F.col("window_id")
    return (df.withColumn("window_id", F.explode(cands))
              .filter((w >= 0) & (F.col("rn") < w * F.lit(step) + F.lit(size))))


def _opt(df: DataFrame, name: str) -> Column:
    """Column if present, else a typed NULL (absent columns give NULL stats)."""
    return F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")


def _sorted_quantile(arr: Column, p: float) -> Column:
    """Linear-interpolation quantile of a sorted array (NULL when empty)."""
    n = F.size(arr)
    pos = F.lit(p) * (n - 1)
    lo, hi = F.floor(pos), F.ceil(pos)
    a, b = F.get(arr, lo.cast("int")), F.get(arr, hi.cast("int"))
    return F.when(n > 0, a + (b - a) * (pos - lo))


# Quantiles inside a window are read from the window's sorted values: a
# window holds at most ``size`` rows, so the array is bounded, and sorting a
# small array is cheaper than the hash-map buffer of ``percentile``.
_QUANTILES = {"median": 0.5, "p95": 0.95}


def _stats(x: Column, prefix: str, which: Sequence[str]) -> list[Column]:
    fns = {
        "mean": lambda c: F.avg(c), "std": lambda c: F.stddev_samp(c),
        "min": lambda c: F.min(c), "max": lambda c: F.max(c), "abs_mean": lambda c: F.avg(F.abs(c)),
    }
    out = [fns[w](x).cast("double").alias(f"{prefix}_{w}") for w in which if w not in _QUANTILES]
    wanted = [w for w in which if w in _QUANTILES]
    if wanted:  # one list serves all of a column's quantiles
        out.append(F.collect_list(x).alias("_".join(["_list", *wanted, prefix])))
    return out


def _finish_quantiles(df: DataFrame) -> DataFrame:
    """Quantiles from the collected lists, each sorted once."""
    lists = [c for c in df.columns if c.startswith("_list_")]
    df = df.withColumns({c: F.sort_array(c) for c in lists})
    exprs = {}
    for c in lists:
        parts = c[len("_list_"):].split("_")
        wanted = [w for w in parts if w in _QUANTILES]
        prefix = "_".join(parts[len(wanted):])
        exprs |= {f"{prefix}_{w}": _sorted_quantile(F.col(c), _QUANTILES[w]).cast("double") for w in wanted}
    return df.withColumns(exprs).drop(*lists)


def cn0_estimate(p: Column, tint: float = 1e-3) -> Column:
    """C/N0 (dB-Hz) from prompt power p = I^2 + Q^2 with the moments (M2, M4)
    estimator: NULL for fewer than 5 rows or a non-positive signal/noise split."""
    m2 = F.avg(p)
    m4 = F.avg(p * p)
    d = F.lit(2.0) * m2 * m2 - m4
    noise = m2 - F.sqrt(d)
    est = F.lit(10.0) * F.log10(F.sqrt(d) / noise) - F.lit(10.0 * math.log10(tint))
    return (F.when((F.count(F.lit(1)) < 5) | (d <= 0) | (noise <= 0), F.lit(None).cast("double"))
             .otherwise(est))


def _inputs(df: DataFrame, keys: Sequence[str], extra: Sequence[str]) -> DataFrame:
    """Per-row quantities the features are built from (absent optional
    columns become typed NULLs)."""
    E, L, P = F.col("abs_E"), F.col("abs_L"), F.col("abs_P")
    I, Q = F.col("Prompt_I"), F.col("Prompt_Q")
    return df.select(
        *[F.col(k) for k in keys], "label", *extra, I.alias("_i"), Q.alias("_q"), P.alias("_p"),
        ((E - L) / (E + L + F.lit(EPS))).alias("_bal"),
        (F.abs(E - L) / (P + F.lit(EPS))).alias("_asym"),
        (P / ((E + L) / F.lit(2.0) + F.lit(EPS))).alias("_dom"),
        (I * I + Q * Q).alias("_pow"),
        F.nullif(_opt(df, "CN0_SNV_dB_Hz"), F.lit(0.0)).alias("_cn0"),
        _opt(df, "carrier_doppler_hz").alias("_dop"),
        _opt(df, "carrier_lock_test").alias("_lock"),
        _opt(df, "carr_error_hz").alias("_cerr"),
        _opt(df, "carr_error_filt_hz").alias("_cerrf"),
        _opt(df, "acc_carrier_phase_rad").alias("_phase"),
        _opt(df, "code_error_chips").alias("_derr"),
        _opt(df, "code_error_filt_chips").alias("_derrf"),
        _opt(df, "code_freq_chips").alias("_cfreq"),
    )


# (input column, feature prefix, statistics) — the 51-feature layout.
_LAYOUT = [
    ("_cn0", "cn0_original", ["mean", "std", "median", "min", "max"]),
    ("_p", "prompt_abs", ["mean", "std", "median", "min", "max"]),
    ("_i", "prompt_i", ["mean", "std"]),
    ("_q", "prompt_q", ["mean", "std"]),
    ("_dop", "doppler", ["mean", "std", "min", "max"]),
    ("_cerr", "carrier_error", ["mean", "std", "abs_mean"]),
    ("_phase", "carrier_phase", ["std"]),
    ("_cerrf", "carrier_error_filt", ["mean", "std"]),
    ("_derr", "code_error", ["mean", "std", "abs_mean"]),
    ("_derrf", "code_error_filt", ["mean", "std", "abs_mean"]),
    ("_cfreq", "code_freq", ["mean", "std"]),
    ("_bal", "early_late_balance", ["mean", "std", "median", "min", "max"]),
    ("_asym", "early_late_asymmetry", ["mean", "std", "median", "p95", "max"]),
    ("_dom", "prompt_dominance", ["mean", "std", "median", "p95", "max"]),
]


def _finish(feats: DataFrame, windows_src: DataFrame, keys: Sequence[str], step: int,
            min_rows: int, min_group_rows: int) -> DataFrame:
    feats = feats.filter(F.col("n_epochs") >= min_rows)
    if min_group_rows > min_rows:
        # Only needed when a group gate is stricter than the window gate;
        # otherwise a kept window already proves its file and PRN are big enough.
        # Rows are there once per window, so the gate reads the channel's own count.
        sizes = windows_src.groupBy(*keys).agg(F.max("group_rows").alias("_n"))
        feats = feats.join(sizes, list(keys)).filter(F.col("_n") >= min_group_rows).drop("_n")
    is_clear = F.col("label") == F.lit(CLEAR_LABEL)
    start = F.col("window_id") * F.lit(step)
    return feats.select(
        *[F.col(k) for k in keys[:-1]], "label",
        F.when(is_clear, F.lit(CLEAR_LABEL)).otherwise(F.lit("spoofed")).alias("binary_label"),
        F.when(is_clear, F.lit(0)).otherwise(F.lit(1)).alias("is_spoofed"),
        F.lit(1).alias("tracking_valid"),
        F.col(keys[-1]),
        "n_epochs", F.col("window_id").cast("bigint").alias("window_id"),
        start.cast("bigint").alias("window_start_row"),
        (start + F.col("n_epochs")).cast("bigint").alias("window_end_row"),
        F.col("n_epochs").alias("window_size"),
        *[F.col(c).cast("double").alias(c) for c in FEATURE_COLUMNS if c != "n_epochs"],
    )


def window_features(windows: DataFrame, min_rows: int = MIN_WINDOW_ROWS,
                    min_group_rows: int = MIN_TRACKING_ROWS, tint: float = 1e-3,
                    keys: Sequence[str] = GROUP_KEYS, step: int = WINDOW_STEP) -> DataFrame:
    """One feature row per kept window (>= ``min_rows`` rows) from exploded
    window rows (``tracking_windows``): a single ``groupBy().agg()``.

    The 51 features: C/N0 statistics and estimate, prompt statistics, Doppler,
    PLL/carrier, DLL/code and correlator-distortion statistics.  Columns absent
    from the input yield NULL features.
    """
    w = _inputs(windows, keys, ["window_id"])
    has_lock = "carrier_lock_test" in windows.columns
    lock_ratio = (F.avg(F.when(F.col("_lock") == 1, 1.0).otherwise(0.0)) if has_lock
                  else F.lit(None).cast("double"))
    aggs = [F.count(F.lit(1)).alias("n_epochs"), cn0_estimate(F.col("_pow"), tint).alias("cn0_est_prompt"),
            (F.max("_dop") - F.min("_dop")).alias("doppler_range"), lock_ratio.alias("pll_lock_ratio")]
    for col, prefix, which in _LAYOUT:
        aggs += _stats(F.col(col), prefix, which)
    feats = _finish_quantiles(w.groupBy(*keys, "label", "window_id").agg(*aggs))
    return _finish(feats, windows, keys, step, min_rows, min_group_rows)


def block_features(rows: DataFrame, size: int = WINDOW_SIZE, step: int = WINDOW_STEP,
                   min_rows: int = MIN_WINDOW_ROWS, min_group_rows: int = MIN_TRACKING_ROWS,
                   tint: float = 1e-3, keys: Sequence[str] = GROUP_KEYS) -> DataFrame:
    """Same result as ``window_features(tracking_windows(...))`` when ``size``
    is a multiple of ``step``, with every row aggregated once.

    Rows (numbered ``rn``) are reduced per block of ``step`` rows to mergeable
    partials — count, mean, M2 (centred sum of squares), min, max, sum of
    |x|, prompt-power moments and, for quantile columns, the block's values.
    Window ``w`` is blocks ``w .. w+k-1``; its partials (k of them) are merged
    with the stable parallel-variance formula and its quantiles read from the
    merged sorted values (bounded by the window size).
    """
    k = size // step
    x = _inputs(rows, keys, ["rn"]).withColumn("_blk", F.floor(F.col("rn") / F.lit(step)))
    has_lock = "carrier_lock_test" in rows.columns
    cols = sorted({c for c, _, _ in _LAYOUT})
    qcols = sorted({c for c, _, which in _LAYOUT if set(which) & set(_QUANTILES)})
    part = [F.count(F.lit(1)).alias("rows"),
            F.sum("_pow").alias("sp"), F.sum(F.col("_pow") * F.col("_pow")).alias("spp"),
            F.count_if(F.col("_lock") == 1).alias("lock1")]
    for c in cols:
        part += [F.count(c).alias(f"n{c}"), F.sum(c).alias(f"s{c}"), F.avg(c).alias(f"m{c}"),
                 (F.var_pop(c) * F.count(c)).alias(f"q{c}"), F.min(c).alias(f"lo{c}"),
                 F.max(c).alias(f"hi{c}"), F.sum(F.abs(c)).alias(f"a{c}")]
    for c in qcols:
        part.append(F.collect_list(c).alias(f"v{c}"))
    blocks = x.groupBy(*keys, "label", F.col("_blk").alias("blk")).agg(*part)
    fields = ["blk"] + [c for c in blocks.columns if c not in set(keys) | {"label", "blk"}]
    cand = F.array(*[F.col("blk") - F.lit(j) for j in range(k)])
    exploded = (blocks.withColumn("window_id", F.explode(cand)).filter(F.col("window_id") >= 0)
                      .select(*keys, "label", "window_id", F.struct(*fields).alias("_part")))
    win = exploded.groupBy(*keys, "label", "window_id").agg(
        F.sort_array(F.collect_list("_part")).alias("parts"))
    parts = F.col("parts")

    def total(f: str, init=None):
        z = F.lit(0.0) if init is None else init
        return F.aggregate(parts, z, lambda a, p: a + F.coalesce(p[f].cast("double"), F.lit(0.0)))

    n_rows = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a + p["rows"])

    def count_of(c):
        return F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a + p[f"n{c}"])

    def weighted_sum(c):
        return F.aggregate(parts, F.lit(0.0), lambda a, p: a + F.coalesce(p[f"s{c}"], F.lit(0.0)))

    def centred(c, mean):
        return F.aggregate(parts, F.lit(0.0), lambda a, p: a + F.coalesce(p[f"q{c}"], F.lit(0.0))
                           + p[f"n{c}"] * F.pow(F.coalesce(p[f"m{c}"], F.lit(0.0)) - F.coalesce(mean, F.lit(0.0)), 2))

    def field(c, prefix):
        return F.transform(parts, lambda p: p[f"{prefix}{c}"])

    def abs_sum(c):
        return F.aggregate(parts, F.lit(0.0), lambda a, p: a + F.coalesce(p[f"a{c}"], F.lit(0.0)))

    win = win.select(*keys, "label", "window_id", "parts", n_rows.alias("n_epochs"),
                     *[count_of(c).alias(f"_n{c}") for c in cols],
                     *[(weighted_sum(c) / F.nullif(count_of(c), F.lit(0))).alias(f"_m{c}") for c in cols])
    feats = {}
    for c in cols:
        n, mean = F.col(f"_n{c}"), F.col(f"_m{c}")
        m2 = centred(c, mean)
        feats[c] = {"mean": mean, "std": F.when(n > 1, F.sqrt(m2 / (n - 1))),
                    "min": F.array_min(field(c, "lo")), "max": F.array_max(field(c, "hi")),
                    "abs_mean": abs_sum(c) / F.nullif(n, F.lit(0))}
        if c in qcols:
            vals = F.array_sort(F.flatten(field(c, "v")))
            feats[c]["median"] = _sorted_quantile(vals, _QUANTILES["median"])
            feats[c]["p95"] = _sorted_quantile(vals, _QUANTILES["p95"])
    nn = F.col("n_epochs").cast("double")
    m2p, m4p = total("sp") / nn, total("spp") / nn
    d = F.lit(2.0) * m2p * m2p - m4p
    noise = m2p - F.sqrt(d)
    cn0 = (F.when((F.col("n_epochs") < 5) | (d <= 0) | (noise <= 0), F.lit(None).cast("double"))
            .otherwise(F.lit(10.0) * F.log10(F.sqrt(d) / noise) - F.lit(10.0 * math.log10(tint))))
    sel = [*keys, "label", "window_id", "n_epochs", cn0.alias("cn0_est_prompt"),
           (feats["_dop"]["max"] - feats["_dop"]["min"]).alias("doppler_range"),
           ((total("lock1") / nn) if has_lock else F.lit(None).cast("double")).alias("pll_lock_ratio")]
    for col, prefix, which in _LAYOUT:
        sel += [feats[col][w].alias(f"{prefix}_{w}") for w in which]
    return _finish(win.select(*sel), rows, keys, step, min_rows, min_group_rows)


def signal_features(df: DataFrame, size: int = WINDOW_SIZE, step: int = WINDOW_STEP,
                    order: Sequence = ("PRN_start_sample_count",), chunk_samples: int = CHUNK_SAMPLES,
                    keys: Sequence[str] = GROUP_KEYS, **kw) -> DataFrame:
    """Clean -> number rows -> per-window features (the E1 feature stage).

    Rows are copied into the ``k = ceil(size/step)`` windows that hold them
    and aggregated once per window (``tracking_windows`` +
    ``window_features``).  For heavily overlapping windows (k above
    ``BLOCK_MERGE_MIN_COPIES``, size a multiple of step) copying every row k
    times costs more than merging per-block partials, so ``block_features``
    is used instead.  Measured at the defaults (k = 2) the copy path is about
    3.5x faster.
    """
    clean = clean_tracking(df)
    if size % step == 0 and size // step > BLOCK_MERGE_MIN_COPIES:
        rows = numbered(clean, keys, order, chunk_samples)
        return block_features(rows, size=size, step=step, keys=keys, **kw)
    win = tracking_windows(clean, size=size, step=step, keys=keys, order=order, chunk_samples=chunk_samples)
    return window_features(win, keys=keys, step=step, **kw)


OBSERVABLE_COLUMNS = ["PRN", "Flag_valid_pseudorange", "Carrier_Doppler_hz", "Pseudorange_m",
                      "Carrier_phase_cycles"]


def observables_features(obs: DataFrame, keys: Sequence[str] = ("source_file", "label")) -> DataFrame:
    """Per (dataset, PRN): epoch count and mean/std of Doppler, pseudorange
    and carrier phase over epochs with a valid pseudorange (all epochs when
    the flag column is absent).  No PRN column -> empty result."""
    keys = list(keys)
    if "PRN" not in obs.columns:
        return obs.limit(0).select(*keys, F.lit(None).cast("int").alias("prn"))
    obs = coerce_columns(obs, [c for c in OBSERVABLE_COLUMNS if c in obs.columns])
    if "Flag_valid_pseudorange" in obs.columns:
        obs = obs.filter(F.col("Flag_valid_pseudorange") == 1)
    obs = obs.filter(F.col("PRN").isNotNull())
    g = obs.groupBy(*keys, F.col("PRN").cast("int").alias("prn")).agg(
        F.count(F.lit(1)).alias("obs_n_epochs"),
        *_stats(_opt(obs, "Carrier_Doppler_hz"), "obs_doppler", ["mean", "std"]),
        *_stats(_opt(obs, "Pseudorange_m"), "obs_pseudorange", ["mean", "std"]),
        *_stats(_opt(obs, "Carrier_phase_cycles"), "obs_carrier_phase", ["mean", "std"]))
    is_clear = F.col("label") == F.lit(CLEAR_LABEL)
    return g.select(*keys, F.when(is_clear, CLEAR_LABEL).otherwise("spoofed").alias("binary_label"),
                    F.when(is_clear, 0).otherwise(1).alias("is_spoofed"), "prn", "obs_n_epochs",
                    *[c for c in g.columns if c.startswith("obs_") and c != "obs_n_epochs"])


def signal_label(label: Column) -> list[Column]:
    """Dataset label -> (binary_label, is_spoofed)."""
    clear = label == F.lit(CLEAR_LABEL)
    return [F.when(clear, CLEAR_LABEL).otherwise("spoofed").alias("binary_label"),
            F.when(clear, 0).otherwise(1).alias("is_spoofed")]


def union_features(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate per-dataset feature tables; columns missing from one
    table are NULL in its rows."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def ragged_rows(df: DataFrame, key: str, arrays: Sequence[str]) -> DataFrame:
    """Named numeric arrays of unequal length (one row per dump) -> one row
    per position, shorter arrays padded with NULL (``arrays_zip`` +
    ``inline``); '/' in names becomes '_'."""
    names = {a: a.replace("/", "_") for a in arrays}
    z = F.arrays_zip(*[F.col(f"`{a}`").alias(names[a]) for a in arrays])
    return (df.select(key, F.posexplode(z).alias("row_index", "_z"))
              .select(key, "row_index", *[F.col(f"_z.{names[a]}").alias(names[a]) for a in arrays]))
