"""Raw IQ statistics, quality checks, histograms and spectra.

Samples are rows ``(source, idx, i, q)``.  Statistics are single aggregates.
For spectra, samples are packed into binary blocks of one hop inside the task
that reads them; only blocks are shuffled.  A span of consecutive blocks, with
the few of the next span that its last segments reach into, is one bounded
group: its overlapping segments are transformed together by a NumPy FFT, and
for the PSD summed per frequency bin before they leave the task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoofscope.session import ship_package

# Sample rate and spectral parameters of the recordings.
FS = 25e6
PSD_NPERSEG = 4096
SPEC_NPERSEG = 2048
SPEC_OVERLAP = 1024
HIST_BINS = 200
INT16_MAX, INT16_MIN = 32767, -32768
DB_FLOOR = 1e-12


def _amp2(i: Column, q: Column) -> Column:
    return i * i + q * q


def _exact_moments(i: Column, q: Column) -> list[Column]:
    """Exact integer sums of int16 samples: order-independent, so results do
    not depend on partitioning.  Squares (up to 2^31) and fourth powers (up to
    2^62) are summed as DECIMAL: a BIGINT sum of squares would overflow at
    2^32 samples."""
    li, lq = i.cast("bigint"), q.cast("bigint")
    p = li * li + lq * lq
    wide = lambda c: F.sum(c.cast("decimal(20,0)"))
    return [F.count(F.lit(1)).alias("_n"), F.sum(li).alias("_si"), F.sum(lq).alias("_sq"),
            wide(li * li).alias("_sii"), wide(lq * lq).alias("_sqq"), wide(p).alias("_sp"),
            wide(p * p).alias("_spp"), F.max(p).alias("_pmax")]


def _mean(s: str) -> Column:
    return F.col(s).cast("double") / F.col("_n").cast("double")


def _pop_std(s1: str, s2: str) -> Column:
    m = _mean(s1)
    return F.sqrt(F.greatest(_mean(s2) - m * m, F.lit(0.0)))


def iq_stats(df: DataFrame, keys=("source",)) -> DataFrame:
    """Count, means and population std of I and Q, amplitude and power.
    Moments of I, Q and power come from exact integer sums."""
    i, q = F.col("i"), F.col("q")
    a = F.sqrt((i.cast("double") * i + q.cast("double") * q))
    g = df.groupBy(*keys).agg(*_exact_moments(i, q), F.avg(a).alias("amplitude_mean"),
                              F.stddev_pop(a).alias("amplitude_std"))
    return g.select(*keys, F.col("_n").alias("iq_samples"), _mean("_si").alias("i_mean"),
                    _mean("_sq").alias("q_mean"), _pop_std("_si", "_sii").alias("i_std"),
                    _pop_std("_sq", "_sqq").alias("q_std"), "amplitude_mean", "amplitude_std",
                    _mean("_sp").alias("power_mean"), _pop_std("_sp", "_spp").alias("power_std"),
                    F.col("_pmax").cast("double").alias("power_max"))


def recording_means(df: DataFrame, keys=("source",)) -> DataFrame:
    """Per recording: exact mean I and Q (integer sum / count)."""
    return df.groupBy(*keys).agg((F.sum(F.col("i").cast("bigint")) / F.count(F.lit(1))).alias("_mi"),
                                 (F.sum(F.col("q").cast("bigint")) / F.count(F.lit(1))).alias("_mq"))


def dc_removed(df: DataFrame, keys=("source",)) -> DataFrame:
    """Subtract each recording's mean I and Q (two passes: the per-source
    means are one row per source)."""
    m = recording_means(df, keys)
    return (df.join(m, list(keys))
              .withColumn("i_dc", F.col("i") - F.col("_mi")).withColumn("q_dc", F.col("q") - F.col("_mq")))


def iq_quality(df: DataFrame, keys=("source",)) -> DataFrame:
    """After DC removal: mean/std/min/max, NaN/Inf/zero counts, clipped
    samples and average power; clipping is also counted on the raw values.
    Means, std and power use the exact sums (shift identities)."""
    d = dc_removed(df, keys)
    i, q = F.col("i_dc"), F.col("q_dc")
    clip = lambda x: (x >= INT16_MAX) | (x <= INT16_MIN)
    g = d.groupBy(*keys, "_mi", "_mq").agg(
        *_exact_moments(F.col("i"), F.col("q")),
        F.min("i").alias("_imin"), F.max("i").alias("_imax"),
        F.count_if(F.isnan(i) | F.isnan(q)).alias("nan_samples"),
        F.count_if((F.abs(i) == float("inf")) | (F.abs(q) == float("inf"))).alias("inf_samples"),
        F.count_if((i == 0) & (q == 0)).alias("zero_samples"),
        F.count_if(clip(i)).alias("clipped_after_dc"),
        F.count_if(clip(F.col("i"))).alias("clipped_raw"))
    mi, mq = F.col("_mi"), F.col("_mq")
    return g.select(
        *keys, F.col("_n").alias("samples"), (_mean("_si") - mi).alias("i_mean"),
        (_mean("_sq") - mq).alias("q_mean"), _pop_std("_si", "_sii").alias("i_std"),
        _pop_std("_sq", "_sqq").alias("q_std"), (F.col("_imin") - mi).alias("i_min"),
        (F.col("_imax") - mi).alias("i_max"), "nan_samples", "inf_samples", "zero_samples",
        "clipped_after_dc", "clipped_raw",
        F.greatest(_mean("_sp") - (mi * mi + mq * mq), F.lit(0.0)).alias("average_power"))


def iq_histogram(df: DataFrame, bins: int = HIST_BINS, keys=("source",)) -> DataFrame:
    """Equal-width histogram of DC-removed I of whole recordings; the maximum
    falls in the last bin."""
    d = dc_removed(df, keys).drop("_mi", "_mq")
    r = d.groupBy(*keys).agg(F.min("i_dc").alias("_mn"), F.max("i_dc").alias("_mx"))
    j = d.join(r, list(keys))
    width = (F.col("_mx") - F.col("_mn")) / bins
    b = F.least(F.floor((F.col("i_dc") - F.col("_mn")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    b = F.coalesce(b, F.lit(0)).cast("int")
    return (j.groupBy(*keys, b.alias("bin"), "_mn", "_mx").agg(F.count(F.lit(1)).alias("n"))
              .select(*keys, "bin", "n", (F.col("_mn") + F.col("bin") * (F.col("_mx") - F.col("_mn")) / bins)
                      .alias("bin_start")))


def iq_prefix(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` samples of every recording (pruned at the reader
    when the input is an ``iq16`` scan with ``max_samples``)."""
    return df.filter(F.col("idx") < n)


# ------------------------------------------------------------------ spectra
def hann_periodic(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def tukey_periodic(n: int, alpha: float = 0.25) -> np.ndarray:
    """Periodic Tukey window (symmetric window of n+1 points, last dropped)."""
    m = n + 1
    x = np.arange(m) / (m - 1)
    w = np.ones(m)
    edge = alpha / 2
    lo = x < edge
    hi = x > 1 - edge
    w[lo] = 0.5 * (1 + np.cos(np.pi * (2 * x[lo] / alpha - 1)))
    w[hi] = 0.5 * (1 + np.cos(np.pi * (2 * x[hi] / alpha - 2 / alpha + 1)))
    return w[:n]


#: Blocks of a span, which is one task's unit of work: 64 x 2,048 samples by default.
SPAN_BLOCKS = 64
_PACKED = {"tinyint": "<i1", "smallint": "<i2", "int": "<i4", "bigint": "<i8", "float": "<f4"}


#: Samples that are packed together, however few of them a batch has.
PACK_ROWS = 10_000


def _gathered(batches):
    """The complete samples of as many batches as have ``PACK_ROWS`` rows."""
    kept, n = [], 0
    for b in batches:
        kept.append(b.dropna(subset=["idx", "i", "q"]).astype({"idx": "int64"}))
        n += len(b)
        if n >= PACK_ROWS:
            yield pd.concat(kept, ignore_index=True) if len(kept) > 1 else kept[0]
            kept, n = [], 0
    if kept:
        yield pd.concat(kept, ignore_index=True)


def packed_blocks(df: DataFrame, block: int, keys=("source",)) -> DataFrame:
    """Rows of samples -> keys, block, at, i, q: the samples of a block that
    came in the same ``PACK_ROWS`` rows or so of a task, as binary arrays; at: their places in the block
    (int32), or just the first place when they are consecutive.

    A block is one row, or two where it lies across those, when samples
    come in order; in any other order it is more rows, not another result.
    Samples with a NULL in idx, i or q are passed over.
    """
    ship_package(df.sparkSession)
    kinds = dict(df.dtypes)
    forms = {c: _PACKED.get(kinds[c], "<f8") for c in ("i", "q")}
    names = [*keys, "block", "at", "i", "q"]

    def pack(batches):
        for rows in _gathered(batches):
            rows = rows.assign(block=rows["idx"] // block).sort_values("idx", kind="stable")
            out = []
            for key, g in rows.groupby([*keys, "block"], sort=False, dropna=False):
                at = (g["idx"].to_numpy() % block).astype("<i4")
                if len(at) == at[-1] - at[0] + 1 and (np.diff(at) == 1).all():
                    at = at[:1]
                out.append((*[None if pd.isna(k) else k for k in key], at.tobytes(), *[g[c].to_numpy().astype(forms[c]).tobytes() for c in ("i", "q")]))
            if out:
                yield _frame(out, names)

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "block bigint", "at binary", "i binary", "q binary"])
    return df.select(*keys, F.col("idx").cast("bigint").alias("idx"), "i", "q").mapInPandas(pack, schema)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Plain objects, so that no column gets a type of its own when it is empty."""
    return pd.DataFrame({c: pd.Series([r[j] for r in rows], dtype=object) for j, c in enumerate(names)})


def _complex(rows: pd.DataFrame, first: int, blocks: int, block: int, forms: dict) -> np.ndarray:
    """The samples of consecutive blocks; NaN where there is none."""
    x = np.full(blocks * block, np.nan + 0j)
    for b, at, i, q in zip(rows["block"], rows["at"], rows["i"], rows["q"]):
        z = np.frombuffer(i, forms["i"]).astype(float) + 1j * np.frombuffer(q, forms["q"]).astype(float)
        places = np.frombuffer(at, "<i4")
        if len(places) < len(z):
            places = places[0] + np.arange(len(z))
        x[(b - first) * block + places] = z
    return x


def periodograms(df: DataFrame, window: np.ndarray, hop: int, fs: float, keys=("source",), summed: bool = False) -> DataFrame:
    """keys, seg, n, power: the power of every full segment (``len(window)``
    samples from ``seg * hop`` on; constant detrend, density scaling) as an
    array over the raw FFT bins; or, ``summed``, one row per span with the sum
    of its ``n`` segments.  Segments with a missing sample are not full."""
    nperseg, kinds = len(window), dict(df.dtypes)
    forms = {c: _PACKED.get(kinds[c], "<f8") for c in ("i", "q")}
    reach = math.ceil(nperseg / hop) - 1  # blocks after its first that a segment needs
    scale = 1.0 / (fs * float(np.sum(window ** 2)))
    spans = F.array_distinct(F.array(F.floor(F.col("block") / SPAN_BLOCKS), F.floor((F.col("block") - reach) / SPAN_BLOCKS)))
    if reach > SPAN_BLOCKS:
        raise ValueError(f"a segment spans more than {SPAN_BLOCKS} hops")
    blocks = packed_blocks(df, hop, keys).withColumn("span", F.explode(spans)).filter("span >= 0")

    def transform(rows: pd.DataFrame) -> pd.DataFrame:
        first = int(rows["span"].iloc[0]) * SPAN_BLOCKS
        x = _complex(rows, first, SPAN_BLOCKS + reach, hop, forms)
        held = np.concatenate([[0], np.cumsum(~np.isnan(x.real))])
        starts = np.arange(SPAN_BLOCKS) * hop
        starts = starts[held[starts + nperseg] - held[starts] == nperseg] if nperseg <= len(x) else starts[:0]
        total, n, out = np.zeros(nperseg), 0, []
        for part in np.array_split(starts, -(-len(starts) // 16) or 1):  # some at a time
            z = x[part[:, None] + np.arange(nperseg)]
            spec = np.fft.fft((z - z.mean(axis=1, keepdims=True)) * window[None, :], axis=1) if len(part) else z
            power = (spec.real ** 2 + spec.imag ** 2) * scale
            if summed:
                total, n = total + power.sum(axis=0), n + len(part)
            else:
                out += [(first + s // hop, 1, p) for s, p in zip(part.tolist(), power)]
        if summed and n:
            out = [(first, n, total)]
        own = [rows[k].iloc[0] for k in keys]
        return _frame([(*own, *r) for r in out], [*keys, "seg", "n", "power"])

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "seg bigint", "n bigint", "power array<double>"])
    return blocks.groupBy(*keys, "span").applyInPandas(transform, schema)


def _freq_axis(nperseg: int, fs: float) -> Column:
    """Shifted bin index k' and its frequency for raw FFT bin ``k``."""
    return F.when(F.col("k") < nperseg // 2, F.col("k")).otherwise(F.col("k") - nperseg) * F.lit(fs / nperseg)


def welch_psd(df: DataFrame, nperseg: int = PSD_NPERSEG, hop: int | None = None, fs: float = FS,
              keys=("source",)) -> DataFrame:
    """Two-sided Welch PSD (periodic Hann, constant detrend, density
    scaling), averaged over segments, in dB, frequency-ordered (shifted)."""
    sums = periodograms(df, hann_periodic(nperseg), hop or nperseg // 2, fs, keys, summed=True)
    p = sums.select(*keys, "n", F.posexplode("power").alias("k", "p"))
    avg = p.groupBy(*keys, "k").agg((F.sum("p") / F.sum("n")).alias("psd"))
    return avg.select(*keys, ((F.col("k") + nperseg // 2) % nperseg).cast("int").alias("freq_index"),
                      _freq_axis(nperseg, fs).alias("freq_hz"),
                      (F.lit(10.0) * F.log10(F.col("psd") + F.lit(DB_FLOOR))).alias("psd_db"))


def spectrogram(df: DataFrame, nperseg: int = SPEC_NPERSEG, overlap: int = SPEC_OVERLAP, fs: float = FS,
                keys=("source",)) -> DataFrame:
    """Per segment and frequency: PSD in dB (periodic Tukey 0.25 window,
    constant detrend, density scaling); ``time_s`` is the segment centre."""
    hop = nperseg - overlap
    each = periodograms(df, tukey_periodic(nperseg), hop, fs, keys)
    p = each.select(*keys, "seg", F.posexplode("power").alias("k", "p"))
    return p.select(*keys, "seg", ((F.col("seg") * hop + nperseg / 2) / F.lit(fs)).alias("time_s"),
                    ((F.col("k") + nperseg // 2) % nperseg).cast("int").alias("freq_index"),
                    _freq_axis(nperseg, fs).alias("freq_hz"),
                    (F.lit(10.0) * F.log10(F.col("p") + F.lit(DB_FLOOR))).alias("psd_db"))
