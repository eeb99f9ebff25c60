"""IQ-recording queries (samples derived from the events table)."""

from __future__ import annotations

from spoofscope.operators import iq
from spoofscope.plans.registry import register, rounded
from spoofscope.sources import adapters as ad

_IQ = ad.cte("iq", ad.IQ_SAMPLES)
_MEANS = """means AS (SELECT source, sum(cast(i AS bigint)) / count(*) AS mi,
                          sum(cast(q AS bigint)) / count(*) AS mq FROM iq GROUP BY source)"""
_DC = f"""{_IQ},
{_MEANS},
dc AS (SELECT iq.source, idx, i, q, mi, mq, i - mi AS i_dc, q - mq AS q_dc FROM iq JOIN means USING (source))"""
R = lambda e, n: f"round({e}, 6) AS {n}"
# exact integer moments (order-independent)
_MOM = """count(*) AS n, sum(cast(i AS bigint)) AS si, sum(cast(q AS bigint)) AS sq,
          sum(cast(i AS bigint) * i) AS sii, sum(cast(q AS bigint) * q) AS sqq,
          sum(cast(i AS bigint) * i + cast(q AS bigint) * q) AS sp,
          sum(cast(cast(i AS bigint) * i + cast(q AS bigint) * q AS hugeint)
              * cast(cast(i AS bigint) * i + cast(q AS bigint) * q AS hugeint)) AS spp"""
_M = lambda s: f"(cast({s} AS double) / n)"
_SD = lambda a, b: f"sqrt(greatest({_M(b)} - {_M(a)} * {_M(a)}, 0))"


def samples(spark, sf_dir):
    return ad.iq_samples(spark, sf_dir)


@register("iq_stats", oracle=f"""WITH {_IQ},
g AS (SELECT source, {_MOM},
             max(cast(i AS bigint) * i + cast(q AS bigint) * q) AS pmax,
             avg(sqrt(cast(i AS double) * i + cast(q AS double) * q)) AS amean,
             stddev_pop(sqrt(cast(i AS double) * i + cast(q AS double) * q)) AS astd
      FROM iq GROUP BY source)
SELECT source, n AS iq_samples, {R(_M('si'), 'i_mean')}, {R(_M('sq'), 'q_mean')},
       {R(_SD('si', 'sii'), 'i_std')}, {R(_SD('sq', 'sqq'), 'q_std')},
       {R('amean', 'amplitude_mean')}, {R('astd', 'amplitude_std')},
       {R(_M('sp'), 'power_mean')}, {R(_SD('sp', 'spp'), 'power_std')}, {R('cast(pmax AS double)', 'power_max')}
FROM g""")
def q_iq_stats(spark, sf_dir):
    return rounded(iq.iq_stats(samples(spark, sf_dir)))


@register("iq_quality", oracle=f"""WITH {_DC},
g AS (SELECT source, mi, mq, {_MOM}, min(i) AS imin, max(i) AS imax,
             cast(count_if(isnan(i_dc) OR isnan(q_dc)) AS bigint) AS nan_samples,
             cast(count_if(isinf(i_dc) OR isinf(q_dc)) AS bigint) AS inf_samples,
             cast(count_if(i_dc = 0 AND q_dc = 0) AS bigint) AS zero_samples,
             cast(count_if(i_dc >= 32767 OR i_dc <= -32768) AS bigint) AS clipped_after_dc,
             cast(count_if(i >= 32767 OR i <= -32768) AS bigint) AS clipped_raw
      FROM dc GROUP BY source, mi, mq)
SELECT source, n AS samples, {R(_M('si') + ' - mi', 'i_mean')}, {R(_M('sq') + ' - mq', 'q_mean')},
       {R(_SD('si', 'sii'), 'i_std')}, {R(_SD('sq', 'sqq'), 'q_std')},
       {R('imin - mi', 'i_min')}, {R('imax - mi', 'i_max')},
       nan_samples, inf_samples, zero_samples, clipped_after_dc, clipped_raw,
       {R('greatest(' + _M('sp') + ' - (mi * mi + mq * mq), 0)', 'average_power')}
FROM g""")
def q_iq_quality(spark, sf_dir):
    return rounded(iq.iq_quality(samples(spark, sf_dir)))


@register("iq_histogram", oracle=f"""WITH {_DC},
p AS (SELECT * FROM dc),
r AS (SELECT source, min(i_dc) AS mn, max(i_dc) AS mx FROM p GROUP BY source),
b AS (SELECT p.source, mn, mx,
             cast(coalesce(least(floor((i_dc - mn) / nullif((mx - mn) / 200, 0)), 199), 0) AS integer) AS bin
      FROM p JOIN r USING (source))
SELECT source, bin, count(*) AS n, {R('mn + bin * (mx - mn) / 200', 'bin_start')}
FROM b GROUP BY source, bin, mn, mx""")
def q_iq_histogram(spark, sf_dir):
    return rounded(iq.iq_histogram(samples(spark, sf_dir)))


PREFIX = 1_000  # samples shown in the time-domain view


@register("iq_prefix", oracle=f"""WITH {_IQ}
SELECT source, idx, i, q FROM iq WHERE idx < {PREFIX}""")
def q_iq_prefix(spark, sf_dir):
    return iq.iq_prefix(samples(spark, sf_dir), PREFIX)


# The SQL oracle evaluates the transform as a plain DFT (O(n^2) per segment);
# at the library's 4096-sample segments that is still a few seconds at sf0.01.
PSD_SEG, PSD_HOP = iq.PSD_NPERSEG, iq.PSD_NPERSEG // 2


@register("welch_psd", oracle=f"""WITH {_IQ},
n AS (SELECT source, count(*) AS nn FROM iq GROUP BY source),
segs AS (SELECT source, idx, cast(i AS double) AS i, cast(q AS double) AS q,
                unnest([idx // {PSD_HOP}, idx // {PSD_HOP} - 1]) AS seg FROM iq),
valid AS (SELECT s.source, seg, idx - seg * {PSD_HOP} AS m, i, q FROM segs s JOIN n USING (source)
          WHERE seg >= 0 AND seg * {PSD_HOP} + {PSD_SEG} <= nn AND idx < seg * {PSD_HOP} + {PSD_SEG}),
dm AS (SELECT source, seg, m, i - avg(i) OVER (PARTITION BY source, seg) AS i,
              q - avg(q) OVER (PARTITION BY source, seg) AS q,
              0.5 - 0.5 * cos(2 * pi() * m / {PSD_SEG}) AS w FROM valid),
dft AS (SELECT source, seg, k,
               sum(w * (i * cos(2 * pi() * ((k * m) % {PSD_SEG}) / {PSD_SEG})
                        + q * sin(2 * pi() * ((k * m) % {PSD_SEG}) / {PSD_SEG}))) AS re,
               sum(w * (q * cos(2 * pi() * ((k * m) % {PSD_SEG}) / {PSD_SEG})
                        - i * sin(2 * pi() * ((k * m) % {PSD_SEG}) / {PSD_SEG}))) AS im
        FROM dm, range(0, {PSD_SEG}) t(k) GROUP BY source, seg, k),
ps AS (SELECT source, k, avg((re * re + im * im) / (25e6 * {PSD_SEG * 3 / 8})) AS psd FROM dft GROUP BY source, k)
SELECT source, cast((k + {PSD_SEG // 2}) % {PSD_SEG} AS integer) AS freq_index,
       {R(f'CASE WHEN k < {PSD_SEG // 2} THEN k ELSE k - {PSD_SEG} END * (25e6 / {PSD_SEG})', 'freq_hz')},
       {R('10 * log10(psd + 1e-12)', 'psd_db')}
FROM ps""")
def q_welch_psd(spark, sf_dir):
    return rounded(iq.welch_psd(samples(spark, sf_dir), nperseg=PSD_SEG, hop=PSD_HOP))


SG, SH = iq.SPEC_NPERSEG, iq.SPEC_NPERSEG - iq.SPEC_OVERLAP
# the periodic Tukey window (0.25) at m / nperseg, and the density scale
_TUKEY = f"""CASE WHEN 8 * m < {SG} THEN 0.5 * (1 + cos(pi() * (8.0 * m / {SG} - 1)))
                 WHEN 8 * m > 7 * {SG} THEN 0.5 * (1 + cos(pi() * (8.0 * m / {SG} - 7))) ELSE 1.0 END"""
_SPEC_SCALE = repr(iq.FS * float((iq.tukey_periodic(SG) ** 2).sum()))


@register("spectrogram", oracle=f"""WITH {_IQ},
n AS (SELECT source, count(*) AS nn FROM iq GROUP BY source),
segs AS (SELECT source, idx, cast(i AS double) AS i, cast(q AS double) AS q,
                unnest([idx // {SH}, idx // {SH} - 1]) AS seg FROM iq),
valid AS (SELECT s.source, seg, idx - seg * {SH} AS m, i, q FROM segs s JOIN n USING (source)
          WHERE seg >= 0 AND seg * {SH} + {SG} <= nn AND idx < seg * {SH} + {SG}),
dm AS (SELECT source, seg, m, i - avg(i) OVER (PARTITION BY source, seg) AS i,
              q - avg(q) OVER (PARTITION BY source, seg) AS q, {_TUKEY} AS w FROM valid),
dft AS (SELECT source, seg, k,
               sum(w * (i * cos(2 * pi() * ((k * m) % {SG}) / {SG}) + q * sin(2 * pi() * ((k * m) % {SG}) / {SG}))) AS re,
               sum(w * (q * cos(2 * pi() * ((k * m) % {SG}) / {SG}) - i * sin(2 * pi() * ((k * m) % {SG}) / {SG}))) AS im
        FROM dm, range(0, {SG}) t(k) GROUP BY source, seg, k)
SELECT source, seg, {R(f'(seg * {SH} + {SG} / 2.0) / 25e6', 'time_s')},
       cast((k + {SG // 2}) % {SG} AS integer) AS freq_index,
       {R(f'CASE WHEN k < {SG // 2} THEN k ELSE k - {SG} END * (25e6 / {SG})', 'freq_hz')},
       {R(f'10 * log10((re * re + im * im) / {_SPEC_SCALE} + 1e-12)', 'psd_db')}
FROM dft""")
def q_spectrogram(spark, sf_dir):
    return rounded(iq.spectrogram(samples(spark, sf_dir)))
