"""Block spectra: samples are packed where they are read, and only blocks move."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoofscope.operators import iq


def recording(spark, n, source="a", seed=1, kind="smallint"):
    r = np.random.default_rng(seed)
    x = r.integers(-3000, 3000, (n, 2))
    rows = [(source, k, int(a), int(b)) for k, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, f"source string, idx long, i {kind}, q {kind}"), x[:, 0] + 1j * x[:, 1]


def plain(x, window, hop, fs):
    """Power of every full segment, one by one."""
    out = {}
    for s in range(0, len(x) - len(window) + 1, hop):
        z = x[s:s + len(window)]
        if not np.isnan(z.real).any():
            spec = np.fft.fft((z - z.mean()) * window)
            out[s // hop] = np.abs(spec) ** 2 / (fs * (window ** 2).sum())
    return out


def power_of(df):
    return {r.seg: np.array(r.power) for r in df.collect()}


@pytest.mark.parametrize("nperseg,hop,n", [(16, 8, 3000), (16, 5, 700), (8, 8, 1111), (16, 8, 15), (32, 24, 2000)])
def test_segments_equal_a_plain_loop(spark, nperseg, hop, n):
    df, x = recording(spark, n)
    w = iq.hann_periodic(nperseg)
    want = plain(x, w, hop, 2.0)
    for given in (df, df.orderBy(F.rand(3)).repartition(5)):
        got = power_of(iq.periodograms(given, w, hop, 2.0))
        assert got.keys() == want.keys()
        for s in want:
            np.testing.assert_allclose(got[s], want[s], rtol=1e-9, atol=1e-9)
    sums = iq.periodograms(df, w, hop, 2.0, summed=True).collect()
    assert sum(r.n for r in sums) == len(want)
    if want:
        np.testing.assert_allclose(np.sum([r.power for r in sums], axis=0), sum(want.values()), rtol=1e-9)


def test_a_wide_recording_moves_blocks_not_samples(spark):
    n, hop = 400_000, 512
    df = spark.range(0, n, 1, 8).select(F.lit("w").alias("source"), F.col("id").alias("idx"), ((F.col("id") * 7919) % 2000 - 1000).cast("smallint").alias("i"),
                                        ((F.col("id") * 104729) % 2000 - 1000).cast("smallint").alias("q"))
    blocks = iq.packed_blocks(df, hop)
    batches = -(-n // 10_000) + 8
    assert blocks.count() <= n // hop + 1 + batches
    assert blocks.select(F.max(F.length("at"))).first()[0] == 4  # consecutive: the first place alone
    moved = iq.periodograms(df, iq.hann_periodic(1024), hop, 1.0, summed=True)
    plan = moved._jdf.queryExecution().executedPlan().toString()
    above, below = plan.index("Exchange"), plan.index("MapInPandas")
    assert plan.count("Exchange") == 1 and above < below  # packed before the only exchange
    full = (n - 1024) // hop + 1
    assert moved.agg(F.sum("n")).first()[0] == full and moved.count() == -(-full // iq.SPAN_BLOCKS)


def test_gaps_nulls_keys_and_empty_input(spark):
    df, x = recording(spark, 900, kind="int")
    other, _ = recording(spark, 300, None, 2, "int")
    holes = df.withColumn("i", F.when(F.col("idx") != 333, F.col("i"))).filter("idx <> 640").unionByName(other)
    y = x.astype(complex)
    y[[333, 640]] = np.nan
    w = iq.tukey_periodic(16)
    got = iq.periodograms(holes, w, 8, 1.0)
    want = plain(y, w, 8, 1.0)
    assert power_of(got.filter("source = 'a'")).keys() == want.keys()
    assert got.filter("source is null").count() == (300 - 16) // 8 + 1
    assert iq.welch_psd(df.limit(0), 16).count() == 0 and iq.spectrogram(df.limit(0), 16, 8).count() == 0


def test_parseval(spark):
    df, x = recording(spark, 4096)
    got = iq.welch_psd(df, 4096, fs=1.0).toPandas()
    w = iq.hann_periodic(4096)
    assert (10 ** (got.psd_db / 10)).sum() == pytest.approx(4096 * (np.abs((x - x.mean()) * w) ** 2).sum() / (w ** 2).sum(), rel=1e-6)


def test_small_batches_make_no_more_rows(spark):
    """Operators of the corpus have smaller batches set for the session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    df = spark.range(0, 20_000, 1, 1).select(F.lit("w").alias("source"), F.col("id").alias("idx"), F.lit(1).cast("smallint").alias("i"),
                                             F.when(F.col("id") != 7, 2).cast("smallint").alias("q"))
    was = spark.conf.get(key)
    try:
        spark.conf.set(key, "100")
        got = iq.packed_blocks(df, 1000).select("block", F.length("i").alias("n")).collect()
    finally:
        spark.conf.set(key, was)
    assert len(got) == 20 and sum(r.n for r in got) == 2 * 19_999
