import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spoofscope.llm import negatives
from spoofscope.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int"
LAST = 1 << 63


def plain(rows):
    """The contract, pair by pair."""
    rows = [(i, [math.floor(256 * float(np.float32(x))) for x in v], (k + 1) % 10 if i is not None and i % 7 == 0 else k) for i, v, k in rows
            if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: max(-(1 << 62), min(1 << 62, sum(x * y for x, y in zip(a, b))))
    out = []
    for n, (i, v, k) in enumerate(rows):
        if i is None or i % 100:
            continue
        scored = sorted(((-dot(v, w), LAST if j is None else j, j, q) for m, (j, w, q) in enumerate(rows) if m != n and len(w) == len(v)), key=lambda t: t[:2])
        for s, _, j, _ in [t for t in scored if t[3] == k][:5]:
            band = [t for t in scored if t[3] != k and 80 * -s <= 100 * -t[0] <= 100 * -s][:5]
            out += [(i, j, r, t[2], -s, -t[0]) for r, t in enumerate(band, 1)]
    return sorted(out, key=str)


def mined(df):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, negatives.hard_negatives(negatives.indexed(df, "embedding", label), F.col("vec_id") % 100 == 0).collect()), key=str)


def side(vectors):
    found = [negatives.summary(np.asarray(v, float)) for v in vectors]
    return negatives.Side(pd.DataFrame({"v": [np.asarray(v, float) for v in vectors], "means": [m for m, _ in found], "deviations": [d for _, d in found]}), len(vectors[0]))


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 40).flatmap(lambda n: st.lists(st.lists(st.integers(-1000, 1000), min_size=n, max_size=n), min_size=2, max_size=5)))
def test_bounds_hold_and_narrow(vectors):
    s = side(vectors)
    i, j = (x.ravel() for x in np.indices((len(vectors),) * 2))
    last = None
    true = np.array([np.dot(s.v[p], s.v[q]) for p, q in zip(i, j)])
    for level in range(len(negatives.LEVELS)):
        low, high = negatives.bounds(s, s, level, i, j)
        assert (low <= true).all() and (true <= high).all()
        if last is not None:
            assert (high - low <= last * (1 + 1e-6) + 1e-3).all()
        last = high - low


def test_coarse_levels_drop_pairs():
    r = np.random.default_rng(1)
    s = side(np.concatenate([r.normal(5, 0.1, (50, 64)), r.normal(-5, 0.1, (50, 64))]))
    i, j = (x.ravel() for x in np.indices((100, 100)))
    low, high = negatives.bounds(s, s, 0, i, j)
    assert (high < negatives.kth_largest(i, low, 5, 100)[i]).mean() > 0.45


def random_rows(n, dims, seed=3):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.3) for _ in range(dims)] for _ in range(4)]
    return [(i, [c + r.gauss(0, 0.1) for c in centres[i % 4]], r.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("n,dims,tile", [(420, 6, 300), (240, 33, 1 << 17)])
def test_against_all_pairs(spark, n, dims, tile, monkeypatch):
    monkeypatch.setattr(negatives, "TILE", tile)
    rows = random_rows(n, dims)
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(3)) == plain(rows)


def test_ties_copies_and_odd_rows(spark):
    same = [0.5, 0.25, -0.1]
    rows = [(i, same, i % 3) for i in range(301)] + [(100, same, 1)] * 3 + [(None, same, 1), (None, same, 2), (7, None, 1), (8, same, None), (9, [1.0, None, 2.0], 1),
            (11, [float("nan")] * 3, 1), (12, [float("inf"), 0.0, 0.0], 2), (500, [], 1), (501, [], 2), (502, [], 1), (600, [0.1, 0.2], 5), (-100, [-0.5, 0.0, 0.3], 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rid", F.lit(1)).withColumn("v", F.lit("x")).withColumn("means", F.lit(2))
    assert mined(df) == plain(rows)
    assert mined(spark.createDataFrame([], SCHEMA)) == []


def test_huge_and_long_vectors(spark):
    r = random.Random(5)
    rows = [(i, [r.choice([1, -1]) * 3e30 * r.random() for _ in range(4)], i % 2) for i in range(0, 210, 5)] + [(i, [r.random() * 1e6 for _ in range(3000)], i % 3) for i in range(1, 402, 33)]
    rows = [(i, [float(np.float32(x)) for x in v], k) for i, v, k in rows] + [(300, rows[-1][1], 1)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_query_on_the_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = QUERIES["op13_hard_negatives"](spark, d)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert dict(got.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)
