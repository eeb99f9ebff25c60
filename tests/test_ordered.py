"""Chunked positions and differences must equal the plain windows exactly."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spoofscope.operators.ordered import ordered_diff, ordered_index, running, value_chunk


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(30000):
        # one key holds ~2/3 of the rows, NULL keys and times included, times tie
        k = rnd.choice(["hot"] * 20 + ["b", "c", None] + [f"k{j}" for j in range(7)])
        rows.append((k, rnd.randint(0, 3), rnd.choice([None, float(rnd.randint(-5000, 5000))]), i,
                     rnd.choice([None, rnd.random() * 100, float("nan")]), (1 << 53) + rnd.randint(0, 9)))
    return spark.createDataFrame(rows, "k string, k2 int, t double, seq long, v double, big bigint")


def same(a, b):
    assert a.dtypes == b.dtypes
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("width", [None, 10, 500, 1e6])
def test_index_equals_window(skewed, width):
    chunk = None if width is None else F.floor(F.col("t") / width)
    a = ordered_index(skewed, ["k", "k2"], ["t", "seq"], "rn", chunk, "n")
    w = Window.partitionBy("k", "k2")
    same(a, skewed.withColumn("rn", (F.row_number().over(w.orderBy("t", "seq")) - 1).cast("bigint"))
         .withColumn("n", F.count(F.lit(1)).over(w)))


@pytest.mark.parametrize("width", [None, 10, 500])
def test_diff_equals_window_with_its_types(skewed, width):
    chunk = None if width is None else F.floor(F.col("t") / width)
    a = ordered_diff(skewed, ["k"], ["t", "seq"], ["v", "t", "big"], chunk=chunk)
    w = Window.partitionBy("k").orderBy("t", "seq")
    same(a, skewed.withColumns({f"delta_{c}": F.col(c) - F.lag(c).over(w) for c in ("v", "t", "big")}))


def test_global_index(skewed):
    a = ordered_index(skewed, [], ["seq"], "rn", F.floor(F.col("seq") / 1000))
    assert [r[0] for r in a.orderBy("seq").select("rn").collect()] == list(range(skewed.count()))


def test_weights_and_value_chunks(spark):
    r = random.Random(2)
    values = sorted({r.choice([0.0, 1.0, -1.0]) * 10 ** r.uniform(-300, 300) for _ in range(500)} | {float("inf"), float("-inf"), 1.0, 1.0000001})
    df = spark.createDataFrame([(v, i % 7) for i, v in enumerate(values)], "v double, n int")
    got = running(df, [], ["v"], value_chunk(F.col("v"), 4), F.col("n"), "b", "t").orderBy("v").collect()
    assert [x.b for x in got] == [sum(i % 7 for i in range(k)) for k in range(len(values))]
    assert {x.t for x in got} == {sum(i % 7 for i in range(len(values)))}


def test_a_hot_key_is_spread_over_tasks(spark, skewed):
    """Two thirds of the rows share a key; no task numbers more than a few chunks of it."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        a = ordered_index(skewed, ["k"], ["t", "seq"], "rn", F.floor(F.col("t") / 50))
        parts = [r["count"] for r in a.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) == 8 and max(parts) < 0.6 * sum(parts)  # NULL times are one chunk of half the rows


def test_one_exchange_of_the_rows_and_no_python(spark, skewed):
    for df in (ordered_index(skewed, ["k"], ["t", "seq"], "rn", F.floor(F.col("t") / 50)),
               ordered_diff(skewed, ["k"], ["t", "seq"], ["v"], chunk=F.floor(F.col("t") / 50))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and "Python" not in plan
        assert plan.count("Window") >= 2 and "rangepartitioning" not in plan


def test_tied_scores_are_one_row_for_the_auc(spark):
    from spoofscope.operators.metrics import roc_auc
    rnd = random.Random(5)
    rows = [(int(rnd.random() < 0.3), 0.5 if rnd.random() < 0.95 else round(rnd.random(), 3)) for _ in range(20000)]
    df = spark.createDataFrame(rows, "y_true int, spoof_probability double")
    p = sorted(rows, key=lambda r: r[1])
    rank, i = {}, 0
    while i < len(p):
        j = i
        while j < len(p) and p[j][1] == p[i][1]:
            j += 1
        rank[p[i][1]] = (i + j + 1) / 2
        i = j
    n1 = sum(y for y, _ in rows)
    want = (sum(rank[s] for y, s in rows if y) - n1 * (n1 + 1) / 2) / (n1 * (len(rows) - n1))
    auc = roc_auc(df)
    assert auc.first()[0] == pytest.approx(want, abs=1e-12)
    # what a window or a single task sees are distinct scores, never rows
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = roc_auc(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for at in [k for k in range(len(plan)) if plan.startswith("Window", k)]:
        assert "partial_" in plan[at:]


def test_grouped_percentiles_match_pandas(spark):
    from spoofscope.operators.stats import grouped_percentiles
    rnd = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 5}", float(rnd.randint(0, 50)), None if i % 7 == 0 else rnd.random())
            for i in range(4000)] + [("empty", None, None)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    got = {r["g"]: r for r in grouped_percentiles(df, ["g"], ["a", "b"], {"median": 0.5, "p95": 0.95}).collect()}
    pdf = df.toPandas()
    for g, part in pdf.groupby("g"):
        for c in ("a", "b"):
            vals = part[c].dropna()
            for name, p in (("median", 0.5), ("p95", 0.95)):
                want = vals.quantile(p) if len(vals) else None
                have = got[g][f"{c}_{name}"] if g in got else None
                assert (want is None and have is None) or abs(have - want) < 1e-12, (g, c, name)
