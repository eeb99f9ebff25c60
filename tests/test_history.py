"""The appendable history: equal to the batch, with only touched buckets rewritten."""

import os
import random

import pytest
from pyspark.sql import functions as F

from spoofscope.operators import trajectory as tr
from spoofscope.sources.history import History

SCHEMA = "seq long, icao24 string, time long, lat double, lon double, lastposupdate double, callsign string"


def polls(n=10, seed=1):
    """Polls of a few aircraft, some reports sent again by later polls."""
    r, seq, out, sent = random.Random(seed), 0, [], []
    for k in range(n):
        rows = []
        for _ in range(r.randrange(3, 9)):
            old = r.choice(sent) if sent and r.random() < 0.3 else None
            row = old[1:] if old else (r.choice(["a", "b", "c", None]), 1000 + 10 * k, r.choice([None, r.random()]), r.random(), float(k), "x")
            rows.append((seq, *row))
            seq += 1
        sent += rows
        out.append(rows)
    return out


def folders(table):
    return table.log.manifest(table.log.newest())["folders"]


def rows_of(df):
    return sorted(map(str, df.select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect()))


def test_polls_appended_one_by_one_equal_the_batch(spark, tmp_path):
    given = polls()
    table = History(spark, str(tmp_path), buckets=7)
    assert table.read() is None
    for k, rows in enumerate(given):
        assert table.append(spark.createDataFrame(rows, SCHEMA), k)
    every = spark.createDataFrame([x for rows in given for x in rows], SCHEMA)
    assert rows_of(table.read()) == rows_of(tr.state_dedup(every))
    half = spark.createDataFrame([x for rows in given[:5] for x in rows], SCHEMA)
    assert rows_of(table.read(4)) == rows_of(tr.state_dedup(half))  # as of an earlier append


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    table = History(spark, str(tmp_path), buckets=16)
    table.append(spark.createDataFrame([(k, f"a{k}", 1000, 1.0, 2.0, 3.0, "x") for k in range(60)], SCHEMA), 0)
    before = folders(table)
    table.append(spark.createDataFrame([(100, "a3", 1010, 1.0, 2.0, 3.0, "y"), (101, "a3", 1010, 9.0, 2.0, 3.0, "y")], SCHEMA), 1)
    after = folders(table)
    assert len(before) > 8 and before.keys() == after.keys() and sum(before[b] != after[b] for b in before) == 1
    assert table.read().count() == 61 and table.read().filter("callsign = 'y'").count() == 2


def test_replay_death_and_another_number_of_buckets(spark, tmp_path):
    table = History(spark, str(tmp_path), buckets=4)
    one, two = (spark.createDataFrame([(k, "a", 1000 + k, 1.0, float(k), 3.0, "x")], SCHEMA) for k in (1, 2))
    assert table.append(one, 0) and not table.append(two, 0) and table.read().count() == 1
    with pytest.raises(Exception):
        table.append(two.withColumn("lat", F.raise_error(F.lit("lost")).cast("double")), 1)
    assert table.read().count() == 1
    assert table.append(two, 1) and table.read().count() == 2
    assert table.append(two.limit(0), 2) and table.read().count() == 2  # an empty poll
    with pytest.raises(ValueError):
        History(spark, str(tmp_path), buckets=5).append(one, 9)


def test_retention_goes_by_time(spark, tmp_path):
    table = History(spark, str(tmp_path), buckets=8, keep_seconds=25)
    for k in range(6):
        table.append(spark.createDataFrame([(10 * k, "a", 1000 + 10 * k, 1.0, float(k), 3.0, "x"), (10 * k + 1, f"b{k}", 1000 + 10 * k, 1.0, 1.0, 3.0, "x"),
                                            (10 * k + 2, "n", None, 1.0, 1.0, 3.0, "x")], SCHEMA), k)
    got = table.read()
    assert {r.time for r in got.collect()} == {None, 1030, 1040, 1050}
    stored = spark.read.parquet(*[os.path.join(str(tmp_path), f) for f in folders(table).values()])
    assert stored.filter("icao24 = 'a' and time < 1025").count() == 0  # gone from the files that were rewritten
