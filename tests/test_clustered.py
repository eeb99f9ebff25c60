"""States stored by place: an area's scan skips most row groups."""

import glob
import math
import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from spoofscope.operators import trajectory as tr
from spoofscope.sources import clustered

AREA = (49.0, 14.0, 51.0, 17.0)


def states(spark, n=60_000, seed=1):
    return spark.range(0, n, 1, 6).select(F.col("id").alias("seq"), (F.rand(seed) * 180 - 90).alias("lat"), (F.rand(seed + 1) * 360 - 180).alias("lon"),
                                          F.md5(F.col("id").cast("string")).alias("icao24"))


def test_place_key_interleaves_bits(spark):
    r = random.Random(1)
    rows = [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(200)] + [(90.0, 180.0), (-90.0, -180.0), (None, 1.0), (1.0, math.nan), (200.0, -999.0)]
    got = spark.createDataFrame(rows, "lat double, lon double").select("lat", "lon", clustered.place_key(F.col("lat"), F.col("lon")).alias("k")).collect()

    def plain(lat, lon):
        if lat is None or lon is None or lat != lat or lon != lon:
            return None
        a, b = (int(min(max((x - low) / (high - low), 0), 1) * 65535) for x, low, high in ((lat, -90, 90), (lon, -180, 180)))
        return sum((a >> i & 1) << 2 * i | (b >> i & 1) << 2 * i + 1 for i in range(16))
    assert [x.k for x in got] == [plain(x.lat, x.lon) for x in got]


def test_an_area_reads_few_row_groups(spark, tmp_path):
    df, path = states(spark).cache(), str(tmp_path / "s")
    clustered.write_by_place(df, path, rows_per_file=2_000, row_group_bytes=1 << 16)
    lamin, lomin, lamax, lomax = AREA
    groups = hit = 0
    for f in glob.glob(path + "/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            la, lo = (meta.row_group(g).column(at[c]).statistics for c in ("lat", "lon"))
            groups += 1
            hit += la.min <= lamax and la.max >= lamin and lo.min <= lomax and lo.max >= lomin
    assert groups >= 25 and hit <= groups / 6
    got = clustered.read_area(spark, path, *AREA)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = got._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(lat,49.0)" in plan and "LessThanOrEqual(lon,17.0)" in plan
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tr.bbox_filter(df, *AREA).collect()))


def test_places_that_are_missing_or_the_same(spark, tmp_path):
    df = spark.createDataFrame([(k, None if k % 3 else 50.0, 15.0, "x") for k in range(900)], "seq long, lat double, lon double, icao24 string")
    clustered.write_by_place(df, str(tmp_path / "s"), rows_per_file=100)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(str(tmp_path / "s") + "/*.parquet")]
    assert len(sizes) > 5 and max(sizes) < 300  # one place is not one file
    assert clustered.read_area(spark, str(tmp_path / "s"), *AREA).count() == 300
    clustered.write_by_place(df.limit(0), str(tmp_path / "e"))
    assert clustered.read_area(spark, str(tmp_path / "e"), *AREA).count() == 0
