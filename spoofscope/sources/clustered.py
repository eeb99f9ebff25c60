"""State tables stored by place, so that an area is read from few row groups.

Rows are sorted along a space-filling curve over latitude and longitude before
they are written: neighbours on the map share files and row groups, whose
minima and maxima then exclude most of the table from an area's scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoofscope.operators import trajectory as tr

#: Bits per coordinate: cells of about 600 m at the equator.
BITS = 16
#: Bytes of a row group, and rows of a file.
ROW_GROUP_BYTES, FILE_ROWS = 8 << 20, 4_000_000


def _spread(c: Column) -> Column:
    """The bits of ``c`` with a zero between each two."""
    out = c
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        out = (out.bitwiseOR(F.shiftleft(out, shift))).bitwiseAND(F.lit(mask).cast("bigint"))
    return out


def place_key(lat: Column, lon: Column) -> Column:
    """The place on the curve: latitude and longitude as ``BITS``-bit numbers,
    their bits interleaved.  NULL where a coordinate is, or isn't a number."""
    def cell(c: Column, low: float, high: float) -> Column:
        whole = (1 << BITS) - 1
        inside = F.greatest(F.least((c.cast("double") - low) / (high - low), F.lit(1.0)), F.lit(0.0))
        return F.when(c.isNotNull() & ~F.isnan(c.cast("double")), F.floor(inside * whole).cast("bigint"))
    return _spread(cell(lat, -90.0, 90.0)).bitwiseOR(F.shiftleft(_spread(cell(lon, -180.0, 180.0)), 1))


def write_by_place(df: DataFrame, path: str, rows_per_file: int = FILE_ROWS, row_group_bytes: int = ROW_GROUP_BYTES, lat: str = "lat", lon: str = "lon") -> None:
    """``df`` as Parquet under ``path``, clustered by place.  Rows without a
    place come first.  Range partitions split where the data is dense; rows of
    one and the same place are spread by the hash of the rest of the row."""
    files = max(1, -(-df.count() // rows_per_file))
    key = place_key(F.col(lat), F.col(lon))
    (df.withColumns({"_place": key, "_spread": F.xxhash64(*df.columns)}).repartitionByRange(files, "_place", "_spread").sortWithinPartitions("_place")
     .drop("_place", "_spread").write.mode("overwrite").option("parquet.block.size", row_group_bytes).parquet(path))


def read_area(spark: SparkSession, path: str, lamin: float, lomin: float, lamax: float, lomax: float) -> DataFrame:
    """The rows within an area; the bounds reach the scan as pushed filters."""
    return tr.bbox_filter(spark.read.parquet(path), lamin, lomin, lamax, lomax)
