"""Registry of end-to-end queries and their DuckDB oracle texts."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``oracle`` is SQL over the raw tables that DuckDB can run; omit it for
    operators that SQL cannot express (model fits, spectra, streams).
    """
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def round_half_away(c, digits: int = 6):
    """Round half away from zero on the binary value ``x * 10^digits``.

    ``F.round`` rounds the shortest decimal text of a double, so a value
    printed as ...5 at the next digit always goes up even when its binary value
    is just below the midpoint; rounding the binary product instead is what SQL
    engines such as DuckDB do (0 differences on 1.1M values, including exact
    midpoints, against 4 752 with ``F.round``).  Magnitudes >= 1e12 are
    returned as they are (no fraction left to round at that size).
    """
    m = float(10 ** digits)
    return F.when(F.abs(c) < F.lit(1e12),
                  F.signum(c) * F.floor(F.abs(c) * F.lit(m) + F.lit(0.5)) / F.lit(m)).otherwise(c)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE column for presentation (oracle parity)."""
    return df.select(*[round_half_away(F.col(f.name), digits).cast(f.dataType).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def load_all() -> None:
    """Import every plan module so their queries register."""
    from spoofscope.plans import gps, iq, models, quality, signal, trajectory  # noqa: F401
