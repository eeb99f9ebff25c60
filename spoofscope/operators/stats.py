"""Exact grouped statistics that stay distributed for large groups."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoofscope.operators.ordered import running, value_chunk


def unpivot(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Wide -> long: (keys, _c, _v) with NULL values dropped."""
    keys = list(keys)
    return (df.select(*keys, F.explode(F.array(*[
                F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in cols
            ])).alias("_kv"))
            .select(*keys, F.col("_kv._c").alias("_c"), F.col("_kv._v").alias("_v"))
            .filter(F.col("_v").isNotNull()))


def percentile_at(before: str, n: str, total: str, value: str, p: float) -> list:
    """Aggregates (low, high, part) of a table of distinct values, each with
    its count and the count before: the values at the two ranks around
    ``p * (total - 1)`` and how far between them the percentile lies."""
    pos = F.lit(float(p)) * (F.col(total) - 1)
    holds = lambda r: (F.col(before) <= r) & (r < F.col(before) + F.col(n))
    return [F.max(F.when(holds(F.floor(pos)), F.col(value))), F.max(F.when(holds(F.ceil(pos)), F.col(value))), F.max(pos - F.floor(pos))]


def grouped_percentiles(df: DataFrame, keys: Sequence[str], cols: Sequence[str], ps: Mapping[str, float]) -> DataFrame:
    """Exact linear-interpolation percentiles (``percentile_cont``) per group:
    ``keys + [f"{col}_{name}"]`` for groups with at least one value.

    Values are counted first (``(keys, column, value) -> n``, combined before
    the shuffle), so ties cost nothing; the distinct values' running counts
    come from ``running`` in value chunks.
    """
    gk = [*keys, "_c"]
    counts = unpivot(df, keys, cols).groupBy(*gk, "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(counts, gk, ["_v"], value_chunk(F.col("_v")), F.col("_n"), "_before", "_total")
    aggs = []
    for name, p in ps.items():
        low, high, part = percentile_at("_before", "_n", "_total", "_v", p)
        aggs.append((low + (high - low) * part).alias(name))
    one = ranked.groupBy(*gk).agg(*aggs)
    flat = one.select(*keys, F.explode(F.array(*[F.struct(F.concat("_c", F.lit(f"_{n}")).alias("name"), F.col(n).alias("v")) for n in ps])).alias("x"))
    return flat.groupBy(*keys).pivot("x.name", [f"{c}_{n}" for c in cols for n in ps]).agg(F.first("x.v"))
