"""Positions and differences in order, inside groups of any size.

A ``Window.partitionBy(key)`` sends every row of a key to one task.  Here a
group is cut into chunks along its order instead: ``chunk`` is a column that
never falls as the order rises (an hour of a timestamp, a range of sample
counts).  Rows are numbered, or compared with the row before, inside
``(keys, chunk)``; a summary with one row per chunk gives what lies before it,
and is joined back on the same keys, so the rows are shuffled once.  The plan
is the same at every size and starts no job while it is built.

Chunks should hold what a task can sort.  NULL keys are a group, and NULLs
come first in an order, as in Spark's own windows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_K, _C = "_key_{}", "_chunk"


def value_chunk(c: Column, per_octave: int = 4096) -> Column:
    """A chunk for values of unknown range: ``per_octave`` chunks for every
    doubling of the magnitude, negative values in mirror order."""
    v = c.cast("double")
    place = F.floor(F.least(F.log2(F.abs(v)), F.lit(2000.0)) * per_octave) + 2000 * per_octave
    return F.when(F.isnan(v), F.lit(1 << 62)).when(v == 0, F.lit(0)).otherwise(F.signum(v).cast("bigint") * place)


def _as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _cut(df: DataFrame, keys: Sequence[str], chunk: Column | None) -> tuple[DataFrame, list[str]]:
    """``df`` with key and chunk columns that are never NULL (so one
    equality join serves them), and the key columns' names."""
    names = [_K.format(i) for i in range(len(keys))]
    made = {n: F.struct(F.col(k).isNotNull(), F.col(k)) for n, k in zip(names, keys)}
    made[_C] = F.struct(chunk.isNotNull(), chunk) if chunk is not None else F.struct(F.lit(True), F.lit(0))
    return df.withColumns(made), names


def running(df: DataFrame, keys: Sequence[str], order: Sequence, chunk: Column | None = None, weight: Column | None = None,
            before: str = "before", total: str | None = None, also: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with the sum of ``weight`` (rows, unless given) over the rows
    before each row of its group, and over the whole group as ``total``;
    ``also`` names more sums over whole groups.

    ``order`` must be a total order inside a group.  Without ``chunk`` a group
    is one chunk, which suits groups of a known bound.
    """
    also = also or {}
    cut, names = _cut(df, keys, chunk)
    inside = Window.partitionBy(*names, _C).orderBy(*[_as_column(o) for o in order])
    if weight is None:
        own = F.row_number().over(inside) - 1
    else:
        own = F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = cut.groupBy(*names, _C).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"),
                                         *[F.sum(c).alias(f"_sum_{k}") for k, c in also.items()])
    group = Window.partitionBy(*names)
    earlier = F.sum("_n").over(group.orderBy(_C).rowsBetween(Window.unboundedPreceding, -1))
    chunks = chunks.select(*names, _C, F.coalesce(earlier, F.lit(0)).alias("_before"), F.sum("_n").over(group).alias("_total"),
                           *[F.sum(f"_sum_{k}").over(group).alias(f"_sum_{k}") for k in also])
    out = cut.withColumn("_own", own).join(chunks, [*names, _C])
    extra = [(F.col("_before") + F.col("_own")).cast("bigint").alias(before)] + ([F.col("_total").alias(total)] if total else [])
    extra += [F.col(f"_sum_{k}").alias(k) for k in also]
    return out.select(*[c for c in df.columns if c not in (before, total, *also)], *extra)


def ordered_index(df: DataFrame, keys: Sequence[str], order: Sequence, index_col: str = "rn",
                  chunk: Column | None = None, count_col: str | None = None) -> DataFrame:
    """Add ``index_col``, equal to ``row_number() - 1`` over ``PARTITION BY
    keys ORDER BY order``, and the group's size as ``count_col``."""
    return running(df, keys, order, chunk, before=index_col, total=count_col)


def ordered_diff(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
                 prefix: str = "delta_", chunk: Column | None = None) -> DataFrame:
    """Add ``prefix + c`` = ``c - lag(c) OVER (PARTITION BY keys ORDER BY
    order)``, of the type that the subtraction has.

    NULL for the first row of a group or when either value is NULL.
    ``order`` are column names, ascending.
    """
    cols = list(cols)
    cut, names = _cut(df, keys, chunk)
    inside = Window.partitionBy(*names, _C).orderBy(*order)
    last = F.max_by(F.struct(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(cols)]), F.struct(*order))
    chunks = cut.groupBy(*names, _C).agg(last.alias("_last"))
    chunks = chunks.select(*names, _C, F.lag("_last").over(Window.partitionBy(*names).orderBy(_C)).alias("_prev"))
    out = cut.withColumns({"_first": F.row_number().over(inside) == 1} | {f"_l{i}": F.lag(c).over(inside) for i, c in enumerate(cols)})
    out = out.join(chunks, [*names, _C])
    kept = [c for c in df.columns if c not in {prefix + c for c in cols}]
    return out.select(*kept, *[(F.col(c) - F.when(F.col("_first"), F.col(f"_prev._p{i}")).otherwise(F.col(f"_l{i}"))).alias(prefix + c)
                               for i, c in enumerate(cols)])
