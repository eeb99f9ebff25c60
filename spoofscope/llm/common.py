"""Helpers that several corpus operators use."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoofscope.session import ensure_checkpoint_dir
from spoofscope.session import ship_package as _ship

#: Words of the documents: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Whether a query's shuffle files are deleted as it ends; else that waits until the driver's JVM has collected what refers to them.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, free: bool = False) -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder and read
    back: lineage ends there, a lost executor loses nothing, and row ids given
    before the write stay as they are.  With ``free`` the shuffle files of the
    write are deleted as it ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, None)
    if free:
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if free and before is None:
            spark.conf.unset(FREE_SHUFFLES)
        elif free:
            spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


#: Documents that a Python task gets at a time, unless the session says how many.
BATCH_ROWS = 2000


def ship_package(spark: SparkSession) -> None:
    """What operators with Python tasks need: the package on the executors,
    and batches of texts small enough for two tasks beside a full heap."""
    _ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's default
        spark.conf.set(key, str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ascii_lower(c: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def only(value: Column, condition: Column) -> Column:
    """A generator: ``value`` where ``condition`` holds, else NULL.  A filter
    on the result stays above it; pushed further down, it would repeat the
    expressions that ``value`` is made of for every element they loop over."""
    return F.explode_outer(F.when(condition, F.array(value)))


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores in front until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


__all__ = ["WORD", "ascii_lower", "ensure_checkpoint_dir", "fresh", "only", "partitions", "ship_package",
           "staged", "table", "text_or_empty"]
