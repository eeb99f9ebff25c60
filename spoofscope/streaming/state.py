"""Settings that keyed streaming state needs."""

from __future__ import annotations

from pyspark.sql import SparkSession

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State with lists and timers needs RocksDB, which keeps it off the heap:
    set for queries started from now on, unless the session names a provider
    of its own."""
    if "HDFSBacked" in spark.conf.get(_PROVIDER, "HDFSBacked"):
        spark.conf.set(_PROVIDER, _ROCKSDB)


def timer(handle, due: int | None, at: int | None) -> int | None:
    """The key's only timer moves from ``due`` to ``at``, milliseconds of
    event time (None: no timer); returns ``at``."""
    if due != at:
        if due is not None:
            handle.deleteTimer(due)
        if at is not None:
            handle.registerTimer(at)
    return at
