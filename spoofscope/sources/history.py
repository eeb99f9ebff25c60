"""An appendable history of state reports.

The history is cut into buckets by a hash of the aircraft, so the copies of a
report share a bucket.  Appending a poll reads and rewrites only the buckets
that the poll touches: their rows and the new ones, the newest copy of each
report kept, rows older than the retention dropped.  The others keep their
files.  A manifest per append (see ``committed``) names every bucket's folder,
so readers see whole appends and a replayed append changes nothing.
"""

from __future__ import annotations

import json
import uuid
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoofscope.operators import trajectory as tr
from spoofscope.sources.committed import BatchTables

_BUCKET = "_bucket"


class History:
    """Keep-last history under ``path``; ``keep_seconds`` before the newest
    report's time are kept (None: all)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256, keep_seconds: int | None = None, key: str = "icao24", time: str = "time",
                 subset: Sequence[str] = ("icao24", "lastposupdate", "lat", "lon"), arrival: str = "seq") -> None:
        self.spark, self.buckets, self.keep, self.key, self.time, self.subset, self.arrival = spark, buckets, keep_seconds, key, time, list(subset), arrival
        self.log = BatchTables(spark, path)
        if key not in self.subset:
            raise ValueError("copies of a report must share its key")

    def _state(self, before: int | None = None) -> dict:
        at = self.log.newest(before)
        return self.log.manifest(at) if at is not None else {"folders": {}, "schema": None, "newest": None, "buckets": self.buckets}

    def _rows(self, state: dict, folders: list[str]) -> DataFrame | None:
        if not folders:
            return None
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        return self.spark.read.schema(schema).parquet(*[f"{self.log.path}/{f}" for f in sorted(folders)])

    def _recent(self, df: DataFrame, newest: int | None) -> DataFrame:
        """Rows without a time stay."""
        if self.keep is None or newest is None:
            return df
        return df.filter(F.col(self.time).isNull() | (F.col(self.time) >= newest - self.keep))

    def append(self, rows: DataFrame, batch_id: int) -> bool:
        """Add a poll's rows; False if the batch is there already."""
        if self.log.manifest(batch_id):
            return False
        state = self._state(batch_id)
        if state["buckets"] != self.buckets:
            raise ValueError(f"the history has {state['buckets']} buckets")
        new = rows.withColumn(_BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        found = new.groupBy(_BUCKET).agg(F.max(self.time).alias("newest")).collect()  # a row per touched bucket
        newest = max((t for t in [state["newest"], *(r.newest for r in found)] if t is not None), default=None)
        touched = {str(r[_BUCKET]) for r in found}
        old = self._rows(state, [f for b, f in state["folders"].items() if b in touched])
        if old is not None:
            new = new.unionByName(old.withColumn(_BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")))
        folder = f"data/batch_id={batch_id}/attempt={uuid.uuid4().hex}"
        kept = tr.state_dedup(self._recent(new, newest), [*self.subset, _BUCKET], self.arrival)
        kept.repartition(max(1, len(touched)), _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.log.path}/{folder}")
        at = self.log._at(folder)
        there = {s.getPath().getName() for s in self.log._fs.listStatus(at)}
        folders = {b: f for b, f in state["folders"].items() if b not in touched}
        folders |= {b: f"{folder}/{_BUCKET}={b}" for b in touched if f"{_BUCKET}={b}" in there}  # a bucket may be empty by now
        self.log.publish(batch_id, {"folders": folders, "schema": rows.schema.json(), "newest": newest, "buckets": self.buckets})
        return True

    def read(self, batch_id: int | None = None) -> DataFrame | None:
        """All rows as of the newest append (or an earlier one); None before the first."""
        state = self.log.manifest(batch_id) if batch_id is not None else self._state()
        if not state or state["schema"] is None:
            return None
        rows = self._rows(state, list(state["folders"].values()))
        if rows is None:
            return self.spark.createDataFrame([], T.StructType.fromJson(json.loads(state["schema"])))
        return self._recent(rows, state["newest"])
