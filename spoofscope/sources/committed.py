"""Tables that are replaced batch by batch, with a commit log.

A batch writes its tables' files into folders of their own, then one small
manifest that names them.  Only a manifest makes a batch visible: a batch that
died half-way, or an attempt that a replay repeated, is never read.  Readers
take the newest manifest, so "the latest predictions" are one whole batch.
All work on files goes through Spark's file systems.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_LOG = "_commits"


class BatchTables:
    """``<path>/<table>/batch_id=N/attempt=<id>/`` and ``<path>/_commits/N.json``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        self._fs = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self, batch_id: int) -> dict | None:
        """The batch's manifest; None without one, or if it is not whole."""
        at = self._at(_LOG, f"{batch_id:020d}.json")
        if not self._fs.exists(at):
            return None
        lines = self.spark.read.text(at.toString(), wholetext=True).collect()
        try:
            found = json.loads(lines[0].value) if lines else None
        except ValueError:
            return None
        return found if found and found.get("whole") else None

    def batches(self) -> list[int]:
        """Ids of the batches in the log, oldest first (names only)."""
        at = self._at(_LOG)
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def newest(self, before: int | None = None) -> int | None:
        """The newest whole batch (of those before ``before``)."""
        return next((b for b in reversed(self.batches()) if (before is None or b < before) and self.manifest(b)), None)

    def commit(self, batch_id: int, tables: dict[str, DataFrame]) -> bool:
        """Write the batch's tables and make them visible at once.  False, and
        nothing written, if the batch is there already (a replay)."""
        if self.manifest(batch_id):
            return False
        folders = {}
        for name, df in tables.items():
            folder = f"{name}/batch_id={batch_id}/attempt={uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{folder}")
            folders[name] = {"folder": folder, "schema": df.schema.json()}
        self.publish(batch_id, {"tables": folders})
        return True

    def publish(self, batch_id: int, entries: dict) -> None:
        """Put the batch's manifest in place, whole or not at all."""
        draft, final = self._at(_LOG, f".{uuid.uuid4().hex}"), self._at(_LOG, f"{batch_id:020d}.json")
        out = self._fs.create(draft, True)
        try:
            out.write(json.dumps({"batch_id": batch_id, **entries, "whole": True}).encode())
        finally:
            out.close()
        if self._fs.exists(final):  # a manifest that was not whole
            self._fs.delete(final, False)
        if not self._fs.rename(draft, final):
            raise OSError(f"batch {batch_id} could not be committed under {self.path}")

    def read(self, table: str, batch_id: int | None = None) -> DataFrame | None:
        """One batch's rows: the newest whole batch unless ``batch_id`` names
        another; None if there is none."""
        batch_id = self.newest() if batch_id is None else batch_id
        found = self.manifest(batch_id) if batch_id is not None else None
        if not found or table not in found.get("tables", {}):
            return None
        entry = found["tables"][table]
        return self.spark.read.schema(T.StructType.fromJson(json.loads(entry["schema"]))).parquet(f"{self.path}/{entry['folder']}")

    def expire(self, keep: int) -> list[int]:
        """Drop all but the newest ``keep`` whole batches, and what older
        batches left behind; the dropped ids.  Manifests go first, so no
        reader finds a batch without its files."""
        whole = [b for b in self.batches() if self.manifest(b)]
        gone, kept = whole[:-keep] if keep else whole, whole[-keep:] if keep else []
        for b in gone:
            self._fs.delete(self._at(_LOG, f"{b:020d}.json"), False)
        oldest = kept[0] if kept else (gone[-1] + 1 if gone else 0)
        for table in self._fs.listStatus(self._at()) if self._fs.exists(self._at()) else []:
            if table.getPath().getName() != _LOG and table.isDirectory():
                for folder in self._fs.listStatus(table.getPath()):
                    name = folder.getPath().getName()
                    if name.startswith("batch_id=") and int(name[9:]) < oldest:
                        self._fs.delete(folder.getPath(), True)
        return gone
