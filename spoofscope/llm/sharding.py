"""Shards through fixed virtual slots.

A record is hashed once, by its id, into one of ``SLOTS`` virtual slots.  The
slots are fixed for good; what changes is the versioned table that says which
shard holds which slot.  Growing by one shard hands some slots to the new
shard and moves nothing else; rebalancing edits the table slot by slot, led by
the bytes that were counted per slot.

The table has ``SLOTS`` rows whatever the corpus size, so it is kept as a
plain list on the driver and broadcast.  All counting is one aggregate with a
row per slot and task.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spoofscope.llm.common import ensure_checkpoint_dir, fresh, staged, text_or_empty

#: Virtual slots; a slot of a 100 TB corpus holds about 12 GB in 8,192 slots.
SLOTS = 8192
#: Rows that one numbering window may hold before a slot is split further.
ROWS_PER_WINDOW = 200_000
MAP_SCHEMA = "version int, n_shards int, slot int, shard int"


@dataclass(frozen=True)
class SlotMap:
    """Version, shard count and the shard of every slot."""

    version: int
    n_shards: int
    shards: tuple[int, ...]


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a key; NULL keys share one fixed slot."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def first_map(n_shards: int, slots: int = SLOTS) -> SlotMap:
    """The map that growth from one shard to ``n_shards`` gives: it depends on
    the two counts alone."""
    if not 1 <= n_shards <= slots:
        raise ValueError(f"between 1 and {slots} shards can hold {slots} slots")
    m = SlotMap(1, 1, (0,) * slots)
    for _ in range(n_shards - 1):
        m = grown(m)
    return SlotMap(1, n_shards, m.shards)


def grown(m: SlotMap) -> SlotMap:
    """One more shard: it takes its share of slots, each from the shard that
    holds the most (the lowest number of equals, its last slot first)."""
    held: dict[int, list[int]] = {}
    for slot, shard in enumerate(m.shards):
        held.setdefault(shard, []).append(slot)
    queue = [(-len(v), k) for k, v in held.items()]
    heapq.heapify(queue)
    out = list(m.shards)
    for _ in range(len(m.shards) // (m.n_shards + 1)):
        n, shard = heapq.heappop(queue)
        out[held[shard].pop()] = m.n_shards
        heapq.heappush(queue, (n + 1, shard))
    return SlotMap(m.version + 1, m.n_shards + 1, tuple(out))


def rebalanced(m: SlotMap, slot_bytes: dict[int, int], tolerance: float = 0.02,
               max_moves: int | None = None) -> SlotMap:
    """The next version, with slots moved from the fullest to the emptiest
    shard until the two are within ``tolerance`` of the mean, no move helps or
    ``max_moves`` are made."""
    load = [0] * m.n_shards
    held: list[list[tuple[int, int]]] = [[] for _ in load]
    for slot, shard in enumerate(m.shards):
        size = slot_bytes.get(slot, 0)
        load[shard] += size
        held[shard].append((size, slot))
    out, mean = list(m.shards), sum(load) / len(load)
    for _ in range(len(out) if max_moves is None else max_moves):
        high, low = max(range(len(load)), key=load.__getitem__), min(range(len(load)), key=load.__getitem__)
        gap = load[high] - load[low]
        fits = [x for x in held[high] if 0 < x[0] < gap]
        if gap <= tolerance * mean or not fits:
            break
        best = min(fits, key=lambda x: (abs(2 * x[0] - gap), x[1]))
        held[high].remove(best)
        held[low].append(best)
        load[high] -= best[0]
        load[low] += best[0]
        out[best[1]] = low
    return SlotMap(m.version + 1, m.n_shards, tuple(out))


def map_table(spark: SparkSession, m: SlotMap) -> DataFrame:
    return spark.createDataFrame([(m.version, m.n_shards, i, s) for i, s in enumerate(m.shards)], MAP_SCHEMA)


def save_map(spark: SparkSession, m: SlotMap, path: str) -> None:
    """Append a version to the stored map; older versions stay readable."""
    map_table(spark, m).coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version, the newest one unless named."""
    df = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = df.agg(F.max("version")).first()[0]
    rows = df.filter(F.col("version") == version).orderBy("slot").collect()  # one row per slot
    if not rows:
        raise ValueError(f"no version {version} of the slot map")
    return SlotMap(rows[0].version, rows[0].n_shards, tuple(r.shard for r in rows))


def stored_versions(spark: SparkSession, path: str, m: SlotMap, slot_bytes: dict[int, int]) -> tuple[SlotMap, SlotMap, SlotMap]:
    """The map, its growth by one shard and its rebalancing by the counted
    bytes of the slots: written under ``path`` as three versions, and as they
    are when read back."""
    more = grown(m)
    even = replace(rebalanced(m, slot_bytes), version=more.version + 1)
    for x in (m, more, even):
        save_map(spark, x, path)
    return tuple(load_map(spark, path, x.version) for x in (m, more, even))


def record_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (NULL: none) plus 16."""
    return (F.octet_length(text_or_empty(text)) + 16).cast("long")


def slot_totals(records: DataFrame, slot: str, size: str) -> DataFrame:
    """Rows and bytes of every slot that has any."""
    return records.groupBy(F.col(slot).alias("slot")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(size).alias("n_bytes"))


def sharded(records: DataFrame, m: SlotMap, key: str = "doc_id", size: str = "size", path: str | None = None) -> DataFrame:
    """``records`` with virtual_slot, shard, grown_shard (under one more
    shard), even_shard (slots moved until the shards' bytes are even), the
    versions of the maps that these come from (map_version, grown_version,
    even_version) and position (gapless from 0 in each shard).

    The maps are stored and read back under ``path``, in a folder of the
    shared checkpoint folder unless given.  Slots that tie in bytes move in
    the order of their numbers.

    Only small records should come in (ids and sizes, no texts).  Rows are
    numbered per part of a slot: a slot with many rows, or rows that share a
    NULL or repeated key, is split into as many parts as its count asks for,
    and the parts' offsets come from a table with one row per part.  Repeated
    rows are separate records with positions of their own.  No rows give no
    rows.
    """
    spark, columns = records.sparkSession, records.columns
    slots = len(m.shards)
    rid = fresh(columns, "rid")
    rows = staged(records.withColumn(rid, F.monotonically_increasing_id()).withColumn("virtual_slot", slot_of(F.col(key), slots)))
    # one row per virtual slot at most: bounded by the slot count
    totals = {r.slot: (r.n_rows, r.n_bytes) for r in slot_totals(rows, "virtual_slot", size).collect()}
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/slot-map-{uuid.uuid4().hex}"
    m, more, even = stored_versions(spark, path, m, {slot: n_bytes or 0 for slot, (_, n_bytes) in totals.items()})
    layout = spark.createDataFrame(
        [(i, s, more.shards[i], even.shards[i], 1 + totals.get(i, (0, 0))[0] // ROWS_PER_WINDOW) for i, s in enumerate(m.shards)],
        "virtual_slot int, shard int, grown_shard int, even_shard int, parts int")
    rows = rows.join(F.broadcast(layout), "virtual_slot").withColumn(
        "part", F.pmod(F.xxhash64(rid), F.col("parts")).cast("int"))
    counts = rows.groupBy("shard", "virtual_slot", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot", "part")
                             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("virtual_slot", "part", F.coalesce(before, F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy(rid))
    return (rows.withColumn("own", own).join(offsets, ["virtual_slot", "part"])
            .select(*columns, "virtual_slot", "shard", "grown_shard", "even_shard", F.lit(m.version).alias("map_version"),
                    F.lit(more.version).alias("grown_version"), F.lit(even.version).alias("even_version"),
                    (F.col("offset") + F.col("own") - 1).alias("position")))
