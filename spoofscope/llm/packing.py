"""Packing tokenised documents into sequences, shortest pack first over the
length histogram.

Every document becomes ids and an end id, cut at multiples of the capacity;
the rest of it is one shorter piece.  The histogram of piece lengths is all
the packer sees: it takes lengths from the longest down and adds each to the
shortest pack with room, or opens a new one, for whole counts at once.  What
comes out are packing patterns with counts.  Each slot of a pattern owns a
range of the ranks of its length, so pieces find their sequence and offset by
their rank among the pieces of that length.

The histogram has one row per length and the patterns are at most two per
length, whatever the corpus size.  Ranks come from positions inside a task's
output plus a prefix sum over (length, task) counts, so no window holds more
than one task's pieces.
"""

from __future__ import annotations

import base64
import json
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoofscope.llm.common import ship_package, staged

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k"
END_ID = 1
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


@lru_cache(maxsize=2)
def whole(name: str):
    """The ``.json`` tokenizer, loaded once a text needs it."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


@lru_cache(maxsize=2)
def encoder(name: str):
    """text -> ids of the public tokenizer.  The bulk is encoded from its rank
    file, which holds the vocabulary of the ``.json`` file and gives the same
    ids several times faster; texts that spell a special token go to the
    ``.json`` tokenizer, which gives that token its own id."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return whole(name).encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
           tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, and the
    ids (little-endian unsigned 32-bit) if asked for.

    NULL and empty texts have the end id alone.  Repeated rows are separate
    documents.  Ids may be NULL.  Other columns are ignored.
    """
    ship_package(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                got = array("I", encode(t.as_py() or ""))
                got.append(end_id)
                raw = memoryview(np.frombuffer(got, dtype=np.uint32).astype("<u4", copy=False)).cast("B")
                for at in range(0, len(got), capacity):
                    part = raw[4 * at:4 * (at + capacity)]
                    row.append(i)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(got))
                    if with_ids:
                        ids.append(bytes(part))
            columns = [b.column(0).take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        cut, PIECES + (", ids binary" if with_ids else ""))


@dataclass(frozen=True)
class Pattern:
    """``count`` sequences that hold pieces of these lengths, in this order."""

    count: int
    lengths: tuple[int, ...]


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Shortest pack first: lengths from the longest down, each into the pack
    with the most room, whole counts at a time."""
    room: dict[int, list[list]] = {}
    most = 0
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"no piece of {length} fits {capacity}")
        left = histogram[length]
        while left:
            while most and not room.get(most):
                most -= 1
            if most < length:
                break
            n, lengths = room[most].pop()
            used = min(n, left)
            if n > used:
                room[most].append([n - used, lengths])
            room.setdefault(most - length, []).append([used, (*lengths, length)])
            left -= used
        each = capacity // length  # new packs: the next piece of this length goes to the pack just opened
        for n, fill in ((left // each, each), (min(1, left % each), left % each)):
            if n:
                free = capacity - fill * length
                room.setdefault(free, []).append([n, (length,) * fill])
                most = max(most, free)
    return [Pattern(n, lengths) for r in sorted(room) for n, lengths in room[r] if n]


def slots(packed: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: the ranges of ranks that each slot of a pattern owns."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for p in packed:
        offset = 0
        for length in p.lengths:
            rank = taken.get(length, 0)
            rows.append((length, rank, sequence, offset))
            taken[length] = rank + p.count
            offset += length
        sequence += p.count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset; no pieces give no rows."""
    spark = cut.sparkSession
    ship_package(spark)
    rows = staged(cut.withColumn("rid", F.monotonically_increasing_id())).withColumn("task", F.shiftright("rid", 33))
    counts = staged(rows.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row per length
    table = slots(patterns(histogram, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("task", "length").orderBy("rid"))
    ranked = (rows.withColumn("own", own).join(offsets, ["task", "length"])
              .select(*cut.columns, (F.col("before") + F.col("own") - 1).alias("rank")))

    names = cut.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = table[:, 0] << 48 | table[:, 1]
        for b in batches:
            length, rank = (b.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            at = np.searchsorted(key, length << 48 | rank, side="right") - 1
            out = [pa.array(table[at, 2] + rank - table[at, 1]), pa.array(table[at, 3])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *out], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.mapInArrow(place, f"{schema}, sequence_id bigint, `offset` bigint")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, length and ids (little-endian unsigned 32-bit, unpadded) of pieces that carry their ids; a
    sequence gathers at most the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return (placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
            .select("sequence_id", "length", joined.alias("ids")))
