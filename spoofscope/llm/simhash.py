"""SimHash near-duplicates through the generalised pigeonhole principle.

The 64 bits are dealt into parts.  If the parts' thresholds t_i satisfy
sum(t_i + 1) = k + 1, two fingerprints within k bits agree up to t_i bits in
some part i; a threshold of -1 leaves a part out.  Bits that go together are
put into the same part, as they tell little more than one of them would, and
a dynamic program gives each part its threshold by the estimated cost of its
probes and candidates.  The number of parts is chosen by the same cost, so the
parts widen as the corpus grows.

Fingerprints are made distinct first: copies cost nothing.  A fingerprint
enters the bucket of its own value in every part, and the buckets of the
larger values within t_i bits (of two different values one is the larger, so
every pair meets).  Pairs in a bucket are verified on all 64 bits.  Buckets of
more than ``BLOCK`` fingerprints are cut into blocks and compared block pair
by block pair, so a task holds at most two blocks, and a crowded bucket gives
a spanning forest of its links rather than all of them: components stay as
they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoofscope.llm.common import partitions, ship_package, staged
from spoofscope.llm.components import components

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Fingerprints of a bucket that are compared in one go.
BLOCK = 2048
#: Runs up to this size emit every link; larger ones a spanning forest.
SMALL_RUN = 48
#: Cost of a bucket entry (it is shuffled and sorted) in units of a compared pair.
ENTRY_COST = 40.0
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 majority bits over XXH64 of the word shingles of ``text``, A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = max(1, len(words) - shingle + 1)
    ends = end[-n:]
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(start[at:min(n, at + CHUNK)].tolist(), ends[at:at + CHUNK].tolist())], "<u8")
        votes += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * votes > n).tolist())


def fingerprints(docs: DataFrame, name: str, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without its text, plus the fingerprint ``name`` (signed 64 bits)."""
    ship_package(docs.sparkSession)
    rest = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.array([fingerprint(t.as_py(), shingle) for t in b.column(0)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(own)], names=[*rest, name])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name != text)
    return docs.select(text, *rest).mapInArrow(run, f"{schema}`{name}` bigint")


def bit_counts(prints: DataFrame, name: str) -> tuple[int, np.ndarray]:
    """Fingerprints, and how often each pair of bits is set together (64 x 64)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64), np.int64)
        n = 0
        for b in batches:
            v = b.column(0).to_numpy().view(np.uint64)
            bits = (v[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            n += len(v)
        pair = np.arange(4097)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(np.append(total.ravel(), n))], names=["pair", "n"])

    got = np.zeros(4097, np.int64)
    for r in prints.select(name).mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 4,097 rows
        got[r.pair] = r.n
    return int(got[4096]), got[:4096].reshape(64, 64)


def grouped_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near equal size, correlated bits together:
    a group starts with the lowest free bit and takes, one by one, the bit
    that correlates most with those it has."""
    p = np.diag(together) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs((together / max(1, n) - np.outer(p, p)) / np.outer(spread, spread))
    free, groups = list(range(64)), []
    for k in range(parts):
        group = [free.pop(0)]
        while len(group) < 64 // parts + (k < 64 % parts):
            best = max(free, key=lambda b: (round(float(r[b, group].sum()), 9), -b))
            free.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def part_cost(n: int, agree: np.ndarray, bits: list[int], t: int) -> float:
    """Estimated cost of threshold ``t``: bucket entries, and the pairs that
    differ in at most ``t`` of the bits, each bit agreeing with its own chance."""
    if t < 0:
        return 0.0
    differ = np.zeros(t + 2)
    differ[0] = 1.0
    for b in bits:
        differ[1:] = differ[1:] * agree[b] + differ[:-1] * (1 - agree[b])
        differ[0] *= agree[b]
    entries = n * (1 + sum(math.comb(len(bits), s) for s in range(1, t + 1)) / 2)
    return ENTRY_COST * entries + n * n / 2 * float(differ[:t + 1].sum())


def allotted(n: int, together: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts in use, for the cheapest number of parts."""
    p = np.diag(together) / max(1, n)
    agree = p * p + (1 - p) * (1 - p)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in range(2, distance + 2):
        groups = grouped_bits(n, together, parts)
        # plan[s]: the cheapest thresholds so far whose t + 1 sum to s
        plan: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for bits in groups:
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (cost, ts) in plan.items():
                for t in range(-1, distance - used + 1):
                    c = cost + part_cost(n, agree, bits, t)
                    if used + t + 1 not in step or c < step[used + t + 1][0]:
                        step[used + t + 1] = (c, (*ts, t))
            plan = step
        cost, ts = plan[distance + 1]
        if best is None or cost < best[0]:
            best = (cost, [(b, t) for b, t in zip(groups, ts) if t >= 0])
    return best[1] if best else []


def entries(values: np.ndarray, plan: list[tuple[list[int], int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(part, bucket, fingerprint): own values and larger values in reach."""
    for k, (bits, t) in enumerate(plan):
        mask = np.uint64(sum(1 << b for b in bits))
        own = values & mask
        yield np.full(len(values), k, np.int32), own, values
        for s in range(1, t + 1):
            for flip in combinations(bits, s):
                near = own ^ np.uint64(sum(1 << b for b in flip))
                up = near > own
                yield np.full(int(up.sum()), k, np.int32), near[up], values[up]


def links_of(bucket: np.ndarray, block: np.ndarray, value: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of sorted runs of equal (bucket, block): all of a short run's, a spanning forest of a long run's."""
    first = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])])
    size = np.diff(np.r_[first, len(bucket)])
    a, b = [], []
    for run, n in zip(first[size > SMALL_RUN].tolist(), size[size > SMALL_RUN].tolist()):
        own = value[run:run + n]
        todo, queue = np.arange(n), []
        while len(todo) or queue:
            if not queue:
                queue, todo = [int(todo[0])], todo[1:]
            x = queue.pop()
            near = np.bitwise_count(own[todo] ^ own[x]) <= distance
            if near.any():
                met = todo[near]
                a.append(np.full(len(met), own[x], np.uint64))
                b.append(own[met])
                queue += met.tolist()
                todo = todo[~near]
    small = np.repeat(size, size) <= SMALL_RUN
    left = np.repeat(first + size, size) - np.arange(len(bucket)) - 1  # later rows of the same run
    at = np.flatnonzero(small & (left > 0))
    step = 1
    while len(at):
        x, y = value[at], value[at + step]
        near = (np.bitwise_count(x ^ y) <= distance) & (x != y)
        a.append(x[near])
        b.append(y[near])
        step += 1
        at = at[left[at] >= step]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def linked(prints: DataFrame, name: str, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between distinct fingerprints of at most ``distance`` bits
    that hold the same components as all links do."""
    spark = prints.sparkSession
    ship_package(spark)
    plan = allotted(*bit_counts(prints, name), distance)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, bucket, own in entries(b.column(0).to_numpy().view(np.uint64), plan):
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(bucket.view(np.int64)), pa.array(own.view(np.int64))], names=["part", "bucket", "print"])

    met = prints.select(name).mapInArrow(probe, "part int, bucket bigint, print bigint")
    crowded = met.groupBy("part", "bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).select(
        "part", "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own_block = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    pairs = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.least(o, F.col("own")).cast("bigint") * F.col("blocks") + F.greatest(o, F.col("own"))))
    dealt = (met.join(crowded, ["part", "bucket"], "left").withColumn("own", own_block)
             .select("part", "bucket", F.explode(pairs).alias("block"), "print")
             .repartition(partitions(spark), "part", "bucket", "block").sortWithinPartitions("part", "bucket", "block"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted; the last run of a batch waits for the next batch."""
        kept: list[np.ndarray] | None = None
        for last, b in ending(batches):
            now = [c.to_numpy() for c in b.columns] if b is not None else [np.zeros(0, t) for t in (np.int32, np.int64, np.int64, np.int64)]
            rows = [np.concatenate(x) for x in zip(kept, now)] if kept is not None else now
            n = len(rows[0])
            if not n:
                continue
            cut = n
            if not last:
                same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]) & (rows[2] == rows[2][-1])
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            kept = [x[cut:] for x in rows]
            if cut:
                part, bucket, block, own = (x[:cut] for x in rows)
                a, c = links_of(bucket, block << 8 | part, own.view(np.uint64), distance)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64))], names=["a", "b"])

    return dealt.mapInArrow(verify, "a bigint, b bigint")


def ending(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch | None]]:
    """The batches, and a closing (True, None)."""
    for b in batches:
        yield False, b
    yield True, None


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, print (signed 64 bits) and component_id, the smallest id that
    links reach.

    A row per row of ``docs``.  NULL and empty texts have the fingerprint
    zero, which links like any other.  NULL ids are no component's smallest;
    a component of nothing else has a NULL component_id.  Repeated rows share
    a component.  Other columns are ignored.
    """
    rows = staged(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "print"))
    distinct = rows.groupBy("print").agg(F.min("doc_id").alias("low"))
    roots = components(linked(distinct.select("print"), "print", distance), "a", "b")
    # a fingerprint without links is its own component
    own = distinct.join(roots, F.col("print") == F.col("node"), "left").select("print", "low", F.coalesce("root", "print").alias("root"))
    # written, the one-row-per-component side leaves a large component's rows free to be split; so does the last join
    own = staged(own)
    smallest = staged(own.groupBy("root").agg(F.min("low").alias("component_id")))
    return rows.join(staged(own.join(smallest, "root").select("print", "component_id")), "print").select("doc_id", "print", "component_id")
