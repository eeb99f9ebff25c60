"""Prefix trie of conversations: which beginnings they share, and what storing each once saves.

Turns are dictionary-encoded (a long id for each distinct role and text), so a
conversation is a sequence of ids, cut into blocks of ``BLOCK`` turns.  Equal
blocks behind equal beginnings become one weighted entry.  Entries are dealt
into range shards by their order; each shard inserts its sorted entries into a
ternary search tree, medians first (so the search trees stay balanced), and one
walk over the nodes, children first, adds up members, leaves and savings.

Only nodes on the paths of a shard's first and last entry can also be in other
shards.  They are emitted as partial sums under a digest of their path and
merged by aggregation; all other nodes are final.  Tries of later blocks are
done first, and hand their totals to the node that they hang from, so a task
never holds a conversation longer than a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoofscope.llm.common import partitions, ship_package, staged
from spoofscope.operators.ordered import ordered_index

#: Turns of a conversation that one trie level holds.
BLOCK = 256
#: Ids that a range shard holds at most, about.
SHARD_IDS = 1 << 20
#: Ids of conversations that are joined into one text at a time, for the digests.
IDS_PER_TEXT = 4096
#: Conversations are named by their hundreds' first, of which so many turns at most go before their own.
FAMILY, MOST_HEAD = 100, 5
_EMPTY = hashlib.sha256(b"").hexdigest()
_NODES = ("depth int, n bigint, conv bigint, parent_conv bigint, chars bigint, children bigint, leaves bigint, saved bigint, end_key string, "
          "tree string, key string, parent_key string, ancestors array<string>")


def encoded(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 0), id, chars of every turn, in the order of turn
    (NULL first), role, text.  A NULL role or text is empty; rows of a NULL
    conv_id belong to no conversation."""
    turns = (conversations.filter(F.col("conv_id").isNotNull())
             .select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    placed = ordered_index(turns, ["conv_id"], ["turn", "role", "text"], "at", chunk=F.floor(F.col("turn") / 1024))
    rows = staged(placed.select("conv_id", "at", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("turn"), "text", "role").alias("h2"),
                                F.length("text").cast("bigint").alias("chars")))
    words = staged(rows.groupBy("h1", "h2").agg(F.min("chars").alias("chars")).withColumn("id", F.monotonically_increasing_id()))
    return rows.drop("chars").join(words, ["h1", "h2"]).select("conv_id", "at", "id", "chars")


def head_turns(conv: Column) -> Column:
    """How many turns of its family's first conversation a conversation begins with, at most."""
    return F.crc32(conv.cast("string").cast("binary")) % (MOST_HEAD + 1)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, at, id, chars) of the rebuilt conversations, and (conv_id,
    n_turns) of all, turnless ones as well.

    A conversation c begins with the first turns of c - c % 100, as many as
    ``head_turns`` says; its own turns follow, without as many of its first.
    """
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own"))
    heads = (turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("at") < MOST_HEAD)).groupBy(F.col("conv_id").alias("base"))
             .agg(F.array_sort(F.collect_list(F.struct("at", "id", "chars"))).alias("head")))
    h = head_turns(F.col("conv_id"))
    convs = staged(sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "base", "left")
                   .withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<at:bigint,id:bigint,chars:bigint>>")), 1, h.cast("int")))
                   .select("conv_id", "head", F.greatest(F.col("n_own") - h, F.lit(0)).alias("n_kept")))
    first = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.at", "t.id", "t.chars")
    own = (turns.filter(F.col("at") >= h).join(convs.select("conv_id", F.size("head").alias("n_head")), "conv_id")
           .select("conv_id", (F.col("at") - h + F.col("n_head")).alias("at"), "id", "chars"))
    return first.union(own), convs.select("conv_id", (F.size("head") + F.col("n_kept")).alias("n_turns"))


def blocks_of(turns: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """conv_id, block, ids, chars, ends, tree, next: the blocks of every
    conversation.  ``tree`` names the beginning before the block, ``next`` that
    with the block: sums of two hashes of each block and its number."""
    cut = (turns.groupBy("conv_id", F.floor(F.col("at") / block).alias("block"))
           .agg(F.array_sort(F.collect_list(F.struct("at", "id", "chars"))).alias("t")).select("conv_id", "block", "t.id", "t.chars"))
    none = sizes.filter("n_turns = 0").select("conv_id", F.lit(0).cast("bigint").alias("block"), F.array().cast("array<bigint>"), F.array().cast("array<bigint>"))
    every = cut.union(none).toDF("conv_id", "block", "ids", "chars")
    of_conv = Window.partitionBy("conv_id").orderBy("block")
    sums = [F.sum(F.xxhash64(F.lit(s), "block", "ids").cast("decimal(30,0)")) for s in (1, 2)]
    key = lambda w: F.concat_ws(":", *[s.over(w).cast("string") for s in sums])
    before = of_conv.rowsBetween(Window.unboundedPreceding, -1)
    return every.select("*", F.lead("block").over(of_conv).isNull().alias("ends"), key(before).alias("tree"),
                        key(of_conv.rowsBetween(Window.unboundedPreceding, 0)).alias("next"))


class TernaryTree:
    """Ternary search tree over sequences of numbers.  Node 0 is above all;
    ``up`` is the node of the sequence without its last number, which is
    always older than the node itself."""

    def __init__(self) -> None:
        self.kids: tuple[list[int], ...] = ([0], [0], [0])  # smaller, next, larger; 0 for none
        self.number, self.up = [0], [0]

    def insert(self, sequence: list[int]) -> list[int]:
        """The nodes along the sequence, those new among them added."""
        number, up, kids, path = self.number, self.up, self.kids, []
        parent = 0
        for x in sequence:
            last, side = parent, 1
            at = kids[1][parent]
            while at and number[at] != x:
                last, side = at, 0 if x < number[at] else 2
                at = kids[side][at]
            if not at:
                at = len(number)
                number.append(x)
                up.append(parent)
                for k in kids:
                    k.append(0)
                kids[side][last] = at
            path.append(at)
            parent = at
        return path


def medians(n: int) -> Iterator[int]:
    """0 to n - 1: the median, then the medians of both halves, and so on."""
    spans = [(0, n)]
    for a, b in spans:
        if a < b:
            m = (a + b) // 2
            yield m
            spans += [(a, m), (m + 1, b)]


def shard_nodes(rows: list[dict], base: int) -> Iterator[dict]:
    """The trie nodes of one shard's entries, as ``_NODES``; base: the depth
    of the trees' roots.  Nodes with a key are partial."""
    rows = sorted(rows, key=lambda r: (r["tree"], r["ids"]))
    trees = {t: i for i, t in enumerate(sorted({r["tree"] for r in rows}))}
    tree = TernaryTree()
    paths: list = [None] * len(rows)
    depth, chars, n, conv = [0], [0], [0], [None]
    children, leaves, saved, end_key, name = [0], [0], [0], [None], [None]
    for m in medians(len(rows)):
        r = rows[m]
        path = tree.insert([trees[r["tree"]], *r["ids"]])
        for j, at in enumerate(path):
            if at == len(depth):  # new
                for column, value in ((depth, j), (chars, r["chars"][j - 1] if j else 0), (n, 0), (conv, None), (children, 0), (leaves, 0), (saved, 0),
                                      (end_key, None), (name, None if j else r["tree"])):
                    column.append(value)
        at, paths[m] = path[-1], path
        n[at] += r["n"]
        conv[at] = r["conv"] if conv[at] is None else min(conv[at], r["conv"])
        if r["ends"]:
            end_key[at] = r["next"]
        children[at] += r["more_children"] or 0
        leaves[at] += r["more_leaves"] or 0
        saved[at] += r["more_saved"] or 0
    key: dict[int, str] = {}
    for r, path in ((rows[0], paths[0]), (rows[-1], paths[-1])) if rows else ():
        h = hashlib.blake2b(f"{base}:{r['tree']}".encode(), digest_size=16)
        key[path[0]] = h.hexdigest()
        for at, x in zip(path[1:], r["ids"]):
            h.update(x.to_bytes(8, "little", signed=True))
            key[at] = h.hexdigest()
    for at in range(len(depth) - 1, 0, -1):  # children before parents
        up = tree.up[at]
        n[up] += n[at]
        conv[up] = conv[at] if conv[up] is None else min(conv[up], conv[at])
        if at not in key:
            leaves[at] = leaves[at] if children[at] else 1
            saved[at] += (n[at] - 1) * chars[at]
            children[up] += 1
            leaves[up] += leaves[at]
            saved[up] += saved[at]
    for at in range(1, len(depth)):
        up, over = tree.up[at], []
        if at in key:
            while up:
                over.append(key[up])
                up = tree.up[up]
            up = tree.up[at]
        yield {"depth": base + depth[at], "n": n[at], "conv": conv[at], "parent_conv": conv[up] if up and up not in key else None, "chars": chars[at],
               "children": children[at], "leaves": leaves[at], "saved": saved[at], "end_key": end_key[at], "tree": name[at], "key": key.get(at),
               "parent_key": key.get(up), "ancestors": over}


def level_nodes(entries: DataFrame, base: int, shards: int) -> DataFrame:
    """The whole nodes of the trees of one level, roots with their ``tree``."""
    ship_package(entries.sparkSession)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = shard_nodes([r for b in batches for r in b.to_pylist()], base)
        while part := [x for x, _ in zip(nodes, range(20_000))]:
            yield pa.RecordBatch.from_pylist(part, schema=_ARROW)

    made = staged(entries.repartitionByRange(shards, "tree", "ids").mapInArrow(grow, _NODES))
    part = made.filter(F.col("key").isNotNull())
    merged = staged(part.groupBy("key").agg(
        *[F.first(c).alias(c) for c in ("depth", "chars", "tree", "parent_key", "ancestors")], F.max("end_key").alias("end_key"), F.min("conv").alias("conv"),
        *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]))
    below = merged.filter(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    counted = merged.join(below, "key", "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0)))
    counted = staged(counted.withColumn("leaves", F.col("leaves") + F.when(F.col("children") == 0, 1).otherwise(0))
                     .withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("chars")).drop("more"))
    sums = (counted.select(F.explode(F.concat("ancestors", F.array("key"))).alias("key"), "leaves", "saved")
            .groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    columns = ["depth", "n", "conv", "parent_conv", "children", "leaves", "saved", "end_key", "tree"]
    over = counted.select(F.col("key").alias("parent_key"), F.col("conv").alias("over_conv"))
    whole = counted.drop("leaves", "saved").join(sums, "key").withColumn("parent_conv", F.lit(None).cast("bigint"))
    inner = made.filter(F.col("key").isNull())
    hung = inner.filter(F.col("parent_key").isNotNull()).select(*columns, "parent_key").unionByName(whole.select(*columns, "parent_key"))
    hung = hung.join(over, "parent_key", "left").withColumn("parent_conv", F.coalesce("parent_conv", "over_conv"))
    return staged(inner.filter(F.col("parent_key").isNull()).select(*columns).unionByName(hung.select(*columns)))


def end_digests(ends: DataFrame) -> DataFrame:
    """end_key, digest: SHA-256 of each key's conversations in ascending
    order, comma-joined.  The ids are sorted and joined in bounded texts
    first; the digest itself reads these in order, one at a time."""
    texts = (ends.groupBy("end_key", F.floor(F.col("conv_id") / IDS_PER_TEXT).alias("part"))
             .agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, h = None, None
        for b in batches:
            done = []
            for key, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if key == last:
                    h.update(b"," + ids.encode())
                    continue
                if last is not None:
                    done.append((last, h.hexdigest()))
                last, h = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([{"end_key": k, "digest": d} for k, d in done], schema=_DIGESTS)
        if last is not None:
            yield pa.RecordBatch.from_pylist([{"end_key": last, "digest": h.hexdigest()}], schema=_DIGESTS)

    return (texts.repartition("end_key").sortWithinPartitions("end_key", "part").select("end_key", "ids")
            .mapInArrow(digest, "end_key string, digest string"))


_DIGESTS = pa.schema([("end_key", pa.string()), ("digest", pa.string())])
_ARROW = pa.schema([(f.split()[0], {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}[f.split()[1]])
                    for f in _NODES.split(", ")])


def prefix_tree(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every node of the trie of the rebuilt conversations: conv_id (its
    smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (in code points), ends_sha256.

    Turns that tie are ordered by role, then text; repeated rows are turns of
    their own; rows of a NULL conv_id take no part; NULL roles and texts are
    empty; texts are known by 128 bits of hashes, at any length; other columns
    are not read.  An empty table has no node, not even the root.
    """
    turns, sizes = rebuilt(staged(encoded(conversations)))
    blocks = staged(blocks_of(turns, sizes, block))
    entries = staged(blocks.groupBy("block", "tree", "ids", "chars", "next")
                     .agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv"), F.sum(F.col("ends").cast("int")).alias("ends")))
    held = {r.block: r.held for r in entries.groupBy("block").agg(F.sum(F.size("ids") + 1).alias("held")).collect()}  # a row per level
    levels, more = [], None
    for k in sorted(held, reverse=True):
        own = entries.filter(F.col("block") == k).drop("block")
        if more is None:
            own = own.select("*", *[F.lit(None).cast("bigint").alias(f"more_{c}") for c in ("children", "leaves", "saved")])
        else:
            own = own.join(more, "next", "left")
        nodes = level_nodes(own, k * block, max(partitions(own.sparkSession), -(-held[k] // SHARD_IDS)))
        more = nodes.filter(F.col("tree").isNotNull()).select(
            F.col("tree").alias("next"), *[F.col(c).alias(f"more_{c}") for c in ("children", "leaves", "saved")])
        levels.append(nodes.filter(F.col("tree").isNull()) if k else nodes)
    if not levels:
        levels = [conversations.sparkSession.createDataFrame([], "depth int, n bigint, conv bigint, parent_conv bigint, children bigint, leaves bigint, saved bigint, end_key string")]
    nodes = reduce(DataFrame.unionByName, [x.drop("tree") for x in levels])
    ended = nodes.filter(F.col("end_key").isNotNull()).join(end_digests(blocks.filter("ends").select(F.col("next").alias("end_key"), "conv_id")), "end_key")
    passed = nodes.filter(F.col("end_key").isNull()).withColumn("digest", F.lit(_EMPTY))
    return ended.unionByName(passed).select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("bigint").alias("depth"), F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("digest").alias("ends_sha256"))
