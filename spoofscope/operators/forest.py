"""Random forests of whole trees on all rows, however many.

Spark ML's learner holds every node of every tree on the driver.  Trees that
are grown out have nearly as many nodes as rows, so that ends at a few
thousand rows.  Here no machine holds a tree, and none is stored: rows that
are to be scored go down a tree together with those it is grown from.

The trees are those of Spark ML's classifier: 32 bins for each feature, cut at
quantiles of all training rows (all values, where there are no more), a NULL or
NaN in the last; each tree draws every row a Poisson number of times; each node
tries the root of the number of features; the split of the largest Gini gain
by class-balanced rows, at most 30 levels deep.  The probability is the mean of
the leaves'.  Nothing is merged after growing.

Rows are binned to a byte for each feature and stored.  Nodes of more than
``SUBTREE_ROWS`` drawn rows are split level by level from summed counts; the
subtree below is grown from its rows in one task.  So many trees at a time are
grown that their rows stay within ``GROUP_BYTES``.  Counts are whole numbers
and draws follow a hash of the row and how often it came before, so a forest
does not depend on partitions.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from math import ceil, sqrt
from threading import Lock

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Imputer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoofscope.session import ensure_checkpoint_dir, ship_package

BINS = 32
#: Drawn rows of a node whose subtree one task grows, at most.
SUBTREE_ROWS = 1 << 20
#: Rows of a stored block, and bytes that a group of trees shuffles.
BLOCK_ROWS, GROUP_BYTES = 1 << 16, 6 << 30
#: Nodes whose counts are held at once.
NODES_AT_ONCE = 512
#: Probabilities and gains are summed as whole numbers of these parts, in any order.
PROBABILITY_PARTS, GAIN_PARTS = 1 << 40, 1 << 16
SCORE, GAIN = 0, 1

_GOLD = 0x9E3779B97F4A7C15
_LIMITS = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])
#: Poisson numbers of mean 1 by the upper 16 bits of a hash.
_DRAWS = np.searchsorted(_LIMITS, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def drawn(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row."""
    return _DRAWS[_mix(ids + np.uint64((tree + 1) * _GOLD + seed & (1 << 64) - 1)) >> np.uint64(48)]


def tried(rng: np.random.Generator, nodes: int, width: int) -> np.ndarray:
    """The features that each node tries: as many as the root of their number."""
    most = ceil(sqrt(width))
    return np.argpartition(rng.random((nodes, width), np.float32), most - 1, axis=1)[:, :most]


def best_splits(hist: np.ndarray, pick: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature or -1, last bin on the left, gain) for counts by class, node, tried feature and bin.
    Of two classes, a node's count times its Gini impurity is twice the product of their masses over their sum."""
    mass = hist * weight[:, None, None, None]
    left = mass.cumsum(3)
    total = left[:, :, :, -1:]
    (l0, l1), (r0, r1) = left[..., :-1], (total - left)[..., :-1]
    n = hist.cumsum(3)[..., :-1].sum(0)
    every = hist.sum((0, 3))[..., None]
    cost = l0 * l1 / np.maximum(l0 + l1, 1e-300) + r0 * r1 / np.maximum(r0 + r1, 1e-300)
    cost[(n == 0) | (n == every)] = np.inf
    cost = cost.reshape(cost.shape[0], -1)
    best, nodes = cost.argmin(1), np.arange(len(cost))
    t0, t1 = total[:, :, 0, 0]
    gain = 2 * (t0 * t1 / np.maximum(t0 + t1, 1e-300) - cost[nodes, best])
    feature = pick[nodes, best // (BINS - 1)]
    return np.where(gain > 1e-9 * (t0 + t1), feature, -1), best % (BINS - 1), gain


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, asked: np.ndarray, weight: np.ndarray, rng: np.random.Generator, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Grows a tree from binned rows, a level at a time; returns the probability of class 1 for the
    rows ``asked`` and the gain of each feature.  Rows lie in order of their nodes."""
    width = x.shape[1]
    flat, flat_asked = x.ravel(), asked.ravel()
    gains, p = np.zeros(width), np.zeros(len(asked))
    rows, y, w = np.arange(len(x)), y.astype(np.int64), w.astype(np.float64)
    first = np.array([0, len(x)])
    of, at = np.arange(len(asked)), np.zeros(len(asked), np.int64)  # rows asked that are in no leaf yet, and their nodes
    while len(first) > 1:
        nodes = len(first) - 1
        node = np.repeat(np.arange(nodes), np.diff(first))
        counts = np.bincount(2 * node + y, w, 2 * nodes).reshape(nodes, 2)
        mass = counts * weight
        leaf_p = mass[:, 1] / np.maximum(mass.sum(1), 1e-300)
        feature, cut = np.full(nodes, -1), np.zeros(nodes, np.int64)
        inner = np.flatnonzero((counts > 0).all(1)) if depth > 0 else np.zeros(0, np.int64)
        for k in range(0, len(inner), NODES_AT_ONCE):
            some = inner[k:k + NODES_AT_ONCE]
            local = np.full(nodes, -1)
            local[some] = np.arange(len(some))
            s = slice(first[some[0]], first[some[-1] + 1])
            mine = local[node[s]]
            keep = np.flatnonzero(mine >= 0)
            mine, at_row, cls, times = mine[keep], rows[s][keep] * width, y[s][keep], w[s][keep]
            pick = tried(rng, len(some), width)
            hist = np.empty((2, len(some), pick.shape[1], BINS))
            cell = (cls * len(some) + mine) * BINS
            for j in range(pick.shape[1]):
                bins = flat[at_row + pick[mine, j]]
                hist[:, :, j] = np.bincount(cell + bins, times, 2 * len(some) * BINS).reshape(2, -1, BINS)
            f, c, gain = best_splits(hist, pick, weight)
            feature[some], cut[some] = f, c
            gains += np.bincount(f[f >= 0], gain[f >= 0], width)
        ended = feature[at] < 0
        p[of[ended]] = leaf_p[at[ended]]
        of, at = of[~ended], at[~ended]
        child = 2 * (np.cumsum(feature >= 0) - 1)
        at = child[at] + (flat_asked[of * width + feature[at]] > cut[at])
        stays = feature[node] >= 0
        rows, y, w, node = rows[stays], y[stays], w[stays], node[stays]
        right = flat[rows * width + feature[node]] > cut[node]
        new = child[node] + right
        first = np.r_[0, np.cumsum(np.bincount(new, minlength=2 * int((feature >= 0).sum())))]
        if not len(rows):
            break
        # left rows before right ones within a node, else in the order they have
        before = np.cumsum(right) - right  # right rows before, of all nodes
        begin = first[child[node]]
        place = np.where(right, first[child[node] + 1] + before - before[begin], np.arange(len(rows)) - (before - before[begin]))
        moved = np.empty(len(rows), np.int64)
        moved[place] = np.arange(len(rows))
        rows, y, w = rows[moved], y[moved], w[moved]
        depth -= 1
        if depth % 4 == 0:  # a node's rows side by side, for the cache
            x = x[rows]
            flat, rows = x.ravel(), np.arange(len(rows))
    return p, gains


class Top:
    """The nodes of one tree that are split from summed counts."""

    def __init__(self, max_depth: int) -> None:
        self.feature, self.cut, self.child, self.depth = [-1], [0], [-1], [max_depth]  # depth: levels left
        self.ended: dict[int, float] = {}  # probability of leaves

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        left = len(self.feature)
        self.feature[node], self.cut[node], self.child[node] = feature, cut, left
        for c in (self.feature, self.child):
            c += [-1, -1]
        self.cut += [0, 0]
        self.depth += [self.depth[node] - 1] * 2
        return left, left + 1

    def leaves(self) -> list[int]:
        return [i for i, f in enumerate(self.feature) if f < 0]

    def route(self, x: np.ndarray) -> np.ndarray:
        feature, cut, child = (np.array(c) for c in (self.feature, self.cut, self.child))
        node = np.zeros(len(x), np.int64)
        inner = np.flatnonzero(feature[node] >= 0)
        while len(inner):
            n = node[inner]
            node[inner] = child[n] + (x[inner, feature[n]] > cut[n])
            inner = inner[feature[node[inner]] >= 0]
        return node


_FREEING = [0, None]
_LOCK = Lock()
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession):
    """Shuffle files of queries are deleted as they end; forests may grow in several threads."""
    with _LOCK:
        if not _FREEING[0]:
            _FREEING[1] = spark.conf.get(_FREE, None)
            spark.conf.set(_FREE, "true")
        _FREEING[0] += 1
    try:
        yield
    finally:
        with _LOCK:
            _FREEING[0] -= 1
            if not _FREEING[0]:
                spark.conf.unset(_FREE) if _FREEING[1] is None else spark.conf.set(_FREE, _FREEING[1])


def _kept(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back; its shuffle files are deleted."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/forest-{uuid.uuid4().hex}"
    with freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def thresholds(rows: DataFrame, columns: Sequence[str]) -> list[np.ndarray]:
    """Where each feature is cut into bins: between its values if they are few, else at quantiles of all rows."""
    shares = [k / 256 for k in range(257)]
    known = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns]
    found = rows.agg(*[F.percentile_approx(c, shares, 10_000).alias(f"q{i}") for i, c in enumerate(known)]).first()
    out = []
    for q in found:
        q = np.array(q or [], np.float64)
        values = np.unique(q)
        if len(values) <= BINS:
            with np.errstate(invalid="ignore"):
                between = values[:-1] / 2 + values[1:] / 2
            out.append(np.where(np.isfinite(between), between, values[:-1]))
        else:
            out.append(np.unique(q[8:-1:8]))
    return out


BLOCK = "asked boolean, ids binary, y binary, x binary"


def blocks(rows: DataFrame, cuts: list[np.ndarray], asked: bool) -> DataFrame:
    """Rows (id or hash, class, features) as binned blocks.  Equal hashes follow one another; a row's id comes
    from its hash and how many with it came before."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size, last, seen = [], 0, None, 0

        def block() -> pa.RecordBatch:
            columns = [np.concatenate(c).tobytes() for c in zip(*kept)]
            return pa.RecordBatch.from_arrays([pa.array([asked]), *[pa.array([c], pa.binary()) for c in columns]], names=["asked", "ids", "y", "x"])

        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            if not asked:
                new = np.r_[True, ids[1:] != ids[:-1]]
                first = np.flatnonzero(new)
                before = np.arange(len(ids)) - first[np.cumsum(new) - 1]
                if last == ids[0]:
                    before[:first[1] if len(first) > 1 else len(ids)] += seen
                last, seen = ids[-1], int(before[-1]) + 1
                ids = _mix(ids.view(np.uint64) + before.astype(np.uint64) * np.uint64(_GOLD)).view(np.int64)
            x = np.stack([np.searchsorted(t, b.column(2 + i).to_numpy(zero_copy_only=False)) for i, t in enumerate(cuts)], axis=1).astype(np.uint8)
            kept.append((ids, b.column(1).to_numpy(zero_copy_only=False).astype(np.uint8), x.ravel()))
            size += len(ids)
            if size >= BLOCK_ROWS:
                yield block()
                kept, size = [], 0
        if kept:
            yield block()

    return rows.mapInArrow(pack, BLOCK)


def _unpacked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for i in range(b.num_rows):
            ids, y, x = (np.frombuffer(b.column(k)[i].as_py(), d) for k, d in ((1, np.uint64), (2, np.uint8), (3, np.uint8)))
            yield b.column(0)[i].as_py(), ids, y, x.reshape(-1, width)


class Forest:
    """A forest on all of ``train``.  Its trees are grown when rows are scored (or importances asked for), and the
    rows go down with them."""

    def __init__(self, train: DataFrame, features: Sequence[str], label: str = "y", impute: bool = False,
                 n_trees: int = 300, max_depth: int = 30, seed: int = 42) -> None:
        self.spark, self.label, self.columns = train.sparkSession, label, list(features)
        self.n_trees, self.max_depth, self.seed, self.gains = n_trees, max_depth, seed, None
        self.imputer = None
        if impute:
            self.imputer = Imputer(inputCols=self.columns, outputCols=[f"{c}__imp" for c in self.columns], strategy="median", relativeError=1e-4).fit(train)
            train, self.columns = self.imputer.transform(train), [f"{c}__imp" for c in self.columns]
        with _LOCK:  # shipping twice at once fails
            ship_package(self.spark)
        counts = {int(r[0]): r[1] for r in train.groupBy(label).count().collect()}
        self.n = sum(counts.values())
        self.weight = np.array([self.n / (len(counts) * counts[c]) if counts.get(c) else 0.0 for c in (0, 1)])
        self.cuts = thresholds(train, self.columns)
        rows = train.select(F.xxhash64(label, *self.columns).alias("_h"), F.col(label).cast("int"), *self._values())
        self.train = _kept(blocks(rows.repartition(self._tasks(), "_h").sortWithinPartitions("_h"), self.cuts, False))

    def _tasks(self) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions", "200")), self.spark.sparkContext.defaultParallelism)

    def _values(self) -> list:
        return [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(self.columns)]

    def importances(self) -> list[float]:
        """Mean over the trees of each feature's share of the tree's gain, scaled to 1 in all."""
        if self.gains is None:
            self._grown(None, 0)
        total = self.gains.sum(1, keepdims=True)
        mean = np.divide(self.gains, total, out=np.zeros_like(self.gains), where=total > 0).mean(0)
        return (mean / (mean.sum() or 1.0)).tolist()

    def probabilities(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` with the probability of class 1."""
        df = df.withColumn("_asked", F.monotonically_increasing_id()).checkpoint(eager=True)  # ids stay as they are
        rows = self.imputer.transform(df) if self.imputer else df
        asked = _kept(blocks(rows.select("_asked", F.lit(0), *self._values()), self.cuts, True))
        sums = self._grown(asked, df.count())
        mean = (F.col("_sum") / F.lit(float(PROBABILITY_PARTS)) / F.lit(float(self.n_trees))).alias(out)
        return rows.join(sums.withColumnRenamed("id", "_asked"), "_asked", "left").select(*[c for c in rows.columns if c != "_asked"], mean)

    def _grown(self, asked: DataFrame | None, n_asked: int) -> DataFrame:
        """(id, _sum) of the rows asked, over all trees; keeps the gains."""
        width = len(self.columns)
        a_tree = 0.64 * self.n * (width + 2) + n_asked * (width + 8)
        at_once = int(min(self.n_trees, max(1, GROUP_BYTES // max(1, a_tree))))
        gains, parts = np.zeros((self.n_trees, width)), []
        for first in range(0, self.n_trees, at_once):
            trees = range(first, min(self.n_trees, first + at_once))
            tops = self._tops(trees, gains)
            found = _kept(self._subtrees(tops, asked))
            for r in found.filter(F.col("kind") == GAIN).collect():
                gains[r.id // width, r.id % width] += r.value / GAIN_PARTS
            parts.append(found.filter(F.col("kind") == SCORE))
        self.gains = gains
        every = parts[0]
        for p in parts[1:]:
            every = every.union(p)
        return every.groupBy("id").agg(F.sum("value").alias("_sum"))

    def _tops(self, trees: range, gains: np.ndarray) -> dict[int, Top]:
        """The trees down to nodes that one task grows on."""
        tops = {t: Top(self.max_depth) for t in trees}
        open_ = {t: [0] for t in trees} if 0.64 * self.n > SUBTREE_ROWS else {}
        while open_:
            following: dict[int, list[int]] = {}
            for t, node, feature, cut, gain, *counts in self._level(tops, open_).collect():
                top = tops[t]
                sides = [(top.ended, node, np.array(counts[:2]) + counts[2:])] if feature < 0 else []
                if feature >= 0:
                    gains[t, feature] += gain
                    sides = [(top.ended, c, np.array(n)) for c, n in zip(top.split(node, feature, cut), (counts[:2], counts[2:]))]
                for ended, at, n in sides:
                    mass = n * self.weight
                    if feature < 0 or (n == 0).any() or top.depth[at] == 0:
                        ended[at] = float(mass[1] / max(mass.sum(), 1e-300))
                    elif n.sum() > SUBTREE_ROWS:
                        following.setdefault(t, []).append(at)
            open_ = {t: sorted(nodes) for t, nodes in following.items()}
        return tops

    def _level(self, tops: dict[int, Top], open_: dict[int, list[int]]) -> DataFrame:
        """The splits of the open nodes, from counts that each task sums over its rows."""
        width, seed, weight = len(self.columns), self.seed, self.weight
        most = ceil(sqrt(width))

        def picks(t: int) -> np.ndarray:
            return np.concatenate([tried(np.random.default_rng([seed, t, node]), 1, width) for node in open_[t]])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {t: np.zeros(len(nodes) * most * BINS * 2, np.int64) for t, nodes in open_.items()}
            pick = {t: picks(t) for t in open_}
            for _, ids, y, x in _unpacked(batches, width):
                for t, nodes in open_.items():
                    w = drawn(ids, t, seed)
                    local = np.full(len(tops[t].feature), -1)
                    local[nodes] = np.arange(len(nodes))
                    at = local[tops[t].route(x)]
                    here = np.flatnonzero((at >= 0) & (w > 0))
                    at, times, cls = at[here], w[here].astype(np.float64), y[here].astype(np.int64)
                    for j in range(most):
                        bins = x[here, pick[t][at, j]]
                        sums[t] += np.bincount(((cls * len(nodes) + at) * most + j) * BINS + bins, times, len(sums[t])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], names=["tree", "counts"])

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for t, c in zip(b.column(0).to_pylist(), b.column(1)):
                    c = np.frombuffer(c.as_py(), np.int64)
                    total[t] = total[t] + c if t in total else c
            out = []
            for t, c in total.items():
                hist, pick = c.reshape(2, -1, most, BINS).astype(np.float64), picks(t)
                feature, cut, gain = best_splits(hist, pick, weight)
                for i, node in enumerate(open_[t]):
                    j = int(np.flatnonzero(pick[i] == feature[i])[0]) if feature[i] >= 0 else 0
                    left, every = hist[:, i, j, :cut[i] + 1].sum(1), hist[:, i, j].sum(1)
                    out.append((t, node, int(feature[i]), int(cut[i]), float(gain[i]), *[int(v) for v in (*left, *(every - left))]))
            if out:
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["tree", "node", "feature", "cut", "gain", "l0", "l1", "r0", "r1"])

        return (self.train.mapInArrow(count, "tree int, counts binary").repartition(min(self._tasks(), len(open_)), "tree")
                .mapInArrow(choose, "tree int, node int, feature int, cut int, gain double, l0 bigint, l1 bigint, r0 bigint, r1 bigint"))

    def _subtrees(self, tops: dict[int, Top], asked: DataFrame | None) -> DataFrame:
        """(kind, id, value): summed probabilities of the rows asked, and gains, of the trees below ``tops``."""
        width, seed, weight = len(self.columns), self.seed, self.weight
        leaves = sum(len(t.leaves()) for t in tops.values())
        names, kinds = ["tree", "leaf", "y", "x", "ids", "asked"], [pa.int32(), pa.int32(), *[pa.binary()] * 4]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ask, ids, y, x in _unpacked(batches, width):
                for t, top in tops.items():
                    if not ask:
                        w = drawn(ids, t, seed)
                        here = np.flatnonzero(w)
                        mine, cls = x[here], y[here] | w[here] << 1
                    else:
                        mine, cls = x, ids
                    node = top.route(mine)
                    by = np.argsort(node, kind="stable") if len(top.feature) > 1 else np.arange(len(node))
                    edges = np.r_[0, np.flatnonzero(np.diff(node[by])) + 1, len(by)]
                    rows = []
                    for a, e in zip(edges[:-1], edges[1:]):
                        if a < e:
                            leaf, data = int(node[by[a]]), (cls[by[a:e]].tobytes(), mine[by[a:e]].tobytes())
                            if ask:
                                rows.append((t, leaf, b"", b"", *data))
                            elif leaf not in top.ended:
                                rows.append((t, leaf, *data, b"", b""))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        def finish(tree: int, leaf: int, blobs: list[tuple[bytes, ...]]) -> Iterator[pa.RecordBatch]:
            cls, x, ids, wanted = (np.frombuffer(b"".join(c), d) for c, d in zip(zip(*blobs), (np.uint8, np.uint8, np.int64, np.uint8)))
            top = tops[tree]
            if leaf in top.ended:
                p, gains = np.full(len(ids), top.ended[leaf]), np.zeros(width)
            else:
                p, gains = grow(x.reshape(-1, width), cls & 1, cls >> 1, wanted.reshape(-1, width), weight, np.random.default_rng([seed, tree, leaf, 1]), top.depth[leaf])
            parts = [(SCORE, ids, np.rint(p * PROBABILITY_PARTS)), (GAIN, tree * width + np.arange(width), np.rint(gains * GAIN_PARTS))]
            for kind, i, v in parts:
                for k in range(0, len(i), BLOCK_ROWS):
                    of = i[k:k + BLOCK_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), kind, np.int32)), pa.array(of.astype(np.int64)), pa.array(v[k:k + BLOCK_ROWS].astype(np.int64))],
                                                     names=["kind", "id", "value"])

        def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, kept = None, []
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    if row[:2] != now and kept:
                        yield from finish(*now, kept)
                        kept = []
                    now = row[:2]
                    kept.append(row[2:])
            if kept:
                yield from finish(*now, kept)

        rows = self.train if asked is None else self.train.union(asked)
        dealt = rows.mapInArrow(deal, "tree int, leaf int, y binary, x binary, ids binary, asked binary")
        return (dealt.repartition(max(self._tasks(), min(leaves, 512)), "tree", "leaf").sortWithinPartitions("tree", "leaf")
                .mapInArrow(ends, "kind int, id bigint, value bigint").groupBy("kind", "id").agg(F.sum("value").alias("value")))
