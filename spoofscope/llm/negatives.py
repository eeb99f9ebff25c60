"""Hard negatives: for an anchor and each of its positives, the best-scoring rows of other labels within a band below the positive.

Scores are inner products.  Every vector is stored with the mean and the
deviation of each of its segments; two vectors' score lies within the sum,
over segments, of length x (product of means +- product of deviations).
Segments are refined in levels (1, 4, 16 of them): a pair whose bounds show
that it can't be among the wanted is dropped at the coarsest level that shows
it, and what is left is scored exactly.

Rows and anchors are hashed into blocks, and each pair of blocks is one group:
a group's size is bounded, anchors (and rows) are repeated once per block of
the other side, and only the first few of each group go on to be merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoofscope.llm.common import ship_package, staged

#: Segments of the levels, coarsest first; each divides the next.
LEVELS = (1, 4, 16)
#: Rows of a block at most, about; below, blocks are the root of the number of rows.
BLOCK_ROWS = 1 << 16
#: Pairs whose bounds are held at a time.
TILE = 1 << 17
#: Positives of an anchor, and negatives of an anchor and positive.
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least so many hundredths of the positive's.
LEAST_SHARE = 80
#: Bounds are widened by this share of their size, for rounding.
SLACK = 1e-9
#: Scores beyond count as this, and components of more than the other are cut to it.
_FAR, _LARGEST = 1 << 62, 1e100


def indexed(embeddings: DataFrame, vector: str = "embedding", label: Column | None = None, scale: float = 256.0) -> DataFrame:
    """rid, vec_id, label, v, means and deviations (of the finest segments) of
    every row that takes part: those with a label and a vector without NULL,
    NaN or infinite components.  A component x becomes floor(scale * x)."""
    ship_package(embeddings.sparkSession)
    label = F.col("label") if label is None else label
    v = F.transform(vector, lambda x: x.cast("double"))
    sound = label.isNotNull() & F.col(vector).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (embeddings.filter(F.coalesce(sound, F.lit(False))).select("vec_id", label.cast("bigint").alias("label"), v.alias("v"))
            .withColumn("rid", F.monotonically_increasing_id()))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            whole = [np.floor(np.clip(np.asarray(x, float), -_LARGEST, _LARGEST) * scale) for x in b["v"]]
            found = [summary(x) for x in whole]
            yield b.assign(v=whole, means=[m for m, _ in found], deviations=[d for _, d in found])

    return staged(rows.mapInPandas(add, "vec_id bigint, label bigint, v array<double>, rid bigint, means array<double>, deviations array<double>"))


def width(dims: int) -> int:
    """Components of a finest segment; the last one is filled up with zeros."""
    return max(1, -(-dims // LEVELS[-1]))


def summary(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each finest segment."""
    w = width(len(v))
    s = np.concatenate([v, np.zeros(LEVELS[-1] * w - len(v))]).reshape(LEVELS[-1], w)
    return s.mean(1), s.std(1)


def coarser(means: np.ndarray, deviations: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of fewer, longer segments, from those of the finest."""
    m, d = (x.reshape(len(x), segments, -1) for x in (means, deviations))
    mean = m.mean(2)
    return mean, np.sqrt((d * d).mean(2) + ((m - mean[:, :, None]) ** 2).mean(2))


class Side:
    """The rows or anchors of a block whose vectors have the same length."""

    def __init__(self, rows: pd.DataFrame, dims: int) -> None:
        self.rows, self.width = rows, width(dims)
        self.v = np.stack(rows["v"].to_list()).astype(float).reshape(len(rows), dims)
        fine = [np.stack(rows[c].to_list()).astype(float) for c in ("means", "deviations")]
        self.levels = [coarser(*fine, s) for s in LEVELS]
        self.most = float(np.abs(self.v).max(initial=0.0))


def bounds(a: Side, b: Side, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of the pairs (i, j)."""
    (am, ad), (bm, bd) = a.levels[level], b.levels[level]
    w = a.width * LEVELS[-1] // LEVELS[level]
    am, ad, bm, bd = am[i], ad[i], bm[j], bd[j]
    mid, off = np.einsum("ij,ij->i", am, bm), np.einsum("ij,ij->i", ad, bd)
    off += SLACK * np.einsum("ij,ij->i", np.abs(am) + ad, np.abs(bm) + bd)
    return np.clip(w * (mid - off), -_FAR, _FAR), np.clip(w * (mid + off), -_FAR, _FAR)


def exact(a: Side, b: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The scores; products that doubles can't hold are added up as whole numbers of any size."""
    if a.most * b.most * max(1, a.v.shape[1]) < 2 ** 52:
        return np.einsum("ij,ij->i", a.v[i], b.v[j]).astype(np.int64)
    return np.array([max(-_FAR, min(_FAR, sum(int(x) * int(y) for x, y in zip(a.v[p], b.v[q])))) for p, q in zip(i, j)], dtype=np.int64)


def kth_largest(owner: np.ndarray, value: np.ndarray, k: int, owners: int) -> np.ndarray:
    """Each owner's k-th largest value; minus infinity if it has fewer."""
    order = np.lexsort((-value, owner))
    first = np.searchsorted(owner[order], np.arange(owners + 1))
    at = first[:-1] + k - 1
    out = np.full(owners, -np.inf)
    has = at < first[1:]
    out[has] = value[order][at[has]]
    return out


def best(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each owner's first ``k`` pairs, higher scores and then smaller ids first."""
    order = np.lexsort((ids, -score, owner))
    o = owner[order]
    return order[np.arange(len(o)) - np.searchsorted(o, o) < k]


def tiles(a: Side, b: Side) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j) of a block, some anchors at a time."""
    step = max(1, TILE // max(1, len(b.rows)))
    for s in range(0, len(a.rows), step):
        n = min(step, len(a.rows) - s)
        yield np.repeat(np.arange(s, s + n), len(b.rows)), np.tile(np.arange(len(b.rows)), n)


def positives_of(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the first other rows of each anchor's label."""
    al, bl, ar, br, ids = a.rows["label"].to_numpy(), b.rows["label"].to_numpy(), a.rows["rid"].to_numpy(), b.rows["rid"].to_numpy(), _ids(b)
    out = []
    for i, j in tiles(a, b):
        keep = (al[i] == bl[j]) & (ar[i] != br[j])
        i, j = i[keep], j[keep]
        for level in range(len(LEVELS)):
            low, high = bounds(a, b, level, i, j)
            keep = high >= kth_largest(i, low, POSITIVES, len(a.rows))[i]
            i, j = i[keep], j[keep]
        score = exact(a, b, i, j)
        at = best(i, score, ids[j], POSITIVES)
        out.append((i[at], j[at], score[at]))
    return tuple(np.concatenate(x) for x in zip(*out))


def negatives_of(a: Side, b: Side, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, ...]:
    """(i, j, positive's place, score) of the first rows of other labels
    within each positive's band; least, most: (anchors, positives), with an
    empty band where there is no positive."""
    al, bl, ids = a.rows["label"].to_numpy(), b.rows["label"].to_numpy(), _ids(b)
    out = []
    for i, j in tiles(a, b):
        keep = al[i] != bl[j]
        i, j = i[keep], j[keep]
        for level in range(len(LEVELS)):
            low, high = bounds(a, b, level, i, j)
            keep = np.zeros(len(i), bool)
            for p in range(least.shape[1]):
                band_low, band_high = least[i, p].astype(float), most[i, p].astype(float)
                sure = (low >= band_low) & (high <= band_high)
                cut = kth_largest(i[sure], low[sure], NEGATIVES, len(a.rows))[i]
                keep |= (high >= np.maximum(band_low, cut)) & (low <= band_high) & (band_low <= band_high)
            i, j = i[keep], j[keep]
        score = exact(a, b, i, j)
        for p in range(least.shape[1]):
            inside = (score >= least[i, p]) & (score <= most[i, p])
            x, y, s = i[inside], j[inside], score[inside]
            at = best(x, s, ids[y], NEGATIVES)
            out.append((x[at], y[at], np.full(len(at), p), s[at]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _ids(side: Side) -> np.ndarray:
    """vec_ids, NULL after all others."""
    return np.array([np.iinfo(np.int64).max if x is None or x != x else int(x) for x in side.rows["vec_id"].astype(object)], dtype=np.int64)


def _pairs(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, work, schema: str) -> DataFrame:
    """``work(anchors, rows)`` on every pair of blocks."""
    size = min(BLOCK_ROWS, max(1, math.isqrt(max(n_rows, 1))))
    row_blocks, anchor_blocks = -(-n_rows // size) or 1, -(-n_anchors // size) or 1
    place = lambda n: F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("ab", place(anchor_blocks)).withColumn("rb", every(row_blocks))
    right = rows.withColumn("rb", place(row_blocks)).withColumn("ab", every(anchor_blocks))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        for dims, own in a.groupby(a["v"].map(len)):  # vectors of different lengths have no score
            other = b[b["v"].map(len) == dims]
            if len(other):
                found.append(work(Side(own.reset_index(drop=True), dims), Side(other.reset_index(drop=True), dims)))
        return pd.concat(found) if found else pd.DataFrame({f.split()[0]: [] for f in schema.split(", ")})

    return left.groupBy("ab", "rb").cogroup(right.groupBy("ab", "rb")).applyInPandas(run, schema)


def hard_negatives(index: DataFrame, is_anchor: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``index`` is what ``indexed`` returns.  An anchor's positives are its first
    ``POSITIVES`` other rows of its label; ties go by vec_id, NULL last, then
    by row.  Repeated rows are rows of their own, and rows of a NULL vec_id
    are no anchors.  Vectors of different lengths have no score; empty ones
    score 0.  Scores beyond +-2^62 count as that.  Empty tables, anchors
    without positives and positives without negatives give no rows.
    """
    schema = "rid bigint, other bigint, other_id bigint, score bigint, place int"
    anchors = staged(index.filter(F.coalesce(is_anchor, F.lit(False))))
    n_rows, n_anchors = index.count(), anchors.count()

    def told(a: Side, b: Side, i: np.ndarray, j: np.ndarray, place, score: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"rid": a.rows["rid"].to_numpy()[i], "other": b.rows["rid"].to_numpy()[j],
                             "other_id": b.rows["vec_id"].astype("Int64").to_numpy()[j], "score": score, "place": place})

    def near(a: Side, b: Side) -> pd.DataFrame:
        i, j, score = positives_of(a, b)
        return told(a, b, i, j, 0, score)

    def hard(a: Side, b: Side) -> pd.DataFrame:
        least, most = np.ones((len(a.rows), POSITIVES), np.int64), np.zeros((len(a.rows), POSITIVES), np.int64)
        for r, scores in enumerate(a.rows["scores"]):
            for p, s in enumerate(map(int, scores)):
                if s >= 0:
                    least[r, p], most[r, p] = -(-LEAST_SHARE * s // 100), s
        return told(a, b, *negatives_of(a, b, least, most))

    def first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("other_id"), "other")
        return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    positives = staged(first(_pairs(index, anchors, n_rows, n_anchors, near, schema), ["rid"], POSITIVES)
                       .select("rid", (F.col("rank") - 1).alias("place"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))
    scores = positives.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("p"))
    ready = staged(anchors.join(scores.select("rid", F.col("p.positive_score").alias("scores")), "rid"))
    negatives = first(_pairs(index, ready, n_rows, n_anchors, hard, schema), ["rid", "place"], NEGATIVES)
    return (negatives.join(positives, ["rid", "place"]).join(anchors.select("rid", F.col("vec_id").alias("anchor_id")), "rid")
            .select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
