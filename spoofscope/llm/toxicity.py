"""Toxic spans by a linear-chain conditional random field.

Two states per word, clean and toxic.  A word's features are hashed pieces of
it (the word, its beginnings and its end), the transitions carry the context.
Words are labelled from labelled documents: in a toxic document, a word is
toxic if it or one of its beginnings is found in many more toxic than clean
documents.  Forward and backward passes give every word's marginal; a
document's score is a logistic function of the number and share of its likely
words and its largest marginal, fitted on the same documents, and its spans are the runs of
words whose marginal is at least one half.

Fitting uses a bounded sample of the labelled rows: ``FIT_DOCS`` documents a
label and ``FIT_CHARS`` characters, in the order of a hash of their ids.
Every document is scored, whole, by tasks that hold one batch at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoofscope.llm.common import ship_package, staged

#: The bounds of the sample that the model is fitted on.
FIT_DOCS, FIT_CHARS = 1500, 12_000_000
#: Hashed features; the lowest number stands for "no such feature".
FEATURES = 1 << 18
BEGINNINGS = (3, 4, 5, 6, 7)
ROUNDS, RATE, RIDGE = 40, 0.6, 1e-4
#: Words of a training chain; longer documents are cut into several chains.
CHAIN = 512
#: A word or beginning marks toxic documents if this many times as many toxic documents have it ...
RATIO = 8.0
#: ... and at least this share of them, and this many.
LEAST_SHARE, LEAST_DOCS = 0.015, 4
#: Words whose scores a Python worker remembers.
REMEMBERED = 400_000
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def pieces(word: str) -> list[str]:
    """The word and its beginnings, as text."""
    return [f"={word}", *[f"^{word[:n]}" for n in BEGINNINGS if len(word) >= n]]


def feature_ids(word: str) -> list[int]:
    """Hashed features, as many for every word (0: none)."""
    names = [*pieces(word), f"${word[-4:]}", f"#{min(len(word), 12)}"]
    ids = [1 + xxhash.xxh32_intdigest(n.encode()) % (FEATURES - 1) for n in names]
    return ids + [0] * (len(BEGINNINGS) + 3 - len(ids))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text is a multiple of 5; NULL ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def marginals(size: np.ndarray, emission: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of every word, and the expected counts of the four transitions.

    ``size``: words per chain; ``emission``: log odds of the words, chain by
    chain; ``trans``: log weights [from, to].  All chains advance together,
    longest first, on the ratio of the two states' messages.
    """
    n, t = len(emission), np.exp(trans)
    odds = np.exp(np.clip(emission, -30, 30))
    by = np.argsort(-size, kind="stable")
    start = (np.cumsum(size) - size)[by]
    length = size[by]
    live = np.searchsorted(-length, -np.arange(1, (int(length[0]) if len(length) else 0) + 1), side="right")
    forward, backward = np.empty(n), np.ones(n)
    counts = np.zeros((2, 2))
    if not len(live) or not live[0]:
        return forward[:0], counts
    at = start[:live[0]]
    ratio = odds[at]
    forward[at] = ratio
    for step, k in enumerate(live[1:], 1):
        at = start[:k] + step
        ratio = odds[at] * (ratio[:k] * t[1, 1] + t[0, 1]) / (ratio[:k] * t[1, 0] + t[0, 0])
        forward[at] = ratio
    beta = np.ones(len(start))
    for step in range(len(live) - 1, 0, -1):
        k = live[step]
        at = start[:k] + step
        x = odds[at] * beta[:k]
        beta[:k] = (t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x)
        backward[at - 1] = beta[:k]
    inner = np.ones(n, bool)
    inner[start[:live[0]]] = False
    later = np.flatnonzero(inner)
    f, x = forward[later - 1], odds[later] * backward[later]
    pair = np.stack([np.full(len(later), t[0, 0]), t[0, 1] * x, f * t[1, 0], f * t[1, 1] * x])
    counts = (pair / pair.sum(0)).sum(1).reshape(2, 2)
    z = forward * backward
    return z / (1 + z), counts


@dataclass(frozen=True)
class Model:
    """Feature weights, transitions and the document's logistic weights (bias first)."""

    weights: np.ndarray
    trans: np.ndarray
    doc: np.ndarray

    def emission(self, word: str) -> float:
        return float(self.weights[feature_ids(word)].sum())


def summary(p: np.ndarray) -> list[float]:
    """What a document's score is made of: how many words are likely toxic,
    their share, and the largest marginal.  Unlikely words add nothing,
    however many a long text has."""
    if not len(p):
        return [1.0, 0.0, 0.0, 0.0]
    likely = float(p[p >= 0.3].sum())
    return [1.0, np.log1p(likely), 10.0 * likely / (len(p) + 10.0), float(p.max())]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 25) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def fit(texts: list[str | None], toxic: list[int], prior: float | None = None) -> Model:
    """The field and the logistic function, from whole labelled texts.
    ``prior``: the share of toxic documents among all labelled ones, where the
    sample's own differs.  Without both labels every score is the same."""
    y = np.array(toxic, float)
    share = float(y.mean()) if len(y) else 0.0
    prior = min(max(share if prior is None else prior, 1e-3), 1 - 1e-3)
    if not 0 < share < 1:
        return Model(np.zeros(FEATURES, np.float32), np.zeros((2, 2)), np.array([np.log(prior / (1 - prior)), 0, 0, 0]))
    # words become numbers at once, so that a text is held as an array
    number: dict[str, int] = {}
    tokens = [np.fromiter((number.setdefault(w, len(number)) for w in words_of(t)), np.int64) for t in texts]
    names = list(number)
    has: list[Counter] = [Counter(), Counter()]
    for t, label in zip(tokens, toxic):
        has[label].update(set(chain.from_iterable(pieces(names[w]) for w in np.unique(t).tolist())))
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    least = max(LEAST_DOCS, LEAST_SHARE * n1)
    marks = {k for k, n in has[1].items() if n >= least and n / n1 >= RATIO * (has[0][k] + 0.5) / n0}
    del has

    marked = np.array([any(x in marks for x in pieces(w)) for w in names], bool)
    ids = np.array([feature_ids(w) for w in names], np.int64).reshape(len(names), -1)
    chains = [t[a:a + CHAIN] for t in tokens for a in range(0, len(t), CHAIN)]
    labels = np.concatenate([marked[t] if label else np.zeros(len(t), bool) for t, label in zip(tokens, toxic)]).astype(float)
    word = np.concatenate(chains)
    size = np.array([len(c) for c in chains])
    first = np.zeros(len(word), bool)
    first[np.cumsum(size) - size] = True
    inner = np.flatnonzero(~first)
    seen = np.bincount((2 * labels[inner - 1] + labels[inner]).astype(int), minlength=4).reshape(2, 2)

    # full-batch ascent on the log likelihood, steps scaled per weight
    weights, trans = np.zeros(FEATURES), np.zeros((2, 2))
    square, square_t = np.full(FEATURES, 1e-8), np.full((2, 2), 1e-8)
    scale = 1.0 / max(1.0, labels.sum())
    for _ in range(ROUNDS):
        p, counts = marginals(size, weights[ids].sum(1)[word], trans)
        g = np.bincount(word, weights=labels - p, minlength=len(names))
        grad = np.bincount(ids.ravel(), weights=np.repeat(g, ids.shape[1]), minlength=FEATURES) * scale - RIDGE * weights
        grad[0] = 0.0
        grad_t = (seen - counts) * scale - RIDGE * trans
        square += grad * grad
        square_t += grad_t * grad_t
        weights += RATE * grad / np.sqrt(square)
        trans += RATE * 0.5 * grad_t / np.sqrt(square_t)
    emission = weights[ids].sum(1)
    sizes = np.array([len(t) for t in tokens])
    p, _ = marginals(sizes, emission[np.concatenate(tokens)], trans)
    end = np.cumsum(sizes)
    x = np.array([summary(p[e - s:e]) for s, e in zip(sizes, end)])
    doc = logistic(x, y)
    doc[0] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return Model(weights.astype(np.float32), trans, doc)


def sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
           fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS) -> tuple[list[str], list[int], float | None]:
    """Texts and labels to fit on, and the share of toxic labels among all rows
    that may be learnt from.  An id with both labels counts as toxic; an id on
    several documents gives one of them.  At most ``fit_docs`` documents of a
    label and ``fit_chars / 2`` characters are taken, in the order of a hash;
    a text that is too long for what is left is passed over.  An empty table
    gives no texts."""
    known = (labels.filter(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(doc_id)))
             .groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("y")))
    known = staged(known)
    prior = known.agg(F.avg("y")).first()[0]
    order = F.xxhash64("id")
    picked = known.filter("y = 1").orderBy(order, "id").limit(fit_docs).union(known.filter("y = 0").orderBy(order, "id").limit(fit_docs))
    # at most 2 x fit_docs rows are broadcast
    rows = staged(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(staged(picked)), "id")
                  .groupBy("id", "y").agg(F.min("text").alias("text")))
    sizes = rows.select("id", "y", F.coalesce(F.length("text"), F.lit(0)).alias("n")).orderBy(order, "id").collect()
    ids, total = [], {0: 0, 1: 0}
    for r in sizes:  # a text that does not fit is passed over; each label has half of the characters
        if total[r.y] + r.n <= fit_chars // 2:
            total[r.y] += r.n
            ids.append((r.id,))
    if not ids:
        return [], [], prior
    got = rows.join(F.broadcast(docs.sparkSession.createDataFrame(ids, f"id {dict(rows.dtypes)['id']}")), "id").orderBy(order, "id").collect()
    return [r.text for r in got], [r.y for r in got], prior


_memory: dict[str, float] = {}
_memory_of: list = [None]


def scored(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without its text, plus score, predicted and spans (start and end of toxic runs, in characters).

    NULL and empty texts have no words: their score is that of a document
    without marginals.  A row per row; other columns stay, save those by the
    results' names."""
    ship_package(docs.sparkSession)
    made = ("score", "predicted", "spans")
    keep = [c for c in docs.columns if c != text and c not in made]
    key = xxhash.xxh64_hexdigest(model.weights.tobytes())
    bc = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bc.value
        if _memory_of[0] != key:
            _memory.clear()
            _memory_of[0] = key
        for b in batches:
            score, spans = [], []
            texts = b.column(0)
            for lo, docs_ in parts(t.as_py() for t in texts):
                size = np.array([len(d) for d in docs_], np.int64)
                if len(_memory) > REMEMBERED:
                    _memory.clear()
                for d in docs_:
                    for w in set(d):
                        if w not in _memory:
                            _memory[w] = m.emission(w)
                e = np.fromiter(map(_memory.__getitem__, chain.from_iterable(docs_)), float, int(size.sum()))
                p, _ = marginals(size, e, m.trans)
                for i, (s, end) in enumerate(zip(size.tolist(), np.cumsum(size).tolist())):
                    own = p[end - s:end]
                    score.append(float(1 / (1 + np.exp(-np.clip(np.dot(summary(own), m.doc), -30, 30)))))
                    spans.append(runs(texts[lo + i].as_py(), own) if s and own.max() >= 0.5 else [])
            columns = [*b.columns[1:], pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32()),
                       pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *made])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + "score double, predicted int, spans array<struct<start:bigint,end:bigint>>"
    return docs.select(text, *keep).mapInArrow(run, schema)


def parts(texts: Iterator[str | None], most: int = 1 << 20) -> Iterator[tuple[int, list[list[str]]]]:
    """(number of the first, words of each) for runs of texts of about ``most`` words."""
    first, held, words = 0, [], 0
    for i, t in enumerate(texts):
        held.append(words_of(t))
        words += len(held[-1])
        if words >= most:
            yield first, held
            first, held, words = i + 1, [], 0
    if held:
        yield first, held


def runs(text: str, p: np.ndarray) -> list[dict[str, int]]:
    """Neighbouring toxic words as one span.  Lower case can change a text's
    length, so its words are found in the text itself where that happens."""
    low = text.lower()
    at = [m.span() for m in WORD.finditer(low if len(low) == len(text) else text)]
    out: list[dict[str, int]] = []
    last = -2
    for i in np.flatnonzero(p[:len(at)] >= 0.5).tolist():
        if i == last + 1:
            out[-1]["end"] = at[i][1]
        else:
            out.append({"start": at[i][0], "end": at[i][1]})
        last = i
    return out
