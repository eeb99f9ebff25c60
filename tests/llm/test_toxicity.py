import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoofscope.llm import toxicity
from spoofscope.llm.queries import QUERIES


def exact(emission, trans):
    """Marginals and transition counts by summing over all labellings."""
    n = len(emission)
    p, counts, z = np.zeros(n), np.zeros((2, 2)), 0.0
    for code in range(2 ** n):
        y = [code >> i & 1 for i in range(n)]
        w = np.exp(sum(emission[i] for i in range(n) if y[i]) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        z += w
        p += w * np.array(y)
        for a, b in zip(y, y[1:]):
            counts[a, b] += w
    return p / z, counts / z


def test_marginals_equal_the_sum_over_labellings():
    r = np.random.default_rng(1)
    size = np.array([5, 0, 1, 7, 3])
    e, trans = r.normal(0, 2, size.sum()), r.normal(0, 1, (2, 2))
    p, counts = toxicity.marginals(size, e, trans)
    ends = np.cumsum(size)
    want = [exact(e[b - n:b], trans) for n, b in zip(size, ends) if n]
    assert np.allclose(p, np.concatenate([x for x, _ in want])) and np.allclose(counts, sum(c for _, c in want))
    assert len(toxicity.marginals(np.array([0]), np.zeros(0), trans)[0]) == 0


def corpus(n=400, seed=2):
    r = random.Random(seed)
    names = [f"{a}{b}{c}" for a in ("lor", "ips", "dol") for b in ("em", "um", "or") for c in ("a", "ix", "us", "ent")]
    texts, labels = [], []
    for i in range(n):
        words = [r.choice(names) for _ in range(r.randrange(5, 60))]
        if toxic := i % 4 == 0:
            for _ in range(1 + len(words) // 10):
                words.insert(r.randrange(len(words)), r.choice(["grubword", "Zorkish", "zorkest"]))
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels


def test_fit_finds_words_beginnings_and_documents():
    texts, labels = corpus()
    m = toxicity.fit(texts, labels)
    assert m.emission("grubword") > 0 > m.emission("loremus") and m.emission("zorkling") > m.emission("lorentz")


def test_scores_spans_and_edge_cases(spark, docs_of, empty_docs):
    texts, labels = corpus()
    m = toxicity.fit(texts, labels)
    extra = [None, "", "...", "İ grubword zorkish loremus " * 3, "loremus " * 30_000]
    got = {r.doc_id: r for r in toxicity.scored(docs_of([*texts, *extra]), m).collect()}
    assert np.mean([got[i].predicted == y for i, y in enumerate(labels)]) > 0.97
    for i in range(400, 403):
        assert 0 <= got[i].score < 0.5 and got[i].spans == []
    shown = [extra[3][s["start"]:s["end"]].lower() for s in got[403].spans]
    assert len(shown) == 3 and all("grubword zorkish" in x and "loremus" not in x for x in shown) and got[404].predicted == 0
    assert toxicity.scored(empty_docs, m).count() == 0
    again = toxicity.scored(docs_of([(None, texts[0]), (1, texts[0]), (1, texts[0])]).withColumnRenamed("lang", "score"), m).collect()
    assert len({r.score for r in again}) == 1 and len(again) == 3


def test_one_label_alone_scores_all_alike(docs_of):
    m = toxicity.fit(["a b", None], [0, 0])
    assert len({r.score for r in toxicity.scored(docs_of(["a b", "c d", None]), m).collect()}) == 1
    assert len({r.score for r in toxicity.scored(docs_of(["a"]), toxicity.fit([], [])).collect()}) == 1


def test_sample_is_bounded_and_leaves_held_out_rows(spark, docs_of):
    texts, labels = corpus(300)
    rows = [(i, y, 1) for i, y in enumerate(labels)] + [(None, 1, 1), (5, None, 1), (4, 0, 1)]
    known = spark.createDataFrame(rows, "doc_id bigint, toxic int, quality int")
    docs = docs_of([*enumerate(texts), (8, texts[8]), (None, "x")])
    held = {r.doc_id for r in docs.filter(toxicity.held_out(F.col("doc_id"))).collect()}
    got, y, prior = toxicity.sample(docs, known, fit_docs=20)
    assert sum(y) == 20 and len(y) == 40 and prior == pytest.approx(0.25, abs=0.05)
    assert not {texts.index(t) for t in got} & held
    assert len(toxicity.sample(docs, known, fit_chars=500)[0]) < 10


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op9_toxicity"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out and toxic is not null").toPandas()
    assert ((got.score >= 0) & (got.score <= 1)).all() and (got.predicted == (got.score >= 0.5)).all()
    assert (got.predicted == got.toxic).mean() > 0.9


def test_a_very_long_labelled_text_is_passed_over(spark, docs_of):
    """Wherever it stands in the hash order, the others are learnt from, of both labels."""
    rows = [(i, ("foul " if i % 2 else "kind ") * 20) for i in range(1, 120)]
    for long in (2, 3, 57):
        docs = docs_of([(i, "word " * 50_000 if i == long else t) for i, t in rows])
        labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, toxic int")
        texts, ys, _ = toxicity.sample(docs, labels, fit_chars=20_000)
        assert 0 < sum(ys) < len(ys) and max(map(len, texts)) == 100 and sum(map(len, texts)) <= 20_000
    assert toxicity.sample(docs.limit(0), labels)[:2] == ([], [])
