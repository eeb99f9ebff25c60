import random
import re

import numpy as np
import pytest

from spoofscope.llm import decontaminate as d

RX = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return RX.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window):
    w, covered, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        for k in range(max(1, len(b) - window + 1) if b else 0):
            p = b[k:k + window]
            for i in range(len(w) - len(p) + 1):
                if w[i:i + len(p)] == p:
                    covered |= set(range(i, i + len(p)))
                    found.add(item)
    return len(w), covered, sorted(x for x in found if x is not None)


def corpus(seed, n=60, letters="abcde"):
    r = random.Random(seed)
    items = [(i, " ".join(r.choice(letters) for _ in range(r.randrange(0, 9)))) for i in range(8)] + [(99, None), (98, " . "), (None, "a b c a")]
    texts = [" ".join(r.choice(letters + "xyz") for _ in range(r.randrange(80))) for _ in range(n)]
    return items, [*texts, None, "", "...", "A B-C;A d"]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("shard", [7, 50, 10_000])
def test_search_equals_brute_force(seed, shard):
    items, texts = corpus(seed)
    got = list(d.searched(iter(texts), d.Phrases(items, 4), shard))
    for (n, spans, found), t in zip(got, texts, strict=True):
        covered = {i for a, b in spans.tolist() for i in range(a, b + 1)}
        assert (n, covered, found) == brute(t, items, 4), t


def test_suffix_order_and_index():
    r = np.random.default_rng(1)
    s = r.integers(0, 3, 500)
    s[-1] = 0
    order = d.suffix_order(s, 3)
    key = lambda i: [x if x else 3 + i + k for k, x in enumerate(s[i:].tolist())]
    assert order.tolist() == sorted(range(500), key=key)
    tree = d.WaveletTree(s, 3)
    at = np.arange(501)
    for c in range(3):
        assert tree.rank(np.full(501, c), at).tolist() == [int((s[:k] == c).sum()) for k in at]


def test_tables(spark, docs_of, empty_docs):
    items, texts = corpus(9)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for limit in (d.BLOCK_WORDS, 3):
        got = {r.doc_id: r for r in d.passages(docs_of(texts), bench, window=4, block_words=limit, clean=True).collect()}
        for i, t in enumerate(texts):
            n, covered, found = brute(t, items, 4)
            r = got[i]
            assert r.n_words == n and r["items"] == found
            assert {k for s in r.spans for k in range(s["first"], s["last"] + 1)} == covered
            left = [w for k, w in enumerate(words(t)) if k not in covered]
            assert words(r.text) == left and (r.text is None) == (t is None)
    assert d.passages(empty_docs, bench).count() == 0
    none = d.passages(docs_of(["a b"]), bench.limit(0)).first()
    assert none.n_words == 2 and none.spans == []


def test_null_and_repeated_ids_and_clashing_columns(spark, docs_of):
    bench = spark.createDataFrame([(1, "p q r"), (1, "p q r")], "item_id bigint, text string")
    df = docs_of([(None, "x p q r"), (2, "p q r"), (2, "p q r")]).withColumnRenamed("source", "rid").withColumnRenamed("n_chars", "items")
    got = d.passages(df, bench, block_words=1).collect()
    assert len(got) == 3 and all(r["items"] == [1] and r.rid == "s" for r in got)


def test_cut_text_keeps_the_rest():
    assert d.without("Ä one, two! three. four", [(1, 2)]) == "Ä ! three. four"
