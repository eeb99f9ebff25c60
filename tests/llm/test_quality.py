import math
import re

import pytest
from pyspark.sql import functions as F

from spoofscope.llm import quality

TEXTS = [None, "", "a b c", "a " * 50, "\n".join(["same line here"] * 4 + ["other"]), "x # y % z ABC\tD\x0be\x0cf\rg",
         "ünï cödé wörds " * 3, "one two three four five six seven one two three four five nine", "w " * 4]


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(5)}
    full = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(full) - len(set(full)), len(covered))


def test_counts(docs_of):
    got = {r.doc_id: r for r in quality.counted(docs_of(TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t


def test_long_text_is_counted_whole(docs_of):
    text = " ".join(f"w{i}" for i in range(100_000)) + " w1 w2 w3 w4 w5"
    r = quality.counted(docs_of([text])).first()
    assert (r.n_words, r.n_repeat_words) == (100_005, 10)


@pytest.mark.parametrize("n,k,p", [(10, 0, .1), (200, 3, .05), (5000, 40, .0125), (0, 0, .1)])
def test_binomial_tail(spark, n, k, p):
    want = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(min(n, k) + 1))
    got = spark.range(1).select(quality.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()[0]
    assert got == pytest.approx(want, rel=1e-9)


def corpus(spark, clean=900, bad=60, lang="en"):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(20)), lang) for i in range(clean)]
    rows += [(clean + i, " ".join(f"v{i}x{j}%%%" for j in range(20)), lang) for i in range(bad)]
    labels = [(i, int(i < clean), 0) for i in range(clean + bad)]
    return (spark.createDataFrame(rows, "doc_id bigint, text string, lang string"),
            spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))


def test_cutoffs_reject_junk_and_keep_clean(spark):
    docs, labels = corpus(spark)
    counts = quality.counted(docs).drop("text")
    got = quality.judged(counts, quality.certified(counts, labels)).collect()
    assert {r.doc_id for r in got if not r.kept} == set(range(900, 960))


def test_few_labels_certify_nothing(spark):
    docs, labels = corpus(spark, clean=60, bad=30)
    counts = quality.counted(docs).drop("text")
    assert quality.certified(counts, labels).count() == 0
    assert all(r.kept for r in quality.judged(counts, quality.certified(counts, labels)).collect())


def test_null_stratum_null_labels_and_empty_tables(spark, docs_of, empty_docs):
    docs, labels = corpus(spark, lang=None)
    labels = labels.union(spark.createDataFrame([(None, 1, 0), (3, None, None), (3, 1, 0)], labels.schema))
    counts = quality.counted(docs).drop("text")
    got = quality.judged(counts, quality.certified(counts, labels))
    assert got.filter("not kept").count() == 60
    none = spark.createDataFrame([], labels.schema)
    some = quality.counted(docs_of(TEXTS))
    assert quality.judged(some, quality.certified(some, none)).filter("kept").count() == 1
    assert quality.judged(quality.counted(empty_docs), quality.certified(some, labels)).count() == 0


def test_no_python_in_the_plan(spark):
    docs, labels = corpus(spark, clean=50, bad=5)
    counts = quality.counted(docs)
    plan = quality.judged(counts, quality.certified(counts, labels))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
