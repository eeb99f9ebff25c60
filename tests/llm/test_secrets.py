import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spoofscope.llm import secrets
from spoofscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_base(text):
    """The contract's words, with the patterns as given there."""
    found = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for kind, (name, pattern, least) in enumerate([("access", r"AKIA[A-Z0-9]+", 18), ("hex", r"[0-9a-f]+", 16)], 1):
        found += [(m.start(), kind, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [s for *_, s in sorted(found)]


def cheapest(value, words):
    """The least cost over all segmentations, tried one by one."""
    matches = [*words, *secrets.patterns(value)]
    n = len(value)

    def rest(i, brute):
        if i == n:
            return 0.0
        tries = [(0 if brute else secrets.SEGMENT_BITS) + secrets._class_bits(value[i]) + rest(i + 1, True)]
        tries += [secrets.SEGMENT_BITS + b + rest(i + k, False) for s, k, b in matches if s == i]
        return min(tries)
    return rest(0, False)


@settings(max_examples=150, deadline=None)
@given(st.text("ab1q2wAK é", min_size=1, max_size=9), st.lists(st.tuples(st.integers(0, 5), st.integers(1, 4), st.floats(0.5, 20)), max_size=4))
def test_least_cost_is_that_of_all_segmentations(value, words):
    words = [w for w in words if w[0] + w[1] <= len(value)]
    assert secrets.guess_bits(value, words) == pytest.approx(cheapest(value, words))


def test_patterns_lower_the_cost():
    brute = lambda v: sum(map(secrets._class_bits, v))
    for v in ("1999/12/31", "31.12.1999", "aaaaaaaaaaaa", "abcabcabcabc", "qwertyuiop", "zyxwvuts"):
        assert secrets.guess_bits(v, []) < brute(v) / 1.5, v
    assert secrets.guess_bits("x7Gq", []) == pytest.approx(brute("x7Gq") + secrets.SEGMENT_BITS)
    assert secrets.guess_bits("a" * 100_000, []) < 30


def test_pieces_know_capitals_and_look_alikes():
    got = {(w, s): b for w, s, k, b in secrets.pieces("P4ssWord") if k >= 4}
    assert got["pass", 0] == 2.0 and got["word", 4] == 1.0 and got["password", 0] == 1 + 8
    assert not list(secrets.pieces("12_")) and all(k <= 24 for _, _, k, _ in secrets.pieces("x" * 60))


def spans(df):
    return [[tuple(s) for s in r.spans] for r in df.orderBy("doc_id").collect()]


def test_dear_values_are_added_and_cheap_ones_are_not(docs_of):
    filler = "the garden gate opened slowly and nobody knew the password of the old house " * 5
    texts = [filler, "pwd: k#9Zq!vT2x$Lm, and more", "passphrase is garden-house-gate", "pwd=12345678 pin: 19991231", "login = P@ssword1",
             "token: abcdefghijklmnop.x", "compass = k#9Zq!vT2x$Lm", "é password = 'k#9Zq!vT2x$Lm'"]
    got = spans(secrets.found(docs_of(texts)))
    assert got[0] == [] and got[2] == [] and got[3] == [] and got[6] == []
    assert got[1] == [("guess", 5, 18)] and texts[1][5:18] == "k#9Zq!vT2x$Lm"
    assert got[5] == [("assign", 0, 25)]  # covered by a base span: not told twice
    assert got[7] == [("guess", 14, 27)]


def test_odd_inputs(spark, docs_of, empty_docs):
    long = "x " * 200_000 + "secret=" + "Zk3" * 50_000
    rows = [(None, "token=abcdefgh12345"), (1, None), (2, ""), (3, long), (4, "AKIA" + "A1" * 8), (4, "AKIA" + "A1" * 8), (5, "AKIAKIA0"), (6, "ſecret=abcdefgh12345 toKen:abcdefgh12345")]
    got = secrets.found(docs_of(rows).withColumn("rid", F.lit(1)).withColumn("spans", F.lit("s"))).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append([tuple(s) for s in r.spans])
    assert by[None] == [[("assign", 0, 19)]] and by[1] == by[2] == by[5] == [[]]
    assert by[3] == [[("assign", 400_000, len(long))]] and by[4] == [[("access", 0, 20)]] * 2
    assert by[6] == [[("assign", 21, 40)]]  # only ASCII letters count in either case
    assert secrets.found(empty_docs).count() == 0


def test_query_against_plain_scan(spark):
    got = {r.doc_id: r for r in QUERIES["op11_secrets"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    counts = {r.word: r.n for r in secrets.word_counts(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    total = sum(counts.values())
    assert len(got) == len(docs)
    for d in docs:
        r, base = got[d.doc_id], plain_base(d.text or "")
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex"))
        held = [tuple(map(int, s.split(":")[1:])) for s in base]
        more = []
        for s, e, v in secrets.values_of(d.text or ""):
            words = [(i, k, secrets.math.log2(total / counts[w]) + b) for w, i, k, b in secrets.pieces(v) if w in counts]
            if secrets.guess_bits(v, words) >= secrets.LEAST_BITS and not any(a <= s and e <= b for a, b in held):
                more.append(f"guess:{s}:{e}")
        assert sorted(filter(None, r.spans.split(","))) == sorted(base + more)
