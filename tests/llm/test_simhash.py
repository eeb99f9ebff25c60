import random
import re

import numpy as np
import xxhash

from spoofscope.llm import simhash
from spoofscope.llm.components import components


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    s = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute_components(prints, distance):
    left, out = set(prints), {}
    while left:
        todo = [left.pop()]
        found = set(todo)
        while todo:
            x = todo.pop()
            near = {y for y in left if bin(x ^ y).count("1") <= distance}
            left -= near
            found |= near
            todo += near
        out |= {x: min(found) for x in found}
    return out


def check(df, rows, distance=4):
    prints = {i: brute_print(t) for i, t in rows}
    groups = brute_components(set(prints.values()), distance)
    low = {}
    for i, p in prints.items():
        low[groups[p]] = min(low.get(groups[p], i), i)
    got = {r.doc_id: (r.print % 2 ** 64, r.component_id) for r in df.collect()}
    assert got == {i: (p, low[groups[p]]) for i, p in prints.items()}


def variants(n, seed=3):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = [f"w{r.randrange(2000)}" for _ in range(r.randrange(0, 120))]
        out.append(" ".join(words))
        for _ in range(r.randrange(4)):
            copy = list(words)
            if copy:
                copy[r.randrange(len(copy))] = "Changed"
            out.append("\t".join(copy))
    return out


def test_components_equal_brute_force(docs_of):
    rows = list(enumerate([*variants(120), None, "", "one", "ONE", "one two three", " a\x0bb\x0cc "]))
    check(simhash.near_duplicates(docs_of(rows)), rows)


def test_crowded_buckets_are_split(docs_of, monkeypatch):
    r = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(r.randrange(3)):
            words[r.randrange(300)] = f"x{r.randrange(50)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "SMALL_RUN", 4)
    check(simhash.near_duplicates(docs_of(rows)), rows)


def test_any_plan_finds_every_near_pair():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2 ** 63, 400, dtype=np.uint64)
    far = [x ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for x in base for k in (1, 3, 4)]
    values = np.unique(np.concatenate([base, np.array(far, np.uint64)]))
    bits = list(range(64))
    plans = [[(bits[i::5], 0) for i in range(5)], [(bits[:32], 1), (bits[32:], 2)], [(bits[:20], 2), (bits[20:42], 1)],
             [(bits[:16], 1), (bits[16:32], 0), (bits[32:48], 0), (bits[48:], 0)]]
    plans.append([(bits[:13], 4)])
    want = {(int(a), int(b)) for i, a in enumerate(values) for b in values[i + 1:][np.bitwise_count(values[i + 1:] ^ a) <= 4]}
    for plan in plans[:2] + plans[3:]:
        assert sum(t + 1 for _, t in plan) == 5
        met = {}
        for part, bucket, own in simhash.entries(values, plan):
            for k, b, v in zip(part.tolist(), bucket.tolist(), own.tolist()):
                met.setdefault((k, b), []).append(v)
        found = {(min(a, b), max(a, b)) for m in met.values() for i, a in enumerate(m) for b in m[i + 1:] if a != b and bin(a ^ b).count("1") <= 4}
        assert found == want


def test_thresholds_fill_the_distance():
    rng = np.random.default_rng(6)
    bits = (rng.random((5000, 64)) < 0.5).astype(np.int64)
    bits[:, 7] = bits[:, 50]
    together = bits.T @ bits
    small, large = simhash.allotted(5000, together), simhash.allotted(5_000_000_000, together * 1_000_000)
    for plan in (small, large):
        assert sum(t + 1 for _, t in plan) == 5
        assert len({b for group, _ in plan for b in group}) == sum(len(g) for g, _ in plan)
    assert min(len(g) for g, _ in large) > max(len(g) for g, _ in small) - 1  # more rows, wider parts
    groups = simhash.grouped_bits(5000, together, 4)
    assert any({7, 50} <= set(g) for g in groups) and sorted(b for g in groups for b in g) == list(range(64))


def test_links_are_a_forest_of_the_run():
    own = np.arange(200, dtype=np.uint64)  # numbers below 256 are at most 8 bits apart
    a, b = simhash.links_of(np.zeros(200, np.int64), np.zeros(200, np.int64), own, 4)
    assert len(a) == 199 and (np.bitwise_count(a ^ b) <= 4).all()


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (7, 7), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}
    assert components(edges.limit(0), "a", "b").count() == 0


def test_null_and_repeated_ids_and_empty_table(docs_of, empty_docs):
    got = simhash.near_duplicates(docs_of([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "other words here now")])).collect()
    assert sorted(str(r.component_id) for r in got) == ["3", "3", "3", "None"]
    assert simhash.near_duplicates(empty_docs).count() == 0


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(f"w{i}" for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(text) == whole == brute_print(text)
