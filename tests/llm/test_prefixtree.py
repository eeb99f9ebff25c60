import hashlib
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spoofscope.llm import prefixtree
from spoofscope.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain_nodes(rows):
    """The contract's nodes by way of all prefixes."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(role, text) for *_, role, text in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(own.get(base, [])[:h] + t[h:])
    members = defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        below = [out[q] for q in children[p]]
        ends = ",".join(map(str, sorted(c for c in members[p] if len(whole[c]) == len(p))))
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), sum(b[5] for b in below) or 1,
                  (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(b[6] for b in below), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=lambda r: r[:2])


def nodes(df, **kw):
    return sorted((tuple(r) for r in prefixtree.prefix_tree(df, **kw).collect()), key=lambda r: r[:2])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=5), max_size=12, unique_by=tuple))
def test_ternary_tree_holds_its_sequences(sequences):
    tree = prefixtree.TernaryTree()
    paths = {}
    for i in prefixtree.medians(len(sequences)):
        paths[tuple(sequences[i])] = tree.insert(sequences[i])
    assert len(tree.number) - 1 == len({tuple(s[:d]) for s in sequences for d in range(1, len(s) + 1)})
    for s, path in paths.items():
        assert tuple(tree.number[at] for at in path) == s and [tree.up[at] for at in path] == [0, *path[:-1]]
        assert tree.insert(list(s)) == path


def test_medians_keep_search_trees_flat():
    assert sorted(prefixtree.medians(1000)) == list(range(1000))
    tree, depth = prefixtree.TernaryTree(), {}
    for i in prefixtree.medians(1023):
        tree.insert([i])
    todo = [(tree.kids[1][0], 1)]
    for at, d in todo:
        depth[at] = d
        todo += [(k[at], d + 1) for k in (tree.kids[0], tree.kids[2]) if k[at]]
    assert max(depth.values()) == 10


def random_rows(seed, n=240):
    import random
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(400), n // 3) + [100, 200]:
        for t in range(r.randrange(1, 9)):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["a", "bé", "ccc"])))
    return rows


@pytest.mark.parametrize("block,shard", [(256, 1 << 20), (2, 5), (3, 40)])
def test_against_all_prefixes(spark, block, shard, monkeypatch):
    monkeypatch.setattr(prefixtree, "SHARD_IDS", shard)
    monkeypatch.setattr(prefixtree, "IDS_PER_TEXT", 16)
    rows = random_rows(block) + [(c, t, "user", "same") for c in range(500, 560) for t in range(7)]
    assert nodes(spark.createDataFrame(rows, SCHEMA).repartition(5), block=block) == plain_nodes(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (7, None, None, None), (7, None, None, None), (7, 3, "user", None), (7, 3, "user", "b"), (7, 3, "assistant", "b"), (-7, 1, "u", "t"),
            (100, 1, None, "head"), (101, 1, "", "head"), (102, None, "user", "y" * 300_000), (103, 1, "user", "z")] + [(104, i, "user", str(i % 3)) for i in range(700)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("tree", F.lit(1)).withColumn("n", F.lit(2)).withColumn("at", F.lit(1))
    assert nodes(df) == plain_nodes(rows)
    assert nodes(spark.createDataFrame([], SCHEMA)) == []


def test_query_on_the_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op12_prefix_trie"](spark, d)
    assert got.columns[:8] == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == plain_nodes(rows)
