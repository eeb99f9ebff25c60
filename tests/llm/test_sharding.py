import zlib

from pyspark.sql import functions as F

from spoofscope.llm import sharding
from spoofscope.llm.queries import QUERIES


def shard(df, n=40):
    return sharding.sharded(df.select("doc_id", sharding.record_size().alias("size")), sharding.first_map(n))


def test_map_depends_on_counts_alone_and_grows_into_the_new_shard():
    m = sharding.first_map(40)
    assert m == sharding.first_map(40) and set(m.shards) == set(range(40))
    held = [m.shards.count(s) for s in range(40)]
    assert max(held) - min(held) <= 2
    more = sharding.grown(m)
    assert more.version == m.version + 1
    assert all(b in (a, 40) for a, b in zip(m.shards, more.shards)) and 40 in more.shards
    assert sharding.first_map(41).shards == more.shards


def test_rebalanced_moves_few_slots_and_evens_bytes():
    m = sharding.first_map(4, slots=64)
    size = {i: 100 + (900 if m.shards[i] == 0 else 0) for i in range(64)}
    r = sharding.rebalanced(m, size)
    load = lambda x: [sum(size[i] for i in range(64) if x.shards[i] == s) for s in range(4)]
    assert max(load(r)) - min(load(r)) < (max(load(m)) - min(load(m))) / 4
    moved = [i for i in range(64) if m.shards[i] != r.shards[i]]
    assert 0 < len(moved) <= 32 and r.version == m.version + 1
    assert sharding.rebalanced(m, {}).shards == m.shards


def test_stored_versions(spark, tmp_path):
    m = sharding.first_map(3, slots=32)
    path = str(tmp_path / "map")
    sharding.save_map(spark, m, path)
    sharding.save_map(spark, sharding.grown(m), path)
    assert sharding.load_map(spark, path, 1) == m
    assert sharding.load_map(spark, path) == sharding.grown(m)


def test_positions_are_gapless_with_nulls_and_repeats(docs_of, empty_docs, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_WINDOW", 5)
    rows = [(i, "x" * (i % 7)) for i in range(300)] + [(None, None)] * 40 + [(7, "same")] * 30
    got = shard(docs_of(rows)).toPandas()
    assert len(got) == len(rows)
    for _, g in got.groupby("shard"):
        assert sorted(g.position) == list(range(len(g)))
    assert got.groupby(got.doc_id.fillna(-1))["shard"].nunique().max() == 1
    assert shard(empty_docs).count() == 0


def test_extra_columns_with_clashing_names(docs_of):
    df = docs_of(["a", "b"]).select("doc_id", sharding.record_size().alias("size"), F.lit(5).alias("rid"))
    got = sharding.sharded(df, sharding.first_map(2)).collect()
    assert {r.rid for r in got} == {5}


def test_query(spark):
    d = "/root/testdata/sf0.001"
    got = QUERIES["op6_sharding"](spark, d).toPandas().set_index("doc_id")
    for doc_id, text in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect():
        raw = (text or "").encode()
        r = got.loc[doc_id]
        assert (r["size"], r.text_crc32) == (len(raw) + 16, zlib.crc32(raw)) and r.grown_shard in (r["shard"], 40)
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_slots_and_maps_recomputed(spark, docs_of, tmp_path):
    """Every row's slot and its shards under all three stored maps, by plain Python."""
    import struct

    import xxhash
    rows = [(i, "x" * (i * i % 900)) for i in range(-40, 400)]
    df = docs_of(rows).select("doc_id", sharding.record_size().alias("size"))
    got = {r.doc_id: r for r in sharding.sharded(df, sharding.first_map(5, 64), path=str(tmp_path / "m")).collect()}
    slot = {i: xxhash.xxh64_intdigest(struct.pack("<q", i), 42) % 64 for i, _ in rows}  # 64 divides 2^64
    load = {k: sum(len(t) + 16 for i, t in rows if slot[i] == k) for k in set(slot.values())}
    first, more, even = (sharding.load_map(spark, str(tmp_path / "m"), v) for v in (1, 2, 3))
    assert first == sharding.first_map(5, 64) and more.n_shards == 6 and even.n_shards == 5
    for i, _ in rows:
        r = got[i]
        assert (r.virtual_slot, r["shard"], r.grown_shard, r.even_shard) == (slot[i], first.shards[slot[i]], more.shards[slot[i]], even.shards[slot[i]])
        assert (r.map_version, r.grown_version, r.even_version) == (1, 2, 3)
    held = lambda m: [sum(n for k, n in load.items() if m.shards[k] == s) for s in range(5)]
    assert max(held(even)) - min(held(even)) < max(held(first)) - min(held(first))
    assert sharding.load_map(spark, str(tmp_path / "m")) == even


def test_ties_in_bytes_move_in_slot_order():
    m = sharding.SlotMap(1, 2, (0, 0, 0, 0, 1))
    assert sharding.rebalanced(m, {0: 10, 1: 10, 2: 10, 3: 10, 4: 0}) == sharding.SlotMap(2, 2, (1, 1, 0, 0, 1))
