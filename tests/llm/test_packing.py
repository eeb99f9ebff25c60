import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spoofscope.llm import packing

WHOLE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_ids_are_the_json_tokenizers(text):
    assert packing.encoder("byte_bpe_50k")(text) == WHOLE.encode(text, add_special_tokens=False).ids


def test_ids_of_whole_documents_and_special_tokens(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    for t in [*[r.text for r in rows], "a <|endoftext|> b", "  \n\n \t x", "x" * 5000]:
        assert packing.encoder("byte_bpe_50k")(t) == WHOLE.encode(t, add_special_tokens=False).ids


def test_patterns_use_every_piece_once():
    r = random.Random(1)
    histogram = {n: r.randrange(500, 2000) for n in range(1, 65)}
    packed = packing.patterns(histogram, 64)
    used = {}
    for p in packed:
        assert sum(p.lengths) <= 64
        for n in p.lengths:
            used[n] = used.get(n, 0) + p.count
    assert used == histogram and len(packed) <= 2 * 64
    assert sum(p.count for p in packed) * 64 <= 1.05 * sum(k * v for k, v in histogram.items()) + 64
    assert packing.patterns({}, 64) == []


def check(df, texts, capacity):
    rows = df.toPandas()
    whole = {i: ids(t) for i, t in texts}
    for i, g in rows.groupby("doc_id"):
        g = g.sort_values("start")
        assert list(g.start) == list(np.cumsum([0, *g.length])[:-1]) and g.length.sum() == len(whole[i])
        for r in g.itertuples():
            assert r.doc_tokens == len(whole[i])
            assert r.ids_crc32 == zlib.crc32(np.array(whole[i][r.start:r.start + r.length], "<u4").tobytes())
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == list(np.cumsum([0, *g.length])[:-1]) and g.length.sum() <= capacity
    assert sorted(set(rows.sequence_id)) == list(range(rows.sequence_id.nunique()))
    return rows


def test_pieces_and_sequences(docs_of):
    r = random.Random(2)
    texts = [(i, " ".join(f"w{r.randrange(99)}" for _ in range(r.randrange(120)))) for i in range(200)]
    texts += [(200, None), (201, ""), (202, "long " * 3000)]
    cut = packing.pieces(docs_of(texts).repartition(5), capacity=64, with_ids=True)
    placed = packing.packed(cut, 64)
    rows = check(placed.drop("ids"), texts, 64)
    assert rows.length.sum() / (64 * rows.sequence_id.nunique()) > 0.97
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(placed).collect()}
    part = {(p.doc_id, p.start): p for p in placed.collect()}
    for p in part.values():
        assert whole[p.sequence_id][4 * p.offset:4 * (p.offset + p.length)] == bytes(p.ids)


def test_null_and_repeated_ids_and_empty_table(docs_of, empty_docs):
    placed = packing.packed(packing.pieces(docs_of([(None, "a"), (None, "a"), (1, "b"), (1, "b")])))
    assert placed.count() == 4 and placed.select("offset").distinct().count() == 4
    assert packing.packed(packing.pieces(empty_docs)).count() == 0
