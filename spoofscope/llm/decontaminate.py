"""Benchmark passages in documents, found through an FM-index per shard.

A shard is a bounded run of document words.  Words that no test phrase uses
cannot be part of a match: each run of them, and each document's end, is one
separator, and every separator is a symbol of its own to the suffix sort.  The
sort gives the Burrows-Wheeler transform, over which a wavelet tree of bit
vectors answers rank queries.  All phrases are searched backward at once.  A
range of suffixes is located by walking each row back to the next sampled
suffix position (every ``SAMPLE``-th place and every place behind a
separator).  Positions become spans of words, and spans are merged.

Memory stays flat: shards hold ``SHARD_WORDS`` words, and a longer document is
cut into pieces that overlap by a window less one word.  The phrases reach the
tasks as a closure of at most about ``BLOCK_WORDS`` words; a larger benchmark
is searched in as many blocks of items as it needs, and the blocks' hits are
merged per document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoofscope.llm.common import fresh, ship_package, staged

WINDOW = 10
SHARD_WORDS = 1 << 20
SAMPLE = 8
#: Words of benchmark text that one search carries.
BLOCK_WORDS = 4_000_000
#: Bytes outside words become spaces, A-Z lower case: words are runs of 0-9, a-z and bytes from 0x80.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class BitVector:
    """Bits with rank by a running count per 64-bit word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros((len(bits) >> 6) + 1, np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletTree:
    """Symbols below ``sigma``, a bit per level from the highest; each level puts its zeros in front of its ones."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[tuple[int, BitVector, int]] = []
        for bit in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            self.levels.append((bit, BitVector(ones), int(len(ones) - np.count_nonzero(ones))))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low = np.zeros_like(at)
        for bit, v, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            a, b = v.rank(low), v.rank(at)
            low, at = np.where(one, zeros + a, low - a), np.where(one, zeros + b, at - b)
        return at - low

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before it."""
        low, symbol = np.zeros_like(at), np.zeros_like(at)
        for bit, v, zeros in self.levels:
            one = v.get(at)
            symbol |= one.astype(np.int64) << bit
            a, b = v.rank(low), v.rank(at)
            low, at = np.where(one, zeros + a, low - a), np.where(one, zeros + b, at - b)
        return symbol, at - low


def suffix_order(symbols: np.ndarray, sigma: int) -> np.ndarray:
    """The suffixes in order.  Symbol 0 stands for separators, which differ
    from each other (the earlier is the smaller) and follow all words; the
    last symbol is one.  Prefix doubling, on the suffixes still tied alone."""
    n, gap = len(symbols), symbols == 0
    order = np.argsort(np.where(gap, sigma, symbols), kind="stable")
    tied = order[~gap[order]]
    rank = np.empty(n, np.int64)
    rank[order[len(tied):]] = np.arange(len(tied), n)
    group = symbols[tied]
    new = np.r_[True, group[1:] != group[:-1]] if len(tied) else np.zeros(0, bool)
    rank[tied] = np.flatnonzero(new)[np.cumsum(new) - 1]
    done = 1
    while True:
        # the suffixes that share their rank with a neighbour
        r = rank[tied]
        same = np.zeros(len(tied), bool)
        if len(tied):
            same[1:] = r[1:] == r[:-1]
            same[:-1] |= same[1:]
        tied = tied[same]
        if not len(tied):
            break
        r, ahead = rank[tied], rank[tied + done]
        by = np.argsort(r * n + ahead, kind="stable")
        tied, r, ahead = tied[by], r[by], ahead[by]
        first = np.r_[True, r[1:] != r[:-1]]
        new = first | np.r_[True, ahead[1:] != ahead[:-1]]
        start = np.flatnonzero(first)[np.cumsum(first) - 1]
        sub = np.flatnonzero(new)[np.cumsum(new) - 1]
        rank[tied] = r + sub - start
        done *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


class FMIndex:
    """Search and location in symbols below ``sigma``, 0 being separators."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = SAMPLE):
        self.n = len(symbols)
        order = suffix_order(symbols, sigma)
        last = symbols[order - 1]
        self.tree = WaveletTree(last, sigma)
        counts = np.bincount(symbols, minlength=sigma)
        counts[0] = 0  # separators sort behind the words
        self.first = np.cumsum(counts) - counts
        marked = (order % sample == 0) | (last == 0)
        self.marks, self.sampled = BitVector(marked), order[marked]

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that begin with each phrase; phrases are filled from the right."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        width = phrases.shape[1]
        for k in range(width - 1, -1, -1):
            on = np.flatnonzero((width - k <= lengths) & (low < high))
            if not len(on):
                break
            c = phrases[on, k]
            low[on] = self.first[c] + self.tree.rank(c, low[on])
            high[on] = self.first[c] + self.tree.rank(c, high[on])
        return low, np.maximum(low, high)

    def located(self, rows: np.ndarray) -> np.ndarray:
        """The position of each row's suffix."""
        out, steps, open_ = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(open_):
            there = self.marks.get(rows)
            out[open_[there]] = self.sampled[self.marks.rank(rows[there])] + steps
            open_, rows = open_[~there], rows[~there]
            c, before = self.tree.get(rows)
            rows, steps = self.first[c] + before, steps + 1
        return out


class Phrases:
    """The distinct windows of a block of benchmark items, as symbols."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        found: dict[tuple[bytes, ...], set] = {}
        for item, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[i:i + window]), set()).add(item)
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for p in found for w in p}))}
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.rows = np.zeros((len(found), window), np.int64)
        for row, p in zip(self.rows, found):
            row[window - len(p):] = [self.vocabulary[w] for w in p]
        self.items = [sorted(x for x in s if x is not None) for s in found.values()]
        self.window = window

    def hits(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
        """(text, first word, phrase) of every occurrence; texts: a symbol per word, 0 for others."""
        symbols, word, owner = [], [], []
        for i, t in enumerate(texts):
            # a run of other words is one separator, and so is the end
            keep = np.flatnonzero(np.r_[t != 0, True] | (np.r_[t[:1] * 0 + 1, t] != 0))
            symbols.append(np.r_[t, 0][keep])
            word.append(keep)
            owner.append(np.full(len(keep), i))
        s = np.concatenate([np.zeros(1, np.int64), *symbols]).astype(np.int64)
        w, o = np.concatenate([[0], *word]), np.concatenate([[0], *owner])
        if not s.any() or not len(self.lengths):
            return
        index = FMIndex(s, len(self.vocabulary) + 1)
        low, high = index.ranges(self.rows, self.lengths)
        n = high - low
        phrase = np.repeat(np.arange(len(n)), n)
        at = index.located(np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum()))
        yield from zip(o[at].tolist(), w[at].tolist(), phrase.tolist())


def searched(texts: Iterator[str | None], phrases: Phrases, shard_words: int = SHARD_WORDS) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """For each text: its words, the covered words as rows (first, last), merged, and the ids of the items found."""
    get = phrases.vocabulary.get
    sizes: list[int] = []
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[int]] = {}
    shard: list[tuple[int, int, np.ndarray]] = []
    held = 0

    def search() -> None:
        for i, first, p in phrases.hits([t for _, _, t in shard]):
            doc, offset, _ = shard[i]
            first += offset
            spans.setdefault(doc, []).append((first, first + int(phrases.lengths[p]) - 1))
            items.setdefault(doc, set()).update(phrases.items[p])

    for doc, text in enumerate(texts):
        words = words_of(text)
        sizes.append(len(words))
        t = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
        for at in range(0, max(1, len(t)), shard_words):
            piece = t[at:at + shard_words + phrases.window - 1]
            shard.append((doc, at, piece))
            held += len(piece)
            if held >= shard_words:
                search()
                shard, held = [], 0
    search()
    for doc, n in enumerate(sizes):
        yield n, merged(spans.get(doc, [])), sorted(items.get(doc, ()))


def merged(spans: list[tuple[int, int]]) -> np.ndarray:
    """Spans (first, last) that touch or overlap become one."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    s = np.array(sorted(spans), np.int64)
    reach = np.maximum.accumulate(s[:, 1])
    new = np.r_[True, s[1:, 0] > reach[:-1] + 1]
    start = np.flatnonzero(new)
    return np.column_stack([s[start, 0], np.maximum.reduceat(s[:, 1], start)])


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` less the words from first to last of every span, and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [(m.start(), m.end()) for m in re.finditer(rb"[^ ]+", raw.translate(WORD_BYTES))]
    out, end = [], 0
    for first, last in spans:
        out.append(raw[end:at[first][0]])
        end = at[last][1]
    return b"".join([*out, raw[end:]]).decode("utf-8", "surrogatepass")


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in blocks of about ``block_words`` words."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("text"))
    n = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + n // (2 * block_words)  # a word and its separator are two bytes at least
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        yield [(r.item, r.text) for r in part.collect()]  # bounded by the block's size


FOUND = "n_words bigint, spans array<struct<first:bigint,last:bigint>>, items array<bigint>"


def _search(docs: DataFrame, text: str, phrases: Phrases, keep: list[str], clean: str | None = None) -> DataFrame:
    """``keep`` columns with n_words, spans and items, and ``clean``: the text without the spans."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0)
            n, spans, items = [], [], []
            for words, s, i in searched((t.as_py() for t in texts), phrases):
                n.append(words)
                spans.append([{"first": x, "last": y} for x, y in s.tolist()])
                items.append(i)
            columns = [*b.columns[1:], pa.array(n, pa.int64()),
                       pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(items, pa.list_(pa.int64()))]
            names = [*keep, "n_words", "spans", "items"]
            if clean:
                columns.append(pa.array([without(t.as_py(), [(x["first"], x["last"]) for x in s]) if s else t.as_py()
                                         for t, s in zip(texts, spans)], pa.string()))
                names.append(clean)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + FOUND + (f", `{clean}` string" if clean else "")
    return docs.select(text, *keep).mapInArrow(run, schema)


def passages(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
             window: int = WINDOW, block_words: int = BLOCK_WORDS, clean: bool = False) -> DataFrame:
    """The columns of ``docs`` but the text, plus n_words, spans (first and
    last word of the merged hits) and items (ids found, sorted); with
    ``clean`` the text is there as well, less the spans.

    A row per row of ``docs``; repeated rows are separate documents.  NULL and
    empty texts have no words.  Items without words have no windows; items
    without an id cover words but are not listed; an id on several rows is
    listed once.  An empty benchmark covers nothing.  Columns of ``docs`` by
    the names of the results are replaced.
    """
    made = ("n_words", "spans", "items")
    keep = [c for c in docs.columns if c != text and c not in made]
    blocks = benchmark_blocks(benchmark, item_id, item_text, block_words)
    head = next(blocks)
    second = next(blocks, None)
    if second is None:
        return _search(docs, text, Phrases(head, window), keep, text if clean else None)
    rid = fresh(docs.columns, "rid")
    rows = staged(docs.select(text, *keep).withColumn(rid, F.monotonically_increasing_id()))
    found = None
    for items in (head, second, *blocks):
        part = _search(rows, text, Phrases(items, window), [rid])
        found = part if found is None else found.unionByName(part)
    together = found.groupBy(rid).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
                                      F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return _united(rows.join(together, rid).drop(rid), text, keep, clean)


def _united(df: DataFrame, text: str, keep: list[str], clean: bool) -> DataFrame:
    """Spans of several blocks merged, as in one search."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0)
            spans = [merged([(x["first"], x["last"]) for x in s.as_py()]).tolist() for s in b.column(b.num_columns - 2)]
            columns = [*b.columns[1:-2], pa.array([[{"first": x, "last": y} for x, y in s] for s in spans],
                                                  pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), b.columns[-1]]
            if clean:
                columns.append(pa.array([without(t.as_py(), s) if s else t.as_py() for t, s in zip(texts, spans)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = [*keep, "n_words", "spans", "items", *([text] if clean else [])]
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + FOUND + (f", `{text}` string" if clean else "")
    return df.select(text, *keep, "n_words", "spans", "items").mapInArrow(run, schema)


def n_hit(spans: str = "spans"):
    """Words covered by merged spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
