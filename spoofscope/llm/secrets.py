"""Secrets in texts: fixed patterns, and values in credential context that are dear to guess.

A value that follows a word for a credential (``pwd = ...``) is a secret only
if guessing it is dear.  Its guess cost is the least sum, over all ways to cut
the value into segments, of the segments' costs in bits: words (by their
frequency in the corpus, with capitals and look-alike digits), dates, repeated
blocks, straight keyboard or alphabet walks, and brute-force spans (by the
characters' classes).  A dynamic program finds it in one pass over the value.

Texts are scanned once, in Arrow batches; a linear-time pattern passes over
texts without anything of interest.  From there on the job handles distinct
values: their pieces are joined with the word counts of all documents, so the
dictionary is never held whole by a task or the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoofscope.llm.common import ship_package, staged

# The kinds of spans in the order of ties, and the patterns and least lengths of the given ones.
KINDS = ["assign", "access", "hex", "guess"]
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]{16,}"  # shorter hex runs fail anyway
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
# Words that announce a credential, what may stand between, and the value.
CONTEXT = (r"(?i:password|passwd|passphrase|passcode|pass|pwd|secret|token|credentials?|api[_ -]?key|access[_ -]?key|private[_ -]?key"
           r"|signing[_ -]?key|auth|login|pin)[\"'`]?(?:[ \t]*(?::=|=>|[:=])[ \t]*|[ \t]+(?:is|was)[ \t]+)[\"'`]?")
VALUE = r"([^\s\"'`<>]{8,})"
# Key rows, and look-alikes of letters.
ROWS = ["1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm"]
LOOKS = {"@": "a", "4": "a", "3": "e", "1": "l", "0": "o", "$": "s", "5": "s", "7": "t"}

#: Bits from which a value counts as a secret: 2^40 guesses.
LEAST_BITS = 40.0
#: A dictionary word has so many letters; the cost of a longer one is that of its parts.
WORD_LETTERS = (3, 24)
#: Bits for each cut between segments.
SEGMENT_BITS = 1.0
_KEY = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
_DATE = re.compile(r"(?=((?:19|20)\d\d([-/._]?)(\d{1,2})\2(\d{1,2})))|(?=((\d{1,2})([-/._]?)(\d{1,2})\7(?:19|20)\d\d))|(?=((?:19|20)\d\d))")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns: leftmost matches of each that
    don't overlap, the end exclusive, those too short dropped."""
    found = [(0, m.start(), m.end()) for m in re.finditer(ASSIGN, text, re.ASCII) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    found += [(1, m.start(), m.end()) for m in re.finditer(ACCESS, text) if m.end() - m.start() >= LEAST_ACCESS]
    return found + [(2, m.start(), m.end()) for m in re.finditer(HEX, text)]


def values_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, value) of what stands in credential context; punctuation at the end is no part of it."""
    out = []
    for m in re.finditer(rf"(?<![A-Za-z]){CONTEXT}{VALUE}", text):
        value = m[1].rstrip(".,;:!?)]}")
        if len(value) >= 8:
            out.append((m.start(1), m.start(1) + len(value), value))
    return out


def pieces(value: str) -> Iterator[tuple[str, int, int, float]]:
    """(word, start, length, bits of its spelling) of every run of letters, or
    of letters behind look-alikes, that could be a dictionary word."""
    plain = "".join(LOOKS.get(c, c.lower() if len(c.lower()) == 1 else c) for c in value)
    n, least, most = len(value), *WORD_LETTERS
    for i in range(n):
        swapped = capitals = 0
        for j in range(i, min(n, i + most)):
            if not plain[j].isalpha():
                break
            swapped += value[j] in LOOKS
            capitals += value[j] != plain[j] and value[j] not in LOOKS
            k = j - i + 1
            if k >= least:
                whole = capitals == k or capitals == 1 and value[i] != plain[i]
                yield plain[i:j + 1], i, k, float(swapped) + (0.0 if not capitals else 1.0 if whole else float(k))


def _class_bits(c: str) -> float:
    return math.log2(26) if c.isascii() and c.isalpha() else math.log2(10) if c.isascii() and c.isdigit() else math.log2(33) if c.isascii() else 8.0


def _step(a: str, b: str) -> tuple | None:
    """The move from key a to key b, if they are neighbours on the keyboard or in the alphabet."""
    if a.isascii() and b.isascii() and (a + b).isalpha() and abs(ord(a) - ord(b)) == 1:
        return ("abc", ord(b) - ord(a))
    if a in _KEY and b in _KEY:
        rows, cols = _KEY[b][0] - _KEY[a][0], _KEY[b][1] - _KEY[a][1]
        if (rows, cols) != (0, 0) and abs(rows) <= 1 and abs(cols) <= 1:
            return rows, cols
    return None


def patterns(value: str) -> Iterator[tuple[int, int, float]]:
    """(start, length, bits) of dates, repeats and walks."""
    n, low = len(value), value.lower() if len(value.lower()) == len(value) else value
    for m in _DATE.finditer(value):
        if m[1] and 1 <= int(m[3]) <= 12 and 1 <= int(m[4]) <= 31:
            yield m.start(), len(m[1]), math.log2(366 * 200) + 2 * bool(m[2])
        if m[5] and (1 <= int(m[6]) <= 31 and 1 <= int(m[8]) <= 12 or 1 <= int(m[6]) <= 12 and 1 <= int(m[8]) <= 31):
            yield m.start(), len(m[5]), 1 + math.log2(366 * 200) + 2 * bool(m[7])
    for m in re.finditer(r"(?=((?:19|20)\d\d))", value):
        yield m.start(), 4, math.log2(200)
    for period in range(1, 9):
        block, same = 0.0, 0  # from right to left: bits of the block, and how far the value equals itself moved by the period
        for i in range(n - period - 1, -1, -1):
            same = same + 1 if value[i] == value[i + period] else 0
            times = same // period + 1
            if times >= (3 if period == 1 else 2):
                block = sum(map(_class_bits, value[i:i + period]))
                yield i, times * period, block + math.log2(times)
    run, step = 1, None
    for i in range(n - 2, -1, -1):
        now = _step(low[i], low[i + 1])
        run, step = (run + 1 if now == step else 2) if now else 1, now
        if run >= 3:
            yield i, run, math.log2(47 * 8) + math.log2(run) + (0.0 if value[i:i + run] in (low[i:i + run], low[i:i + run].upper()) else float(run))


def guess_bits(value: str, words: list[tuple[int, int, float]]) -> float:
    """The least cost of ``value``; words: (start, length, bits) of dictionary words in it."""
    ending: dict[int, list[tuple[int, float]]] = {}
    for start, length, bits in [*words, *patterns(value)]:
        ending.setdefault(start + length, []).append((start, bits))
    best, loose = [0.0], math.inf  # of prefixes; of the prefix so far, ending inside a brute-force span
    for end, c in enumerate(value, 1):
        loose = min(loose, best[-1] + SEGMENT_BITS) + _class_bits(c)
        best.append(min([loose, *(best[s] + SEGMENT_BITS + b for s, b in ending.get(end, ()))]))
    return best[-1]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n: the dictionary, of all texts.  Tokens at white space, bare of
    punctuation at either end, lower-cased, of letters alone, seen three times
    or more; values in credential context are no words."""
    clean = F.regexp_replace(F.col(text), f"(?<![A-Za-z]){CONTEXT}{VALUE}", " ")
    low, high = WORD_LETTERS
    words = docs.select(F.explode(F.split(F.lower(clean), r"[\p{P}\s]*\s[\p{P}\s]*|^\p{P}+|\p{P}+$")).alias("word"))
    return words.filter(F.col("word").rlike(rf"^\p{{L}}{{{low},{high}}}$")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base (spans of the fixed patterns) and candidates (values in
    credential context) of every row; a NULL text has neither."""
    ship_package(docs.sparkSession)
    kind = dict(docs.dtypes)[doc_id]
    any_of = f"{ASSIGN}|{ACCESS}|{HEX}|{CONTEXT}{VALUE}".replace(r"\x20", " ")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            hits = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, any_of), False)).to_pylist()
            base: list = [[]] * len(texts)
            values: list = [[]] * len(texts)
            for i in hits:
                t = texts[i].as_py()
                base[i] = [{"kind": k, "start": s, "end": e} for k, s, e in base_spans(t)]
                values[i] = [{"start": s, "end": e, "value": v} for s, e, v in values_of(t)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, _SPANS), pa.array(values, _VALUES)], names=["doc_id", "base", "candidates"])

    return docs.select(doc_id, text).mapInArrow(
        scan, f"doc_id {kind}, base array<struct<kind:int,start:int,end:int>>, candidates array<struct<start:int,end:int,value:string>>")


_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_VALUES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))


def guess_costs(values: DataFrame, counts: DataFrame) -> DataFrame:
    """key, bits of the distinct values (key, value), from the word counts."""
    ship_package(values.sparkSession)
    total = counts.agg(F.sum("n")).first()[0] or 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, found = [], pieces(value)
                while rows := [r for r, _ in zip(found, range(20_000))]:  # long values in parts
                    word, start, length, bits = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(rows)), pa.array(word), pa.array(start, pa.int32()), pa.array(length, pa.int32()),
                                                      pa.array(bits, pa.float64())], names=["key", "word", "start", "length", "spelling"])

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [guess_bits(v, [(w["start"], w["length"], w["bits"]) for w in ws or ()]) for v, ws in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.float64())], names=["key", "bits"])

    parts = values.select("key", "value").mapInArrow(cut, "key string, word string, start int, length int, spelling double")
    bits = F.log2(F.lit(float(total)) / F.col("n")) + F.col("spelling")
    known = (parts.join(counts, "word").groupBy("key").agg(F.collect_list(F.struct("start", "length", bits.alias("bits"))).alias("words")))
    return values.join(known, "key", "left").select("key", "value", "words").mapInArrow(cost, "key string, bits double")


def found(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_bits: float = LEAST_BITS) -> DataFrame:
    """doc_id and spans (kind, start, end; code points, the end exclusive) of
    every row: the fixed patterns' matches, whole, and as ``guess`` the values
    of at least ``least_bits`` in credential context that no such match covers.

    Spans are sorted by start, then by kind as in ``KINDS``.  NULL and empty
    texts have no spans, rows with a NULL id count like others, repeated rows
    each get a row, an empty table gives none, other columns are not read, and
    texts and values are taken whole at any length.
    """
    rows = staged(scanned(docs, doc_id, text).withColumn("rid", F.monotonically_increasing_id()))
    covered = F.exists("base", lambda b: (b["start"] <= F.col("c.start")) & (b["end"] >= F.col("c.end")))
    open_ = (rows.select("rid", "base", F.explode("candidates").alias("c")).filter(~covered)
             .select("rid", "c.start", "c.end", "c.value", F.sha2(F.col("c.value"), 256).alias("key")))
    values = staged(open_.groupBy("key").agg(F.first("value").alias("value")))
    dear = staged(guess_costs(values, staged(word_counts(docs, text))).filter(F.col("bits") >= least_bits).select("key"))
    added = (open_.join(dear, "key").groupBy("rid")
             .agg(F.collect_list(F.struct(F.lit(KINDS.index("guess")).alias("kind"), "start", "end")).alias("added")))
    every = F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind:int,start:int,end:int>>")))
    by_start = F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("rank"), s["end"].alias("end")))
    named = F.transform(F.array_sort(by_start), lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1).alias("kind"),
                                                                   s["start"].alias("start"), s["end"].alias("end")))
    return rows.join(added, "rid", "left").select("doc_id", named.alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
