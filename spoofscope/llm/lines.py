"""Repeated passages of lines: overlapping three-line windows, found globally.

Every document's lines with a visible character are numbered; each run of
three of them is a window, known by a 128-bit hash.  A window that occurs more
than once keeps its first occurrence, in the order of (doc_id, text hash,
line), and every later occurrence covers its three lines.  The union of a
document's covered lines is removed.

Shuffles carry hashes, not lines.  The first occurrence per window is a
``min`` aggregate (combined before the shuffle, so a passage in millions of
documents is one row per task); its join with the occurrences has one row per
window on the one side, and adaptive execution splits a hot window's
occurrences on the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoofscope.llm.common import fresh, ship_package, staged

WINDOW = 3
#: White space of lines that count as blank.
BLANK = " \t\n\x0b\x0c\r"


def visible_lines(text: Column) -> Column:
    """Lines (split at ``\\n``) that hold a character other than white space, as (at, line) with
    ``at`` the line's place among all lines."""
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("at"), x.alias("line"))),
                    lambda s: s["line"].rlike(r"[^\x20\x09-\x0D]"))


def windows(lines: Column, size: int = WINDOW) -> Column:
    """Hashes (h1, h2) and number of every ``size`` consecutive lines."""
    def one(i: Column) -> Column:
        parts = [F.get(lines, i + k)["line"] for k in range(size)]
        return F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(size), *parts).alias("h2"), i.alias("at"))
    return F.when(F.size(lines) >= size, F.transform(F.sequence(F.lit(0), F.size(lines) - size), one))


def without_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated passages gone from ``text``, plus n_lines
    (visible lines), n_removed and removed_at (the places, among all lines,
    of those removed).

    A NULL text stays NULL; texts of fewer than ``size`` visible lines stay
    whole; blank lines stay.  NULL ids order first.  Rows equal in id and
    text are one document: each of them gets the same result.  Rows that
    share an id but not the text are different documents.
    """
    ship_package(docs.sparkSession)
    made = ("n_lines", "n_removed", "removed_at")
    columns = [c for c in docs.columns if c not in made]
    h, key, at = (fresh(columns, x) for x in ("text_hash", "id_key", "covered"))
    base = docs.select(*columns).withColumn(h, F.xxhash64(text)).withColumn(key, F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    seen = (base.select(F.col(doc_id).alias("id"), F.col(key).alias("key"), F.col(h).alias("hash"), visible_lines(F.col(text)).alias("lines"))
            .select("id", "key", "hash", F.explode(windows(F.col("lines"), size)).alias("w"))
            .select("id", "key", "hash", "w.h1", "w.h2", "w.at"))
    place = F.struct("id", "key", "hash", "at")
    # written, so that the join below can split a hot window's occurrences
    first = staged(seen.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                   .filter(~F.col("first").eqNullSafe(F.col("last"))).select("h1", "h2", "first"))
    later = seen.join(first, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    covered = later.groupBy(F.col("key").alias(key), F.col("hash").alias(h)).agg(F.collect_set("at").alias(at))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, n, gone = [], [], []
            for t, starts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                every = (t or "").split("\n")
                places = [i for i, x in enumerate(every) if x.strip(BLANK)]
                out = sorted({places[s + k] for s in starts or () for k in range(size)})
                drop = set(out)
                kept.append("\n".join([x for i, x in enumerate(every) if i not in drop]) if out else t)
                n.append(len(places))
                gone.append(out)
            columns_ = dict(zip(rest, b.columns[2:])) | {text: pa.array(kept, pa.string())}
            yield pa.RecordBatch.from_arrays([*[columns_[c] for c in columns], pa.array(n, pa.int64()), pa.array([len(g) for g in gone], pa.int64()),
                                              pa.array(gone, pa.list_(pa.int32()))], names=[*columns, *made])

    rest = [c for c in columns if c != text]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = "".join(f"`{c}` {kinds[c]}, " for c in columns) + "n_lines bigint, n_removed bigint, removed_at array<int>"
    return base.join(covered, [key, h], "left").select(text, at, *rest).mapInArrow(clean, schema)
