"""Licence notices: MinHash bands over overlapping windows, then containment.

Texts and notices become runs of five words.  A notice with t runs belongs to
the size class W, the next power of two that is at least t.  For each class, a
text is cut into windows of 2 W runs, one every W, so any W consecutive runs
lie whole in some window.  A window that holds the share c of a notice's runs
has a Jaccard similarity of at least c t / (2 W + t - c t) with it, and t is
more than W / 2 (t = 1 has W = 1), so the least similarity is known.  Bands of
one row each are then so many that all of them miss with a probability of at
most ``MISS``.  Windows and notices that share a band are compared exactly:
the share of the notice's runs in the window must reach ``CONTAINMENT``.

A band of one row can only agree through a run that both sides hold, so
windows without any run of any notice are passed over before signing: none of
their bands could agree.  The notices are a parameter of bounded size and are
broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoofscope.llm.common import ascii_lower, only, text_or_empty

SHINGLE, CONTAINMENT = 5, 0.8
#: Chance that every band misses a window at the least similarity.
MISS = 1e-4
MOST_NOTICES = 2000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Short public licence notices.
NOTICES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
}


def size_class(t: int) -> int:
    return 1 << (t - 1).bit_length()


def bands_for(size: int, containment: float = CONTAINMENT, miss: float = MISS) -> int:
    """Bands (of one row) for a size class: the least similarity is that of its
    shortest notice."""
    t = size // 2 + 1
    least = containment * t / (2 * size + t - containment * t)
    return math.ceil(math.log(miss) / math.log(1 - least))


def shingles(text: Column) -> Column:
    """Hashes of every five consecutive words; NULL with fewer words."""
    words = F.array_remove(F.split(ascii_lower(text), SEPARATORS, -1), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def runs(words: Column) -> Column:
    return F.when(F.array_size(words) >= SHINGLE, F.transform(
        F.sequence(F.lit(0), F.array_size(words) - SHINGLE),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])))


def signature(window: Column, bands: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda k: F.array_min(F.transform(window, lambda h: F.xxhash64(h, k))))


def templates(spark: SparkSession, notices: dict[str, str]) -> DataFrame:
    """license_id, runs, size (class) and n_runs of every notice."""
    if len(notices) > MOST_NOTICES:
        raise ValueError(f"at most {MOST_NOTICES} notices")
    df = (spark.createDataFrame(sorted(notices.items()), "license_id string, text string")
          .select("license_id", shingles(F.col("text")).alias("w")).select("license_id", F.array_distinct(runs(F.col("w"))).alias("runs"))
          .withColumn("n_runs", F.array_size("runs")))
    return df.withColumn("size", F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n_runs").cast("double")))).cast("int"))


def found(docs: DataFrame, notices: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document and notice found: doc_id, license_id, n_windows that
    hold it, containment (the best, in thousandths) and first_word (where the
    first of its runs begins).

    NULL and short texts have no rows, nor has an empty table.  Rows that
    share an id (NULL too) are reported together.  Other columns are ignored.
    """
    notices = NOTICES if notices is None else notices
    spark = docs.sparkSession
    known = templates(spark, notices)
    rows = known.collect()  # bounded by MOST_NOTICES
    known = spark.createDataFrame(rows, known.schema)
    if short := [r.license_id for r in rows if not r.n_runs]:
        raise ValueError(f"notices need {SHINGLE} words: {short}")
    sizes = sorted({r.size for r in rows})
    every = F.array(*[F.lit(h) for h in sorted({h for r in rows for h in r.runs})])
    texts = (docs.select(F.col(doc_id).alias("doc_id"), shingles(text_or_empty(text)).alias("w"))
             .select("doc_id", runs(F.col("w")).alias("runs"))
             .select("doc_id", only(F.col("runs"), F.arrays_overlap("runs", every)).alias("runs")).filter(F.col("runs").isNotNull()))
    n = F.array_size("runs")
    def cut(s: int) -> Column:
        last = F.greatest(F.ceil(n / s).cast("int") - 2, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda j: F.struct(
            F.lit(s).alias("size"), (j * s).alias("start"), F.slice("runs", j * s + 1, F.lit(2 * s)).alias("window")))

    windows = (texts.select("doc_id", F.explode_outer(F.flatten(F.array(*[cut(s) for s in sizes]))).alias("x")).select("doc_id", "x.*")
               .filter(F.arrays_overlap("window", every)))
    sign = lambda c: F.coalesce(*[F.when(F.col("size") == s, signature(c, bands_for(s))) for s in sizes])
    signed = windows.select("*", F.posexplode_outer(sign(F.col("window"))).alias("band", "low"))
    keys = known.select("license_id", "n_runs", F.col("runs").alias("notice"), "size", F.posexplode_outer(sign(F.col("runs"))).alias("band", "low"))
    share = F.array_size(F.array_intersect("window", "notice"))
    first = F.array_min(F.filter(F.transform("window", lambda h, i: F.when(F.array_contains("notice", h), i)), lambda i: i.isNotNull()))
    hits = (signed.join(F.broadcast(keys), ["size", "band", "low"])
            .groupBy("doc_id", "license_id", "start", "window", "notice", "n_runs").agg(F.count(F.lit(1)).alias("n_bands"))
            .filter(share >= F.col("n_runs") * CONTAINMENT))
    return hits.groupBy("doc_id", "license_id").agg(
        F.count_distinct("start").alias("n_windows"), F.max(F.expr("(1000 * array_size(array_intersect(window, notice))) div n_runs")).alias("containment"),
        F.min(F.col("start") + first).cast("long").alias("first_word"))
