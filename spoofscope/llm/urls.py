"""URL filter: host and path rules, then a naive Bayes score for the rest.

Hosts are concatenated names, so their labels are first split into words by
the most probable segmentation under a unigram model (Viterbi).  The unigram
counts come from the whole corpus of documents.  A multinomial naive Bayes
model of the words of host and path, learnt from all URLs that a rule decides,
judges the URLs that no rule fits.

Everything is counted, joined and scored per distinct label, host or path, and
joined back to the pages; only counts (a single row) reach the driver.  Word
weights are whole millionths, so sums do not depend on their order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoofscope.llm.common import ascii_lower, ship_package

#: Longest word that a host label is split into.
LONGEST_WORD = 24
#: Rules become one expression; more of them than this are refused.
MOST_RULES = 1000
#: An unknown character costs as much as a word seen less than once, this many times over.
UNKNOWN = math.log(1000.0)


@dataclass(frozen=True)
class Rule:
    """``place`` is host/path, e.g. ``example.com/en/``; it fits the host and its subdomains."""

    verdict: str
    place: str


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; NULLs without one."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.place), r.place)):  # the longest ends up outermost
        at, _, rest = r.place.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        name, verdict = F.when(fits, F.lit(r.place)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def word_counts(docs: DataFrame, text: str = "text", longest: int = LONGEST_WORD) -> DataFrame:
    """word, n: runs of letters of all texts, in lower case."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}]+")).alias("word"))
    return words.filter((F.length("word") > 0) & (F.length("word") <= longest)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def segment(label: str, pieces: list[tuple[int, int, float]], unknown: float) -> list[str]:
    """The most probable words of ``label``; pieces: (start, length, log
    probability) of known words in it.  Neighbouring unknown characters form
    one word."""
    ending: dict[int, list[tuple[int, float]]] = {}
    for start, length, p in pieces:
        ending.setdefault(start + length, []).append((start, p))
    best, back = [0.0], [0]
    for end in range(1, len(label) + 1):
        score, start, known = best[end - 1] + unknown, end - 1, False
        for s, p in sorted(ending.get(end, ())):
            if best[s] + p > score:
                score, start, known = best[s] + p, s, True
        best.append(score)
        back.append(start if known else -start - 1)
    words, end, loose = [], len(label), 0
    while end:
        start = back[end]
        if start < 0:
            start, loose = -start - 1, loose or end
        else:
            if loose:
                words.append(label[end:loose])
                loose = 0
            words.append(label[start:end])
        end = start
    if loose:
        words.append(label[:loose])
    return words[::-1]


def segmented(labels: DataFrame, counts: DataFrame, longest: int = LONGEST_WORD) -> DataFrame:
    """label, words for the distinct, non-empty ``label`` strings."""
    ship_package(labels.sparkSession)
    labels = labels.select("label").filter(F.length("label") > 0).distinct()
    total = counts.agg(F.sum("n")).first()[0] or 0
    size = F.length("label")
    starts = labels.select("label", F.explode(F.sequence(F.lit(1), size)).alias("start"))
    pieces = starts.select("label", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), size - F.col("start") + 1))).alias("length"))
    known = (pieces.withColumn("word", F.expr("substring(label, start, length)")).join(counts, "word")
             .groupBy("label").agg(F.collect_list(F.struct((F.col("start") - 1).alias("start"), "length",
                                                           F.log(F.col("n") / F.lit(float(total or 1))).alias("p"))).alias("pieces")))
    unknown = -math.log(total + 1.0) - UNKNOWN

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"label": b["label"], "words": [
                segment(x, [(p["start"], p["length"], p["p"]) for p in (() if ps is None else ps)], unknown)
                for x, ps in zip(b["label"], b["pieces"])]})

    return labels.join(known, "label", "left").mapInPandas(split, "label string, words array<string>")


def host_labels(host: Column) -> Column:
    """Parts of a host between dots, hyphens and digits."""
    return F.split(host, r"[.\-0-9_:@]+")


def path_words(path: Column) -> Column:
    """Runs of letters of the path, in lower case, and ``0`` for a run of digits."""
    return F.transform(F.regexp_extract_all(F.lower(path), F.lit(r"(\p{L}+|[0-9]+)"), 1),
                       lambda w: F.when(w.rlike("^[0-9]+$"), F.lit("0")).otherwise(w))


def judged(pages: DataFrame, rules: list[Rule], counts: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict and score_micro (millionths of
    the log odds of ``block``; NULL where a rule decides).

    NULL URLs and those without ``://`` have an empty host and path; without
    words their score is the prior alone.  Equal URLs are judged once.  Scores
    above 0 block.  Words that no rule-decided URL has carry no weight.
    """
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score_micro")]
    host, path = host_of(F.col(url)), path_of(F.col(url))
    places = pages.select(host.alias("host"), path.alias("path")).groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    places = places.withColumn("rule", rule).withColumn("verdict", verdict)

    labels = places.select("host").distinct().select("host", F.explode(host_labels(F.col("host"))).alias("label"))
    split = segmented(labels, counts)
    in_host = (labels.join(split, "label").select("host", F.explode("words").alias("word"))
               .groupBy("host", "word").agg(F.count(F.lit(1)).alias("k")))
    in_path = (places.select("path").distinct().select("path", F.explode(path_words(F.col("path"))).alias("word"))
               .groupBy("path", "word").agg(F.count(F.lit(1)).alias("k")))

    known = places.filter(F.col("verdict").isNotNull())
    by = lambda key: known.groupBy(key).agg(*[F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in ("allow", "block")])
    learnt = (by("host").join(in_host, "host").select("word", "k", "allow", "block")
              .unionByName(by("path").join(in_path, "path").select("word", "k", "allow", "block"))
              .groupBy("word").agg(F.sum(F.col("k") * F.col("allow")).alias("allow"), F.sum(F.col("k") * F.col("block")).alias("block")))
    t = learnt.agg(F.count(F.lit(1)).alias("v"), F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    seen = known.agg(*[F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in ("allow", "block")]).first()
    micro = lambda x: F.round(x * 1e6).cast("long")
    shift = math.log(((t.allow or 0) + t.v + 1) / ((t.block or 0) + t.v + 1))
    weights = learnt.select("word", micro(F.log((F.col("block") + 1.0) / (F.col("allow") + 1.0)) + F.lit(shift)).alias("w"))
    prior = round(1e6 * math.log(((seen.block or 0) + 1) / ((seen.allow or 0) + 1)))

    open_ = places.filter(F.col("verdict").isNull())
    score = lambda words, key: (open_.select(key).distinct().join(words, key).join(weights, "word")
                                .groupBy(key).agg(F.sum(F.col("k") * F.col("w")).alias(f"{key}_score")))
    total = F.lit(prior) + F.coalesce("host_score", F.lit(0)) + F.coalesce("path_score", F.lit(0))
    scored = (open_.join(score(in_host, "host"), "host", "left").join(score(in_path, "path"), "path", "left")
              .select("host", "path", total.cast("long").alias("score_micro")))
    out = pages.select(*names, host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return (out.join(scored, ["host", "path"], "left")
            .select(*names, "host", "path", rule.alias("rule"),
                    F.coalesce(verdict, F.when(F.col("score_micro") > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                    "score_micro"))
