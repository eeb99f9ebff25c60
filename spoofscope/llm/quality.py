"""Quality rules whose cutoffs are certified on labelled documents.

A rule rejects a document whose score (a whole per-mille share) reaches the
rule's cutoff in the document's stratum.  Cutoffs are tried from the strictest
down.  With n clean labelled documents of the stratum, of which k would be
rejected, the exact binomial tail P(Bin(n, a) <= k) is the p-value of "the
false rejection rate exceeds a"; a cutoff is certified while this and all
stricter cutoffs stay at or below delta / (strata x rules).  That is fixed
sequence testing inside a rule and Bonferroni across rules and strata, so with
probability 1 - delta every certified cutoff holds at once.  The rate of a
single rule is a = alpha / rules, hence a stratum loses at most the share
alpha of its clean documents.  Among the certified cutoffs the one that
rejects the most bad less clean labelled documents is used.

All of it is DataFrame work: word windows are compared inside the row, counts
per (stratum, rule, level) are one partial aggregate, and the cutoff table has
a row per stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoofscope.llm.common import only, staged, text_or_empty

#: Share of a stratum's clean documents that may be lost, and the chance that this fails.
ALPHA, DELTA = 0.05, 0.05
#: Cutoffs in per mille, strictest first.
GRID = (900, 800, 700, 600, 500, 400, 300, 250, 200, 150, 120, 100, 80, 60, 50, 40, 30, 20, 15, 10, 5)
RULES = ("symbols", "capitals", "dup_lines", "repeats")
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = r"[\x20\x09-\x0D]+"
REPEAT_WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def _size(c: Column | str) -> Column:
    return F.array_size(c)


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``COUNTS`` (NULL text: zeros)."""
    t, own = text_or_empty(text), "_q_"
    words = F.array_remove(F.split(t, SPACE, -1), "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    gone = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    df = (docs.withColumn(own + "words", F.transform(words, lambda w: F.xxhash64(w)))
          .withColumn(own + "lines", lines))
    w = F.col(own + "words")
    df = df.withColumn(own + "windows", F.when(_size(w) >= REPEAT_WINDOW, F.transform(
        F.sequence(F.lit(0), _size(w) - REPEAT_WINDOW),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(REPEAT_WINDOW)]))))
    v = F.col(own + "windows")
    # only texts with a repeated window sort their windows
    df = df.withColumn(own + "sorted", F.when(_size(F.array_distinct(v)) < _size(v), F.sort_array(
        F.transform(v, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col(own + "sorted")
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    df = df.withColumn(own + "starts", F.sort_array(F.filter(F.transform(s, lambda x, i: F.when(
        same(x, F.when(i > 0, F.get(s, i - 1))) | same(x, F.get(s, i + 1)), x["i"])), lambda x: x.isNotNull())))
    p = F.col(own + "starts")
    repeated = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(REPEAT_WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(REPEAT_WINDOW)))),
                           F.lit(0).cast("long"), lambda a, x: a + x)
    made = {"n_words": _size(w), "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")), "n_symbols": gone(SYMBOLS),
            "n_dup_lines": _size(own + "lines") - _size(F.array_distinct(own + "lines")),
            "n_repeat_words": F.coalesce(repeated, F.lit(0)), "n_lines": _size(own + "lines"), "n_capitals": gone(CAPITALS)}
    return df.select(*[c for c in docs.columns if c not in made], *[made[k].cast("long").alias(k) for k in COUNTS])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def score(rule: str) -> Column:
    """Whole per mille of the rule's share; 0 where there is nothing to share."""
    part, whole = {"symbols": ("n_symbols", "word_chars"), "capitals": ("n_capitals", "word_chars"),
                   "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}[rule]
    return F.when(F.col(whole) > 0, F.expr(f"(1000 * {part}) div {whole}")).otherwise(F.lit(0)).cast("long")


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exactly, summed in logarithms."""
    start = F.struct((n * math.log1p(-p)).alias("term"), (n * math.log1p(-p)).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i) / (i + 1)) + math.log(p / (1 - p))
        high = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(-F.abs(acc["total"] - term)))).alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(0).cast("long"), k - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, add, lambda acc: F.exp(acc["total"]))


def certified(counts: DataFrame, labels: DataFrame, stratum: str = "lang", doc_id: str = "doc_id",
              alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum and, for each rule, cutoff_<rule> (NULL: none is certified).

    ``counts``: rows of :func:`counted`; ``labels``: doc_id, quality (1 clean,
    0 bad).  Labels without an id or a quality say nothing; a document that is
    labelled twice counts with its lower quality.  Documents that fail the
    base rules are left out, as the rules never see them.  No labels give no
    rows, and so no rejections.
    """
    marks = labels.filter(F.col(doc_id).isNotNull() & F.col("quality").isin(0, 1)).groupBy(doc_id).agg(F.min("quality").alias("quality"))
    level = lambda r: F.size(F.filter(F.array(*[F.lit(g) for g in GRID]), lambda g: score(r) >= g))
    levels = only(F.struct(*[level(r).alias(r) for r in RULES]), ~base_failed()).alias("levels")
    scored = (counts.join(marks, doc_id).select("quality", F.col(stratum).alias("stratum"), levels)
              .filter(F.col("levels").isNotNull()).select("quality", "stratum", "levels.*"))
    long = scored.select("stratum", "quality", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(r).alias("level")) for r in RULES])).alias("x")).select("stratum", "quality", "x.*")
    table = staged(long.groupBy("stratum", "rule", "level").agg(
        F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad")))
    # a level counts the grid's cutoffs that a score reaches; the last cutoffs of the grid are the lowest
    whole = Window.partitionBy("stratum", "rule")
    every = table.select("stratum", "rule").distinct().select("stratum", "rule", F.explode(F.sequence(F.lit(0), F.lit(len(GRID)))).alias("level"))
    table = every.join(table.withColumnRenamed("stratum", "_s"), F.col("stratum").eqNullSafe(F.col("_s")) & (every["rule"] == table["rule"])
                       & (every["level"] == table["level"]), "left").select(
        "stratum", every["rule"], every["level"], F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad"))
    # the cutoff at grid place g (from 1, strictest) rejects scores of level >= len(GRID) - g + 1
    up = whole.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    table = (table.withColumn("n", F.sum("good").over(whole)).withColumn("k", F.sum("good").over(up))
             .withColumn("rejected", F.sum("bad").over(up)).filter(F.col("level") > 0))
    rate = alpha / len(RULES)
    n_strata = table.select("stratum").distinct().count()
    limit = delta / (len(RULES) * max(1, n_strata))
    holds = F.when(F.col("k") > F.col("n") * rate, F.lit(False)).otherwise(binomial_tail(F.col("n"), F.col("k"), rate) <= limit)
    table = (table.withColumn("holds", holds.cast("int")).withColumn("chain", F.min("holds").over(up))
             .withColumn("cutoff", F.element_at(F.array(*[F.lit(g) for g in GRID]), (len(GRID) + 1 - F.col("level")).cast("int")))
             .filter((F.col("chain") == 1) & (F.col("rejected") > F.col("k"))))
    best = table.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct(F.col("rejected") - F.col("k"), "cutoff")).alias("cutoff"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cutoff_{r}") for r in RULES])


def judged(counts: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``counts`` with base_failed and kept.  A stratum without a certified
    cutoff (NULL is a stratum too) rejects by the base rules alone."""
    fails = F.lit(False)
    for r in RULES:
        fails = fails | F.coalesce(score(r) >= F.col(f"cutoff_{r}"), F.lit(False))
    cut = cutoffs.withColumnRenamed("stratum", "_stratum")
    return (counts.join(cut, counts[stratum].eqNullSafe(cut["_stratum"]), "left")
            .select(*counts.columns, base_failed().alias("base_failed"), (~base_failed() & ~fails).alias("kept")))
