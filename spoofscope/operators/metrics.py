"""Classification-quality operators over scored rows.

Input: one row per scored example with ``y_true`` (0/1), a probability and,
optionally, ``y_pred``.  Every metric is a single aggregation pass (no
per-threshold or per-class rescans).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoofscope.operators.ordered import running, value_chunk

# Decision thresholds compared in the sweep, class names,
# outcome names and the histogram resolution.
SWEEP_THRESHOLDS = [0.2, 0.3, 0.35, 0.4, 0.5]
CLASS_NAMES = {0: "clean", 1: "spoofed"}
OUTCOMES = {(1, 1): "Correctly detected attack", (1, 0): "Missed attack",
            (0, 1): "False alarm", (0, 0): "Correct normal"}
HIST_BINS = 40


def predict(df: DataFrame, prob: str = "spoof_probability", threshold: float = 0.5) -> DataFrame:
    """``y_pred = prob >= threshold`` and ``correct``."""
    y = F.when(F.col(prob) >= threshold, 1).otherwise(0)
    return df.withColumn("y_pred", y).withColumn("correct", F.col("y_true") == F.col("y_pred"))


def _div(a: Column, b: Column) -> Column:
    """a / b with 0 when b is 0 (zero-division -> 0)."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def _cells(y: Column, p: Column) -> list[Column]:
    return [F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
            F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp")]


def _metric_cols() -> list[Column]:
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    return [_div(tp + tn, tp + tn + fp + fn).alias("accuracy"),
            _div(tp, tp + fp).alias("precision"), _div(tp, tp + fn).alias("recall"),
            _div(2 * tp, 2 * tp + fp + fn).alias("f1")]


def confusion_cells(df: DataFrame) -> DataFrame:
    """One row: tn, fp, fn, tp (labels fixed to [0, 1])."""
    return df.agg(*_cells(F.col("y_true"), F.col("y_pred")))


def confusion_matrix(df: DataFrame) -> DataFrame:
    """Always 2x2: rows (y_true, y_pred, n) for every cell, zeros included."""
    c = confusion_cells(df)
    cell = lambda t, p, n: F.struct(F.lit(t).alias("y_true"), F.lit(p).alias("y_pred"),
                                    F.col(n).alias("n"))
    return c.select(F.inline(F.array(cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"),
                                     cell(1, 1, "tp"))))


def metrics_from_cells(cells: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 from (tn, fp, fn, tp); 0 on zero
    division.  F1 = 2TP / (2TP + FP + FN)."""
    return cells.select("tn", "fp", "fn", "tp", *_metric_cols())


def classification_metrics(df: DataFrame) -> DataFrame:
    return metrics_from_cells(confusion_cells(df))


def classification_report(df: DataFrame) -> DataFrame:
    """Per class precision/recall/F1/support plus accuracy, macro and
    weighted averages (one aggregation, then arithmetic on one row)."""
    c = confusion_cells(df)
    tn, fp, fn, tp = (F.col(x).cast("double") for x in ("tn", "fp", "fn", "tp"))
    p1, r1 = _div(tp, tp + fp), _div(tp, tp + fn)
    p0, r0 = _div(tn, tn + fn), _div(tn, tn + fp)
    f1_1, f1_0 = _div(2 * tp, 2 * tp + fp + fn), _div(2 * tn, 2 * tn + fn + fp)
    s0, s1 = tn + fp, tp + fn
    n = s0 + s1
    acc = _div(tp + tn, n)
    row = lambda name, p, r, f, s: F.struct(F.lit(name).alias("class_name"), p.alias("precision"),
                                          r.alias("recall"), f.alias("f1_score"),
                                          s.cast("bigint").alias("support"))
    return c.select(F.inline(F.array(
        row(CLASS_NAMES[0], p0, r0, f1_0, s0), row(CLASS_NAMES[1], p1, r1, f1_1, s1),
        row("accuracy", acc, acc, acc, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n),
        row("weighted avg", _div(p0 * s0 + p1 * s1, n), _div(r0 * s0 + r1 * s1, n),
            _div(f1_0 * s0 + f1_1 * s1, n), n))))


def threshold_sweep(df: DataFrame, prob: str = "spoof_probability",
                    thresholds: Sequence[float] = SWEEP_THRESHOLDS) -> DataFrame:
    """Metrics at every threshold (``prob >= t``) in one pass: one
    aggregation computes the four confusion cells for each threshold
    (conditional counts, combined map-side); the one-row result is unpivoted
    to one row per threshold.  Rows are read once and never multiplied."""
    y, p = F.col("y_true"), F.col(prob)
    aggs = []
    for k, t in enumerate(thresholds):
        hit = p >= F.lit(float(t))
        aggs += [F.count_if((y == 0) & ~hit).alias(f"tn{k}"), F.count_if((y == 0) & hit).alias(f"fp{k}"),
                 F.count_if((y == 1) & ~hit).alias(f"fn{k}"), F.count_if((y == 1) & hit).alias(f"tp{k}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tn{k}").alias("tn"),
                              F.col(f"fp{k}").alias("fp"), F.col(f"fn{k}").alias("fn"),
                              F.col(f"tp{k}").alias("tp")) for k, t in enumerate(thresholds)])
    cells = one.select(F.inline(rows))
    return cells.select(
        "threshold", *[c for c in _metric_cols()],
        F.col("fp").alias("false_alarms"), F.col("fn").alias("missed_attacks"),
        F.col("tn").alias("true_negatives"), F.col("tp").alias("true_positives"),
    ).withColumnRenamed("precision", "attack_precision").withColumnRenamed("recall", "attack_recall") \
     .withColumnRenamed("f1", "attack_f1")


def roc_auc(df: DataFrame, prob: str = "spoof_probability") -> DataFrame:
    """Exact ROC AUC with tied scores averaged (Mann-Whitney rank sum);
    NULL when only one class is present.

    Rows are counted per distinct score first, so ties are one row; running
    counts of the distinct scores come in value chunks (``running``), and the
    rank sum is a global aggregate.
    """
    counts = df.groupBy(prob).agg(F.count_if(F.col("y_true") == 1).alias("_pos"), F.count(F.lit(1)).alias("_n"))
    per_score = running(counts, [], [prob], value_chunk(F.col(prob)), F.col("_n"), "_before").withColumn(
        "_avg_rank", F.col("_before") + (F.col("_n") + 1) / 2.0)
    s = per_score.agg(F.sum(F.col("_avg_rank") * F.col("_pos")).alias("rs"),
                      F.sum("_pos").cast("double").alias("n1"),
                      (F.sum("_n") - F.sum("_pos")).cast("double").alias("n0"))
    auc = (F.col("rs") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n0") * F.col("n1"))
    return s.select(F.when((F.col("n0") > 0) & (F.col("n1") > 0), auc).alias("roc_auc"))


def outcome_classes(df: DataFrame) -> DataFrame:
    """Outcome name and marker colour per row class, with counts."""
    y, p = F.col("y_true"), F.col("y_pred")
    name = (F.when((y == 1) & (p == 1), OUTCOMES[(1, 1)]).when((y == 1) & (p == 0), OUTCOMES[(1, 0)])
             .when((y == 0) & (p == 1), OUTCOMES[(0, 1)]).otherwise(OUTCOMES[(0, 0)]))
    color = (F.when((y == 1) & (p == 1), "red").when((y == 1) & (p == 0), "orange")
              .when((y == 0) & (p == 1), "purple").otherwise("green"))
    return df.groupBy(name.alias("outcome"), color.alias("color")).agg(F.count(F.lit(1)).alias("n"))


def probability_histogram(df: DataFrame, prob: str = "spoof_probability", bins: int = HIST_BINS) -> DataFrame:
    """Counts in ``bins`` equal-width bins on [0, 1] per true class."""
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    return (df.groupBy("y_true", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("bin_start", F.col("bin") / F.lit(float(bins)))
              .withColumn("bin_end", (F.col("bin") + 1) / F.lit(float(bins))))


def accuracy_by(df: DataFrame, keys: Sequence[str], prob: str = "spoof_probability",
                first_true_by: str | None = None) -> DataFrame:
    """count, correct, accuracy and mean probability per key; optionally the
    first row's true class (by ``first_true_by``)."""
    aggs = [F.count(F.lit(1)).alias("count"), F.count_if(F.col("correct")).alias("correct"),
            F.avg(F.col("correct").cast("double")).alias("accuracy")]
    if first_true_by:
        aggs.append(F.min_by("y_true", first_true_by).alias("true_class"))
    aggs.append(F.avg(prob).alias(f"avg_{prob}"))
    return df.groupBy(*keys).agg(*aggs)


def confident_mistakes(df: DataFrame, prob: str = "spoof_probability", n: int = 30,
                       tie: Sequence[str] = ("seq",)) -> DataFrame:
    """Wrong predictions ranked by the confidence of the wrong call."""
    wrong = F.when(F.col("y_pred") == 1, F.col(prob)).otherwise(1.0 - F.col(prob))
    m = df.filter(~F.col("correct")).withColumn("confidence_wrong", wrong)
    return m.orderBy(F.col("confidence_wrong").desc(), *[F.col(c) for c in tie]).limit(n)


def top_predictions(df: DataFrame, prob: str = "attack_probability", n: int = 20,
                    tie: Sequence[str] = ("icao24",)) -> DataFrame:
    return df.orderBy(F.col(prob).desc(), *[F.col(c).asc() for c in tie]).limit(n)


def prediction_summary(df: DataFrame, prob: str = "attack_probability",
                       pred: str = "predicted_anomaly") -> DataFrame:
    """Total, anomalies, anomaly rate, mean and max probability; zeros for an
    empty input or absent columns."""
    p = F.col(prob) if prob in df.columns else F.lit(None).cast("double")
    a = F.col(pred) if pred in df.columns else F.lit(0)
    s = df.agg(F.count(F.lit(1)).alias("total_aircraft"),
               F.coalesce(F.sum(a), F.lit(0)).cast("bigint").alias("predicted_anomalies"),
               F.avg(p).alias("_avg"), F.max(p).alias("_max"))
    return s.select("total_aircraft", "predicted_anomalies",
                    _div(F.col("predicted_anomalies").cast("double"), F.col("total_aircraft").cast("double"))
                    .alias("anomaly_rate"),
                    F.coalesce(F.col("_avg"), F.lit(0.0)).alias("average_attack_probability"),
                    F.coalesce(F.col("_max").cast("double"), F.lit(0.0)).alias("max_attack_probability"))


def mixed_groups(df: DataFrame, group: str = "group_id", target: str = "y_true",
                 order: str = "seq") -> DataFrame:
    """Groups whose rows carry more than one target value: first value,
    distinct count and size."""
    g = df.groupBy(group).agg(F.min_by(target, order).alias("first"),
                              F.countDistinct(target).alias("nunique"), F.count(F.lit(1)).alias("size"))
    return g.filter(F.col("nunique") > 1)


def group_key(cols: Sequence[str]) -> Column:
    """``a__b`` composite key; NULL parts become 'nan' (never skipped)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = F.concat(out, F.lit("__"), p)
    return out
