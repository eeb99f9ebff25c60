"""Model-quality queries over scored rows (adapter B3) and live predictions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spoofscope.operators import metrics as mt
from spoofscope.operators import trajectory as tr
from spoofscope.plans.registry import register, rounded
from spoofscope.plans.trajectory import _STATES, states
from spoofscope.sources import adapters as ad

_SC = f"""{ad.cte('scores', ad.SCORES)},
pred AS (
  SELECT *, CASE WHEN spoof_probability >= 0.5 THEN 1 ELSE 0 END AS y_pred,
         (CASE WHEN spoof_probability >= 0.5 THEN 1 ELSE 0 END) = y_true AS correct
  FROM scores
),
cells AS (
  SELECT cast(count_if(y_true = 0 AND y_pred = 0) AS bigint) AS tn, cast(count_if(y_true = 0 AND y_pred = 1) AS bigint) AS fp,
         cast(count_if(y_true = 1 AND y_pred = 0) AS bigint) AS fn, cast(count_if(y_true = 1 AND y_pred = 1) AS bigint) AS tp
  FROM pred
)"""
_R = "round(coalesce(cast({a} AS double) / nullif(cast({b} AS double), 0), 0), 6)"


def scored(spark, sf_dir):
    return mt.predict(ad.scores(spark, sf_dir))


@register("confusion_matrix", oracle=f"""WITH {_SC}
SELECT 0 AS y_true, 0 AS y_pred, tn AS n FROM cells UNION ALL SELECT 0, 1, fp FROM cells
UNION ALL SELECT 1, 0, fn FROM cells UNION ALL SELECT 1, 1, tp FROM cells""")
def q_confusion_matrix(spark, sf_dir):
    return mt.confusion_matrix(scored(spark, sf_dir))


@register("classification_metrics", oracle=f"""WITH {_SC}
SELECT tn, fp, fn, tp, {_R.format(a='tp + tn', b='tp + tn + fp + fn')} AS accuracy,
       {_R.format(a='tp', b='tp + fp')} AS precision, {_R.format(a='tp', b='tp + fn')} AS recall,
       {_R.format(a='2 * tp', b='2 * tp + fp + fn')} AS f1 FROM cells""")
def q_classification_metrics(spark, sf_dir):
    return rounded(mt.classification_metrics(scored(spark, sf_dir)))


_REP = f"""
, rep AS (SELECT tn, fp, fn, tp, tn + fp AS s0, tp + fn AS s1, tn + fp + fn + tp AS n,
   coalesce(cast(tn AS double) / nullif(tn + fn, 0), 0) AS p0, coalesce(cast(tn AS double) / nullif(tn + fp, 0), 0) AS r0,
   coalesce(cast(2 * tn AS double) / nullif(2 * tn + fn + fp, 0), 0) AS f0,
   coalesce(cast(tp AS double) / nullif(tp + fp, 0), 0) AS p1, coalesce(cast(tp AS double) / nullif(tp + fn, 0), 0) AS r1,
   coalesce(cast(2 * tp AS double) / nullif(2 * tp + fp + fn, 0), 0) AS f1
  FROM cells)"""


@register("classification_report", oracle=f"""WITH {_SC}{_REP}
SELECT 'clean' AS class_name, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1_score, s0 AS support FROM rep
UNION ALL SELECT 'spoofed', round(p1, 6), round(r1, 6), round(f1, 6), s1 FROM rep
UNION ALL SELECT 'accuracy', round(cast(tp + tn AS double) / n, 6), round(cast(tp + tn AS double) / n, 6), round(cast(tp + tn AS double) / n, 6), n FROM rep
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), n FROM rep
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / n, 6), round((r0 * s0 + r1 * s1) / n, 6), round((f0 * s0 + f1 * s1) / n, 6), n FROM rep""")
def q_classification_report(spark, sf_dir):
    return rounded(mt.classification_report(scored(spark, sf_dir)))


_SWEEP_CELLS = "\nUNION ALL\n".join(
    f"""SELECT cast({t} AS double) AS threshold,
       cast(count_if(y_true = 0 AND spoof_probability < {t}) AS bigint) AS tn,
       cast(count_if(y_true = 0 AND spoof_probability >= {t}) AS bigint) AS fp,
       cast(count_if(y_true = 1 AND spoof_probability < {t}) AS bigint) AS fn,
       cast(count_if(y_true = 1 AND spoof_probability >= {t}) AS bigint) AS tp
FROM scores""" for t in mt.SWEEP_THRESHOLDS)


@register("threshold_sweep", oracle=f"""WITH {_SC},
c AS ({_SWEEP_CELLS})
SELECT threshold, {_R.format(a='tp + tn', b='tp + tn + fp + fn')} AS accuracy,
       {_R.format(a='tp', b='tp + fp')} AS attack_precision, {_R.format(a='tp', b='tp + fn')} AS attack_recall,
       {_R.format(a='2 * tp', b='2 * tp + fp + fn')} AS attack_f1,
       fp AS false_alarms, fn AS missed_attacks, tn AS true_negatives, tp AS true_positives
FROM c""")
def q_threshold_sweep(spark, sf_dir):
    return rounded(mt.threshold_sweep(ad.scores(spark, sf_dir)))


@register("roc_auc", oracle=f"""WITH {_SC},
r AS (SELECT y_true, rank() OVER (ORDER BY spoof_probability) AS lo,
             count(*) OVER (PARTITION BY spoof_probability) AS c FROM scores),
s AS (SELECT sum(CASE WHEN y_true = 1 THEN lo + (c - 1) / 2.0 ELSE 0 END) AS rs,
             cast(cast(count_if(y_true = 1) AS bigint) AS double) AS n1, cast(cast(count_if(y_true = 0) AS bigint) AS double) AS n0 FROM r)
SELECT round(CASE WHEN n0 > 0 AND n1 > 0 THEN (rs - n1 * (n1 + 1) / 2) / (n0 * n1) END, 6) AS roc_auc FROM s""")
def q_roc_auc(spark, sf_dir):
    return rounded(mt.roc_auc(ad.scores(spark, sf_dir)))


@register("outcome_classes", oracle=f"""WITH {_SC}
SELECT CASE WHEN y_true = 1 AND y_pred = 1 THEN 'Correctly detected attack'
            WHEN y_true = 1 AND y_pred = 0 THEN 'Missed attack'
            WHEN y_true = 0 AND y_pred = 1 THEN 'False alarm' ELSE 'Correct normal' END AS outcome,
       CASE WHEN y_true = 1 AND y_pred = 1 THEN 'red' WHEN y_true = 1 AND y_pred = 0 THEN 'orange'
            WHEN y_true = 0 AND y_pred = 1 THEN 'purple' ELSE 'green' END AS color,
       count(*) AS n
FROM pred GROUP BY 1, 2""")
def q_outcome_classes(spark, sf_dir):
    return mt.outcome_classes(scored(spark, sf_dir))


@register("probability_histogram", oracle=f"""WITH {_SC}
SELECT y_true, cast(least(floor(spoof_probability * 40), 39) AS integer) AS bin, count(*) AS n,
       round(least(floor(spoof_probability * 40), 39) / 40.0, 6) AS bin_start,
       round((least(floor(spoof_probability * 40), 39) + 1) / 40.0, 6) AS bin_end
FROM scores GROUP BY 1, 2, 4, 5""")
def q_probability_histogram(spark, sf_dir):
    return rounded(mt.probability_histogram(ad.scores(spark, sf_dir)))


@register("accuracy_per_label", oracle=f"""WITH {_SC}
SELECT label, count(*) AS count, cast(count_if(correct) AS bigint) AS correct,
       round(avg(cast(correct AS integer)), 6) AS accuracy,
       round(avg(spoof_probability), 6) AS avg_spoof_probability
FROM pred GROUP BY label""")
def q_accuracy_per_label(spark, sf_dir):
    return rounded(mt.accuracy_by(scored(spark, sf_dir), ["label"]))


@register("accuracy_per_group", oracle=f"""WITH {_SC}
SELECT source_file, tracking_file, count(*) AS count, cast(count_if(correct) AS bigint) AS correct,
       round(avg(cast(correct AS integer)), 6) AS accuracy, arg_min(y_true, seq) AS true_class,
       round(avg(spoof_probability), 6) AS avg_spoof_probability
FROM pred GROUP BY source_file, tracking_file""")
def q_accuracy_per_group(spark, sf_dir):
    return rounded(mt.accuracy_by(scored(spark, sf_dir), ["source_file", "tracking_file"],
                                  first_true_by="seq"))


@register("mixed_groups", oracle=f"""WITH {_SC}
SELECT group_id, arg_min(y_true, seq) AS first, count(DISTINCT y_true) AS nunique, count(*) AS size
FROM scores GROUP BY group_id HAVING count(DISTINCT y_true) > 1""")
def q_mixed_groups(spark, sf_dir):
    return mt.mixed_groups(ad.scores(spark, sf_dir))


@register("confident_mistakes", oracle=f"""WITH {_SC}
SELECT label, source_file, tracking_file, seq, y_true, y_pred, round(spoof_probability, 6) AS spoof_probability,
       round(CASE WHEN y_pred = 1 THEN spoof_probability ELSE 1.0 - spoof_probability END, 6) AS confidence_wrong
FROM pred WHERE NOT correct
ORDER BY CASE WHEN y_pred = 1 THEN spoof_probability ELSE 1.0 - spoof_probability END DESC, seq LIMIT 30""")
def q_confident_mistakes(spark, sf_dir):
    m = mt.confident_mistakes(scored(spark, sf_dir))
    return rounded(m.select("label", "source_file", "tracking_file", "seq", "y_true", "y_pred",
                            "spoof_probability", "confidence_wrong"))


@register("group_key", oracle=f"""WITH {_SC}
SELECT DISTINCT coalesce(source_file, 'nan') || '__' ||
       coalesce(CASE WHEN group_id % 11 = 0 THEN NULL ELSE tracking_file END, 'nan') AS group_key
FROM scores""")
def q_group_key(spark, sf_dir):
    s = ad.scores(spark, sf_dir).withColumn(
        "tracking_file", F.when(F.col("group_id") % 11 == 0, F.lit(None)).otherwise(F.col("tracking_file")))
    return s.select(mt.group_key(["source_file", "tracking_file"]).alias("group_key")).distinct()


# -------------------------------------------------------------- live views
_LIVE = f"""{_STATES},
live AS (
  SELECT icao24, callsign, time, seq,
         cast(seq * 7919 % 1000 AS double) / cast(1000 AS double) AS attack_probability,
         CASE WHEN cast(seq * 7919 % 1000 AS double) / cast(1000 AS double) >= 0.3 THEN 1 ELSE 0 END AS predicted_anomaly
  FROM states
)"""


def live_scores(spark, sf_dir):
    """Stand-in scores for live states (no fitted model in an oracle query):
    probability from the arrival id, flag at the live threshold 0.3."""
    s = states(spark, sf_dir)
    p = (F.col("seq") * 7919 % 1000).cast("double") / F.lit(1000.0)
    return s.select("icao24", "callsign", "time", "seq", p.alias("attack_probability"),
                    F.when(p >= tr.ANOMALY_THRESHOLD, 1).otherwise(0).alias("predicted_anomaly"))


@register("prediction_summary", oracle=f"""WITH {_LIVE}
SELECT count(*) AS total_aircraft, cast(coalesce(sum(predicted_anomaly), 0) AS bigint) AS predicted_anomalies,
       round(coalesce(cast(sum(predicted_anomaly) AS double) / nullif(cast(count(*) AS double), 0), 0), 6) AS anomaly_rate,
       round(coalesce(avg(attack_probability), 0), 6) AS average_attack_probability,
       round(coalesce(max(attack_probability), 0), 6) AS max_attack_probability
FROM live""")
def q_prediction_summary(spark, sf_dir):
    return rounded(mt.prediction_summary(live_scores(spark, sf_dir)))


@register("prediction_distribution", oracle=f"""WITH {_LIVE}
SELECT predicted_anomaly, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM live GROUP BY predicted_anomaly""")
def q_prediction_distribution(spark, sf_dir):
    d = live_scores(spark, sf_dir).groupBy("predicted_anomaly").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()  # over the per-class table (two rows)
    return rounded(d.select("predicted_anomaly", "n", (F.col("n") / F.sum("n").over(every)).alias("share")))


@register("top_predictions", oracle=f"""WITH {_LIVE}
SELECT icao24, callsign, seq, round(attack_probability, 6) AS attack_probability, predicted_anomaly
FROM live ORDER BY attack_probability DESC, icao24 ASC NULLS FIRST, seq LIMIT 20""")
def q_top_predictions(spark, sf_dir):
    t = mt.top_predictions(live_scores(spark, sf_dir), n=20, tie=("icao24", "seq"))
    return rounded(t.select("icao24", "callsign", "seq", "attack_probability", "predicted_anomaly"))


@register("high_risk", oracle=f"""WITH {_LIVE}
SELECT icao24, seq, round(attack_probability, 6) AS attack_probability FROM live WHERE attack_probability > 0.6""")
def q_high_risk(spark, sf_dir):
    return rounded(tr.high_risk(live_scores(spark, sf_dir)).select("icao24", "seq", "attack_probability"))


@register("prediction_status", oracle=f"""WITH {_LIVE}
SELECT seq, CASE WHEN predicted_anomaly = 1 THEN 'Predicted anomaly' ELSE 'Predicted normal' END AS status,
       CASE WHEN predicted_anomaly = 1 THEN 'red' ELSE 'green' END AS border_color,
       CASE WHEN predicted_anomaly = 1 THEN 8 ELSE 6 END AS radius,
       printf('%.3f', attack_probability) AS probability_text
FROM live""")
def q_prediction_status(spark, sf_dir):
    s = live_scores(spark, sf_dir)
    return s.select("seq", *tr.prediction_status(F.col("attack_probability"), F.col("predicted_anomaly")))
