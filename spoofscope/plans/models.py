"""Grouped validation and model queries.

Oracle-checked: group split, stratified group folds and holdout-fold choice
(pure relational work).  Model fits (random forests on all training rows) are
rows-only: no forest is bit-identical to another implementation's.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoofscope.operators import ml
from spoofscope.operators import trajectory as tr
from spoofscope.operators import tracking as trk
from spoofscope.operators.forest import Forest
from spoofscope.plans import signal as sig
from spoofscope.plans import trajectory as trp
from spoofscope.plans.registry import register, rounded
from spoofscope.sources import adapters as ad
from spoofscope.sources import readers as rd

#: Rows that a forest is fitted on; ``None``: all of them.  Only tests set a number (see ``ml.fit_rows``).
FIT_ROWS: int | None = None
#: Rows that Spark ML's learner is given, at most: it holds all nodes on the driver.  More are grown by ``forest.Forest``.
FEW_ROWS = 2_000
#: Tasks that the rows of Spark ML's learner are in, at most.
FIT_TASKS = 8
#: What names a window.
WINDOW_KEY = ["source_file", "tracking_file", "prn", "window_id"]
N_EMB = 64
EMB_FEATURES = [f"e{i}" for i in range(N_EMB)]


def ml_rows(spark, sf_dir) -> DataFrame:
    """Embeddings as model rows: 64 features, y = label >= 5, group = vec_id % 20."""
    e = ad.read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("seq"), (F.col("vec_id") % 20).alias("group_id"),
                    F.when(F.col("label") >= 5, 1).otherwise(0).alias("y"),
                    *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(N_EMB)])


_GROUPS = """
g AS (SELECT DISTINCT vec_id % 20 AS group_id FROM embeddings),
gr AS (SELECT group_id, row_number() OVER (ORDER BY md5(cast(group_id AS varchar) || ':42'), group_id) - 1 AS r,
              count(*) OVER () AS gn FROM g)"""


@register("group_split", oracle=f"""WITH {_GROUPS}
SELECT e.vec_id % 20 AS group_id, gr.r < ceil(0.2 * gr.gn) AS is_test, count(*) AS n_rows
FROM embeddings e JOIN gr ON e.vec_id % 20 = gr.group_id GROUP BY 1, 2""")
def q_group_split(spark, sf_dir):
    s = ml.group_split(ml_rows(spark, sf_dir), "group_id")
    return s.groupBy("group_id", "is_test").agg(F.count(F.lit(1)).alias("n_rows"))


_FOLDS = """
gs AS (SELECT vec_id % 20 AS group_id, count(*) AS size, sum(CASE WHEN label >= 5 THEN 1 ELSE 0 END) AS pos
       FROM embeddings GROUP BY 1),
gc AS (SELECT *, CASE WHEN pos * 2 >= size THEN 1 ELSE 0 END AS cls, count(*) OVER () AS ng FROM gs),
gk AS (SELECT *, least(4, ng) AS kk,
              row_number() OVER (PARTITION BY cls ORDER BY size DESC, md5(cast(group_id AS varchar) || ':42'), group_id) - 1 AS r
       FROM gc),
folds AS (SELECT group_id, cast(CASE WHEN (r // kk) % 2 = 0 THEN r % kk ELSE kk - 1 - r % kk END + 1 AS integer) AS fold,
                 cls, size FROM gk)"""


@register("stratified_group_folds", oracle=f"WITH {_FOLDS}\nSELECT group_id, fold, cls, size FROM folds")
def q_stratified_group_folds(spark, sf_dir):
    return ml.stratified_group_folds(ml_rows(spark, sf_dir), "group_id")


@register("holdout_fold", oracle=f"""WITH {_FOLDS},
rows AS (SELECT e.vec_id % 20 AS group_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y FROM embeddings e),
per AS (SELECT fold, count(*) AS test_rows, count(DISTINCT r.group_id) AS test_groups,
               cast(count_if(y = 0) AS bigint) AS test_clean, cast(count_if(y = 1) AS bigint) AS test_spoofed
        FROM rows r JOIN folds f USING (group_id) GROUP BY fold),
tot AS (SELECT count(*) AS n FROM rows),
ng AS (SELECT count(*) AS g FROM folds)
SELECT fold, n - test_rows AS train_rows, test_rows, g - test_groups AS train_groups, test_groups,
       test_clean, test_spoofed, round(cast(abs(test_rows - 0.25 * n) AS double), 6) AS size_distance
FROM per, tot, ng WHERE test_clean > 0 AND test_spoofed > 0
ORDER BY abs(test_rows - 0.25 * n), fold LIMIT 1""")
def q_holdout_fold(spark, sf_dir):
    rows = ml_rows(spark, sf_dir)
    folds = ml.stratified_group_folds(rows, "group_id")
    summary = ml.fold_table(rows, folds, "group_id")
    return rounded(ml.holdout_fold(summary, rows.count()))


#: Bound of the registered sample, small enough to bite on every table.
SAMPLE_ROWS = 200


@register("fit_sample", oracle=f"""WITH r AS (
  SELECT vec_id AS seq, vec_id % 20 AS group_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, md5(cast(vec_id AS varchar) || ':42') AS h FROM embeddings),
s AS (SELECT y, group_id, count(*) AS n FROM r GROUP BY y, group_id),
per AS (SELECT y, n, count(*) AS m FROM s GROUP BY y, n),
f AS (SELECT y, n, coalesce(sum(n * m) OVER (PARTITION BY y ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
             sum(m) OVER (PARTITION BY y ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM per),
l AS (SELECT y, arg_min(floor((share - below) / rest), n) AS most
      FROM f, (SELECT {SAMPLE_ROWS} // count(DISTINCT y) AS share FROM r) WHERE below + rest * n > share GROUP BY y),
k AS (SELECT *, row_number() OVER (PARTITION BY y, group_id ORDER BY h) AS rk FROM r)
SELECT y, group_id, count(*) AS n_rows, cast(sum(seq) AS bigint) AS seq_sum
FROM k LEFT JOIN l USING (y) WHERE rk <= most OR most IS NULL GROUP BY y, group_id""")
def q_fit_sample(spark, sf_dir):
    """Rows of every class and group within a bound; the models themselves are fitted on all rows."""
    rows = ml.fit_rows(ml_rows(spark, sf_dir), "group_id", SAMPLE_ROWS, key=["seq"])
    return rows.groupBy("y", "group_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("seq").alias("seq_sum"))


# -------------------------------------------------------- model fits (R)
_FITTED: dict = {}


def once(name: str, spark, sf_dir: str, source: str, make):
    """One fit serves every query of an application that reports on it, for
    as long as the files of its ``source`` table are the same; its scored
    rows are in the checkpoint folder."""
    key = (spark.sparkContext.applicationId, name, rd.file_versions(spark, f"{sf_dir.rstrip('/')}/{source}.parquet"))
    if key not in _FITTED:
        _FITTED[key] = make()
    return _FITTED[key]


def fitted(train: DataFrame, group: str, features, label: str = "y", impute: bool = False, key=None):
    """The forest (300 trees of depth 30) on all training rows that have a
    class, class-balanced by their weights.

    Few rows are taken out of the table once and held by ``FIT_TASKS`` tasks
    at most: Spark ML's learner reads them many times, and every task of it
    sends the counts of all nodes that a step splits, even for no row at all.
    """
    train = train.filter(F.col(label).isNotNull())
    if FIT_ROWS is not None:
        train = ml.fit_rows(train, group, FIT_ROWS, label, key)
    rows = train.select(label, *features).checkpoint(eager=True)
    if rows.count() > FEW_ROWS:
        return Forest(rows, features, label, impute, ml.N_TREES, ml.MAX_DEPTH, ml.SEED)
    return ml.forest_pipeline(features, label, impute=impute).fit(ml.class_balanced_weights(rows.coalesce(FIT_TASKS), label))


#: Folds that are fitted at the same time.
FITS_AT_ONCE = 4


def cross_validate(rows: DataFrame, group: str, features, label: str = "y", impute: bool = False,
                   threshold: float = 0.5, key=None):
    """Fit and score one forest per fold, several folds at a time; returns
    (cv table, folds)."""
    # k fits reuse the rows: materialise them once (reliable checkpoint, so
    # a lost executor does not force recomputing the feature pipeline)
    rows = rows.checkpoint(eager=True)
    folds = ml.stratified_group_folds(rows, group, label)
    summary = ml.fold_table(rows, folds, group, label)
    j = rows.join(folds.select(group, "fold"), group)

    def one(f: int):
        model = fitted(j.filter(F.col("fold") != f), group, features, label, impute, key)
        scored = ml.score(model, j.filter(F.col("fold") == f), threshold).select(label, "spoof_probability", "y_pred")
        r = ml.evaluate(scored.checkpoint(eager=True), label).first()  # scored once; a row of metrics
        return f, r["accuracy"], r["f1"], r["roc_auc"]

    k = folds.agg(F.max("fold")).first()[0] or 0
    spark = rows.sparkSession
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        runs = [pool.submit(inheritable_thread_target(spark)(one), f) for f in range(1, k + 1)]
        found = [r.result() for r in runs]
    return summary.join(spark.createDataFrame(found, "fold int, accuracy double, f1 double, roc_auc double"), "fold"), folds


@register("fold_table", oracle=f"""WITH {_FOLDS},
rows AS (SELECT e.vec_id % 20 AS group_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y FROM embeddings e)
SELECT fold, (SELECT count(*) FROM rows) - count(*) AS train_rows, count(*) AS test_rows,
       (SELECT count(*) FROM folds) - count(DISTINCT r.group_id) AS train_groups, count(DISTINCT r.group_id) AS test_groups,
       cast(count_if(y = 0) AS bigint) AS test_clean, cast(count_if(y = 1) AS bigint) AS test_spoofed
FROM rows r JOIN folds f USING (group_id) GROUP BY fold""")
def q_fold_table(spark, sf_dir):
    """What the cross validation is made of: sizes, groups and classes of every fold."""
    rows = ml_rows(spark, sf_dir)
    return ml.fold_table(rows, ml.stratified_group_folds(rows, "group_id"), "group_id")


def embedding_cv(spark, sf_dir) -> DataFrame:
    return once("cv", spark, sf_dir, "embeddings",
                lambda: cross_validate(ml_rows(spark, sf_dir), "group_id", EMB_FEATURES, key=["seq"])[0].checkpoint(eager=True))


@register("cv_results")
def q_cv_results(spark, sf_dir):
    return rounded(embedding_cv(spark, sf_dir).orderBy("fold"))


@register("cv_summary")
def q_cv_summary(spark, sf_dir):
    return rounded(embedding_cv(spark, sf_dir).agg(F.avg("accuracy").alias("accuracy"), F.avg("f1").alias("f1"),
                          F.avg("roc_auc").alias("roc_auc")))


def signal_rows(spark, sf_dir) -> DataFrame:
    f = sig.features(spark, sf_dir)
    return f.withColumn("group_id", F.concat(F.col("source_file"), F.lit("__"), F.col("tracking_file"))) \
            .withColumn("y", F.col("is_spoofed"))


def holdout_split(rows: DataFrame, group: str, label: str = "y") -> tuple[DataFrame, DataFrame]:
    """(train, test): the fold nearest 25 % of the rows with both classes is the test set; without one, an error.
    ``rows`` are read several times, so what they are made from should be stored."""
    folds = ml.stratified_group_folds(rows, group, label)
    pick = ml.holdout_fold(ml.fold_table(rows, folds, group, label), rows.count()).first()
    if pick is None:
        raise ValueError("no fold holds both classes")
    j = rows.join(folds.select(group, "fold"), group)
    return j.filter(F.col("fold") != pick["fold"]), j.filter(F.col("fold") == pick["fold"])


def holdout_model(rows: DataFrame, group: str, features, label: str = "y", impute: bool = False,
                  threshold: float = 0.5, key=None):
    """Model, training rows and the scored test rows, written once: metrics and reports read the same scores."""
    train, test = holdout_split(rows, group, label)
    model = fitted(train, group, features, label, impute, key)
    return model, train, ml.score(model, test, threshold).checkpoint(eager=True)


def summary_record(name: str, threshold: float, train: DataFrame, scored: DataFrame, label: str = "y",
                   with_auc: bool = True, task: str = "binary classification",
                   validation: str = "grouped holdout", normal: str = "normal", attack: str = "attack") -> DataFrame:
    """One row with the fields of a published model summary."""
    ev = ml.evaluate(scored, label)
    cols = [F.lit(name).alias("model_name"), F.lit("RandomForest").alias("model_type"), F.lit(task).alias("task"),
            F.lit(validation).alias("validation_method"), F.lit(float(threshold)).alias("selected_threshold"), "accuracy",
            F.col("precision").alias("attack_precision"), F.col("recall").alias("attack_recall"),
            F.col("f1").alias("attack_f1")]
    if with_auc:
        cols.append("roc_auc")
    cnt = scored.agg(F.count(F.lit(1)).alias("test_rows"),
                     F.count_if(F.col(label) == 0).alias(f"test_{normal}"),
                     F.count_if(F.col(label) == 1).alias(f"test_{attack}"))
    tr_n = train.agg(F.count(F.lit(1)).alias("train_rows"))
    one = F.lit(1).alias("_one")
    return (ev.select(*cols, one).join(tr_n.select("*", one), "_one")
              .join(cnt.select("*", one), "_one").drop("_one")  # all one-row frames
              .withColumn("description", F.lit(f"{name}: random forest, {validation}, threshold {threshold}")))


def signal_holdout(spark, sf_dir):
    def make():
        rows = signal_rows(spark, sf_dir).checkpoint(eager=True)  # the windows are built once
        feats = ml.usable_features(rows, trk.FEATURE_COLUMNS)
        return (*holdout_model(rows, "group_id", feats, impute=True, threshold=0.5, key=WINDOW_KEY), feats)
    return once("signal", spark, sf_dir, "lineitem", make)


@register("train_signal")
def q_train_signal(spark, sf_dir):
    _, train, scored, _ = signal_holdout(spark, sf_dir)
    return rounded(summary_record("signal", 0.5, train, scored, normal="clear_sky", attack="spoofed"))


@register("holdout_eval")
def q_holdout_eval(spark, sf_dir):
    """Everything said about one fitted model, from the same scored rows:
    metrics, confusion matrix, accuracy per label and per group, and the most
    confident mistakes, in long form (part, name, metric, value)."""
    _, _, scored, _ = signal_holdout(spark, sf_dir)
    return rounded(evaluation_long(scored))


def evaluation_long(scored: DataFrame, label: str = "y", prob: str = "spoof_probability") -> DataFrame:
    s = scored.withColumn("correct", (F.col(label) == F.col("y_pred")).cast("int"))
    ev = ml.evaluate(s, label)
    metrics = ev.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in ev.columns])).alias("x"))
    parts = [metrics.select(F.lit("metrics").alias("part"), F.lit("all").alias("name"), "x.metric", "x.value")]
    cells = s.groupBy(label, "y_pred").agg(F.count(F.lit(1)).cast("double").alias("value"))
    parts.append(cells.select(F.lit("confusion"), F.concat(F.lit("true_"), F.col(label)), F.concat(F.lit("predicted_"), F.col("y_pred")), "value"))
    for part, by in (("label", "label"), ("group", "group_id")):
        g = s.groupBy(F.col(by).alias("name")).agg(F.avg("correct").alias("accuracy"), F.count(F.lit(1)).cast("double").alias("rows"))
        parts.append(g.select(F.lit(part), "name", F.explode(F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).alias("v")) for c in ("accuracy", "rows")])).alias("x"))
                     .select("*", "x.m", "x.v").drop("x"))
    sure = F.greatest(F.col(prob), 1 - F.col(prob))
    worst = s.filter("correct = 0").orderBy(sure.desc(), "source_file", "tracking_file", "prn", "window_id").limit(20)
    parts.append(worst.select(F.lit("mistake"), F.concat_ws("/", "source_file", "tracking_file", "prn", "window_id"), F.concat(F.lit("true_"), F.col(label)), prob))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def trajectory_rows(spark, sf_dir) -> DataFrame:
    """All rows; those without an aircraft id are one group."""
    f = tr.binary_label(trp.features(spark, sf_dir))
    return f.withColumn("y", F.col("binary_label")).withColumn("group_id", F.coalesce("icao24", F.lit("")))


def trajectory_holdout(spark, sf_dir):
    def make():
        split = ml.group_split(trajectory_rows(spark, sf_dir), "group_id").checkpoint(eager=True)
        train, test = split.filter(~F.col("is_test")), split.filter(F.col("is_test"))
        model = fitted(train, "group_id", tr.MODEL_FEATURES, key=["seq"])
        return model, train, ml.score(model, test, tr.ANOMALY_THRESHOLD).checkpoint(eager=True)
    return once("trajectory", spark, sf_dir, "events", make)


@register("train_trajectory")
def q_train_trajectory(spark, sf_dir):
    _, train, scored = trajectory_holdout(spark, sf_dir)
    return rounded(summary_record("trajectory", tr.ANOMALY_THRESHOLD, train, scored, with_auc=False, validation="grouped split"))


@register("score")
def q_score(spark, sf_dir):
    _, _, scored, _ = signal_holdout(spark, sf_dir)
    s = scored.withColumn("correct", F.col("y") == F.col("y_pred"))
    return rounded(s.select("label", "source_file", "tracking_file", "prn", "window_id", "window_start_row",
                            "window_end_row", F.col("y").alias("y_true"), "y_pred", "spoof_probability",
                            "correct"))


# Short explanations shown next to the most important features.
FEATURE_DESCRIPTIONS = {
    "cn0_original_mean": "Mean carrier-to-noise density reported by the receiver.",
    "cn0_est_prompt": "C/N0 estimated from prompt correlator power moments.",
    "doppler_std": "Spread of carrier Doppler inside the window.",
    "doppler_range": "Range of carrier Doppler inside the window.",
    "pll_lock_ratio": "Share of epochs with the carrier loop locked.",
    "carrier_error_abs_mean": "Mean absolute carrier tracking error.",
    "code_error_abs_mean": "Mean absolute code tracking error.",
    "early_late_asymmetry_mean": "Mean early/late correlator asymmetry.",
    "early_late_asymmetry_p95": "95th percentile of early/late asymmetry.",
    "prompt_dominance_mean": "Mean prompt-to-early/late power ratio.",
    "position_change": "Planar position jump between consecutive reports.",
    "velocity_change_rate": "Speed change per second.",
    "altitude_diff": "Geometric minus barometric altitude.",
    "contact_delay": "Seconds between the last position and the last contact.",
    "velocity": "Reported ground speed.",
    "heading": "Reported track angle.",
    "heading_change_rate": "Turn per second.",
    "altitude_change_rate": "Geometric altitude change per second.",
    **{f"delta_{c}": f"Change of {c} since the aircraft's report before." for c in tr.DELTA_COLUMNS},
    **{f"prompt_abs_{k}": f"{v} of the prompt correlator's magnitude inside the window."
       for k, v in {"mean": "Mean", "std": "Spread", "median": "Median", "min": "Smallest value", "max": "Largest value"}.items()},
}
DEFAULT_DESCRIPTION = "Feature used by the model to score the anomaly probability."


def describe_features(importance: DataFrame, top: int = 10) -> DataFrame:
    """Top features by importance, left-joined to the description dictionary
    (a fixed, small table: broadcast)."""
    spark = importance.sparkSession
    d = spark.createDataFrame(list(FEATURE_DESCRIPTIONS.items()), "feature string, description string")
    t = importance.orderBy(F.col("importance").desc(), "feature").limit(top)
    return (t.join(F.broadcast(d), "feature", "left")
             .withColumn("description", F.coalesce("description", F.lit(DEFAULT_DESCRIPTION))))


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    model, _, _, feats = signal_holdout(spark, sf_dir)
    return rounded(describe_features(ml.feature_importance(model, feats, spark), 20))


def _description_sql() -> str:
    """Features of both models by their number of values, and their descriptions."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    d = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in FEATURE_DESCRIPTIONS.items())
    counts = lambda name, table, cols: " UNION ALL ".join(
        f"SELECT '{name}' AS model_name, '{c}' AS feature, count({c}) AS n_values FROM {table}" for c in cols)
    inputs = " UNION ALL ".join(f"SELECT 'trajectory' AS model_name, '{c}' AS feature, count(*) AS n_values FROM adsb_raw" for c in tr.MODEL_FEATURES)
    return (sig._FEATURES_CTE + f", {ad.cte('adsb_raw', ad.ADSB_RAW)}, d(feature, description) AS (VALUES {d}), n AS ("
            + counts("signal", "features", trk.FEATURE_COLUMNS) + f" UNION ALL {inputs}"
            + f") SELECT model_name, n.feature, n_values, coalesce(description, {quoted(DEFAULT_DESCRIPTION)}) AS description FROM n LEFT JOIN d USING (feature)")


@register("feature_descriptions", oracle=_description_sql())
def q_feature_descriptions(spark, sf_dir):
    """Every feature of both models, how many windows or reports have it (the
    trajectory model's inputs are filled, so all have), and its description."""
    def counted(name: str, df: DataFrame, cols) -> DataFrame:
        one = df.agg(*[F.count(c).alias(c) for c in cols])
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_values")) for c in cols])
        return one.select(F.explode(pairs).alias("x")).select(F.lit(name).alias("model_name"), "x.feature", "x.n_values")

    n = counted("signal", sig.features(spark, sf_dir), trk.FEATURE_COLUMNS).union(
        counted("trajectory", tr.model_input(trp.features(spark, sf_dir)), tr.MODEL_FEATURES))
    d = spark.createDataFrame(list(FEATURE_DESCRIPTIONS.items()), "feature string, description string")
    return (n.join(F.broadcast(d), "feature", "left")  # a fixed, small table
            .select("model_name", "feature", "n_values", F.coalesce("description", F.lit(DEFAULT_DESCRIPTION)).alias("description")))


@register("model_summary")
def q_model_summary(spark, sf_dir):
    """The published record of both models, side by side."""
    a = q_train_trajectory(spark, sf_dir)
    b = q_train_signal(spark, sf_dir)
    return a.unionByName(b, allowMissingColumns=True)


@register("model_overview")
def q_model_overview(spark, sf_dir):
    """The comparison of both models: names, thresholds and headline metrics."""
    return q_model_summary(spark, sf_dir).select("model_name", "model_type", "selected_threshold", "validation_method", "accuracy",
                                                 "attack_precision", "attack_recall", "attack_f1", "roc_auc", "train_rows", "test_rows")
