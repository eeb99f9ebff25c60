"""Grouped validation and random-forest models with Spark ML.

Splits never break a group (an aircraft, a receiver file/channel) across
train and test.  Group assignment is computed on the (small) per-group table
and joined back; few rows are fitted by Spark ML's tree learner, more by
``forest.Forest``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoofscope.operators import metrics as mt
from spoofscope.operators.forest import Forest
from spoofscope.operators.ordered import ordered_index

# The forest configuration and validation scheme.
N_TREES = 300
SEED = 42
MAX_DEPTH = 30          # Spark's upper bound (the reference grows trees without limit)
TEST_SHARE = 0.2
N_FOLDS = 4
HOLDOUT_SHARE = 0.25


def group_order_key(group: str, seed: int = SEED):
    """Deterministic pseudo-random order of groups: md5 of 'group:seed'."""
    return F.md5(F.concat(F.col(group).cast("string"), F.lit(f":{seed}")))


def group_split(df: DataFrame, group: str, test_share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Adds ``is_test``: the first ceil(test_share * G) groups in md5 order go
    to test, whole groups only."""
    groups = df.select(group).distinct().withColumn("_h", group_order_key(group, seed))
    ranked = ordered_index(groups, [], ["_h", group], "_r", chunk=F.substring("_h", 1, 3), count_col="_g")
    flags = ranked.select(group, (F.col("_r") < F.ceil(F.lit(test_share) * F.col("_g"))).alias("is_test"))
    return df.join(flags, group)


def class_balanced_weights(df: DataFrame, label: str = "y", out: str = "weight") -> DataFrame:
    """Row weight n / (k * n_class) (scikit-learn's 'balanced')."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    every = Window.partitionBy()  # over the per-class table: one row per class
    w = c.select(label, (F.sum("_nc").over(every) / (F.count(F.lit(1)).over(every) * F.col("_nc"))).alias(out))
    return df.join(F.broadcast(w), label)  # one row per class


def stratified_group_folds(df: DataFrame, group: str, label: str = "y", k: int = N_FOLDS,
                           seed: int = SEED) -> DataFrame:
    """Per group: its majority class and size; groups of each class are dealt
    to folds 1..k in a snake order by size (desc) then md5, so folds get
    similar class mixes and sizes.  Returns (group, fold)."""
    g = (df.groupBy(group).agg(F.count(F.lit(1)).alias("size"),
                                F.sum(F.col(label).cast("long")).alias("_pos"))
           .withColumn("cls", F.when(F.col("_pos") * 2 >= F.col("size"), 1).otherwise(0))
           .withColumn("_h", group_order_key(group, seed)))
    # as many folds as groups at most
    g = ordered_index(g, [], ["_h", group], "_x", chunk=F.substring("_h", 1, 3), count_col="_groups").drop("_x")
    r = ordered_index(g, ["cls"], [F.col("size").desc(), F.col("_h"), F.col(group)], "_r",
                      chunk=F.struct(-F.col("size"), F.substring("_h", 1, 2)))
    kk = F.least(F.col("_groups"), F.lit(k))
    cyc, idx = F.floor(F.col("_r") / kk), F.col("_r") % kk
    fold = F.when(cyc % 2 == 0, idx).otherwise(kk - 1 - idx) + 1
    return r.select(group, fold.cast("int").alias("fold"), "cls", "size")


def fold_table(df: DataFrame, folds: DataFrame, group: str, label: str = "y") -> DataFrame:
    """Per fold: test/train rows and groups and test class counts."""
    j = df.join(folds.select(group, "fold"), group)
    n = df.count()
    g_total = folds.count()
    per = j.groupBy("fold").agg(F.count(F.lit(1)).alias("test_rows"),
                                F.countDistinct(group).alias("test_groups"),
                                F.count_if(F.col(label) == 0).alias("test_clean"),
                                F.count_if(F.col(label) == 1).alias("test_spoofed"))
    return per.select("fold", (F.lit(n) - F.col("test_rows")).alias("train_rows"), "test_rows",
                      (F.lit(g_total) - F.col("test_groups")).alias("train_groups"), "test_groups",
                      "test_clean", "test_spoofed")


def holdout_fold(folds_summary: DataFrame, total_rows: int, share: float = HOLDOUT_SHARE) -> DataFrame:
    """The fold with both classes whose size is nearest ``share`` of the rows
    (ties -> lowest fold)."""
    ok = folds_summary.filter((F.col("test_clean") > 0) & (F.col("test_spoofed") > 0))
    dist = F.abs(F.col("test_rows") - F.lit(share * total_rows))
    return ok.withColumn("size_distance", dist).orderBy("size_distance", "fold").limit(1)


def forest_pipeline(features: Sequence[str], label: str = "y", weight: str | None = "weight",
                    impute: bool = False, n_trees: int = N_TREES, max_depth: int = MAX_DEPTH,
                    seed: int = SEED) -> Pipeline:
    """[median Imputer] -> VectorAssembler -> RandomForestClassifier."""
    stages = []
    cols = list(features)
    if impute:
        out = [f"{c}__imp" for c in cols]
        stages.append(Imputer(inputCols=cols, outputCols=out, strategy="median", relativeError=1e-4))
        cols = out
    stages.append(VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep"))
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=n_trees,
                                maxDepth=max_depth, featureSubsetStrategy="sqrt", seed=seed,
                                subsamplingRate=1.0, bootstrap=True,
                                maxMemoryInMB=1024)  # deep trees: more nodes are split in one pass
    if weight:
        rf = rf.setWeightCol(weight)
    stages.append(rf)
    return Pipeline(stages=stages)


def fit_rows(train: DataFrame, group: str, most: int, label: str = "y", key: Sequence[str] | None = None, seed: int = SEED) -> DataFrame:
    """At most ``most`` rows to fit on, from every class and, as far as the
    bound allows, every group.

    Each class gets the same share of ``most``; within a class every group
    gives its first rows by a hash of ``key`` (all columns, unless given), up
    to the highest number per group that keeps the class within its share.
    With more groups than rows in the share, that many groups give a row
    each.  A row that repeats with its key counts once, one
    without a class not at all.  The model queries fit on all rows, not on these.

    Only hashes are shuffled, ``most`` per group and task at most; the hashes
    that stay (``most`` of them) are broadcast to the rows.
    """
    cols = list(key or train.columns)
    mark = F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols], F.lit(str(seed))))
    rows = train.select(F.col(label).alias("_y"), F.col(group).alias("_g"), mark.alias("_h")).filter(F.col("_y").isNotNull()).distinct()
    sizes = rows.groupBy("_y", "_g").agg(F.count(F.lit(1)).alias("_n"))
    by_size = sizes.groupBy("_y", "_n").agg(F.count(F.lit(1)).alias("_m"))  # a row per class and distinct size
    rising = Window.partitionBy("_y").orderBy("_n")
    filled = by_size.select("_y", "_n", F.coalesce(F.sum(F.col("_n") * F.col("_m")).over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_below"),
                            F.sum("_m").over(rising.rowsBetween(0, Window.unboundedFollowing)).alias("_rest"))
    classes = sizes.select("_y").distinct()
    classes = classes.withColumn("_share", F.floor(F.lit(most) / F.count(F.lit(1)).over(Window.partitionBy())))  # over a row per class
    over = (filled.join(F.broadcast(classes), "_y").filter(F.col("_below") + F.col("_rest") * F.col("_n") > F.col("_share"))
            .groupBy("_y").agg(F.min_by(F.floor((F.col("_share") - F.col("_below")) / F.col("_rest")), "_n").alias("_level"), F.first("_share").alias("_share")))
    first = Window.partitionBy("_y", "_g").orderBy("_h")
    ranked = rows.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= most)
    picked = ranked.join(F.broadcast(over), "_y", "left")  # a row per class
    some = picked.filter((F.col("_level") > 0) & (F.col("_r") <= F.col("_level")) | F.col("_level").isNull()).select("_h")
    lone = (picked.filter((F.col("_level") == 0) & (F.col("_r") == 1))
            .withColumn("_k", F.row_number().over(Window.partitionBy("_y").orderBy("_h"))).filter((F.col("_k") <= most) & (F.col("_k") <= F.col("_share"))).select("_h"))
    return train.withColumn("_h", mark).join(F.broadcast(some.union(lone)), "_h", "left_semi").drop("_h")  # ``most`` hashes


def usable_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Features present with at least one non-NULL value (an all-NULL column
    cannot be imputed and is dropped)."""
    present = [c for c in features if c in df.columns]
    if not present:
        return []
    counts = df.agg(*[F.count(c).alias(c) for c in present]).first().asDict()
    return [c for c in present if counts[c] > 0]


def score(model: PipelineModel | Forest, df: DataFrame, threshold: float = 0.5,
          prob_col: str = "spoof_probability") -> DataFrame:
    """Probability of class 1 and ``y_pred = p >= threshold``.  A model that
    never saw class 1 gives 0."""
    if isinstance(model, Forest):
        s = model.probabilities(df, prob_col)
    else:
        s = model.transform(df).withColumn(prob_col, F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0)))
    return s.withColumn("y_pred", F.when(F.col(prob_col) >= threshold, 1).otherwise(0)) \
            .drop("features", "rawPrediction", "probability", "prediction")


def feature_importance(model: PipelineModel | Forest, features: Sequence[str], spark) -> DataFrame:
    imp = model.importances() if isinstance(model, Forest) else model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, [float(x) for x in imp])),
                                 "feature string, importance double")


def evaluate(scored: DataFrame, label: str = "y", prob: str = "spoof_probability") -> DataFrame:
    """One row: tn, fp, fn, tp, accuracy, precision, recall, f1, roc_auc."""
    s = scored.withColumnRenamed(label, "y_true") if label != "y_true" else scored
    m = mt.classification_metrics(s).withColumn("_one", F.lit(1))
    auc = mt.roc_auc(s.select("y_true", prob), prob=prob).withColumn("_one", F.lit(1))
    return m.join(auc, "_one").drop("_one")  # two one-row results


def feature_availability(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """(available, missing) feature names against the table's schema
    (metadata only)."""
    present = set(df.columns)
    return [f for f in features if f in present], [f for f in features if f not in present]


def fit_all(rows: DataFrame, features: Sequence[str], label: str = "y", impute: bool = False,
            path: str | None = None, **kw) -> PipelineModel:
    """Refit on every row (class-balanced weights) and optionally save with
    Spark ML persistence; the feature list travels inside the assembler."""
    rows = class_balanced_weights(rows, label)
    model = forest_pipeline(features, label, impute=impute, **kw).fit(rows)
    if path:
        model.write().overwrite().save(path)
    return model
