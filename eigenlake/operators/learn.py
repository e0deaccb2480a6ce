"""Cross-validated classifiers, and comparisons of feature sets by them."""

from __future__ import annotations

import functools

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cohort, inference
from .order import midranks


def _model(kind: str, seed: int):
    if kind == "logistic":
        return LogisticRegression(featuresCol="x", labelCol="y", regParam=1e-4, maxIter=25)
    if kind == "svm":
        return LinearSVC(featuresCol="x", labelCol="y", regParam=1e-4, maxIter=25)
    if kind == "forest":
        return RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=100, seed=seed)
    raise ValueError(f"unknown model {kind}")


def _rows(features: DataFrame, folds: int, seed: int) -> DataFrame:
    fold = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(folds)).cast("int")
    return features.select("id", F.col("label").cast("double").alias("y"), array_to_vector(F.col("f").cast("array<double>")).alias("raw"), fold.alias("fold")).where("y is not null and raw is not null")


def _fitted(rows: DataFrame, kind: str, seed: int):
    return Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True), _model(kind, seed)]).fit(rows)


def out_of_fold(features: DataFrame, model: str = "logistic", folds: int = 5, seed: int = 42) -> DataFrame:
    """(id, fold, y, score, predicted) of features (id, label 0/1, f array): each row is scored by the model fitted on the other folds.

    Folds go by the id's hash; models are logistic, svm and forest, on
    standardised features.  Rows with a null label or features are left out;
    the folds to train on need both labels.
    """
    rows, parts = _rows(features, folds, seed), []
    for i in range(folds):
        out = _fitted(rows.where(F.col("fold") != i), model, seed).transform(rows.where(F.col("fold") == i))
        score = vector_to_array("rawPrediction")[1]
        parts.append(out.select("id", "fold", "y", score.alias("score"), F.col("prediction").alias("predicted")))
    return functools.reduce(DataFrame.unionByName, parts)


def _per_fold(scored: DataFrame) -> DataFrame:
    """(fold, accuracy, auc): balanced accuracy and area under the curve; null for a fold with one label."""
    right = lambda y: F.avg(F.when(F.col("y") == y, (F.col("predicted") == y).cast("double")))
    m, n = F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)
    auc = (F.sum(F.when(F.col("y") == 1, F.col("r"))) - m * (m + 1) / 2) / F.nullif((m * n).cast("double"), F.lit(0.0))
    return midranks(scored, "score", "r", "fold").groupBy("fold").agg(((right(1) + right(0)) / 2).alias("accuracy"), auc.alias("auc"))


def classify(features: DataFrame, model: str = "svm", folds: int = 5, seed: int = 42) -> DataFrame:
    """(accuracy, accuracy_std, auc, auc_std): means and population deviations over the folds of balanced accuracy and area under the curve."""
    per = _per_fold(out_of_fold(features, model, folds, seed))
    return per.agg(F.avg("accuracy").alias("accuracy"), F.stddev_pop("accuracy").alias("accuracy_std"), F.avg("auc").alias("auc"), F.stddev_pop("auc").alias("auc_std"))


def importance(features: DataFrame, model: str = "svm", seed: int = 42) -> DataFrame:
    """(feature, importance) of the model fitted on all rows: absolute coefficients, or the forest's share of impurity."""
    fitted = _fitted(_rows(features, 1, seed), model, seed).stages[-1]
    values = fitted.featureImportances.toArray() if model == "forest" else abs(fitted.coefficients.toArray())
    return features.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "feature int, importance double")


def compare_methods(new: DataFrame, reference: DataFrame, folds: int = 10, margin: float = 0.05, seed: int = 42) -> DataFrame:
    """One row: DeLong's comparison of out-of-fold logistic scores of two feature sets (id, label, f) of the same rows, non-inferiority and equivalence of the folds' areas, and their effect size."""
    a, b = (out_of_fold(f, "logistic", folds, seed) for f in (new, reference))
    both = a.select("id", "y", F.col("score").alias("s_a")).join(b.select("id", F.col("score").alias("s_b")), "id")
    metrics = _per_fold(a).select("fold", F.col("auc").alias("new")).join(_per_fold(b).select("fold", F.col("auc").alias("ref")), "fold").dropna()
    metrics = metrics.select("new", "ref")
    effect = metrics.agg((F.avg(F.col("new") - F.col("ref")) / F.nullif(F.stddev_samp(F.col("new") - F.col("ref")), F.lit(0.0))).alias("effect"))
    one = lambda df, mark: df.toDF(*(f"{mark}_{c}" for c in df.columns))
    parts = [one(cohort.delong(both.select(F.col("y").cast("int").alias("y"), "s_a", "s_b")), "delong"), one(inference.non_inferiority(metrics, margin), "ni"), one(inference.equivalence_tost(metrics, margin), "tost"), effect]
    return functools.reduce(DataFrame.crossJoin, parts)  # of one row each


def rank_descriptors(descriptors: DataFrame, labels: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """(descriptor, auc, accuracy, effect, score) of descriptors (subject, descriptor, vid, value) for labels (subject, label 0/1).

    Features are a subject's mean and deviation; the score is half the area
    under the curve, three tenths of the balanced accuracy and a fifth of
    Cohen's d of the means, up to 2, over 2.
    """
    f = descriptors.groupBy("subject", "descriptor").agg(F.avg("value").alias("m"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("s")).join(labels, "subject")
    parts = []
    for name in [r.descriptor for r in f.select("descriptor").distinct().orderBy("descriptor").collect()]:  # names, not rows
        own = f.where(F.col("descriptor") == name)
        result = classify(own.select(F.col("subject").alias("id"), "label", F.array("m", "s").alias("f")), "logistic", folds, seed)
        d = cohort.ttest(own.select("subject", F.col("label").cast("string").alias("grp"), F.lit(0).alias("vid"), F.col("m").alias("value")), "1", "0").select(F.abs("cohens_d").alias("effect"))
        parts.append(result.crossJoin(d).select(F.lit(name).alias("descriptor"), "auc", "accuracy", "effect"))  # one row each
    out = functools.reduce(DataFrame.unionByName, parts)
    return out.withColumn("score", 0.5 * F.col("auc") + 0.3 * F.col("accuracy") + 0.2 * F.least(F.col("effect") / 2, F.lit(1.0)))
