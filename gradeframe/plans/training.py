"""Class-weighted multiclass training, out-of-fold scoring and prediction output."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeframe.functions.encode import blend, first_argmax, label_of
from gradeframe.operators.joins import align_predictions, lookup_join, stack_rows
from gradeframe.operators.metrics import class_weights, macro_f1
from gradeframe.operators.sampling import stratified_folds
from gradeframe.parallel import run_together
from gradeframe.plans import stopping
from gradeframe.session import settle
from gradeframe.sources.store import reuse_or_fit, reuse_or_write

MISSING_FEATURE = -999.0
#: Folds that are fitted at the same time.
FOLDS_AT_ONCE = 3


@dataclass(frozen=True)
class ForestParams:
    """Forest settings.

    ``tree_grid`` is tried in order until the score stops rising. With
    ``stop_after`` only its last size is grown, once, and cut back to the prefix
    of least validation log-loss, looked for until so many trees bring no gain.
    """

    tree_grid: tuple[int, ...] = (20, 40, 80)
    depth: int = 10
    row_share: float = 0.8
    column_share: str = "0.8"
    min_rows: int = 30
    bins: int = 64
    seed: int = 42
    patience: int = 1
    stop_after: int | None = None

    def forest(self, trees: int) -> RandomForestClassifier:
        return RandomForestClassifier(
            labelCol="label", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=self.depth,
            subsamplingRate=self.row_share, featureSubsetStrategy=self.column_share, minInstancesPerNode=self.min_rows,
            maxBins=self.bins, seed=self.seed,
        )


@dataclass(frozen=True)
class CrossValidation:
    predictions: DataFrame
    folds: DataFrame
    refit_trees: int
    models: list = field(default_factory=list)


def feature_matrix(df: DataFrame, features: Sequence[str], keep: Sequence[str], missing: float = MISSING_FEATURE) -> DataFrame:
    """Dense ``features`` vector with missing values as a constant, beside the kept columns."""
    names = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(missing))) for c in features}
    plain = df.select(*keep, *[v.alias(f"f_{c}") for c, v in names.items()])
    assembler = VectorAssembler(inputCols=[f"f_{c}" for c in features], outputCol="features")
    return assembler.transform(plain).select(*keep, "features")


def with_classes(df: DataFrame, label: str, classes: Sequence[str]) -> DataFrame:
    """Attach the class list to the label, so every model knows all classes."""
    attributes = {"ml_attr": {"type": "nominal", "name": "label", "vals": list(classes)}}
    return df.withColumn("label", F.col(label).cast("double").alias("label", metadata=attributes))


def weighted(df: DataFrame, label: str) -> DataFrame:
    """Balanced row weights. The weight table has one row per class."""
    weights = class_weights(df, label).select(label, "weight")
    return lookup_join(df, weights, [label], "left")


def score(model, df: DataFrame, keep: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """Class probabilities, the first most likely index and its class name."""
    out = model.transform(df).select(*keep, vector_to_array("probability").alias("probability"))
    index = first_argmax(F.col("probability"))
    return out.withColumn("predicted", index).withColumn("predicted_class", label_of(index, classes))


def _score_of(df: DataFrame) -> float:
    return macro_f1(df, "label", "predicted").first()["macro_f1"]


def choose_trees(train: DataFrame, valid: DataFrame, params: ForestParams, keep: Sequence[str], classes: Sequence[str]):
    """Grow the forest size while the validation macro-F1 rises; return the best fit.

    With ``stop_after``, the prefix of one forest with the least validation log-loss.
    """
    if params.stop_after is not None:
        model = params.forest(params.tree_grid[-1]).fit(train)
        curve = stopping.loss_curve(model, valid)
        trees, _ = stopping.best_prefix(curve, params.stop_after)
        return stopping.prefix_of(model, trees), -curve[trees - 1] if curve else None, trees
    best, since = None, 0
    for trees in params.tree_grid:
        model = params.forest(trees).fit(train)
        value = _score_of(score(model, valid, keep, classes))
        if best is None or value > best[1]:
            best, since = (model, value, trees), 0
        else:
            since += 1
            if since >= params.patience:
                break
    return best


def cross_validate(
    df: DataFrame, key: str, features: Sequence[str], label: str, fold: str, k: int, classes: Sequence[str],
    params: ForestParams = ForestParams(), per_fold: Mapping[str, str] | None = None,
    store: str | None = None, mark: str = "", folds_at_once: int = FOLDS_AT_ONCE,
) -> CrossValidation:
    """Fit on the other folds, score the held-out one, stack the held-out rows.

    ``per_fold`` maps a feature to a column prefix whose ``<prefix>_<i>`` column
    is that feature while fold ``i`` is held out (fold-safe encodings). With
    ``store`` a finished fold is reused: its model, predictions and score live
    under names that carry ``mark``, a fingerprint of the inputs. Up to
    ``folds_at_once`` folds run side by side, each with its own training rows in
    the cache; the first failure cancels the others, and with ``store`` a later
    call goes on from the finished folds.
    """
    spark, keep = df.sparkSession, [key, fold, "label"]

    def one(i: int):
        columns = [f"{per_fold[c]}_{i}" if per_fold and c in per_fold else c for c in features]
        data = with_classes(feature_matrix(df, columns, [key, fold, label]), label, classes)

        def fit():
            train, valid = weighted(data.filter(F.col(fold) != i), "label"), data.filter(F.col(fold) == i)
            train = with_classes(train, "label", classes).cache()
            try:
                return choose_trees(train, valid, params, keep, classes)[0]
            finally:
                train.unpersist()

        if store is None:
            model = fit()
        else:
            model = reuse_or_fit(spark, store, f"model_fold{i}", mark, RandomForestClassificationModel.load, fit)
        predict = lambda: score(model, data.filter(F.col(fold) == i), keep, classes)
        out = predict() if store is None else reuse_or_write(spark, store, f"oof_fold{i}", mark, predict)
        return out, model, _score_of(out)

    held, models, values = zip(*run_together(spark, [partial(one, i) for i in range(k)], folds_at_once, "folds"))
    scores = [(i, value, model.getNumTrees) for i, (model, value) in enumerate(zip(models, values))]
    folds = spark.createDataFrame(scores, "fold int, f1 double, trees int")
    refit = stopping.refit_size([s[2] for s in scores])
    return CrossValidation(stack_rows(*held), folds, refit, list(models))


def fit_all(
    df: DataFrame, key: str, features: Sequence[str], label: str, classes: Sequence[str], trees: int,
    params: ForestParams = ForestParams(), store: str | None = None, mark: str = "",
):
    """Fit on every row with a fixed forest size."""

    def fit():
        data = weighted(with_classes(feature_matrix(df, features, [key, label]), label, classes), "label")
        data = with_classes(data, "label", classes).cache()
        try:
            return params.forest(trees).fit(data)
        finally:
            data.unpersist()

    if store is None:
        return fit()
    return reuse_or_fit(df.sparkSession, store, "model_all", mark, RandomForestClassificationModel.load, fit)


def predict_rows(model, scoring: DataFrame, original: DataFrame, key: str, features: Sequence[str],
                 classes: Sequence[str], label: str, default: str) -> DataFrame:
    """All original columns and rows with the predicted class filled in."""
    matrix = feature_matrix(scoring, features, [key])
    predicted = score(model, matrix, [key], classes).select(key, F.col("predicted_class").alias(label))
    return align_predictions(original, predicted, [key], label, default)


def importance_table(model, features: Sequence[str]) -> DataFrame:
    """Feature importances; one row per model column."""
    values = model.featureImportances.toArray().tolist()
    return SparkSession.active().createDataFrame(list(zip(features, values)), "feature string, importance double")


def blended(left: DataFrame, right: DataFrame, key: str, left_weight: float, classes: Sequence[str]) -> DataFrame:
    """Weighted mean of two models' probabilities and the class it picks."""
    both = left.select(key, F.col("probability").alias("_l")).join(right.select(key, F.col("probability").alias("_r")), key)
    mixed = both.select(key, blend(F.col("_l"), F.col("_r"), left_weight).alias("probability"))
    index = first_argmax(F.col("probability"))
    return mixed.withColumn("predicted", index).withColumn("predicted_class", label_of(index, classes))


def stacked_matrix(predictions: Sequence[DataFrame], key: str, keep: DataFrame) -> DataFrame:
    """Out-of-fold probabilities of several models as one feature vector per row."""
    out = keep
    for i, p in enumerate(predictions):
        out = out.join(p.select(key, F.col("probability").alias(f"_p{i}")), key)
    parts = [F.col(f"_p{i}") for i in range(len(predictions))]
    return out.withColumn("features", array_to_vector(F.concat(*parts))).drop(*[f"_p{i}" for i in range(len(predictions))])


def _learned(train: DataFrame, rows: DataFrame, params: ForestParams, keep: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """Scores of ``rows`` by a forest of the largest size, fitted on ``train`` alone."""
    data = with_classes(weighted(train, "label"), "label", classes).cache()
    try:
        model = params.forest(params.tree_grid[-1]).fit(data)
    finally:
        data.unpersist()
    return score(model, rows, keep, classes)


def nested_stack(
    df: DataFrame, key: str, features: Sequence[str], label: str, fold: str, k: int, classes: Sequence[str],
    bases: Sequence[ForestParams], top: ForestParams, inner: int = 2, per_fold: Mapping[str, str] | None = None, seed: int = 42,
) -> DataFrame:
    """Out-of-fold scores of a second model on the votes of several base models.

    For each held-out fold everything is learned from the other folds: they are
    split once more into ``inner`` folds, whose out-of-fold votes the second
    model is fitted on; base models of all other folds vote on the held-out
    rows, which the second model then scores. So no vote that the second model
    learns from was made by a model that saw the row itself or a held-out one.
    ``per_fold`` is as in ``cross_validate``. It takes k x (bases x (inner + 1) + 1)
    fits; votes are settled, so a lost executor repeats no fit.
    """
    keep, parts = [key, fold, "label"], []
    for i in range(k):
        columns = [f"{per_fold[c]}_{i}" if per_fold and c in per_fold else c for c in features]
        data = with_classes(feature_matrix(df, columns, [key, fold, label]), label, classes)
        held = data.filter(F.col(fold) == i)
        rest = settle(stratified_folds(data.filter(F.col(fold) != i), [key], label, inner, "_inner", seed))
        learned, voted = [], []
        for params in bases:
            inside = [
                _learned(rest.filter(F.col("_inner") != j), rest.filter(F.col("_inner") == j), params, keep, classes)
                for j in range(inner)
            ]
            learned.append(settle(stack_rows(*inside)))
            voted.append(settle(_learned(rest, held, params, keep, classes)))
        matrix = lambda votes: stacked_matrix(votes, key, votes[0].select(*keep))
        parts.append(settle(_learned(matrix(learned), matrix(voted), top, keep, classes)))
    return stack_rows(*parts)
