"""End-to-end runs: inputs to features, folds, model, predictions and files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeframe.functions import domain
from gradeframe.functions.domain import GRADES, OUTSIDE
from gradeframe.operators import encoding, joins, metrics, profile, sampling
from gradeframe.plans import grading, training
from gradeframe.session import settle
from gradeframe.sources import sinks, store, tables

LABEL = "LAST_GRADE"
PER_FOLD = {"farm_grade_loo": "farm_grade", "farm_grade_cnt": "farm_grade_cnt", "farm_grade_std": "farm_grade_std"}


@dataclass(frozen=True)
class Inputs:
    """The five tables and the rows to score. ``train`` and ``scoring`` share a unique row key."""

    train: DataFrame
    scoring: DataFrame
    weather: DataFrame
    area: DataFrame
    death: DataFrame
    lineage: DataFrame | None = None


@dataclass(frozen=True)
class Result:
    predictions: DataFrame
    importance: DataFrame
    distribution: DataFrame
    scores: DataFrame
    out_of_fold: DataFrame | None = None


def read_inputs(spark: SparkSession, folder: str, train: str, scoring: str, weather: str, area: str, death: str, lineage: str) -> Inputs:
    """CSV files by declared schema; the scoring table keeps every column it has."""
    at = lambda name: f"{folder}/{name}"
    return Inputs(
        tables.read_csv(spark, at(train), tables.FACT), tables.read_full_csv(spark, at(scoring), tables.FACT),
        tables.read_csv(spark, at(weather), tables.WEATHER), tables.read_csv(spark, at(area), tables.AREA),
        tables.read_csv(spark, at(death), tables.DEATH, ["FARM_UNIQUE_NO"]), tables.read_csv(spark, at(lineage), tables.LINEAGE),
    )


def fold_features(inputs: Inputs, lookups: grading.Lookups, key: str, folds: int, weather_start: str) -> DataFrame:
    """Training features, fold numbers and the encodings of every fold.

    Folds need the key and the label only, so they are drawn on the bare rows and
    the wide features are computed once.
    """
    bare = inputs.train.select(key, domain.grade_index(F.col(LABEL), strict=True).alias("label"))
    drawn = settle(sampling.stratified_folds(bare, [key], "label", folds).select(key, "fold"))
    df = grading.training_features(inputs.train, lookups, weather_start)
    df = df.select(key, grading.FARM, "grade_score", "label", *grading.FEATURES).join(drawn, key)
    return encoding.with_fold_encoding(df, grading.FARM, "grade_score", "fold", folds, "farm_grade")


def full_run(
    inputs: Inputs, key: str, params: training.ForestParams = training.ForestParams(), folds: int = 3,
    weather_start: str = grading.WEATHER_START, root: str | None = None,
) -> Result:
    """Cross-validate, refit on every row and score.

    With ``root`` the feature table, fold models and final model are kept there
    under a fingerprint of the inputs and settings, and reused by a later run.
    """
    spark = inputs.train.sparkSession
    for rows in (inputs.train, inputs.scoring):
        joins.require_row_key(rows, [key])
    named = {k: v for k, v in vars(inputs).items() if v is not None and k != "scoring"}
    mark = store.fingerprint(named, {"params": params, "folds": folds, "start": weather_start}) if root else ""
    lookups = grading.lookups(inputs.weather, inputs.area, inputs.death)
    build = lambda: fold_features(inputs, lookups, key, folds, weather_start)
    features = store.reuse_or_write(spark, root, "features", mark, build) if root else settle(build())
    cv = training.cross_validate(
        features, key, grading.FEATURES, "label", "fold", folds, GRADES, params, PER_FOLD, root, mark
    )
    model = training.fit_all(features, key, grading.FEATURES, "label", GRADES, cv.refit_trees, params, root, mark)
    encodings = settle(grading.encoding_table(inputs.train))
    rows = grading.scoring_features(inputs.scoring, lookups, encodings, inputs.train, weather_start)
    predictions = training.predict_rows(model, rows, inputs.scoring, key, grading.FEATURES, GRADES, LABEL, OUTSIDE)
    overall = metrics.macro_f1(cv.predictions, "label", "predicted").select(F.col("macro_f1").alias("oof_macro_f1"))
    return Result(
        predictions, training.importance_table(model, grading.FEATURES),
        profile.class_distribution(predictions, LABEL, GRADES),
        joins.attach(metrics.score_summary(cv.folds, "f1", "trees"), overall, []), cv.predictions,
    )


def baseline_run(
    inputs: Inputs, key: str, sample: int = 600_000, params: training.ForestParams = training.ForestParams(),
) -> Result:
    """Stratified sample, one 80/20 hold-out, one model.

    Sire, strain and farm means come from the training part only, so the
    hold-out score does not see its own targets; scoring uses them too.
    """
    for rows in (inputs.train, inputs.scoring):
        joins.require_row_key(rows, [key])
    lookups = grading.lookups(inputs.weather, inputs.area, inputs.death, base=True)
    picked = sampling.stratified_sample(inputs.train, [key], LABEL, sample)
    split = settle(sampling.stratified_holdout(picked, [key], LABEL, 0.2))
    fitted_on = split.filter(~F.col("is_validation"))
    parents = grading.pedigree(inputs.lineage)
    statistics = grading.target_statistics(fitted_on, parents)

    def matrix(df: DataFrame, keep: list[str]) -> DataFrame:
        rows = grading.baseline_features(df, lookups, parents, statistics)
        return training.feature_matrix(rows, grading.BASELINE_FEATURES, keep)

    data = settle(matrix(grading.with_target(split).drop("grade_score"), [key, "label", "is_validation"]))
    data = training.with_classes(data, "label", GRADES)
    train = training.with_classes(training.weighted(data.filter("not is_validation"), "label"), "label", GRADES)
    model, score, trees = training.choose_trees(train, data.filter("is_validation"), params, [key, "label"], GRADES)
    scored = training.score(model, matrix(inputs.scoring.drop(LABEL), [key]), [key], GRADES)
    predictions = joins.align_predictions(
        inputs.scoring, scored.select(key, F.col("predicted_class").alias(LABEL)), [key], LABEL, OUTSIDE
    )
    summary = train.sparkSession.createDataFrame([(score, trees)], "macro_f1 double, trees int")
    return Result(
        predictions, training.importance_table(model, grading.BASELINE_FEATURES),
        profile.class_distribution(predictions, LABEL, GRADES), summary,
    )


def write_result(result: Result, out: str, key: str) -> None:
    """Predictions with a byte order mark, ranked importance and out-of-fold probabilities."""
    sinks.write_csv(result.predictions, f"{out}/predictions", bom=True)
    sinks.write_importance(result.importance, f"{out}/feature_importance")
    if result.out_of_fold is not None:
        wide = [F.get("probability", F.lit(i)).alias(c) for i, c in enumerate(GRADES)]
        sinks.write_csv(result.out_of_fold.select(key, *wide), f"{out}/oof_predictions")
