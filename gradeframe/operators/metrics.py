"""Classification metrics as small aggregates over (label, prediction) pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Rows per (label, prediction) pair."""
    return df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, label: str, predicted: str, classes: Sequence) -> DataFrame:
    """One row per true class, one column per predicted class of a fixed list."""
    cells = [F.count_if(F.col(predicted) == c).alias(str(c)) for c in classes]
    return df.groupBy(F.col(label).alias("label")).agg(*cells)


def class_f1(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Support, precision, recall and F1 for every class seen on either side."""
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("tp")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), hit.alias("tp")),
    )
    per = (
        confusion(df, label, predicted).select(F.inline(sides)).filter(F.col("class").isNotNull())
        .groupBy("class").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("tp").alias("tp"))
    )
    zero = F.lit(0.0)
    return per.select(
        "class", "support", "predicted", "tp",
        F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted")), zero).alias("precision"),
        F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), zero).alias("recall"),
        F.coalesce(F.try_divide(F.col("tp") * 2.0, F.col("support") + F.col("predicted")), zero).alias("f1"),
    )


def macro_f1(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Unweighted mean F1 over the classes seen on either side."""
    return class_f1(df, label, predicted).agg(F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("n_classes"))


def score_summary(folds: DataFrame, score: str, rounds: str) -> DataFrame:
    """Mean and population deviation of a fold score, mean rounds and the refit size."""
    return folds.agg(
        F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"),
        F.avg(rounds).alias("mean_rounds"), F.floor(F.avg(rounds) * F.lit(1.1)).alias("refit_rounds"),
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight ``N / (K * n_c)`` per class."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total, classes = counts.agg(F.sum("n")).scalar(), counts.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("weight", total.cast("double") / (classes * F.col("n")))
