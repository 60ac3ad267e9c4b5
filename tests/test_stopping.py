"""Early stopping inside one forest against prefixes scored one by one."""

import math

import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gradeframe.plans import stopping, training

CLASSES = ["x", "y", "z", "never"]
PARAMS = training.ForestParams(tree_grid=(15,), depth=4, min_rows=2, bins=16, stop_after=4)


@pytest.fixture(scope="module")
def halves(spark):
    df = spark.range(400).selectExpr("id", "int(id % 3) y", "id % 3 + 2 * randn(1) a", "rand(2) b", "int(id % 2) fold").cache()
    data = training.with_classes(training.feature_matrix(df, ["a", "b"], ["id", "fold", "y"]), "y", CLASSES)
    train = training.with_classes(training.weighted(data.filter("fold = 0"), "label"), "label", CLASSES)
    return train.cache(), data.filter("fold = 1").cache()


@pytest.fixture(scope="module")
def forest(halves):
    return PARAMS.forest(15).fit(halves[0])


def loss_of(model, valid):
    p = F.greatest(F.element_at(vector_to_array("probability"), F.col("label").cast("int") + 1), F.lit(stopping.LEAST))
    return model.transform(valid).agg(F.avg(-F.log(p))).first()[0]


def test_curve_equals_prefixes_scored_one_by_one(forest, halves):
    curve = stopping.loss_curve(forest, halves[1])
    assert len(curve) == 15
    for k in range(1, 16):
        assert curve[k - 1] == pytest.approx(loss_of(stopping.prefix_of(forest, k), halves[1]), rel=1e-12)
    assert curve[-1] == pytest.approx(loss_of(forest, halves[1]), rel=1e-12)


def test_prefix_keeps_settings_and_survives_a_store(forest, tmp_path):
    short = stopping.prefix_of(forest, 4)
    short.save(str(tmp_path / "m"))
    again = RandomForestClassificationModel.load(str(tmp_path / "m"))
    assert again.getNumTrees == short.getNumTrees == 4 and len(again.trees) == 4
    assert again.getOrDefault("maxDepth") == 4 and again.getOrDefault("labelCol") == "label" and forest.getNumTrees == 15


def test_patience():
    assert stopping.best_prefix([5, 4, 3, 3.5, 3.2, 1], 3) == (6, 6) and stopping.best_prefix([5, 4, 3, 3.5, 3.2, 1], 2) == (3, 5)
    assert stopping.best_prefix([2, 2, 2], 5) == (1, 3) and stopping.best_prefix([math.inf], 1) == (1, 1) and stopping.best_prefix([], 1) == (1, 0)
    assert stopping.refit_size([10, 20, 33]) == 23


def test_cross_validation_cuts_each_fold(spark, halves):
    df = spark.range(300).selectExpr("id", "int(id % 3) y", "id % 3 + 2 * randn(1) a", "rand(2) b", "int(id % 2) fold").cache()
    cv = training.cross_validate(df, "id", ["a", "b"], "y", "fold", 2, CLASSES, PARAMS)
    sizes = [r["trees"] for r in cv.folds.orderBy("fold").collect()]
    assert [m.getNumTrees for m in cv.models] == sizes and all(1 <= s <= 15 for s in sizes)
    assert cv.refit_trees == int(sum(sizes) / 2 * 1.1) and cv.predictions.count() == 300


def test_no_validation_rows_and_an_unknown_class(forest, halves):
    assert stopping.loss_curve(forest, halves[1].limit(0)) == []
    odd = halves[1].limit(5).withColumn("label", F.lit(9.0))
    assert stopping.loss_curve(forest, odd)[0] == pytest.approx(-math.log(stopping.LEAST))
