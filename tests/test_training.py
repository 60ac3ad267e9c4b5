"""Invariants of training, out-of-fold scoring and output on small generated rows."""

import random

import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import functions as F

from gradeframe.operators import encoding, sampling
from gradeframe.plans import training
from gradeframe.sources import sinks, store

CLASSES = ["x", "y", "z", "never"]
PARAMS = training.ForestParams(tree_grid=(3, 6), depth=4, min_rows=1, bins=16)


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(240):
        y = rnd.choice([0, 0, 0, 1, 2])
        rows.append((i, float(y) + rnd.gauss(0, 0.2), None if i % 9 == 0 else rnd.random(), f"k{i % 11}", y, float(y)))
    df = spark.createDataFrame(rows, "id int, a double, b double, k string, y int, t double")
    df = sampling.stratified_folds(df, ["id"], "y", 3)
    return encoding.with_fold_encoding(df, "k", "t", "fold", 3, "enc").cache()


@pytest.fixture(scope="module")
def cv(data):
    return training.cross_validate(data, "id", ["a", "b", "enc"], "y", "fold", 3, CLASSES, PARAMS, per_fold={"enc": "enc"})


def test_every_row_is_scored_once(data, cv):
    assert cv.predictions.count() == data.count()
    assert cv.predictions.select("id").distinct().count() == data.count()
    assert cv.predictions.join(data.select("id", F.col("fold").alias("f")), "id").filter("fold <> f").count() == 0


def test_probabilities_cover_all_classes_and_sum_to_one(cv):
    total = F.aggregate("probability", F.lit(0.0), lambda a, x: a + x)
    assert cv.predictions.filter((F.abs(total - 1) > 1e-9) | (F.size("probability") != 4)).count() == 0


def test_it_learns(cv):
    assert cv.folds.agg(F.min("f1")).first()[0] > 0.8
    assert 3 <= cv.refit_trees <= 6


def test_folds_are_reused_by_fingerprint(spark, data, tmp_path, monkeypatch):
    run = lambda mark: training.cross_validate(
        data, "id", ["a", "b", "enc"], "y", "fold", 3, CLASSES, PARAMS, {"enc": "enc"}, str(tmp_path), mark
    )
    first = run("m1")
    monkeypatch.setattr(training, "choose_trees", lambda *a, **k: pytest.fail("fitted again"))
    again = run("m1")
    pick = lambda c: sorted(map(tuple, c.predictions.select("id", "predicted").collect()))
    assert pick(first) == pick(again)
    assert sorted(map(tuple, first.folds.collect())) == sorted(map(tuple, again.folds.collect()))
    with pytest.raises(BaseException, match="fitted again"):
        run("m2")


def test_folds_side_by_side_give_what_one_after_the_other_gives(data, cv):
    alone = training.cross_validate(data, "id", ["a", "b", "enc"], "y", "fold", 3, CLASSES, PARAMS, {"enc": "enc"}, folds_at_once=1)
    pick = lambda c: sorted((r["id"], r["fold"], r["predicted"], tuple(r["probability"])) for r in c.predictions.collect())
    assert pick(alone) == pick(cv) and alone.refit_trees == cv.refit_trees
    assert sorted(map(tuple, alone.folds.collect())) == sorted(map(tuple, cv.folds.collect()))


def test_a_broken_run_goes_on_from_its_finished_folds(data, cv, tmp_path, monkeypatch):
    run = lambda: training.cross_validate(
        data, "id", ["a", "b", "enc"], "y", "fold", 3, CLASSES, PARAMS, {"enc": "enc"}, str(tmp_path), "m", folds_at_once=1
    )
    choose, fitted, broken = training.choose_trees, [], [2]

    def watched(train, *rest):
        (held,) = {0, 1, 2} - {r["fold"] for r in train.select("fold").distinct().collect()}
        if held in broken:
            raise RuntimeError("lost the driver's patience")
        fitted.append(held)
        return choose(train, *rest)

    monkeypatch.setattr(training, "choose_trees", watched)
    with pytest.raises(RuntimeError, match="patience"):
        run()
    assert fitted == [0, 1]
    broken.clear()
    done = run()
    assert fitted == [0, 1, 2]
    pick = lambda c: sorted((r["id"], r["predicted"]) for r in c.predictions.collect())
    assert pick(done) == pick(cv)


def test_final_model_scores_and_aligns(spark, data, tmp_path):
    model = training.fit_all(data, "id", ["a", "b"], "y", CLASSES, 3, PARAMS, str(tmp_path), "m")
    loaded = store.reuse_or_fit(spark, str(tmp_path), "model_all", "m", RandomForestClassificationModel.load, lambda: None)
    assert loaded.getNumTrees == model.getNumTrees == 3
    original = data.select("id", "k").withColumn("grade", F.lit(None).cast("string"))
    out = training.predict_rows(model, data.filter("id < 200"), original, "id", ["a", "b"], CLASSES, "grade", "never")
    assert out.columns == ["id", "k", "grade"] and out.count() == data.count()
    assert out.filter("id >= 200 and grade <> 'never'").count() == 0
    assert out.filter("id < 200 and grade = 'never'").count() == 0
    importance = training.importance_table(model, ["a", "b"])
    assert importance.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def test_oof_columns_carry_class_names(cv):
    from pyspark.ml.functions import array_to_vector

    vectors = cv.predictions.withColumn("probability", array_to_vector("probability"))
    assert sinks.probability_columns(vectors, CLASSES, ["id"]).columns == ["id", *CLASSES]


def test_missing_features_become_a_constant(data):
    row = training.feature_matrix(data.filter("id = 0"), ["a", "b"], ["id"]).first()
    assert row["features"][1] == -999.0


def test_stacking_and_blending(data, cv):
    matrix = training.stacked_matrix([cv.predictions, cv.predictions], "id", cv.predictions.select("id", "label"))
    assert matrix.first()["features"].size == 8 and matrix.count() == data.count()
    same = training.blended(cv.predictions, cv.predictions, "id", 0.3, CLASSES)
    assert same.join(cv.predictions.select("id", F.col("predicted").alias("p")), "id").filter("predicted <> p").count() == 0


TOP = training.ForestParams(tree_grid=(4,), depth=3, min_rows=1, bins=16)
OTHER = training.ForestParams(tree_grid=(3,), depth=2, min_rows=1, bins=16, seed=5)


def test_nested_stacking_never_learns_from_what_it_scores(data, monkeypatch):
    steps, learned = [], training._learned

    def watched(train, rows, *rest):
        ids = [{r["id"] for r in d.select("id").collect()} for d in (train, rows)]
        steps.append(ids)
        return learned(train, rows, *rest)

    monkeypatch.setattr(training, "_learned", watched)
    out = training.nested_stack(data, "id", ["a", "b", "enc"], "y", "fold", 3, CLASSES, [TOP, OTHER], TOP, per_fold={"enc": "enc"})
    assert out.count() == data.count() == out.select("id").distinct().count()
    assert out.filter("label = predicted").count() > 0.8 * out.count()
    assert len(steps) == 3 * (2 * 3 + 1) and all(train.isdisjoint(rows) for train, rows in steps)
    folds = {}
    for r in data.select("id", "fold").collect():
        folds.setdefault(r["fold"], set()).add(r["id"])
    for i in range(3):
        mine = steps[7 * i : 7 * i + 7]
        assert mine[-1][1] == folds[i] and all(train.isdisjoint(folds[i]) for train, _ in mine)


def test_nested_stacking_of_random_labels_stays_at_chance(spark):
    rnd = random.Random(11)
    rows = [(i, rnd.random(), f"k{i // 2}", c, float(c)) for i in range(600) for c in [rnd.randrange(3)]]
    df = sampling.stratified_folds(spark.createDataFrame(rows, "id int, a double, k string, y int, t double"), ["id"], "y", 2)
    deep = training.ForestParams(tree_grid=(5,), depth=8, min_rows=1, bins=32)
    out = training.nested_stack(df.cache(), "id", ["a"], "y", "fold", 2, CLASSES[:3], [deep, OTHER], deep)
    assert abs(out.filter("label = predicted").count() / 600 - 1 / 3) < 0.08
