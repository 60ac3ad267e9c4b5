"""Sizes, disjointness and determinism of samples, hold-outs and folds."""

import pytest
from pyspark.sql import functions as F

from gradeframe.operators import sampling

SIZES = {"a": 3001, "b": 400, "c": 7, "d": 1}


@pytest.fixture(scope="module")
def labelled(spark):
    data, i = [], 0
    for label, n in SIZES.items():
        for _ in range(n):
            data.append((i, label))
            i += 1
    data += [(10_000 + j, None) for j in range(5)]
    return spark.createDataFrame(data, "id long, y string")


@pytest.mark.parametrize("n", [0, 1, 50, 3414, 99999])
@pytest.mark.parametrize("span", [64, 10**6])
def test_sample_size_is_exact(labelled, n, span):
    out = sampling.sample_rows(labelled, ["id"], n, rows_per_range=span)
    assert out.count() == min(n, 3414)
    assert out.select("id").distinct().count() == min(n, 3414)


def test_stratified_sample_quota(labelled):
    out = sampling.stratified_sample(labelled, ["id"], "y", 1000, rows_per_range=64)
    got = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert got == {y: min(n, int(1000 * n / 3414) + 1) for y, n in SIZES.items()}


def test_folds_differ_by_at_most_one(labelled):
    for k in (2, 3, 5):
        out = sampling.stratified_folds(labelled.dropna(), ["id"], "y", k, rows_per_range=64)
        assert out.count() == sum(SIZES.values())
        assert out.select("id").distinct().count() == out.count()
        for y, n in SIZES.items():
            sizes = [out.filter((F.col("y") == y) & (F.col("fold") == i)).count() for i in range(k)]
            assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_result_does_not_depend_on_partitions_or_ranges(labelled):
    def folds(df, span):
        return sorted(map(tuple, sampling.stratified_folds(df, ["id"], "y", 3, rows_per_range=span).select("id", "fold").collect()))

    first = folds(labelled.repartition(1), 10**6)
    assert first == folds(labelled.repartition(7), 10**6) == folds(labelled.repartition(4, "y"), 50)
    other = sampling.stratified_folds(labelled, ["id"], "y", 3, seed=7).select("id", "fold")
    assert first != sorted(map(tuple, other.collect()))


def test_holdout_share(labelled):
    out = sampling.stratified_holdout(labelled, ["id"], "y", 0.2, rows_per_range=64)
    got = {r["y"]: r["n"] for r in out.groupBy("y").agg(F.count_if("is_validation").alias("n")).collect()}
    assert got == {"a": 600, "b": 80, "c": 1, "d": 0}


def test_time_split(spark):
    df = spark.sql("select id, add_months(date'2023-06-01', cast(id as int)) d from range(24)")
    train, later = sampling.split_by_year(df, "d", 2023)
    assert (train.count(), later.count()) == (7, 17)
