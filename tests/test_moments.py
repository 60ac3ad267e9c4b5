"""Co-moments against plain numpy, for wide tables, large means and shifted subsets."""

import math
import random

import numpy as np
import pytest

from gradeframe.operators import moments


def plain(rows, i, j):
    ok = lambda v: v is not None and not math.isnan(v)
    xy = np.array([(r[i], r[j]) for r in rows if ok(r[i]) and ok(r[j])], dtype=np.longdouble)
    if not len(xy):
        return None
    x, y = xy.T
    dx, dy = x - x.mean(), y - y.mean()
    if (x == x[0]).all() or (y == y[0]).all():
        return None
    return float((dx * dy).sum() / np.sqrt((dx * dx).sum() * (dy * dy).sum()))


def check(spark, rows, names, tolerance=1e-9):
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(4)
    got = {(r["a"], r["b"]): r["corr"] for r in moments.correlations(df, names).collect()}
    assert len(got) == len(names) ** 2
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            want = plain(rows, i, j)
            assert got[a, b] is None if want is None else got[a, b] == pytest.approx(want, abs=tolerance), (a, b)


def test_sixty_columns(spark):
    rnd = np.random.default_rng(1)
    base = rnd.normal(size=(300, 60)) + rnd.normal(size=(300, 1))
    check(spark, base.tolist(), [f"c {k}" for k in range(60)])


def test_missing_values_in_blocks(spark):
    rnd = random.Random(2)
    rows = [tuple(rnd.choice([None, math.nan, *[rnd.gauss(k, k + 1) for _ in range(6)]]) for k in range(19)) + (None, 3.0) for _ in range(200)]
    check(spark, rows, [f"c{k}" for k in range(21)])


def test_a_mean_of_a_billion_and_shifted_subsets(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(400):
        x = 1e9 + rnd.random()
        # y is there only where z lies far from its overall mean, and c is constant only there.
        far = k % 4 == 0
        rows.append((x, x - 1e9 + rnd.random() if far else None, 1e9 + rnd.randrange(3) if far else rnd.gauss(0, 1), 0.1 if far else rnd.random()))
    check(spark, rows, ["x", "y", "z", "c"], 1e-6)
    df = spark.createDataFrame(rows, "x double, y double, z double, c double")
    assert moments.co_moments(df, ["x", "y", "z", "c"])[1, 3].flat


def test_empty_table_and_no_columns(spark):
    df = spark.createDataFrame([], "x double, y double")
    assert {r["corr"] for r in moments.correlations(df, ["x", "y"]).collect()} == {None}
    assert moments.correlations(df, []).collect() == []
