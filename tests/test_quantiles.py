"""Exact quantiles: the counted-bucket way against numpy."""

import math
import random

import numpy as np
import pytest

from gradeframe.functions import binning
from gradeframe.operators import quantiles as q

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


def check_groups(spark, groups):
    data = [(g, float(v)) for g, vs in groups.items() for v in vs]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "g string, x double").repartition(5)
    got = {(r["g"], r["probability"]): r["value"] for r in q.quantiles(df, "x", PROBS, ["g"]).collect()}
    assert len(got) == len(groups) * len(PROBS)
    for g, vs in groups.items():
        for p in PROBS:
            assert got[g, p] == pytest.approx(np.quantile(np.array(vs, dtype=float), p), rel=1e-12, abs=1e-12), (g, p)


def test_many_shapes(spark):
    rnd = random.Random(5)
    check_groups(spark, {
        "one": [4], "two": [1, 9], "ties": [3] * 500 + [7], "normal": [rnd.gauss(0, 1) for _ in range(3000)],
        "heavy": [math.exp(rnd.gauss(0, 6)) for _ in range(3000)], "ints": [rnd.randrange(5) for _ in range(2000)],
        "negative": [-x for x in range(1000)], "outlier": [0] * 10 + [1e300, -1e300],
    })


def test_one_group_with_a_third_of_all_rows(spark):
    rnd = random.Random(6)
    groups = {f"s{i}": [rnd.random() for _ in range(20)] for i in range(100)}
    groups["hot"] = [round(rnd.random(), 2) for _ in range(1000)]
    check_groups(spark, groups)


def test_coarse_sketch_is_still_exact(spark):
    rnd = random.Random(7)
    values = [rnd.random() ** 9 for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r["probability"]: r["value"] for r in q.quantiles(df, "x", PROBS, accuracy=20).collect()}
    assert [got[p] for p in PROBS] == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-12)


def test_both_ways_agree_and_skip_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", math.nan), ("a", 2.0), (None, 5.0), ("b", None)], "g string, x double")
    for _ in range(2):
        got = sorted(tuple(r) for r in q.quantiles(df, "x", [0.5], ["g"]).collect())
        assert got == [("a", 0.5, 1.5)]


def test_interpolation_and_infinity(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 4.0, 10.0)], "x double")
    for _ in range(2):
        (row,) = q.quantiles(df, "x", [0.9]).collect()
        assert row["value"] == pytest.approx(7.6)
    inf = spark.createDataFrame([(x,) for x in (1.0, math.inf, math.inf, math.inf)], "x double")
    assert q.quantiles(inf, "x", [0.9]).first()["value"] == math.inf


def test_empty_input(spark):
    df = spark.createDataFrame([], "x double")
    assert q.quantile_values(df, "x", [0.5]) == [None]


def test_approx_is_close(spark):
    df = spark.range(10001).selectExpr("double(id) x")
    assert q.quantiles(df, "x", [0.5], approx=True).first()["value"] == pytest.approx(5000, abs=5)


def test_winsorise_and_cuts(spark):
    df = spark.createDataFrame([(float(x),) for x in range(101)] + [(None,)], "x double")
    assert binning.winsorise(df, "x", 0.95).agg({"x": "max"}).first()[0] == 95.0
    assert binning.at_or_above_quantile(df, "x", 0.75).count() == 26
    assert binning.at_or_below_quantile(df, "x", 0.25).count() == 26


@pytest.fixture
def small_limits(monkeypatch):
    """Few values to a bracket and coarse sketches, so that brackets are narrowed again and again."""
    monkeypatch.setattr(q, "RANKED_VALUES", 20)
    monkeypatch.setattr(q, "GRID", 8)
    monkeypatch.setattr(q, "TIGHT", 3)
    monkeypatch.setattr(q, "WHOLE", 1)


def test_brackets_are_narrowed_until_a_task_can_rank_them(spark, small_limits):
    rnd = random.Random(8)
    groups = {"a": [rnd.random() ** 5 for _ in range(4000)], "b": [float(rnd.randrange(3)) for _ in range(500)], "c": [1.0, 2.0],
              "inf": [math.inf] * 50 + [-math.inf] * 50 + [float(x) for x in range(200)]}
    data = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(data, "g string, x double").repartition(3)
    probs = [0.0, 0.3, 0.5, 0.999, 1.0]
    got = {(r["g"], r["probability"]): r["value"] for r in q.quantiles(df, "x", probs, ["g"], accuracy=50).collect()}
    for g, vs in groups.items():
        s = sorted(vs)
        for p in probs:
            at = (len(s) - 1) * p
            a, z = s[math.floor(at)], s[math.ceil(at)]
            assert got[g, p] == (a if a == z else pytest.approx(a + (z - a) * (at - math.floor(at)), rel=1e-12)), (g, p)
    whole = [v for vs in groups.values() for v in vs if math.isfinite(v)]
    finite = df.filter("abs(x) < 10000")
    values = q.quantile_values(finite, "x", [0.1, 0.5]) + [r["value"] for r in q.quantiles(finite, "x", [0.9], accuracy=50).collect()]
    assert values == pytest.approx(list(np.quantile(whole, [0.1, 0.5, 0.9])), rel=1e-12)


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    first = q._first_brackets

    def shifted(rows, slots, by, accuracy, also):
        from pyspark.sql import functions as F

        told = first(rows, slots, by, accuracy, also)
        # The first rank's bracket lies above it, the second's below.
        return told.withColumns({"_a0": F.lit(900.0), "_z0": F.lit(910.0), "_a1": F.lit(3.0), "_z1": F.lit(4.0)})

    monkeypatch.setattr(q, "_first_brackets", shifted)
    df = spark.range(1001).selectExpr("double(id) x")
    assert q.quantile_values(df, "x", [0.1, 0.7, 0.5]) == [100.0, 700.0, 500.0]


def test_several_columns_share_passes_without_multiplied_rows(spark):
    rnd = random.Random(9)
    rows = [tuple(rnd.choice([None, math.nan, rnd.gauss(k, 1)]) for k in range(10)) + ("g" if i % 3 else "h",) for i in range(900)]
    names = [f"c{k}" for k in range(10)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", g string")
    from pyspark.sql import functions as F

    got = {(r["g"], r["column"], r["probability"]): r for r in q.column_quantiles(df, names, [0.25, 0.5], ["g"], also=lambda v: {"top": F.max(v)}).collect()}
    assert len(got) == 2 * 10 * 2
    for g in "gh":
        for k, name in enumerate(names):
            vs = [r[k] for r in rows if r[10] == g and r[k] is not None and not math.isnan(r[k])]
            for p in (0.25, 0.5):
                assert got[g, name, p]["value"] == pytest.approx(np.quantile(vs, p)) and got[g, name, p]["n"] == len(vs) and got[g, name, p]["top"] == max(vs)


def test_only_what_brackets_hold_is_shuffled(spark):
    """Of 400,000 distinct values in each of two groups, a bracket holds about four errors' worth; nothing is sorted by ranges."""
    df = spark.range(800_000, numPartitions=8).selectExpr("double(id * 7919 % 800011) x", "string(id % 2) g")
    rows = df.selectExpr("g", "x AS _v0")
    slots = q._Slots(1, [0.25, 0.5, 0.9])
    around = q._around(rows, q._first_brackets(rows, slots, ["g"], q.SKETCH_ACCURACY, []), slots, ["g"])
    assert around.count() <= 2 * 3 * 400_000 * 2 * (q.NARROW + 1) / q.SKETCH_ACCURACY + 2
    plan = around._jdf.queryExecution().executedPlan().toString().lower()
    # Combined in each task before the one exchange; no sort by ranges, no multiplied rows.
    assert plan.count("exchange hashpartitioning") == 1 and "partial_count" in plan
    assert "rangepartitioning" not in plan and "generate" not in plan
    assert q.quantiles(df, "x", [0.5], ["g"]).count() == 2
