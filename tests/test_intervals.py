"""Interval aggregates by two lookups against plain loops, and the shape of their plans."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from gradeframe.functions import weather
from gradeframe.operators import intervals, timeseries

ODD = {3: math.nan, 4: math.inf, 5: -math.inf}


def series_rows(seed=1):
    rnd = random.Random(seed)
    rows = []
    for key, length in (("a", 200), ("b", 1), ("c", 37)):
        for p in range(50, 50 + length):
            for _ in range(rnd.choice([0, 1, 1, 2])):
                rows.append((key, p, rnd.choice([None, ODD.get(rnd.randrange(60), rnd.gauss(0, 5))]), rnd.randrange(-9, 9)))
    return rows + [(None, 60, 1.0, 1), ("a", None, 1.0, 1), ("b", 50, 2.0, 5)]


def asked_rows(seed=2):
    rnd = random.Random(seed)
    rows = [(rnd.choice("abc"), rnd.randrange(20, 280)) for _ in range(250)]
    rows = [(k, a, a + rnd.choice([0, 1, 2, 3, 7, 8, 31, 64, 150, 300])) for k, a in rows]
    return rows + [("zz", 50, 60), ("a", 60, 50), (None, 50, 60), ("a", None, 60), ("a", 60, None), ("b", 50, 50), ("a", 49, 250)]


def plain(rows, key, a, z):
    if None in (key, a, z):
        return None, 0, None, 0, None, None
    inside = [r for r in rows if r[0] == key and r[1] is not None and a <= r[1] <= z]
    xs, ns = [r[2] for r in inside if r[2] is not None], [r[3] for r in inside]
    # NaN is the largest value, as in Spark.
    rank = lambda v: (math.isnan(v), v)
    return (sum(xs) if xs else None, len(xs), sum(ns) if ns else None, len(ns), max(xs, key=rank) if xs else None, min(xs, key=rank) if xs else None)


def same(a, b):
    if a is None or b is None:
        return a is b
    return (math.isnan(a) and math.isnan(b)) or a == b or abs(a - b) <= 1e-9


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_any_interval_takes_two_lookups(spark, limit):
    rows, asked = series_rows(), asked_rows()
    series = spark.createDataFrame(rows, "k string, p int, x double, n long")
    spans = spark.createDataFrame([(i, *r) for i, r in enumerate(asked)], "id int, k string, a int, z int")
    index = intervals.interval_index(series, ["k"], F.col("p"), {"xs": F.col("x"), "ns": F.col("n")}, {"top": F.col("x")}, {"low": F.col("x")})
    out = intervals.interval_values(spans, index, F.col("a"), F.col("z"), broadcast_bytes=limit)
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(asked) and out.columns == ["id", "k", "a", "z", "xs", "xs_count", "ns", "ns_count", "top", "low"]
    for i, (key, a, z) in enumerate(asked):
        want = plain(rows, key, a, z)
        have = tuple(got[i][c] for c in ("xs", "xs_count", "ns", "ns_count", "top", "low"))
        assert all(same(x, y) for x, y in zip(have, want)), (key, a, z, have, want)


def test_season_months_by_arithmetic(spark):
    spans = [(a, a + n) for a in range(24) for n in (0, 1, 5, 11, 12, 40)]
    df = spark.createDataFrame(spans, "a int, z int")
    got = {(r["a"], r["z"]): r["n"] for r in df.select("a", "z", intervals.months_in(F.col("a"), F.col("z"), (12, 1, 2)).alias("n")).collect()}
    assert got == {(a, z): sum(m % 12 + 1 in (12, 1, 2) for m in range(a, z + 1)) for a, z in spans}


def test_empty_series(spark):
    series = spark.createDataFrame([], "k string, p int, x double")
    spans = spark.createDataFrame([("a", 1, 2)], "k string, a int, z int")
    index = intervals.interval_index(series, ["k"], F.col("p"), {"xs": F.col("x")}, {"top": F.col("x")})
    assert [tuple(r) for r in intervals.interval_values(spans, index, F.col("a"), F.col("z")).collect()] == [("a", 1, 2, None, 0, None)]


def test_rearing_measures_equal_the_expanded_months(spark):
    rnd = random.Random(4)
    start = datetime.date(2019, 1, 1)
    facts = [(i, rnd.randrange(4), start + datetime.timedelta(rnd.randrange(-500, 1500))) for i in range(200)]
    facts = [(i, s, b, b + datetime.timedelta(rnd.randrange(-40, 900))) for i, s, b in facts]
    df = spark.createDataFrame(facts, "id int, stn int, s date, e date")
    names = "ta_mean ta_max_mean ta_min_mean thi_mean thi_max rhm_mean heat2d heat3d cold_d rn_sum ws_mean".split()
    months = [(s, datetime.date(2019 + m // 12, m % 12 + 1, 1), *[None if rnd.random() < 0.1 else rnd.randrange(30) for _ in names])
              for s in range(3) for m in range(36) if rnd.random() < 0.8]
    kinds = {n: "long" if n in ("heat2d", "heat3d", "cold_d") else "double" for n in names}
    cast = [(s, d, *[None if v is None else float(v) if kinds[n] == "double" else v for n, v in zip(names, vs)]) for s, d, *vs in months]
    monthly = spark.createDataFrame(cast, "stn int, month date, " + ", ".join(f"{n} {k}" for n, k in kinds.items()))
    floor = F.lit("2019-03-10").cast("date")
    a = timeseries.interval_rollup(df, monthly, ["stn"], "s", "e", weather.rearing_aggregates(), floor)
    table = timeseries.interval_measures(df, monthly, ["stn"], "s", "e", *weather.rearing_measures(), floor=floor)
    b = timeseries.apply_interval_table(df, table, ["stn"], "s", "e", floor)
    key = lambda d: {r["id"]: {c: None if r[c] is None else round(float(r[c]), 9) if not isinstance(r[c], datetime.date) else r[c] for c in a.columns} for r in d.collect()}
    assert key(a) == key(b)


def test_preceding_days_cost_alike_for_one_day_and_a_year(spark):
    daily = spark.sql("select cast(id % 5 as int) stn, date_add(date'2020-01-01', cast(id div 5 as int)) date, cast(id % 7 as double) x from range(5000)")
    facts = spark.sql("select id, cast(id % 6 as int) stn, date_add(date'2020-06-01', cast(id % 400 as int)) at from range(2000)")
    plans, results = [], []
    for days in (1, 365):
        out = timeseries.preceding_days(facts, daily, ["stn"], "date", "at", days, {"x_sum": F.col("x")})
        plans.append(out._jdf.queryExecution().executedPlan().toString().lower())
        results.append({r["id"]: r["x_sum"] for r in out.collect()})
    assert all("generate" not in p for p in plans) and plans[0].count("exchange") == plans[1].count("exchange")
    values = {(r["stn"], r["date"]): r["x"] for r in daily.collect()}
    for days, got in zip((1, 365), results):
        for r in facts.collect():
            xs = [values[k] for d in range(1, days + 1) if (k := (r["stn"], r["at"] - datetime.timedelta(d))) in values]
            assert got[r["id"]] == (sum(xs) if xs else None)


def test_no_interval_or_day_is_expanded(spark, monkeypatch):
    """Rows that a Generate makes are those of the keys' calendars, however long and many the intervals are."""
    made = []
    spread = intervals.spread
    monkeypatch.setattr(intervals, "spread", lambda df, columns: made.append(df.count()) or spread(df, columns))
    monkeypatch.setattr(timeseries, "spread", lambda *a: pytest.fail("intervals were expanded"))
    monthly = spark.sql("select 1 stn, add_months(date'2020-01-01', cast(id as int)) month, double(id) x from range(24)")
    spans = spark.sql("select 1 stn, date_add(date'1990-01-01', cast(id as int)) s, date'2050-01-01' e from range(3000)")
    table = timeseries.interval_measures(spans, monthly, ["stn"], "s", "e", {"x": F.col("x")}, {}, {"x": F.col("x")})
    assert {r["x"] for r in table.collect()} == {276.0} and table.count() == 99 and made == [1]
