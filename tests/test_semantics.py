"""Edge cases on literal rows."""

import datetime as dt
import math
import statistics

import pytest
from pyspark.sql import functions as F

from gradeframe.functions import binning, clean, domain, encode, weather
from gradeframe.operators import encoding, metrics, profile, timeseries


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def one(spark, **columns):
    return tuple(spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first())


D = dt.date


def test_all_null_group_sums_to_zero_and_has_no_mean(spark):
    df = spark.createDataFrame([(1, D(2024, 1, 5), None, None, None, None, None)],
                               "stn int, date date, ta_max double, ta_min double, rhm_avg double, rn_day double, ws_davg double")
    out = timeseries.monthly_rollup(weather.with_index(df), ["stn"], "date", weather.full_aggregates()).first()
    assert (out["rn_sum"], out["ta_mean"], out["thi_max"], out["heat2d"], out["cold_d"]) == (0.0, None, None, 0, 0)


def test_leave_one_out_and_singletons(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 5.0), ("b", 4.0), (None, 9.0)], "k string, x double")
    out = encoding.with_leave_one_out(df, "k", "x", "e").select("k", "x", "e_loo", "e_cnt", "e_std")
    assert rows(out, "k", "x")[0] == (None, 9.0, None, None, None)
    assert [r[2] for r in rows(out, "k", "x")[1:]] == [5.0, 3.0, 0.0]
    assert rows(out, "k", "x")[3][4] is None
    prior = encoding.with_leave_one_out(df, "k", "x", "e", singleton="prior", prior=7.5)
    assert prior.filter("k = 'b'").first()["e_loo"] == 7.5
    assert encoding.with_leave_one_out(df, "k", "x", "e", singleton="null").filter("k = 'b'").first()["e_loo"] is None


def test_null_group_key_is_left_out(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0)], "k string, x double")
    assert rows(encoding.encoding_stats(df, "k", "x", "e"), "k") == [("a", 1.0, 1, None)]
    assert rows(encoding.group_size(df, "k", "n"), "k") == [("a", 1)]
    assert rows(profile.value_counts(df, "k"), "k") == [("a", 1)]
    assert rows(encoding.target_means(df, "k", {"m": "x"}), "k") == [("a", 1.0)]


def test_bad_dates(spark):
    df = spark.createDataFrame([(-99,), (20240231,), (20240131,), (None,)], "d int")
    assert [r[0] for r in df.select(clean.compact_date("d")).collect()] == [None, None, D(2024, 1, 31), None]
    text = spark.createDataFrame([("x",), ("2024-02-30",), ("2024-02-29",)], "d string")
    assert [r[0] for r in text.select(clean.iso_date("d")).collect()] == [None, None, D(2024, 2, 29)]


def test_fixed_bins_are_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (20.0,), (20.1,), (50.0,), (200.0,), (1e9,), (None,), (-3.0,), (math.nan,)], "x double")
    labels = ["1", "2", "3", "4", "5"]
    got = [r[0] for r in df.select(binning.fixed_bins(F.col("x"), domain.HERD_EDGES, labels)).collect()]
    assert got == [None, "1", "2", "2", "4", "5", None, None, None]


def test_quantile_bins_share_ties_and_include_the_lowest(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 1, 1, 2, 3, 4, 5, 6)], "x double")
    out = binning.quantile_bins(df, "x", list("abcd"), "b")
    got = {(r["x"], r["b"]) for r in out.collect()}
    assert (1.0, "a") in got and (6.0, "d") in got
    assert len({b for x, b in got if x == 1.0}) == 1
    tied = spark.createDataFrame([(1.0,)] * 5 + [(9.0,)], "x double")
    assert {r["x"]: r["b"] for r in binning.quantile_bins(tied, "x", list("abcd"), "b").collect()} == {1.0: "a", 9.0: "d"}


def test_month_span_counts_both_ends(spark):
    df = spark.createDataFrame([(1, D(2024, 1, 31), D(2024, 3, 1)), (2, D(2024, 3, 1), D(2024, 1, 1)), (3, None, D(2024, 1, 1))],
                               "id int, s date, e date").withColumn("stn", F.lit(7))
    monthly = spark.createDataFrame([(7, D(2024, 2, 1), 4.0)], "stn int, month date, x double")
    aggregates = [F.count(F.lit(1)).alias("months"), F.sum("x").alias("x")]
    out = timeseries.interval_rollup(df, monthly, ["stn"], "s", "e", aggregates).select("id", "months", "x")
    assert rows(out, "id") == [(1, 3, 4.0), (2, None, None), (3, None, None)]
    floored = timeseries.interval_rollup(df, monthly, ["stn"], "s", "e", aggregates, F.lit("2024-02-01").cast("date"))
    assert rows(floored.select("id", "months"), "id") == [(1, 2), (2, None), (3, None)]


def test_rearing_interval_without_weather(spark):
    df = spark.createDataFrame([(1, 9, D(2024, 6, 3), D(2024, 7, 2)), (2, 9, D(2024, 3, 3), D(2024, 4, 2))], "id int, stn int, s date, e date")
    monthly = spark.createDataFrame([], "stn int, month date, ta_mean double, ta_max_mean double, ta_min_mean double, thi_mean double, "
                                        "thi_max double, rhm_mean double, heat2d long, heat3d long, cold_d long, rn_sum double, ws_mean double")
    out = timeseries.interval_rollup(df, monthly, ["stn"], "s", "e", weather.rearing_aggregates()).orderBy("id").collect()
    first, second = out
    assert (first["rear_ta_mean"], first["rear_month_cnt"], first["rear_heat2d_total"], first["rear_rn_total"]) == (None, 0, 0, 0.0)
    assert (first["rear_summer_heat"], first["rear_winter_cold"]) == (0, None)
    assert second["rear_summer_heat"] is None


def test_month_shift_clamps(spark):
    assert one(spark, d=clean.shift_months(F.lit("2024-03-31").cast("date"), 1)) == (D(2024, 2, 29),)


def test_lagged_lookup_is_by_calendar(spark):
    monthly = spark.createDataFrame([(1, D(2024, 1, 1), 10.0), (1, D(2024, 3, 1), 30.0)], "stn int, month date, x double")
    facts = spark.createDataFrame([(1, 1, D(2024, 3, 31)), (2, 1, D(2024, 2, 10)), (3, 5, D(2024, 3, 1))], "id int, stn int, d date")
    lookup = timeseries.lagged_lookup(monthly, ["stn"], "month", {"s_": 0, "p1_": 1, "p2_": 2})
    out = timeseries.month_join(facts, lookup, ["stn"], "d").select("id", "s_x", "p1_x", "p2_x")
    assert rows(out, "id") == [(1, 30.0, None, 10.0), (2, None, 10.0, None), (3, None, None, None)]


def test_gap_fill(spark):
    df = spark.createDataFrame([(D(2024, 1, 9),), (D(2024, 3, 2),), (None,)], "d date")
    assert rows(timeseries.gap_filled_counts(df, "d"), "month") == [(D(2024, 1, 1), 1), (D(2024, 2, 1), 0), (D(2024, 3, 1), 1)]
    assert timeseries.gap_filled_counts(df.filter("d is null"), "d").count() == 0


def test_pairwise_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (None, 9.0), (5.0, None)], "a double, b double")
    got = {(r["a"], r["b"]): r["corr"] for r in profile.correlations(df, ["a", "b"]).collect()}
    assert got["a", "b"] == got["b", "a"] == pytest.approx(0.654654, abs=1e-6)
    assert got["a", "a"] == pytest.approx(1.0)
    flat = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "a double, b double")
    got = {(r["a"], r["b"]): r["corr"] for r in profile.correlations(flat, ["a", "b"]).collect()}
    assert got["a", "b"] is None and got["b", "b"] is None and got["a", "a"] == pytest.approx(1.0)


def test_first_argmax_wins(spark):
    assert one(spark, i=encode.first_argmax(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.5)))) == (1,)


def test_row_mean_and_safe_ratio(spark):
    null = F.lit(None).cast("double")
    assert one(spark, a=clean.row_mean(F.lit(2.0), null, F.lit(4.0)), b=clean.row_mean(null, null)) == (3.0, None)
    assert one(spark, a=clean.safe_ratio(F.lit(1), F.lit(0)), b=clean.safe_ratio(F.lit(1), F.lit(4))) == (None, 0.25)
    assert one(spark, r=clean.smoothed_death_rate(F.lit(3.0), null)) == (1.5,)


def test_clip_keeps_null(spark):
    floor = F.lit("2020-01-01").cast("date")
    assert one(spark, a=clean.clip_lower(F.lit(None).cast("date"), floor), b=clean.clip_lower(F.lit("2019-05-05").cast("date"), floor)) == (None, D(2020, 1, 1))


def test_missing_month_is_winter(spark):
    null = F.lit(None).cast("int")
    assert one(spark, a=encode.season_code(null), b=encode.season_code(F.lit(8)), c=encode.season_label(null, domain.SEASONS)) == (3, 1, domain.SEASONS[3])


def test_grade_codes(spark):
    df = spark.createDataFrame([(g,) for g in domain.GRADES] + [("?",), (None,)], "g string")
    out = df.select("g", domain.grade_score(F.col("g")).alias("s"), domain.grade_index(F.col("g")).alias("i")).collect()
    assert [r["s"] for r in out] == list(range(15, -1, -1)) + [0, 0]
    assert [r["i"] for r in out] == list(range(16)) + [None, 15]
    assert len(domain.REGIONS) == 19
    assert one(spark, a=domain.region_code(F.lit("충청북도")), b=domain.region_code(F.lit("x")), c=domain.sex_code(F.lit("거세"))) == (18, -1, 2)


def test_grade_parts(spark):
    df = spark.createDataFrame([("1++A",), ("1+C",), ("등외",), (None,), ("zz",)], "g string")
    got = [tuple(r) for r in df.select(domain.quality_of(F.col("g")), domain.yield_of(F.col("g"))).collect()]
    assert got == [("1++", "A"), ("1+", "C"), ("등외", None), (None, None), (None, None)]


def test_yield_index_and_grade(spark):
    index = domain.yield_index(F.lit("암"), F.lit(10.0), F.lit(90.0), F.lit(400.0))
    expected = (6.90137 - 0.9446 * 10 + 0.31806 * 90 + 0.54952 * 400) / 400 * 100
    assert one(spark, i=index)[0] == pytest.approx(expected)
    limits = [("암", 61.83, "A"), ("암", 59.70, "B"), ("암", 59.69, "C"), ("수", 68.45, "A"), ("거세", 60.39, "C")]
    for sex, value, grade in limits:
        assert one(spark, g=domain.yield_grade(F.lit(sex), F.lit(value))) == (grade,)


def test_fill_with_mean_uses_the_training_rows(spark):
    train = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    score = spark.createDataFrame([(None,), (100.0,)], "x double")
    assert sorted(r[0] for r in clean.fill_with_mean(score, "x", train).collect()) == [2.0, 100.0]
    assert clean.fill_with_mean(score, "y", train).first()["y"] == 7.5


def test_narrowing_a_bad_value_gives_null(spark):
    df = spark.createDataFrame([("7",), ("x",)], "a string")
    assert [r[0] for r in clean.narrow(df, {"a": "int"}).collect()] == [7, None]


def test_member_rate_counts_missing_as_no(spark):
    df = spark.createDataFrame([("a", "1++"), ("a", None), ("b", "2"), (None, "1+")], "g string, q string")
    out = profile.member_rate(df, "g", "q", domain.HIGH_QUALITY)
    assert rows(out, "g") == [("a", 0.5, 0.5), ("b", 0.0, 0.5)]


def test_histogram_closes_the_last_bin_and_keeps_empty_ones(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,)], "x double")
    out = profile.histogram(df, "x", 5)
    assert [r["n"] for r in out.orderBy("bin").collect()] == [2, 0, 0, 0, 1]
    flat = profile.histogram(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x", 2).orderBy("bin").collect()
    assert [(r["low"], r["n"]) for r in flat] == [(2.5, 0), (3.0, 2)]


def test_box_stats(spark):
    df = spark.createDataFrame([("g", float(x)) for x in (1, 2, 3, 4, 100)] + [("g", None)], "g string, x double")
    out = profile.box_stats(df, "x", "g").first()
    assert tuple(out) == ("g", 5, 2.0, 3.0, 4.0, 1.0, 4.0, 1)


def test_crosstab_normalises_before_dropping_a_class(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "z"), ("a", None)], "r string, c string")
    assert rows(profile.crosstab_share(df, "r", "c", ["1"]), "r") == [("a", 0.5)]


def test_macro_f1_by_hand(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "d")], "y string, p string")
    got = {r["class"]: r["f1"] for r in metrics.class_f1(df, "y", "p").collect()}
    assert got == pytest.approx({"a": 2 / 3, "b": 2 / 3, "c": 0.0, "d": 0.0})
    assert metrics.macro_f1(df, "y", "p").first()["macro_f1"] == pytest.approx(1 / 3)


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "y string")
    assert {r["y"]: r["weight"] for r in metrics.class_weights(df, "y").collect()} == pytest.approx({"a": 4 / 6, "b": 2.0})


def test_fold_encoding_never_sees_held_out_targets(spark):
    base = [("f", 0, 10.0), ("f", 1, 2.0), ("f", 1, 4.0), ("f", 2, 6.0)]
    schema = "k string, fold int, x double"
    out = encoding.with_fold_encoding(spark.createDataFrame(base, schema), "k", "x", "fold", 3, "e")
    held = out.filter("fold = 0").first()
    assert held["e_0"] == pytest.approx(4.0) and held["e_cnt_0"] == 3
    changed = [(k, f, 999.0 if f == 0 else x) for k, f, x in base]
    again = encoding.with_fold_encoding(spark.createDataFrame(changed, schema), "k", "x", "fold", 3, "e")
    pick = lambda d: sorted((r["fold"], r["x"], r["e_0"]) for r in d.filter("fold <> 0").collect())
    assert pick(out) == pick(again)
    assert pick(out)[0] == (1, 2.0, 5.0)


def test_preceding_days_excludes_the_day_itself(spark):
    daily = spark.createDataFrame([(1, D(2024, 1, 1), 1.0), (1, D(2024, 1, 30), 2.0), (1, D(2024, 1, 31), 4.0)], "stn int, date date, x double")
    facts = spark.createDataFrame([(1, 1, D(2024, 1, 31)), (2, 1, D(2024, 2, 1)), (3, 2, D(2024, 2, 1))], "id int, stn int, at date")
    out = timeseries.preceding_days(facts, daily, ["stn"], "date", "at", 30, {"x_sum": F.col("x")})
    assert rows(out.select("id", "x_sum"), "id") == [(1, 3.0), (2, 6.0), (3, None)]


def test_interval_daily_sums(spark):
    daily = spark.createDataFrame([(1, D(2024, 1, 3), 1), (1, D(2024, 1, 3), 1), (1, D(2024, 1, 6), 5)], "stn int, date date, x int")
    facts = spark.createDataFrame([
        (1, 1, D(2024, 1, 1), D(2024, 1, 5)), (2, 1, D(2024, 1, 4), D(2024, 1, 20)), (3, 1, D(2024, 1, 9), D(2024, 1, 2)),
        (4, 1, D(2023, 1, 1), D(2023, 1, 2)), (5, 8, D(2024, 1, 1), D(2024, 1, 2)), (6, 1, D(2024, 1, 6), D(2024, 1, 6)),
        (7, 1, D(2025, 1, 1), D(2025, 1, 2)),
    ], "id int, stn int, s date, e date")
    out = timeseries.interval_daily_sums(facts, daily, ["stn"], "date", "s", "e", {"t": F.col("x").cast("long")})
    assert rows(out.select("id", "t"), "id") == [(1, 2), (2, 5), (3, None), (4, 0), (5, None), (6, 5), (7, 0)]


def test_fold_deviations_of_large_means_do_not_cancel(spark):
    """Rows of fold 2 and rows outside all folds count for folds 0 and 1; a key of one row has no deviation."""
    rows = [(i, "k", 1e9 + (i % 5) / 4, None if i % 7 == 0 else i % 3) for i in range(60)] + [(99, "one", 5.0, 0)]
    df = spark.createDataFrame(rows, "i int, k string, x double, fold int")
    out = encoding.with_fold_encoding(df, "k", "x", "fold", 3, "e")
    got = {r["k"]: r for r in out.collect()}
    for f in range(3):
        rest = [x for _, k, x, g in rows if k == "k" and g != f]
        assert got["k"][f"e_cnt_{f}"] == len(rest)
        assert math.isclose(got["k"][f"e_std_{f}"], statistics.stdev(rest), rel_tol=1e-6)
        assert got["one"][f"e_std_{f}"] is None
    assert sorted(out.columns) == sorted([*df.columns, *[f"e{m}_{f}" for f in range(3) for m in ("", "_cnt", "_std")]])
