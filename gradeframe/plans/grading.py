"""Grading feature plans: the baseline and the full one.

Everything is one lazy plan per data set, built from the operators. Small
lookups (months, farms, encodings) are settled once because several joins read
them; the fact table is never gathered or chunked.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from gradeframe.functions import clean, domain, encode, weather
from gradeframe.operators import encoding, joins, timeseries
from gradeframe.session import settle

FARM = "FARM_UNIQUE_NO"
HEADS = ["C2023", "C2024", "C2025"]
WEATHER_START = "2020-01-01"
LAGS = {"s_": 0, "p1_": 1, "p2_": 2, "p3_": 3}
MISSING_FEATURE = -999.0

ROW_FEATURES = [
    "stn", "WEIGHT", "AGE", "abatt_year", "abatt_month", "abatt_season", "birth_year", "birth_month",
    "birth_season", "sex_code", "sido_code",
]
INTERACTIONS = ["age_sq", "age_sex", "age_abatt_season"]
FARM_FEATURES = ["avg_cattle", "density", "death_cnt", "death_rate"]
ENCODING_FEATURES = ["farm_grade_loo", "farm_grade_cnt", "farm_grade_std"]
REARING_FEATURES = [
    "rear_ta_mean", "rear_ta_max", "rear_ta_min", "rear_thi_mean", "rear_thi_max", "rear_rhm_mean",
    "rear_heat2d_total", "rear_heat3d_total", "rear_cold_d_total", "rear_rn_total", "rear_month_cnt",
    "rear_summer_thi", "rear_summer_heat", "rear_winter_ta", "rear_winter_cold",
]
WEATHER_FEATURES = [p + m for p in [*LAGS, "b_"] for m in weather.FULL_METRICS]
# The farm's plain mean contains a row's own grade, so it is no training feature.
FEATURES = ROW_FEATURES + INTERACTIONS + WEATHER_FEATURES + FARM_FEATURES + ENCODING_FEATURES + REARING_FEATURES

BASE_METRICS = ["ta_mean", "thi_mean", "thi_max", "rhm_mean", "heat2d", "heat3d", "cold_d", "rn_sum"]
BASELINE_FEATURES = (
    ROW_FEATURES + [p + m for p in ("s_", "b_") for m in BASE_METRICS] + FARM_FEATURES
    + ["farm_insfat", "farm_backfat", "father_insfat", "kpn_insfat"]
)


@dataclass(frozen=True)
class Lookups:
    """Small tables every row's features are looked up in."""

    monthly: DataFrame
    farms: DataFrame


def monthly_weather(daily: DataFrame, base: bool = False) -> DataFrame:
    aggregates = weather.base_aggregates() if base else weather.full_aggregates()
    return timeseries.monthly_rollup(weather.with_index(daily), ["stn"], "date", aggregates)


def farm_table(area: DataFrame, death: DataFrame) -> DataFrame:
    """One row per farm: mean heads, heads per area and death count.

    Death counts cover farms without an area row too, hence the full join of
    two per-farm tables.
    """
    cleaned = clean.null_if_sentinel(area, [*HEADS, "AREA"])
    heads = clean.row_mean(*[F.col(c) for c in HEADS])
    per_farm = cleaned.withColumn("avg_cattle", heads).select(
        FARM, "avg_cattle", clean.safe_ratio(F.col("avg_cattle"), F.col("AREA")).alias("density")
    )
    per_farm = joins.unique_lookup(per_farm, [FARM], ["avg_cattle", "density"])
    return per_farm.join(encoding.group_size(death, FARM, "death_cnt"), FARM, "full")


def lookups(weather_daily: DataFrame, area: DataFrame, death: DataFrame, base: bool = False) -> Lookups:
    return Lookups(settle(monthly_weather(weather_daily, base)), settle(farm_table(area, death)))


def typed_fact(fact: DataFrame) -> DataFrame:
    """Parse the compact birth date; the slaughter date is typed by the scan."""
    return fact.withColumn("BIRTH_YMD", clean.compact_date("BIRTH_YMD"))


def with_row_features(df: DataFrame) -> DataFrame:
    """Date parts, seasons and codes of the row itself."""
    killed, born = F.col("ABATT_DATE"), F.col("BIRTH_YMD")
    return df.withColumns({
        "abatt_year": clean.year_or_zero(killed), "abatt_month": clean.month_or_zero(killed),
        "abatt_season": encode.season_code(F.month(killed)),
        "birth_year": clean.year_or_zero(born), "birth_month": clean.month_or_zero(born),
        "birth_season": encode.season_code(F.month(born)),
        "sex_code": domain.sex_code(F.col("JUDGE_SEX")), "sido_code": domain.region_code(F.col("sido")),
    })


def with_interactions(df: DataFrame) -> DataFrame:
    age = F.col("AGE")
    return df.withColumns({
        "age_sq": (age * age).cast("double"), "age_sex": age * F.col("sex_code"),
        "age_abatt_season": age * F.col("abatt_season"),
    })


def with_farm(df: DataFrame, farms: DataFrame, *others: DataFrame, **join) -> DataFrame:
    """Farm features, and whatever other lookups there are by farm, with one join of the rows."""
    out = joins.lookup_joins(df, [farms, *others], [FARM], **join)
    out = out.withColumn("death_cnt", F.coalesce("death_cnt", F.lit(0)))
    return out.withColumn("death_rate", clean.smoothed_death_rate(F.col("death_cnt"), F.col("avg_cattle")))


def _hot_months(base: DataFrame, date: str) -> DataFrame:
    return joins.hot_keys(base.select("stn", F.trunc(date, "MM").alias("month")), ["stn", "month"])


def rearing_table(fact: DataFrame, tables: Lookups, weather_start: str = WEATHER_START, **join) -> DataFrame:
    """Rearing weather of every distinct (station, birth month, slaughter month)."""
    return timeseries.interval_measures(
        fact, tables.monthly, ["stn"], "BIRTH_YMD", "ABATT_DATE", *weather.rearing_measures(),
        floor=F.lit(weather_start).cast("date"), **join,
    )


def common_features(
    fact: DataFrame, base: DataFrame, tables: Lookups, weather_start: str = WEATHER_START,
    by_farm: Sequence[DataFrame] = (), hot_farms: Callable[[], DataFrame] | None = None, **join,
) -> DataFrame:
    """Features that training and scoring rows share, and further lookups by farm.

    Slaughter-month and three lag months come from one join on the month, the
    birth month from a second one, the rearing period from a third. Lookups by
    farm grow with the farms and move the rows, those by calendar don't, so the
    farm comes first, while rows are narrow. ``base`` is
    the same rows before any join: what is counted over the rows is counted
    there, so that the chain of joins runs once.
    """
    floor = F.lit(weather_start).cast("date")
    rearing = rearing_table(base, tables, weather_start, **join)
    hot_months = lambda date: lambda: _hot_months(base, date)
    hot_farms = hot_farms or (lambda: joins.hot_keys(base, [FARM]))
    df = with_farm(fact, tables.farms, *by_farm, hot=hot_farms, **join)
    df = with_interactions(with_row_features(df))
    shifted = settle(timeseries.lagged_lookup(tables.monthly, ["stn"], "month", LAGS))
    df = timeseries.month_join(df, shifted, ["stn"], "ABATT_DATE", hot=hot_months("ABATT_DATE"), **join)
    birth = clean.with_prefix(tables.monthly, "b_", ["stn", "month"])
    df = timeseries.month_join(df, birth, ["stn"], "BIRTH_YMD", hot=hot_months("BIRTH_YMD"), **join)
    return timeseries.apply_interval_table(df, rearing, ["stn"], "BIRTH_YMD", "ABATT_DATE", floor, **join)


def with_target(fact: DataFrame) -> DataFrame:
    """Ordinal grade score and class index."""
    grade = F.col("LAST_GRADE")
    return fact.withColumns({
        "grade_score": domain.grade_score(grade).cast("double"), "label": domain.grade_index(grade, strict=True),
    })


def training_features(fact: DataFrame, tables: Lookups, weather_start: str = WEATHER_START, **join) -> DataFrame:
    base = with_target(typed_fact(fact))
    table = encoding.leave_one_out_table(base, FARM, "grade_score", "farm_grade")
    hot = lambda: joins.heavy_groups(table, [FARM], "_rows")
    df = common_features(base, base, tables, weather_start, [table.drop("_rows")], hot, **join)
    return encoding.without_own(df, "grade_score", "farm_grade")


def encoding_table(fact: DataFrame) -> DataFrame:
    """Farm encodings of the training rows, for scoring."""
    return encoding.encoding_stats(with_target(fact), FARM, "grade_score", "farm_grade")


def scoring_features(
    fact: DataFrame, tables: Lookups, encodings: DataFrame, training: DataFrame,
    weather_start: str = WEATHER_START, **join,
) -> DataFrame:
    """Scoring rows: the training encoding stands in for the leave-one-out mean.

    An unseen farm keeps a NULL there and takes the training mean of the plain
    encoding. All three statistics come from one join.
    """
    base = typed_fact(fact).drop("LAST_GRADE")
    df = encoding.apply_encoding(base, encodings, FARM, "farm_grade", hot=lambda: joins.hot_keys(base, [FARM]), **join)
    df = df.withColumn("farm_grade_loo", F.col("farm_grade_mean"))
    mean = with_target(training).select(F.col("grade_score").alias("farm_grade_mean"))
    df = clean.fill_with_mean(df, "farm_grade_mean", mean)
    return common_features(df, base, tables, weather_start, **join)


def pedigree(lineage: DataFrame) -> DataFrame:
    """One sire and strain per animal, settled because several joins read it."""
    columns = ["CATTLE_NO", "FATHER_CATTLE_NO", "KPN_NO"]
    return settle(joins.unique_lookup(lineage.select(*columns), ["CATTLE_NO"], columns[1:]))


def target_statistics(train: DataFrame, parents: DataFrame, **join) -> dict[str, DataFrame]:
    """Baseline encodings: marbling mean per sire and strain, both means per farm."""
    measured = clean.null_if_sentinel(train.select("CATTLE_NO", FARM, "INSFAT", "BACKFAT"), ["INSFAT", "BACKFAT"])
    bred = joins.lookup_join(measured, parents, ["CATTLE_NO"], "left", **join)
    means = {
        "FATHER_CATTLE_NO": encoding.target_means(bred, "FATHER_CATTLE_NO", {"father_insfat": "INSFAT"}, True),
        "KPN_NO": encoding.target_means(bred, "KPN_NO", {"kpn_insfat": "INSFAT"}, True),
        FARM: encoding.target_means(measured, FARM, {"farm_insfat": "INSFAT", "farm_backfat": "BACKFAT"}),
    }
    return {key: settle(table) for key, table in means.items()}


def baseline_features(fact: DataFrame, tables: Lookups, parents: DataFrame, statistics: dict[str, DataFrame], **join) -> DataFrame:
    """Baseline rows: slaughter and birth month weather, farm, sire and strain means.

    Lookups by animal and farm move the rows and come first, while rows are narrow.
    """
    base = typed_fact(fact)
    df = joins.lookup_join(base, parents, ["CATTLE_NO"], "left", lambda: joins.hot_keys(base, ["CATTLE_NO"]), **join)
    for key, means in statistics.items():
        if key == FARM:
            continue
        bred = lambda: base.select("CATTLE_NO", FARM).join(parents, "CATTLE_NO", "left")
        df = joins.lookup_join(df, means, [key], "left", lambda key=key: joins.hot_keys(bred(), [key]), **join)
    df = with_farm(df, tables.farms, statistics[FARM], hot=lambda: joins.hot_keys(base, [FARM]), **join)
    df = with_row_features(df)
    for prefix, date in (("s_", "ABATT_DATE"), ("b_", "BIRTH_YMD")):
        renamed = clean.with_prefix(tables.monthly, prefix, ["stn", "month"])
        hot = lambda date=date: _hot_months(base, date)
        df = timeseries.month_join(df, renamed, ["stn"], date, hot=hot, **join)
    return df
