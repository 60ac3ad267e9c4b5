"""Weather index columns and the aggregate lists of the monthly rollups."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gradeframe.operators.intervals import months_in

# Index thresholds for moderate and severe heat, and for a cold day.
HEAT_MODERATE = 80
HEAT_SEVERE = 85
COLD_BELOW = -5


def mid_range(high: Column, low: Column) -> Column:
    return (high + low) / 2


def heat_humidity_index(temperature: Column, humidity: Column) -> Column:
    t = temperature * F.lit(1.8)
    return (t + F.lit(32)) - (F.lit(0.55) - humidity * F.lit(0.0055)) * (t - F.lit(26))


def with_index(daily, high="ta_max", low="ta_min", humidity="rhm_avg"):
    """Add the daily mid-range temperature and the temperature-humidity index."""
    return daily.withColumn("ta_avg", mid_range(F.col(high), F.col(low))).withColumn(
        "thi", heat_humidity_index(F.col("ta_avg"), F.col(humidity))
    )


def zero_sum(c: Column) -> Column:
    """Sum that is 0, not NULL, for an all-missing group."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def index_aggregates() -> list[Column]:
    """Monthly index mean and heat-day counts."""
    thi = F.col("thi")
    return [
        F.avg(thi).alias("thi_mean"),
        F.count_if(thi >= HEAT_MODERATE).alias("heat2d"),
        F.count_if(thi >= HEAT_SEVERE).alias("heat3d"),
    ]


def base_aggregates() -> list[Column]:
    """Eight monthly metrics."""
    thi = F.col("thi")
    return [
        F.avg("ta_avg").alias("ta_mean"),
        F.avg(thi).alias("thi_mean"),
        F.max(thi).alias("thi_max"),
        F.avg("rhm_avg").alias("rhm_mean"),
        F.count_if(thi >= HEAT_MODERATE).alias("heat2d"),
        F.count_if(thi >= HEAT_SEVERE).alias("heat3d"),
        F.count_if(F.col("ta_min") < COLD_BELOW).alias("cold_d"),
        zero_sum(F.col("rn_day")).alias("rn_sum"),
    ]


def full_aggregates() -> list[Column]:
    """Eleven monthly metrics: the base list plus mean highs, lows and wind."""
    return base_aggregates() + [
        F.avg("ta_max").alias("ta_max_mean"),
        F.avg("ta_min").alias("ta_min_mean"),
        F.avg("ws_davg").alias("ws_mean"),
    ]


FULL_METRICS = [
    "ta_mean", "ta_max_mean", "ta_min_mean", "thi_mean", "thi_max", "rhm_mean",
    "heat2d", "heat3d", "cold_d", "rn_sum", "ws_mean",
]


def _in_season(months: tuple[int, ...]) -> Column:
    return F.month("month").isin(*months)


def _season_sum(months: tuple[int, ...], metric: str) -> Column:
    """Sum over season months: NULL without such a month, 0 when none has weather."""
    inside = _in_season(months)
    return F.when(F.count_if(inside) > 0, F.coalesce(F.sum(F.when(inside, F.col(metric))), F.lit(0)))


def rearing_aggregates() -> list[Column]:
    """Whole-interval metrics over month rows; means are unweighted means of month means."""
    summer, winter = (6, 7, 8), (12, 1, 2)
    return [
        F.avg("ta_mean").alias("rear_ta_mean"),
        F.avg("ta_max_mean").alias("rear_ta_max"),
        F.avg("ta_min_mean").alias("rear_ta_min"),
        F.avg("thi_mean").alias("rear_thi_mean"),
        F.max("thi_max").alias("rear_thi_max"),
        F.avg("rhm_mean").alias("rear_rhm_mean"),
        F.coalesce(F.sum("heat2d"), F.lit(0)).alias("rear_heat2d_total"),
        F.coalesce(F.sum("heat3d"), F.lit(0)).alias("rear_heat3d_total"),
        F.coalesce(F.sum("cold_d"), F.lit(0)).alias("rear_cold_d_total"),
        zero_sum(F.col("rn_sum")).alias("rear_rn_total"),
        F.count("ta_mean").alias("rear_month_cnt"),
        F.avg(F.when(_in_season(summer), F.col("thi_mean"))).alias("rear_summer_thi"),
        _season_sum(summer, "heat2d").alias("rear_summer_heat"),
        F.avg(F.when(_in_season(winter), F.col("ta_mean"))).alias("rear_winter_ta"),
        _season_sum(winter, "cold_d").alias("rear_winter_cold"),
    ]


def rearing_measures() -> tuple[dict[str, Column], dict[str, Column], dict[str, Column]]:
    """The same metrics as sums and maxima of months, and how they are made of them."""
    summer, winter = (6, 7, 8), (12, 1, 2)
    means = {"rear_ta_mean": "ta_mean", "rear_ta_max": "ta_max_mean", "rear_ta_min": "ta_min_mean", "rear_thi_mean": "thi_mean", "rear_rhm_mean": "rhm_mean"}
    totals = {"rear_heat2d_total": "heat2d", "rear_heat3d_total": "heat3d", "rear_cold_d_total": "cold_d"}
    sums = {m: F.col(m) for m in (*means.values(), *totals.values(), "rn_sum")} | {
        "summer_thi": F.when(_in_season(summer), F.col("thi_mean")), "summer_heat": F.when(_in_season(summer), F.col("heat2d")),
        "winter_ta": F.when(_in_season(winter), F.col("ta_mean")), "winter_cold": F.when(_in_season(winter), F.col("cold_d")),
    }
    mean = lambda m: F.try_divide(F.col(m), F.col(f"{m}_count"))
    zero = lambda m: F.coalesce(F.col(m), F.lit(0))

    def seasonal(months: tuple[int, ...], m: str) -> Column:
        # The months of the interval count, with weather or without.
        return F.when(months_in(F.col("_first_month"), F.col("_last_month"), months) > 0, zero(m))

    derived = (
        {name: mean(m) for name, m in means.items()} | {"rear_thi_max": F.col("thi_max")} | {name: zero(m) for name, m in totals.items()}
        | {"rear_rn_total": F.coalesce(F.col("rn_sum"), F.lit(0.0)), "rear_month_cnt": F.col("ta_mean_count"), "rear_summer_thi": mean("summer_thi"),
           "rear_summer_heat": seasonal(summer, "summer_heat"), "rear_winter_ta": mean("winter_ta"), "rear_winter_cold": seasonal(winter, "winter_cold")}
    )
    return sums, {"thi_max": F.col("thi_max")}, derived
