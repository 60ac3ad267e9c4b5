"""The exploratory report: one pure function per section, tables in, table out.

Tables are cleaned once by ``cleaned``; every section reads what it needs, so
sections can run in any order. Figures are left to the reader of the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeframe.functions import binning, clean, domain, encode, weather
from gradeframe.operators import encoding, joins, profile, sampling, timeseries
from gradeframe.plans.grading import FARM, HEADS
from gradeframe.session import settle

MEASURES = ["BACKFAT", "REA", "WINDEX", "INSFAT", "YUKSAK", "FATSAK", "TISSUE", "GROWTH", "COST_AMT"]
NUMERIC = ["WEIGHT", "BACKFAT", "REA", "WINDEX", "INSFAT", "YUKSAK", "FATSAK", "TISSUE", "GROWTH", "AGE", "COST_AMT"]
READINGS = ["ta_max", "ta_min", "rn_day", "rhm_avg", "ws_davg"]


def cleaned(fact: DataFrame) -> DataFrame:
    """Sentinels to NULL, dates parsed, grade parts, seasons and the high-grade part beside."""
    df = clean.null_if_text(clean.null_if_sentinel(fact, MEASURES), ["WGRADE"])
    born = clean.compact_date("BIRTH_YMD")
    return df.withColumns({
        "BIRTH_YMD": born, "quality": domain.quality_of(F.col("LAST_GRADE")), "yield": domain.yield_of(F.col("LAST_GRADE")),
        "abatt_season": encode.season_label(F.month("ABATT_DATE"), domain.SEASONS),
        "birth_season": encode.season_label(F.month(born), domain.SEASONS),
    })


def cleaned_deaths(death: DataFrame) -> DataFrame:
    df = clean.null_if_text(death, ["DEAD_REASON"])
    df = df.withColumns({"BIRTH_YMD": clean.compact_date("BIRTH_YMD"), "DEAD_YMD": clean.compact_date("DEAD_YMD")})
    dead, born = F.col("DEAD_YMD"), F.col("BIRTH_YMD")
    return df.withColumns({"life_days": clean.days_between(dead, born), "life_months": clean.months_between(dead, born)})


def farms(area: DataFrame) -> DataFrame:
    """Mean heads, heads per area and area per head of each farm row."""
    df = area.withColumn("avg_cattle", clean.row_mean(*[F.col(c) for c in HEADS]))
    return df.withColumns({
        "density": clean.safe_ratio(F.col("avg_cattle"), F.col("AREA")),
        "area_per_head": clean.safe_ratio(F.col("AREA"), F.col("avg_cattle")),
    })


def shapes(tables: dict[str, DataFrame]) -> DataFrame:
    return profile.null_profiles(tables)


def grade_counts(fact: DataFrame) -> DataFrame:
    return profile.in_list_order(profile.value_counts(fact, "LAST_GRADE"), "LAST_GRADE", domain.GRADES)


def quality_by_sex(fact: DataFrame) -> DataFrame:
    return profile.crosstab_share(fact, "JUDGE_SEX", "quality", [*domain.QUALITY, domain.OUTSIDE]).drop(domain.OUTSIDE)


def yield_boxes(fact: DataFrame) -> dict[str, DataFrame]:
    return {c: profile.box_stats(fact, c, "yield") for c in ("WEIGHT", "BACKFAT", "REA", "WINDEX")}


def quality_boxes(fact: DataFrame) -> dict[str, DataFrame]:
    kept = fact.filter(F.col("quality") != domain.OUTSIDE)
    return {c: profile.box_stats(kept, c, "quality") for c in ("INSFAT", "YUKSAK", "FATSAK", "TISSUE", "GROWTH")}


def age_by_sex(fact: DataFrame) -> DataFrame:
    return profile.histogram(fact, "AGE", 50, ["JUDGE_SEX"])


def age_and_weight(fact: DataFrame, key: str, n: int = 50_000) -> DataFrame:
    """An exact-size random sample of the two measures, for a scatter figure."""
    return sampling.sample_rows(fact, [key], n).select("JUDGE_SEX", "AGE", "WEIGHT")


def correlation_matrix(fact: DataFrame) -> DataFrame:
    return profile.correlations(fact, NUMERIC)


def high_rate(fact: DataFrame, group: str) -> DataFrame:
    return profile.member_rate(fact, group, "quality", domain.HIGH_QUALITY)


def region_rates(fact: DataFrame) -> DataFrame:
    return high_rate(fact, "sido").orderBy(F.desc("rate"), "sido")


def season_rates(fact: DataFrame, column: str = "abatt_season") -> DataFrame:
    return profile.in_list_order(high_rate(fact, column), column, domain.SEASONS)


def monthly_trend(fact: DataFrame) -> DataFrame:
    month = clean.month_start("ABATT_DATE").alias("month")
    return fact.filter(F.col("ABATT_DATE").isNotNull()).groupBy(month).agg(
        F.count(F.lit(1)).alias("n"), F.avg("WEIGHT").alias("mean_weight"), F.avg("INSFAT").alias("mean_insfat")
    ).orderBy("month")


def daily_readings(daily: DataFrame) -> DataFrame:
    return timeseries.daily_means(daily, "date", READINGS).orderBy("date")


def farm_area(area: DataFrame) -> dict[str, DataFrame]:
    """Distinct farms, means, and histograms of area and area per head below their 99% point."""
    df = farms(area)
    return {
        "farms": profile.distinct_counts(df, [FARM]),
        "means": df.agg(*[F.avg(c).alias(c) for c in [*HEADS, "AREA"]]),
        **{c: profile.histogram(binning.winsorise(df, c, 0.99), c, 50) for c in ("AREA", "area_per_head")},
    }


def deaths(death: DataFrame) -> dict[str, DataFrame]:
    df = cleaned_deaths(death)
    capped = df.withColumn("life_months", clean.clip_upper(F.col("life_months"), F.lit(120.0)))
    return {
        "life": profile.scalars(df, "life_months"), "life_histogram": profile.histogram(capped, "life_months", 60),
        "months": timeseries.gap_filled_counts(df, "DEAD_YMD").orderBy("month"),
    }


def lineage(edges: DataFrame) -> dict[str, DataFrame]:
    sizes = settle(encoding.group_size(edges, "FATHER_CATTLE_NO", "size"))
    return {
        "distinct": profile.distinct_counts(edges, ["CATTLE_NO", "FATHER_CATTLE_NO", "KPN_NO"]),
        "offspring": profile.describe(sizes, ["size"]),
        "histogram": profile.histogram(binning.winsorise(sizes, "size", 0.95), "size", 50),
    }


def prices(fact: DataFrame) -> dict[str, DataFrame]:
    valid = fact.dropna(subset=["COST_AMT"])
    return {
        "summary": profile.scalars(fact, "COST_AMT"),
        "by_quality": profile.box_stats(valid.filter(F.col("quality") != domain.OUTSIDE), "COST_AMT", "quality"),
        "by_marbling": profile.box_stats(valid, "COST_AMT", "INSFAT"),
    }


def coverage(fact: DataFrame, daily: DataFrame, area: DataFrame, death: DataFrame, edges: DataFrame) -> DataFrame:
    """Matched share of every join key."""
    sides = {"stn": (daily, "stn"), "area": (area, FARM), "death": (death, FARM), "lineage": (edges, "CATTLE_NO")}
    parts = [joins.key_coverage(fact, right, k, k).withColumn("table", F.lit(name)) for name, (right, k) in sides.items()]
    return joins.stack_rows(*parts)


def heat(fact: DataFrame, daily: DataFrame, years: list[int]) -> dict[str, DataFrame]:
    """Monthly index by quality class, and the index by calendar month and year."""
    indexed = weather.with_index(daily)
    monthly = settle(timeseries.monthly_rollup(indexed, ["stn"], "date", weather.index_aggregates()))
    joined = timeseries.month_join(fact, monthly, ["stn"], "ABATT_DATE").filter(F.col("quality") != domain.OUTSIDE)
    dated = indexed.withColumns({"year": F.year("date"), "month": F.month("date")})
    return {
        "boxes": profile.box_stats(joined, "thi_mean", "quality"),
        "heat_days": joined.dropna(subset=["quality"]).groupBy("quality").agg(F.avg("heat2d").alias("heat2d")),
        "by_year": profile.pivot_means(dated, "month", "year", years, "thi").orderBy("month"),
    }


def sires(fact: DataFrame, edges: DataFrame, support: int = 30) -> dict[str, DataFrame]:
    """Sire means with enough offspring, and quality shares of the best and worst sires' offspring."""
    parents = settle(joins.unique_lookup(edges.select("CATTLE_NO", "FATHER_CATTLE_NO", "KPN_NO"), ["CATTLE_NO"], ["FATHER_CATTLE_NO"]))
    bred = joins.lookup_join(fact.select("CATTLE_NO", "INSFAT", "quality"), parents, ["CATTLE_NO"], "left")
    means = settle(encoding.mean_with_support(bred, "FATHER_CATTLE_NO", "INSFAT", support, "father_insfat", "n"))
    shares = lambda kept: profile.in_list_order(
        profile.value_shares(joins.keep_key_members(bred, kept, ["FATHER_CATTLE_NO"]), "quality").drop("n"),
        "quality", domain.QUALITY, {"share": 0.0},
    )
    return {
        "means": means, "histogram": profile.histogram(means, "father_insfat", 40),
        "top": shares(binning.at_or_above_quantile(means, "father_insfat", 0.75)),
        "bottom": shares(binning.at_or_below_quantile(means, "father_insfat", 0.25)),
    }


def herd_rates(fact: DataFrame, area: DataFrame) -> dict[str, DataFrame]:
    """High-grade rate by herd size and by density quartile (quartiles over graded_rows)."""
    lookup = settle(joins.unique_lookup(farms(area).select(FARM, "avg_cattle", "density"), [FARM], ["avg_cattle", "density"]))
    df = joins.lookup_join(fact, lookup, [FARM], "left")
    sized = df.withColumn("size", binning.fixed_bins(F.col("avg_cattle"), domain.HERD_EDGES, domain.HERD_LABELS))
    banded = binning.quantile_bins(df, "density", domain.DENSITY_LABELS, "band", clip_at=0.99)
    return {"size": high_rate(sized, "size"), "density": high_rate(banded, "band")}
