"""Profiling queries: counts, shares, rates, summaries, histograms, boxes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.functions.clean import is_member
from gradeframe.operators.joins import attach, lookup_join
from gradeframe.operators.moments import correlations  # noqa: F401  part of this module's interface
from gradeframe.operators.quantiles import SKETCH_ACCURACY, column_quantiles, quantiles_wide
from gradeframe.session import settle

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def _clean(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def value_counts(df: DataFrame, column: str, out: str = "n") -> DataFrame:
    """Rows per value, NULL left out, largest first."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(out))
    return counts.orderBy(F.desc(out), column)


def with_share(counts: DataFrame, count: str, out: str, scale: float = 1.0) -> DataFrame:
    """Share of the grand total, from a scalar subquery (no one-task window)."""
    total = counts.agg(F.sum(count)).scalar()
    return counts.withColumn(out, F.try_divide(F.col(count) * F.lit(float(scale)), total))


def value_shares(df: DataFrame, column: str, out: str = "share") -> DataFrame:
    return with_share(value_counts(df, column), "n", out)


def in_list_order(df: DataFrame, column: str, order: Sequence[str], fill: dict | None = None) -> DataFrame:
    """Rows in an explicit category order: absent ones dropped, or filled and kept.

    Adds ``rank``, the category's 0-based place.
    """
    rank = F.create_map(*[F.lit(x) for i, v in enumerate(order) for x in (v, i)])
    if fill is None:
        ranked = df.withColumn("rank", F.try_element_at(rank, F.col(column))).filter("rank is not null")
        return ranked.orderBy("rank")
    kept = [c for c in df.columns if c != column]
    spine = df.sparkSession.createDataFrame(list(enumerate(order)), f"rank int, {column} string")
    # The spine is the fixed category list, and the other side is one row per category.
    return spine.join(df, column, "left").fillna(fill).select(column, *kept, "rank").orderBy("rank")


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(k)


def preview(df: DataFrame, order_by: Sequence[str], k: int = 5) -> DataFrame:
    return df.orderBy(*order_by).limit(k)


def crosstab_share(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Row-normalised contingency table, one column per listed value.

    Shares are of all non-NULL categories, listed or not; conditional counts
    need one aggregate where a pivot would need two.
    """
    total = F.count(column)
    shares = [F.try_divide(F.count_if(F.col(column) == v).cast("double"), total).alias(str(v)) for v in values]
    return df.dropna(subset=[row, column]).groupBy(row).agg(*shares)


def pivot_means(df: DataFrame, row: str, column: str, values: Sequence, measure: str) -> DataFrame:
    """Group means with one column per listed ``column`` value."""
    return df.dropna(subset=[row, column]).groupBy(row).pivot(column, list(values)).agg(F.avg(measure))


def member_rate(df: DataFrame, group: str, column: str, members: Sequence, out: str = "rate") -> DataFrame:
    """Share of rows whose value is a member, per group, beside the overall share."""
    flag = is_member(F.col(column), members).cast("double")
    # Totals come from the grouped counts, whose shuffle Spark reuses.
    counts = df.groupBy(group).agg(F.sum(flag).alias("_hits"), F.count(F.lit(1)).alias("_rows"))
    overall = counts.agg(F.sum("_hits") / F.sum("_rows")).scalar()
    return counts.filter(F.col(group).isNotNull()).select(
        group, (F.col("_hits") / F.col("_rows")).alias(out), overall.alias("overall")
    )


def scalars(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, min, median, max of a column and the row count."""
    v = _clean(column)
    base = df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(v).alias("n_valid"), F.avg(v).alias("mean"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )
    return attach(base, quantiles_wide(df, column, {"median": 0.5}), [])


def distinct_counts(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct non-NULL values per column."""
    count = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(*[count(F.col(c)).alias(c) for c in columns])


def describe(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles and max, one row per column."""
    if approx:
        pairs = [F.struct(F.lit(c).alias("column"), F.count(_clean(c)).alias("n"), *[m.alias(k) for k, m in _moments(_clean(c)).items()],
                          F.approx_percentile(_clean(c), list(QUARTILES.values()), SKETCH_ACCURACY).alias("_q")) for c in columns]
        rows = df.agg(F.array(*pairs).alias("_m")).select(F.inline("_m"))
        return rows.select("column", "n", "mean", "std", "min", *[F.col("_q")[k].alias(q) for k, q in enumerate(QUARTILES)], "max")
    found = column_quantiles(df, columns, list(QUARTILES.values()), also=_moments)
    quarts = [F.max(F.when(F.col("probability") == p, F.col("value"))).alias(q) for q, p in QUARTILES.items()]
    # A row for each column and quartile.
    wide = found.groupBy("column").agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *[F.max(c).alias(c) for c in ("mean", "std", "min", "max")], *quarts)
    return wide.select("column", "n", "mean", "std", "min", *QUARTILES, "max")


def _moments(v: Column) -> dict[str, Column]:
    return {"mean": F.avg(v), "std": F.stddev_samp(v), "min": F.min(v), "max": F.max(v)}


def group_size_summary(df: DataFrame, key: str) -> DataFrame:
    """Distribution of the number of rows per key."""
    sizes = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    return describe(settle(sizes), ["size"])


def histogram(df: DataFrame, column: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Fixed-width histogram over each group's own range, empty bins included.

    The last bin is closed. ``density`` integrates to 1 over a group.
    """
    by = list(by)
    rows = df.select(*by, _clean(column).alias("_v")).dropna(subset=[*by, "_v"])
    span = F.max("_v") - F.min("_v")
    ranges = rows.groupBy(*by).agg(
        F.when(span > 0, F.min("_v")).otherwise(F.min("_v") - 0.5).alias("_low"),
        (F.when(span > 0, span).otherwise(1.0) / bins).alias("_width"),
        F.count(F.lit(1)).alias("_n"),
    )
    ranges = settle(ranges)
    spot = F.least(F.floor((F.col("_v") - F.col("_low")) / F.col("_width")), F.lit(bins - 1))
    counts = attach(rows, ranges, by).groupBy(*by, spot.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    low = F.col("_low") + F.col("bin") * F.col("_width")
    return (
        grid.join(counts, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        .select(*by, "bin", low.alias("low"), (low + F.col("_width")).alias("high"), "n",
                (F.col("n") / (F.col("_n") * F.col("_width"))).alias("density"))
    )


def box_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles, whiskers at the last value within 1.5 IQR, and outlier count per group."""
    rows = df.select(by, _clean(value).alias("_v")).dropna()
    quart = settle(quantiles_wide(rows, "_v", QUARTILES, [by]))
    reach = (F.col("q75") - F.col("q25")) * 1.5
    inside = F.col("_v").between(F.col("q25") - reach, F.col("q75") + reach)
    whiskers = lookup_join(rows, quart, [by], "inner").groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
        *[F.max(q).alias(q) for q in QUARTILES],
    )
    return whiskers.select(by, "n", *QUARTILES, "whisker_low", "whisker_high", "outliers")


def null_profile(df: DataFrame, table: str) -> DataFrame:
    """Shape of a table and the missing count and percentage of each column."""
    cells = [
        F.struct(F.lit(table).alias("table"), F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"),
                 F.lit(len(df.columns)).alias("n_columns"), F.count_if(F.col(c).isNull()).alias("nulls"))
        for c in df.columns
    ]
    long = df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))
    return long.withColumn("null_pct", F.try_divide(F.col("nulls") * 100.0, F.col("n_rows")))


def null_profiles(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [null_profile(df, name) for name, df in tables.items()])


def class_distribution(df: DataFrame, label: str, classes: Sequence[str]) -> DataFrame:
    """Count and percentage per class of a fixed list, 0 for an absent class."""
    cells = [
        F.struct(F.lit(i).alias("rank"), F.lit(c).alias(label), F.count_if(F.col(label) == c).alias("n"),
                 F.try_divide(F.count_if(F.col(label) == c) * 100.0, F.count(F.lit(1))).alias("pct"))
        for i, c in enumerate(classes)
    ]
    return df.agg(F.array(*cells).alias("_c")).select(F.inline("_c")).orderBy("rank")
