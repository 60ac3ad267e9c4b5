"""Calendar rollups and joins of facts to a time series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gradeframe.functions.clean import clip_lower
from gradeframe.operators import intervals
from gradeframe.operators.joins import heavy_groups, lookup_join
from gradeframe.session import settle, spread

ONE_MONTH = "interval 1 month"
ONE_DAY = "interval 1 day"


def monthly_rollup(daily: DataFrame, keys: Sequence[str], date: str, aggregates: Sequence[Column]) -> DataFrame:
    """Aggregate a daily series per key and calendar month (``month``, its first day)."""
    keys = list(keys)
    return (
        daily.dropna(subset=[*keys, date]).withColumn("month", F.trunc(date, "MM"))
        .groupBy(*keys, "month").agg(*aggregates)
    )


def lagged_lookup(monthly: DataFrame, keys: Sequence[str], month: str, lags: Mapping[str, int]) -> DataFrame:
    """Monthly metrics of several earlier months side by side, per key and month.

    ``lags`` maps a column prefix to the number of months back. The shifting
    happens on the small monthly table, so a fact table needs one join for all
    lags. A month the series lacks gives NULLs, as a join per lag would.
    """
    keys = list(keys)
    metrics = [c for c in monthly.columns if c not in keys and c != month]
    shifts = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(k).alias("k")) for p, k in lags.items()])
    moved = monthly.withColumn("_l", F.explode(shifts)).withColumn(month, F.add_months(F.col(month), F.col("_l.k")))
    fields = [
        F.max(F.when(F.col("_l.p") == p, F.col(m))).alias(f"{p}{m}") for p in lags for m in metrics
    ]
    return moved.groupBy(*keys, month).agg(*fields)


def month_join(fact: DataFrame, monthly: DataFrame, keys: Sequence[str], date: str, month: str = "month", **join) -> DataFrame:
    """Left join a fact to a monthly table at the month of ``date``."""
    at = fact.withColumn(month, F.trunc(date, "MM"))
    return lookup_join(at, monthly, [*keys, month], "left", **join).drop(month)


def _spans(fact: DataFrame, start: str, end: str, floor: Column | None) -> DataFrame:
    begin = F.col(start) if floor is None else clip_lower(F.col(start), floor)
    valid = begin <= F.col(end)
    return fact.withColumns({
        "_from": F.when(valid, F.trunc(begin, "MM")), "_to": F.when(valid, F.trunc(end, "MM")),
    })


def interval_table(
    fact: DataFrame, monthly: DataFrame, keys: Sequence[str], start: str, end: str,
    aggregates: Sequence[Column], floor: Column | None = None, **join,
) -> DataFrame:
    """Aggregates of a monthly table for every distinct interval of the fact rows.

    Rows that share keys, start month and end month share the answer, so only
    the distinct intervals are expanded; their number is bounded by the calendar
    and the keys, not by the fact rows.
    """
    span_key = [*keys, "_from", "_to"]
    distinct = (
        _spans(fact, start, end, floor).dropna(subset=span_key).groupBy(*span_key).agg(F.count(F.lit(1)).alias("_rows"))
    )
    # The final aggregate keeps this partitioning, so it adds no shuffle of the expanded rows.
    months = spread(distinct, span_key).withColumn("month", F.explode(F.sequence("_from", "_to", F.expr(ONE_MONTH))))
    covered = lookup_join(months, monthly, [*keys, "month"], "left", **join)
    return settle(covered.groupBy(*span_key).agg(*aggregates, F.first("_rows").alias("_rows")))


def apply_interval_table(
    fact: DataFrame, table: DataFrame, keys: Sequence[str], start: str, end: str, floor: Column | None = None, **join,
) -> DataFrame:
    span_key = [*keys, "_from", "_to"]
    hot = lambda: heavy_groups(table, span_key, "_rows")
    spans = _spans(fact, start, end, floor)
    return lookup_join(spans, table.drop("_rows"), span_key, "left", hot, **join).drop("_from", "_to")


def interval_rollup(
    fact: DataFrame, monthly: DataFrame, keys: Sequence[str], start: str, end: str,
    aggregates: Sequence[Column], floor: Column | None = None, **join,
) -> DataFrame:
    """Aggregate a monthly table over each row's own months, ends included.

    Rows without a valid interval get NULLs.
    """
    table = interval_table(fact, monthly, keys, start, end, aggregates, floor, **join)
    return apply_interval_table(fact, table, keys, start, end, floor, **join)


def interval_measures(
    fact: DataFrame, monthly: DataFrame, keys: Sequence[str], start: str, end: str,
    sums: Mapping[str, Column], largest: Mapping[str, Column], derived: Mapping[str, Column], floor: Column | None = None, **join,
) -> DataFrame:
    """Like `interval_table`, for measures of a monthly table that running totals and a sparse table can tell.

    Nothing is expanded: each distinct interval takes two lookups, however long
    it is. ``derived`` makes the wanted columns of the sums (``x`` and
    ``x_count``), the maxima and the month numbers ``_first_month`` and ``_last_month``.
    """
    span_key = [*keys, "_from", "_to"]
    spans = (
        _spans(fact, start, end, floor).dropna(subset=span_key).groupBy(*span_key).agg(F.count(F.lit(1)).alias("_rows"))
        .withColumns({"_first_month": intervals.month_number(F.col("_from")), "_last_month": intervals.month_number(F.col("_to"))})
    )
    index = intervals.interval_index(monthly, keys, intervals.month_number(F.col("month")), sums, largest)
    measured = intervals.interval_values(spans, index, F.col("_first_month"), F.col("_last_month"), **join)
    return settle(measured.select(*span_key, *[c.alias(n) for n, c in derived.items()], "_rows"))


def preceding_days(
    fact: DataFrame, daily: DataFrame, keys: Sequence[str], date: str, at: str, days: int,
    sums: Mapping[str, Column], **join,
) -> DataFrame:
    """Add daily sums over the ``days`` days before ``at`` (that day excluded).

    Every distinct (key, date) of the facts takes two lookups in an index of
    running totals, so the cost doesn't depend on the number of days. A window
    without any value gives NULLs.
    """
    keys = list(keys)
    index = intervals.interval_index(daily, keys, intervals.day_number(F.col(date)), sums)
    asked = fact.select(*keys, F.col(at).alias("_at")).dropna().groupBy(*keys, "_at").agg(F.count(F.lit(1)).alias("_rows"))
    day = intervals.day_number(F.col("_at"))
    rolled = settle(intervals.interval_values(asked, index, day - days, day - 1, **join).select(*keys, "_at", *sums, "_rows"))
    hot = lambda: heavy_groups(rolled, [*keys, "_at"], "_rows")
    return lookup_join(fact.withColumn("_at", F.col(at)), rolled.drop("_rows"), [*keys, "_at"], "left", hot, **join).drop("_at")


def interval_daily_sums(
    fact: DataFrame, daily: DataFrame, keys: Sequence[str], date: str, start: str, end: str,
    sums: Mapping[str, Column], **join,
) -> DataFrame:
    """Add daily sums over each row's own days, ends included.

    Running totals over one row per key and calendar day, gaps filled, turn any
    interval into the difference of two lookups. Totals that must be exact
    should be counts or integers. Invalid intervals and unknown keys give NULLs.
    """
    keys, names = list(keys), list(sums)
    per_day = settle(
        daily.dropna(subset=[*keys, date]).groupBy(*keys, F.col(date).alias("_d")).agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()]
        )
    )
    ends = settle(per_day.groupBy(*keys).agg(F.min("_d").alias("_min"), F.max("_d").alias("_max")))
    # One row per key and calendar day, so each window is bounded by the calendar.
    spine = spread(ends, keys).select(
        *keys, F.explode(F.sequence(F.date_sub("_min", 1), F.col("_max"), F.expr(ONE_DAY))).alias("_d")
    )
    running = W.partitionBy(*keys).orderBy("_d").rowsBetween(W.unboundedPreceding, 0)
    totals = settle(
        spine.join(per_day, [*keys, "_d"], "left")
        .select(*keys, "_d", *[F.sum(F.coalesce(F.col(n), F.lit(0))).over(running).alias(n) for n in names])
    )
    placed = lookup_join(fact, ends, keys, "left", **join)
    inside = lambda d: F.greatest(F.date_sub("_min", 1), F.least(d, F.col("_max")))
    valid = (F.col(start) <= F.col(end)) & F.col("_min").isNotNull()
    placed = placed.withColumns({
        "_a": F.when(valid, inside(F.date_sub(start, 1))), "_z": F.when(valid, inside(F.col(end))),
    })
    first = totals.select(*keys, F.col("_d").alias("_a"), *[F.col(n).alias(f"_a_{n}") for n in names])
    last = totals.select(*keys, F.col("_d").alias("_z"), *[F.col(n).alias(f"_z_{n}") for n in names])
    out = lookup_join(placed, first, [*keys, "_a"], "left", **join)
    out = lookup_join(out, last, [*keys, "_z"], "left", **join)
    added = {n: F.col(f"_z_{n}") - F.col(f"_a_{n}") for n in names}
    helper = ["_min", "_max", "_a", "_z"] + [f"_{x}_{n}" for n in names for x in "az"]
    return out.withColumns(added).drop(*helper)


def daily_means(daily: DataFrame, date: str, columns: Sequence[str]) -> DataFrame:
    """Mean of several measures per date over all keys."""
    return daily.filter(F.col(date).isNotNull()).groupBy(date).agg(*[F.avg(c).alias(c) for c in columns])


def gap_filled_counts(df: DataFrame, date: str, out: str = "n", start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows per calendar month, with 0 for months without any.

    The months run from the first to the last in the data, or from ``start`` or
    to ``end`` where those lie further out.
    """
    counts = settle(
        df.filter(F.col(date).isNotNull()).groupBy(F.trunc(date, "MM").alias("month")).agg(F.count(F.lit(1)).alias(out))
    )
    bound = lambda d: F.trunc(F.lit(d).cast("date"), "MM")
    spine = counts.agg(F.least(F.min("month"), bound(start)).alias("a"), F.greatest(F.max("month"), bound(end)).alias("z")).filter("a is not null and z is not null").select(
        F.explode(F.sequence("a", "z", F.expr(ONE_MONTH))).alias("month")
    )
    return spine.join(counts, "month", "left").withColumn(out, F.coalesce(out, F.lit(0)))
