"""Cleaning and scalar column functions.

Every function returns a Column or a DataFrame built from JVM expressions, so
they stay inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

# The input files write a missing measure as one of these.
NUMERIC_SENTINEL = -99
TEXT_SENTINELS = ("-99", "-99.0")

DAYS_PER_MONTH = 30.44


def null_if_sentinel(df: DataFrame, columns: Sequence[str], sentinel=NUMERIC_SENTINEL) -> DataFrame:
    """Numeric sentinel to NULL over a column list, in one projection."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel).cast(df.schema[c].dataType)) for c in columns})


def null_if_text(df: DataFrame, columns: Sequence[str], sentinels: Sequence[str] = TEXT_SENTINELS) -> DataFrame:
    """Text sentinels to NULL over a column list."""
    return df.withColumns({c: F.when(~F.col(c).isin(*sentinels), F.col(c)) for c in columns})


def fill_nulls(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))


def fill_with_mean(df: DataFrame, column: str, reference: DataFrame | None = None, default: float = 7.5) -> DataFrame:
    """NULL to the mean of ``column`` in ``reference`` (the training rows), else ``default``.

    The mean is a scalar subquery: one partial-aggregated pass, no join.
    """
    source = df if reference is None else reference
    if column not in source.columns:
        return df.withColumn(column, F.lit(float(default)))
    mean = source.agg(F.avg(column)).scalar()
    value = F.col(column) if column in df.columns else F.lit(None).cast("double")
    return df.withColumn(column, F.coalesce(value, mean, F.lit(float(default))))


def narrow(df: DataFrame, casts: Mapping[str, str]) -> DataFrame:
    """Cast columns; a value that does not fit becomes NULL instead of failing the job."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in casts.items()})


def iso_date(column: Column | str) -> Column:
    """``yyyy-MM-dd`` text to date; a bad value is NULL."""
    c = F.col(column) if isinstance(column, str) else column
    return F.try_to_date(c.cast("string"), "yyyy-MM-dd")


def compact_date(column: Column | str) -> Column:
    """Integer ``yyyyMMdd`` to date; a bad value is NULL."""
    c = F.col(column) if isinstance(column, str) else column
    return F.try_to_date(c.cast("string"), "yyyyMMdd")


def year_or_zero(d: Column) -> Column:
    return F.coalesce(F.year(d), F.lit(0))


def month_or_zero(d: Column) -> Column:
    return F.coalesce(F.month(d), F.lit(0))


def month_start(d: Column | str) -> Column:
    return F.trunc(d, "MM")


def shift_months(d: Column | str, back: int) -> Column:
    """Shift a date back by whole months, clamped to the month's last day."""
    return F.add_months(d, -back)


def days_between(end: Column, start: Column) -> Column:
    return F.datediff(end, start)


def months_between(end: Column, start: Column) -> Column:
    return F.datediff(end, start) / F.lit(DAYS_PER_MONTH)


def clip_lower(c: Column, floor: Column) -> Column:
    """Lower bound that keeps NULL (``greatest`` would replace a NULL by the floor)."""
    return F.when(c < floor, floor).otherwise(c)


def clip_upper(c: Column, ceiling: Column) -> Column:
    return F.when(c > ceiling, ceiling).otherwise(c)


def row_mean(*columns: Column) -> Column:
    """Mean over columns of one row, skipping NULLs; NULL when all are missing."""
    total, seen = F.lit(0.0), F.lit(0)
    for c in columns:
        total = total + F.coalesce(c.cast("double"), F.lit(0.0))
        seen = seen + c.isNotNull().cast("int")
    return total / F.nullif(seen, F.lit(0))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio with a zero denominator giving NULL."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def smoothed_death_rate(deaths: Column, herd: Column) -> Column:
    return deaths / (F.coalesce(herd, F.lit(1.0)) + F.lit(1.0))


def change_rate(before: Column, after: Column) -> Column:
    return F.try_divide((after - before).cast("double"), before.cast("double"))


def is_member(c: Column, values: Sequence) -> Column:
    """Membership flag; a missing value is False and so stays in a rate's denominator."""
    return F.coalesce(c.isin(*values), F.lit(False))


def first_group(c: Column, pattern: str) -> Column:
    """First capture group, NULL when the pattern does not match."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def stable_round(c: Column, digits: int) -> Column:
    """Round half up, with a small tolerance.

    Partial sums arrive in any order, so a value that is exactly a half may be
    computed a hair below it; the tolerance keeps such halves rounding up.
    """
    scale = float(10**digits)
    return F.floor(c.cast("double") * F.lit(scale) + F.lit(0.500001)) / F.lit(scale)


def with_prefix(df: DataFrame, prefix: str, keep: Sequence[str]) -> DataFrame:
    """Prefix every column but the kept keys."""
    return df.select([F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def present_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Project the wanted columns that exist, in the wanted order."""
    return df.select([c for c in wanted if c in df.columns])


def numeric_features(df: DataFrame, drop: Sequence[str]) -> list[str]:
    """Ordered list of numeric columns outside the drop list."""
    dropped = set(drop)
    return [
        f.name for f in df.schema
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in dropped
    ]


def add_missing(df: DataFrame, columns: Sequence[str], value: float = -999.0) -> DataFrame:
    """Add model columns the frame lacks as a constant."""
    absent = {c: F.lit(float(value)) for c in columns if c not in df.columns}
    return df.withColumns(absent) if absent else df
