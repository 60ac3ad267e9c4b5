"""Target encodings: plain, leave-one-out and fold-safe."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, functions as F

from gradeframe.operators.joins import heavy_groups, lookup_join
from gradeframe.session import settle


def target_means(df: DataFrame, key: str, targets: Mapping[str, str], drop_missing: bool = False) -> DataFrame:
    """Mean of each target per key; ``targets`` maps output name to column.

    ``drop_missing`` also drops keys none of whose rows has the target.
    """
    subset = [key, *targets.values()] if drop_missing else [key]
    return df.dropna(subset=subset).groupBy(key).agg(*[F.avg(c).alias(n) for n, c in targets.items()])


def group_size(df: DataFrame, key: str, out: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(out))


def encoding_stats(df: DataFrame, key: str, target: str, prefix: str) -> DataFrame:
    """Mean, count and sample deviation of a target per key, in one aggregate."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.avg(target).alias(f"{prefix}_mean"),
        F.count(target).alias(f"{prefix}_cnt"),
        F.stddev_samp(target).alias(f"{prefix}_std"),
    )


def mean_with_support(df: DataFrame, key: str, target: str, minimum: int, mean: str, count: str) -> DataFrame:
    """Mean and count per key, for keys with at least ``minimum`` valid rows."""
    return (
        df.dropna(subset=[key, target]).groupBy(key)
        .agg(F.avg(target).alias(mean), F.count(target).alias(count))
        .filter(F.col(count) >= minimum)
    )


def apply_encoding(df: DataFrame, stats: DataFrame, key: str, prefix: str, **join) -> DataFrame:
    """Look a trained encoding up; an unseen key gets NULL mean and count 0."""
    return unseen_as_zero(lookup_join(df, stats, [key], "left", **join), prefix)


def unseen_as_zero(df: DataFrame, prefix: str) -> DataFrame:
    """Count 0 where a looked-up encoding has no row."""
    return df.withColumn(f"{prefix}_cnt", F.coalesce(F.col(f"{prefix}_cnt"), F.lit(0)))


def leave_one_out_table(df: DataFrame, key: str, target: str, prefix: str) -> DataFrame:
    """Per key: target sum, count, mean and deviation, and the number of rows."""
    return settle(
        df.filter(F.col(key).isNotNull()).groupBy(key).agg(
            F.sum(target).alias("_sum"), F.count(target).alias(f"{prefix}_cnt"),
            F.avg(target).alias(f"{prefix}_mean"), F.stddev_samp(target).alias(f"{prefix}_std"),
            F.count(F.lit(1)).alias("_rows"),
        )
    )


def apply_leave_one_out(
    df: DataFrame, table: DataFrame, key: str, target: str, prefix: str,
    singleton: str = "zero", prior: float | None = None, **join,
) -> DataFrame:
    """Join the table back and take each row's own target out of its key's mean."""
    hot = lambda: heavy_groups(table, [key], "_rows")
    out = lookup_join(df, table.drop("_rows"), [key], "left", hot, **join)
    return without_own(out, target, prefix, singleton, prior)


def without_own(df: DataFrame, target: str, prefix: str, singleton: str = "zero", prior: float | None = None) -> DataFrame:
    """The leave-one-out mean of rows that carry their key's sum and count already."""
    count = F.col(f"{prefix}_cnt")
    loo = (F.col("_sum") - F.col(target)) / F.when(count > 1, count - 1).otherwise(1)
    alone = {"zero": loo, "null": F.lit(None).cast("double"), "prior": F.lit(prior).cast("double")}[singleton]
    return df.withColumn(f"{prefix}_loo", F.when(count <= 1, alone).otherwise(loo)).drop("_sum")


def with_leave_one_out(
    df: DataFrame, key: str, target: str, prefix: str,
    singleton: str = "zero", prior: float | None = None, **join,
) -> DataFrame:
    """Add the leave-one-out mean beside the key's mean, count and deviation.

    The key totals are aggregated (combined on the map side) and joined back,
    instead of a window that would gather a heavy key in one task. A singleton
    gets 0, NULL or ``prior``; a NULL key gets NULLs.
    """
    table = leave_one_out_table(df, key, target, prefix)
    return apply_leave_one_out(df, table, key, target, prefix, singleton, prior, **join)


def fold_totals(df: DataFrame, key: str, target: str, fold: str, k: int) -> DataFrame:
    """Per key: target sum, count and squared deviations from the own mean within each fold, and in rows outside all folds (``x``)."""
    x = F.col(target).cast("double")
    fields = [F.count(F.lit(1)).alias("_rows")]
    outside = F.when(F.coalesce(F.col(fold).isin(*range(k)), F.lit(False)), None).otherwise(x)
    for name, mine in [("x", outside), *[(str(i), F.when(F.col(fold) == i, x)) for i in range(k)]]:
        fields += [
            F.coalesce(F.sum(mine), F.lit(0.0)).alias(f"_s{name}"), F.count(mine).alias(f"_c{name}"),
            F.coalesce(F.var_pop(mine) * F.count(mine), F.lit(0.0)).alias(f"_d{name}"),
        ]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*fields)


def with_fold_encoding(df: DataFrame, key: str, target: str, fold: str, k: int, prefix: str, **join) -> DataFrame:
    """Encodings that never see the rows they are validated on, one set per fold.

    For fold ``i``: ``<prefix>_<i>`` is the mean over the other folds for rows of
    fold ``i``, and the leave-one-out mean over those other folds for the rest;
    ``<prefix>_cnt_<i>`` and ``<prefix>_std_<i>`` are the count and the sample
    deviation over the other folds. One aggregate and one join serve all folds.
    """
    totals = settle(fold_totals(df, key, target, fold, k))
    hot = lambda: heavy_groups(totals, [key], "_rows")
    out = lookup_join(df, totals.drop("_rows"), [key], "left", hot, **join)
    added, groups = {}, ["x", *map(str, range(k))]
    for i in range(k):
        others = [g for g in groups if g != str(i)]
        s, c = (reduce(add, [F.col(f"_{x}{g}") for g in others]) for x in "sc")
        own = (s - F.col(target)) / F.when(c > 1, c - 1).otherwise(1)
        # Deviations of the groups, moved to their common mean: no difference of large squares.
        moved = [F.coalesce(F.col(f"_c{g}") * F.pow(F.try_divide(f"_s{g}", f"_c{g}") - F.try_divide(s, c), F.lit(2)), F.lit(0.0)) for g in others]
        spread = F.try_divide(reduce(add, [F.col(f"_d{g}") for g in others] + moved), c - 1)
        added[f"{prefix}_{i}"] = F.when(F.col(fold) == i, F.try_divide(s, c)).otherwise(own)
        added[f"{prefix}_cnt_{i}"] = F.coalesce(c, F.lit(0))
        added[f"{prefix}_std_{i}"] = F.when(c > 1, F.sqrt(spread))
    helper = [f"_{x}{g}" for g in groups for x in "scd"]
    return out.withColumns(added).drop(*helper)
