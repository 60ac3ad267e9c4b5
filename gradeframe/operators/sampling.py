"""Exact, reproducible samples, hold-outs and folds.

Every row gets a hash of its key and seed. A group's rows are split at exact
ranks of that hash without sorting the group: hash ranges are counted, the
range that holds a split point is found, and only the keys and hashes of that
one range are ranked, to find the row at the split point. Every row is then
placed by comparing its hash and key with those few, in one pass, so a class
that holds most of the table never gathers in one task. The result depends on key and seed
only, not on partitioning. Rows are identified by ``key``, which must be unique.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gradeframe.operators.joins import attach, lookup_join
from gradeframe.session import settle

ROWS_PER_RANGE = 100_000
# Few enough ranges that counting them combines well on the map side; a range
# of a very large group is then longer, which only the ranked ranges notice.
MAX_RANGES = 1 << 20


def _hash_columns(key: Sequence[str], seed: int, method: str) -> tuple[Column, Column]:
    """Order value of a row, and the same as a number in [0, 1]."""
    if method == "xxhash64":
        h = F.xxhash64(*key, F.lit(seed))
        return h, h / F.lit(2.0**64) + F.lit(0.5)
    if method == "md5":
        h = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
        return h, F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)
    raise ValueError(f"unknown hash {method}")


def hash_split(
    df: DataFrame,
    key: Sequence[str],
    bounds: Sequence[Column],
    out: str,
    by: Sequence[str] = (),
    seed: int = 42,
    method: str = "xxhash64",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Number of ``bounds`` at or below each row's 0-based hash rank in its group.

    ``bounds`` are expressions over ``_n`` (group size) and ``_total`` (rows
    with a group). Rows with a NULL group are left out.
    """
    key, by = list(key), list(by)
    rows = df.dropna(subset=by) if by else df
    h, unit = _hash_columns(key, seed, method)
    rows = rows.withColumn("_h", h).withColumn("_u", unit)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    sizes = settle(sizes) if by else sizes
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    sizes = sizes.withColumn("_ranges", F.least(F.ceil(F.col("_n") / F.lit(float(rows_per_range))), F.lit(MAX_RANGES)))
    ranged = attach(rows, sizes, by).withColumn(
        "_r", F.least(F.floor(F.col("_u") * F.col("_ranges")), F.col("_ranges") - 1)
    )
    counts = ranged.groupBy(*by, "_r").agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    before = F.sum("_c").over(group.orderBy("_r").rowsBetween(W.unboundedPreceding, 0)) - F.col("_c")
    points = F.array(*[F.struct(F.lit(i).alias("i"), b.cast("long").alias("at")) for i, b in enumerate(bounds)])
    cut = (
        counts.withColumn("_before", before).withColumn("_total", F.lit(total))
        .withColumn("_p", F.explode(points))
        .filter((F.col("_before") <= F.col("_p.at")) & (F.col("_p.at") < F.col("_before") + F.col("_c")))
    )
    # The row at each split point, found among the keys and hashes of its range alone.
    wanted = settle(cut.select(*by, "_r", F.col("_p.i").alias("_i"), (F.col("_p.at") - F.col("_before")).alias("_take")))
    narrow = ranged.select(*by, "_r", "_h", *key)
    ranges = wanted.select(*by, "_r").distinct()
    rank = F.row_number().over(W.partitionBy(*by, "_r").orderBy("_h", *key)) - 1
    ranked = lookup_join(narrow, ranges, [*by, "_r"], "inner").withColumn("_rank", rank)
    position = F.struct(F.col("_h"), *[F.col(k) for k in key])
    at_split = ranked.withColumn("_at", position).join(wanted, [*by, "_r"]).filter("_rank = _take")
    fields = [F.max(F.when(F.col("_i") == i, F.col("_at"))).alias(f"_at{i}") for i in range(len(bounds))]
    if by:
        rows = attach(rows, settle(sizes.select(*by).join(at_split.groupBy(*by).agg(*fields), by, "left")), by)
        limits = [F.col(f"_at{i}") for i in range(len(bounds))]
    else:
        # One row: its positions come in as literals.
        table = at_split.agg(*fields)
        found = table.first()
        kind = table.schema[0].dataType
        limits = [F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(at, kind)]) if at is not None else None for at in found]
    reached = [F.coalesce(position >= at, F.lit(False)).cast("int") for at in limits if at is not None]
    segment = sum(reached, F.lit(0))
    return rows.withColumn(out, segment).select(*df.columns, out)


def sample_rows(df: DataFrame, key: Sequence[str], n: int, seed: int = 42, method: str = "xxhash64", **kw) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, chosen by hash."""
    return hash_split(df, key, [F.lit(n)], "_seg", (), seed, method, **kw).filter("_seg = 0").drop("_seg")


def stratified_sample(df: DataFrame, key: Sequence[str], label: str, n: int, seed: int = 42, method: str = "xxhash64", **kw) -> DataFrame:
    """Per class ``min(n_c, int(n * n_c / total) + 1)`` rows; unlabelled rows are left out.

    ``total`` counts every row of ``df``, unlabelled ones included.
    """
    rows = df.count()
    quota = F.floor(F.lit(float(n)) * F.col("_n") / F.lit(float(max(rows, 1)))) + 1
    return hash_split(df, key, [quota], "_seg", [label], seed, method, **kw).filter("_seg = 0").drop("_seg")


def stratified_sample_approx(df: DataFrame, label: str, fractions: dict, seed: int = 42) -> DataFrame:
    """Per-class Bernoulli sample: no shuffle, sizes only expected."""
    return df.sampleBy(label, fractions, seed)


def stratified_holdout(df: DataFrame, key: Sequence[str], label: str, share: float = 0.2, out: str = "is_validation", seed: int = 42, method: str = "xxhash64", **kw) -> DataFrame:
    """Flag ``round(share * n_c)`` rows of each class as the hold-out."""
    size = F.floor(F.col("_n") * F.lit(share) + F.lit(0.5))
    split = hash_split(df, key, [size], out, [label], seed, method, **kw)
    return split.withColumn(out, F.col(out) == 0)


def stratified_folds(df: DataFrame, key: Sequence[str], label: str, k: int, out: str = "fold", seed: int = 42, method: str = "xxhash64", **kw) -> DataFrame:
    """Fold number 0..k-1; per class the fold sizes differ by at most one."""
    bounds = [F.floor(F.col("_n") * F.lit(i) / F.lit(float(k))) for i in range(1, k)]
    return hash_split(df, key, bounds, out, [label], seed, method, **kw)


def split_by_year(df: DataFrame, date: str, last_train_year: int) -> tuple[DataFrame, DataFrame]:
    """Time split: rows up to a year, and the rows after it; undated rows are with the first."""
    later = F.coalesce(F.year(date) > last_train_year, F.lit(False))
    return df.filter(~later), df.filter(later)
