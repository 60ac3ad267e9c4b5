"""Lookup joins, key de-duplication, coverage and row alignment."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from gradeframe.session import settle, spread

BROADCAST_BYTES = 64 * 1024 * 1024
# A key is hot when it holds more than this share of the fact rows, or more
# rows than one task should hold. At most HOT_KEYS keys are hot, whatever the
# number of rows, which bounds what the skew path broadcasts.
HOT_SHARE = 1e-3
TASK_ROWS = 2_000_000
HOT_KEYS = 100_000
# Hot keys' values are broadcast up to this size; beyond, they are copied for
# so many tasks.
HEAVY_BYTES = BROADCAST_BYTES
COPIES = 256
# Number of salts that rows of hot and missing keys are spread over.
SPREAD = 4096


def held_bytes(df: DataFrame, limit: int) -> int | None:
    """Bytes a table takes in memory, or None when they exceed ``limit``.

    Rows are counted first, which for a file scan only reads footers; text is
    measured only when the row count alone does not settle it.
    """
    fixed, variable = 16, []
    for f in df.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            variable.append(F.octet_length(F.col(f.name)))
            fixed += 16
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            variable.append(F.octet_length(F.to_json(F.struct(f.name))))
            fixed += 32
        else:
            fixed += 8
    size = df.count() * fixed
    if size <= limit and variable:
        text = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0)) for v in variable])
        size += df.agg(F.sum(text)).first()[0] or 0
    return size if size <= limit else None


def fits(df: DataFrame, limit: int) -> bool:
    """Whether a table takes at most ``limit`` bytes in memory."""
    return held_bytes(df, limit) is not None


def _all_present(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def hot_keys(fact: DataFrame, on: Sequence[str], hot_share: float = HOT_SHARE, task_rows: int = TASK_ROWS) -> DataFrame:
    """Keys above ``hot_share`` of the rows, or above ``task_rows`` rows; see ``heavy_groups``."""
    counts = fact.filter(_all_present(on)).groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    return heavy_groups(counts, on, "_rows", hot_share, task_rows)


def heavy_groups(counts: DataFrame, on: Sequence[str], rows: str, hot_share: float = HOT_SHARE, task_rows: int = TASK_ROWS) -> DataFrame:
    """The same from row counts per key that were made anyway.

    The limit is the lower of the share and ``task_rows``, but never so low that
    more than the larger of ``1 / hot_share`` and ``HOT_KEYS`` keys could exceed it.
    """
    total = F.sum(rows)
    limit = F.least(total * float(hot_share), F.greatest(F.lit(float(task_rows)), total / HOT_KEYS))
    return counts.filter(F.col(rows) > counts.agg(limit).scalar()).select(*on)


def lookup_join(
    fact: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    hot: Callable[[], DataFrame] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join a fact table to a lookup that is unique on ``on``.

    The lookup is measured first. Within ``broadcast_bytes`` it is broadcast and
    the fact table does not move. Beyond that the two are shuffled together,
    except that hot keys (made by ``hot``, or counted from the fact) take their values
    from a broadcast of just those keys, or, beyond ``HEAVY_BYTES`` of values,
    from copies for several tasks; rows of a hot or NULL key are then
    spread over all tasks, so no task receives a heavy key. The fact table is
    read once either way, and both ways return the same rows. NULL keys never
    match.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"lookup_join supports left and inner, not {how}")
    on = list(on)
    if fits(lookup, broadcast_bytes):
        return fact.join(F.broadcast(lookup), on, how)
    return _spread_join(fact, lookup, on, how, hot_keys(fact, on) if hot is None else hot())


def lookup_joins(
    fact: DataFrame,
    lookups: Sequence[DataFrame],
    on: Sequence[str],
    hot: Callable[[], DataFrame] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Left-join several lookups on one key; the fact table moves at most once.

    Lookups are broadcast while together they stay within ``broadcast_bytes``.
    The others are first joined with each other on the key, which moves only
    lookups, and then meet the fact table as one, as in ``lookup_join``. Each is
    unique on ``on``, and their other columns differ.
    """
    on, out, left, large = list(on), fact, broadcast_bytes, []
    for lookup in lookups:
        size = held_bytes(lookup, left)
        if size is None:
            large.append(lookup.filter(_all_present(on)))
        else:
            out, left = out.join(F.broadcast(lookup), on, "left"), left - size
    if large:
        wide = reduce(lambda a, b: a.join(b, on, "full"), large)
        out = _spread_join(out, wide, on, "left", hot_keys(fact, on) if hot is None else hot())
    return out.select(*fact.columns, *[c for t in lookups for c in t.columns if c not in on])


def _spread_join(fact: DataFrame, lookup: DataFrame, on: list[str], how: str, hot: DataFrame) -> DataFrame:
    extra = [c for c in lookup.columns if c not in on]
    values = F.struct(*extra, F.lit(True).alias("_found"))
    # A bounded number of keys, and the lookup has one row for each; their values are measured.
    keys = settle(hot.select(*on))
    known = lookup.join(F.broadcast(keys), on, "left_semi").select(*on, values.alias("_v"))
    heavy = settle(keys.join(known, on, "left").select(*on, "_v", F.lit(True).alias("_hot")))
    carried = fits(heavy, HEAVY_BYTES)
    marked = fact.join(F.broadcast(heavy if carried else heavy.drop("_v")), on, "left")
    # The partition number spreads even identical rows and is the same on a retry.
    spot = lambda n: F.pmod(F.spark_partition_id(), F.lit(n)) + 1
    apart = F.when(~_all_present(on), spot(SPREAD)).when(F.col("_hot"), spot(SPREAD if carried else COPIES))
    marked = marked.withColumn("_salt", apart.otherwise(0))
    # Always 0, but not a literal: the optimizer would fold that one out of the
    # join key, and the rows would be shuffled by the key alone.
    zero = F.pmod(F.hash(*on), F.lit(1))
    cold = lookup.select(*on, values.alias("_w"), zero.alias("_salt"))
    if carried:
        joined = marked.join(cold, [*on, "_salt"], "left").withColumn("_v", F.coalesce("_v", "_w"))
    else:
        copies = spread(heavy, on).select(*on, F.col("_v").alias("_w"), F.explode(F.sequence(F.lit(1), F.lit(COPIES))).alias("_salt"))
        joined = marked.join(cold.unionByName(copies), [*on, "_salt"], "left").withColumnRenamed("_w", "_v")
    if how == "inner":
        joined = joined.filter("_v._found")
    return joined.select(*fact.columns, *[F.col("_v").getField(c).alias(c) for c in extra])


def attach(rows: DataFrame, table: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add a per-group table's columns to rows.

    Without group columns the table is one row of statistics; it comes in as
    literals, so there is no join and the plan stays flat.
    """
    if by:
        return lookup_join(rows, table, by, "inner")
    row = table.first()
    return rows.withColumns({f.name: F.lit(row[f.name]).cast(f.dataType) for f in table.schema})


def unique_lookup(df: DataFrame, key: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key: the first in ``order_by`` order, ties by the other columns.

    A NULL comes after every value, so an empty row never hides a filled one. A
    minimum over the row struct is combined on the map side, so a key with very
    many copies never gathers them in one task. NULL keys are dropped.
    """
    key, order_by = list(key), list(order_by)
    rest = [c for c in df.columns if c not in key and c not in order_by]
    fields = [f for i, c in enumerate([*order_by, *rest]) for f in (F.col(c).isNull().alias(f"_{i}"), F.col(c))]
    first = F.min(F.struct(*fields)) if fields else F.lit(None)
    picked = df.filter(_all_present(key)).groupBy(*key).agg(first.alias("_first"))
    back = [F.col(c) if c in key else F.col(f"_first.{c}").alias(c) for c in df.columns]
    return picked.select(*back)


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys with more than one row, and their row counts."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def assert_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Raise when a lookup key repeats; otherwise return the lookup."""
    found = duplicate_keys(df, key).limit(1).collect()
    if found:
        raise ValueError(f"lookup key {list(key)} repeats: {found[0].asDict()}")
    return df


def require_row_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Raise when a row key is NULL or repeats; otherwise return the rows."""
    if not df.filter(~_all_present(key)).select(*key).isEmpty():
        raise ValueError(f"row key {list(key)} has NULLs")
    return assert_unique(df, key)


def keep_key_members(df: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is in a key set (each key once after the distinct)."""
    key = list(key)
    members = keys.select(*key).filter(_all_present(key)).distinct().withColumn("_member", F.lit(True))
    return lookup_join(df, settle(members), key, "inner").drop("_member").select(*df.columns)


def key_coverage(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Distinct keys on each side, their overlap and the matched share of the left.

    A tagged union with one aggregate per key: partial aggregation removes
    repeats before the shuffle, so heavy keys cost nothing. NULL is no key.
    """
    tagged = left.select(F.col(left_key).alias("k"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(F.col(right_key).alias("k"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per_key = tagged.filter(F.col("k").isNotNull()).groupBy("k").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return per_key.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("left_keys"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("right_keys"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("matched_keys"),
    ).withColumn("match_pct", F.try_divide(F.col("matched_keys") * 100.0, F.col("left_keys")))


def shared_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Distinct non-NULL keys present on both sides."""
    return (
        left.select(F.col(left_key).alias("key")).intersect(right.select(F.col(right_key).alias("key")))
        .filter(F.col("key").isNotNull())
    )


def align_predictions(original: DataFrame, predicted: DataFrame, key: Sequence[str], label: str, default: str) -> DataFrame:
    """Every original row with its predicted label, in the original column order.

    A row without a prediction, or without a key, gets ``default``. Rows are
    told apart by the key, so runs check it with ``require_row_key``; repeated
    predictions for a key keep the smallest label, and the row count of the
    original is preserved.
    """
    key = list(key)
    zero = F.pmod(F.hash(*key), F.lit(1))
    one = predicted.filter(_all_present(key)).groupBy(*key).agg(F.min(label).alias("_pred")).withColumn("_salt", zero)
    # Both sides are as large as the fact table, so this is a plain shuffle join; rows without a key are spread.
    spot = F.pmod(F.spark_partition_id(), F.lit(SPREAD)) + 1
    base = original.withColumn("_salt", F.when(_all_present(key), F.lit(0)).otherwise(spot))
    value = F.coalesce("_pred", F.lit(default)).alias(label)
    columns = [value if c == label else F.col(c) for c in original.columns]
    return base.join(one, [*key, "_salt"], "left").select(*columns, *([] if label in original.columns else [value]))


def stack_rows(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Vertical concatenation by name; a column one side lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rest, first)
