"""Sums, counts, means, maxima and minima of any interval of a series by two lookups.

A series is numbered by whole periods (days, months). For every key and period
an index row holds running totals up to and before the period, and arrays of
the extremes of the 1, 2, 4, ... periods that start at it and that end at it,
each made of the one before by one shift (a sparse table). An interval then
needs two rows, whatever its length: that of its first period and that of its
last. A total is the difference of theirs; an extreme is that of two runs of the
largest power of two that fits, which may overlap. No interval is expanded.

Whole numbers and decimals are exact. Floats are differences of running totals
over one key's calendar; where a measure has NaN or infinities they are counted
apart, so they only affect the intervals they lie in.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from gradeframe.operators.joins import lookup_join
from gradeframe.session import settle, spread

#: Bits that count each kind of non-finite value; more periods than 2^FIELD would not fit a calendar.
FIELD = 21


def day_number(c: Column) -> Column:
    return F.unix_date(c.cast("date"))


def month_number(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c) - 1


def months_in(first: Column, last: Column, months: Sequence[int]) -> Column:
    """How many of the month numbers from first to last fall in the given months of the year."""
    upto = [sum(m + 1 in months for m in range(k)) for k in range(12)]

    def before(n: Column) -> Column:
        return F.floor(n / 12) * len(set(months)) + F.array(*[F.lit(k) for k in upto])[F.pmod(n, F.lit(12))]

    return (before(last + 1) - before(first)).cast("long")


@dataclass(frozen=True)
class IntervalIndex:
    """Index rows of a series, the ends of each key's calendar, and what was measured."""

    rows: DataFrame
    ends: DataFrame
    keys: list[str]
    sums: list[str]
    floats: frozenset[str]
    largest: list[str]
    smallest: list[str]


def _quoted(names: Sequence[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def _extremes(rows: DataFrame, names: Mapping[str, str], levels: int, keys: list[str]) -> DataFrame:
    """Arrays `_fwd_` and `_back_`: extremes of 2^j periods from and up to each one, j = 0 .. levels."""
    order = f"(PARTITION BY {', '.join(_quoted(keys))} ORDER BY _p)"
    first = [f"`{n}` AS `_{side}0_{n}`" for n in names for side in ("fwd", "back")]
    rows = rows.selectExpr("*", *first)
    for j in range(levels):
        rows = rows.selectExpr("*", *[
            f"{pick}(`_{side}{j}_{n}`, {shift}(`_{side}{j}_{n}`, {1 << j}) OVER {order}) AS `_{side}{j + 1}_{n}`"
            for n, pick in names.items() for side, shift in (("fwd", "lead"), ("back", "lag"))])
    arrays = [f"array({', '.join(f'`_{side}{j}_{n}`' for j in range(levels + 1))}) AS `_{side}_{n}`" for n in names for side in ("fwd", "back")]
    return rows.selectExpr(*_quoted([c for c in rows.columns if not c.startswith(("_fwd", "_back"))]), *arrays)


def interval_index(
    series: DataFrame, keys: Sequence[str], period: Column,
    sums: Mapping[str, Column] | None = None, largest: Mapping[str, Column] | None = None, smallest: Mapping[str, Column] | None = None,
) -> IntervalIndex:
    """Index a series for sums (with counts of values), maxima and minima of any interval of whole periods.

    Rows with a NULL key or period are left out; several rows of one period are
    added up. The calendar of each key runs from its first period to its last.
    """
    keys, sums, largest, smallest = list(keys), dict(sums or {}), dict(largest or {}), dict(smallest or {})
    rows = series.withColumn("_p", period.cast("int")).dropna(subset=[*keys, "_p"])
    measured = [part for n, c in sums.items() for part in (F.sum(c).alias(n), F.count(c).alias(f"_n_{n}"))]
    measured += [F.max(c).alias(n) for n, c in largest.items()] + [F.min(c).alias(n) for n, c in smallest.items()]
    per = settle(rows.groupBy(*keys, "_p").agg(*measured))
    real = [f.name for f in per.schema if f.name in sums and isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    odd = {n: f"(isnan(`{n}`) OR abs(`{n}`) = double('Infinity'))" for n in real}
    facts = [f"coalesce(max({odd[n]}), false) AS `_odd_{n}`" for n in real]
    ends = settle(per.groupBy(*keys).agg(F.min("_p").alias("_first"), F.max("_p").alias("_last"), *[F.expr(t) for t in facts]))
    # A handful of numbers: the longest calendar, and which measures are anywhere not finite.
    longest, *told = ends.agg(F.expr("max(_last - _first + 1)"), *[F.expr(f"max(`_odd_{n}`)") for n in real]).first()
    floats = {n for n, found in zip(real, told) if found}
    ends = ends.select(*keys, "_first", "_last")
    # One row per key and period, so each window is bounded by the calendar.
    spine = spread(ends, keys).select(*keys, F.explode(F.sequence("_first", "_last")).alias("_p"))
    own = []
    for n in sums:
        zero = f"CAST(0 AS {per.schema[n].dataType.simpleString()})"
        value = f"CASE WHEN NOT {odd[n]} THEN `{n}` END" if n in floats else f"`{n}`"
        own += [f"coalesce({value}, {zero}) AS `_t_{n}`", f"coalesce(`_n_{n}`, 0L) AS `_n_{n}`"]
        if n in floats:
            kind = f"CASE WHEN isnan(`{n}`) THEN 1L WHEN `{n}` > 0 THEN {1 << FIELD}L ELSE {1 << 2 * FIELD}L END"
            own += [f"CASE WHEN {odd[n]} THEN {kind} ELSE 0L END AS `_f_{n}`"]
    extremes = {**dict.fromkeys(largest, "greatest"), **dict.fromkeys(smallest, "least")}
    table = spine.join(per, [*keys, "_p"], "left").selectExpr(*_quoted(keys), "_p", *own, *_quoted([*extremes]))
    names = [c for c in table.columns if c.startswith(("_t_", "_n_", "_f_"))]
    running = f"(PARTITION BY {', '.join(_quoted(keys))} ORDER BY _p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    table = table.selectExpr("*", *[f"sum(`{n}`) OVER {running} AS `_upto{n}`" for n in names])
    if extremes:
        table = _extremes(table, extremes, int(longest or 1).bit_length() - 1, keys)
    sides = [f"`_upto{n}` - `{n}` AS `_before{n}`" for n in names] + _quoted([f"_upto{n}" for n in names])
    rows = settle(table.selectExpr(*_quoted(keys), "_p", *sides, *_quoted([f"{side}{n}" for n in extremes for side in ("_fwd_", "_back_")])))
    return IntervalIndex(rows, ends, keys, list(sums), frozenset(floats), list(largest), list(smallest))


def interval_values(intervals: DataFrame, index: IntervalIndex, first: Column, last: Column, **join) -> DataFrame:
    """Add the measures of each row's interval, both ends included.

    A sum `x` comes with `x_count`, the number of values in it; sums without a
    value, extremes without one, unknown keys and reversed intervals give NULL
    (and a count of 0). The join is the one shuffle-safe lookup used elsewhere.
    """
    keys, columns = index.keys, intervals.columns
    placed = lookup_join(intervals.withColumns({"_a0": first, "_z0": last}), index.ends, keys, "left", **join)
    some = "_first IS NOT NULL AND _a0 IS NOT NULL AND _z0 IS NOT NULL AND greatest(_a0, _first) <= least(_z0, _last) AND _a0 <= _z0"
    placed = placed.selectExpr(*_quoted(columns), f"CASE WHEN {some} THEN greatest(_a0, _first) END AS _a", f"CASE WHEN {some} THEN least(_z0, _last) END AS _z")
    sides = [c.removeprefix("_upto") for c in index.rows.columns if c.startswith("_upto")]
    extremes = {**dict.fromkeys(index.largest, "greatest"), **dict.fromkeys(index.smallest, "least")}
    start = index.rows.selectExpr(*_quoted(keys), "_p AS _a", *_quoted([f"_before{x}" for x in sides] + [f"_fwd_{n}" for n in extremes]))
    end = index.rows.selectExpr(*_quoted(keys), "_p AS _z", *_quoted([f"_upto{x}" for x in sides] + [f"_back_{n}" for n in extremes]))
    out = lookup_join(placed, start, [*keys, "_a"], "left", **join)
    out = lookup_join(out, end, [*keys, "_z"], "left", **join)

    def over(name: str) -> str:
        return f"(`_upto{name}` - `_before{name}`)"

    added = []
    for n in index.sums:
        total = over(f"_t_{n}")
        if n in index.floats:
            odd, field = over(f"_f_{n}"), f"{1 << FIELD}L"
            up, down = f"({odd} DIV {field}) % {field} > 0", f"{odd} DIV ({field} * {field}) > 0"
            total = (
                f"CASE WHEN {odd} = 0 THEN {total} WHEN {odd} % {field} > 0 OR ({up} AND {down}) THEN double('NaN') "
                f"WHEN {up} THEN double('Infinity') ELSE double('-Infinity') END")
        added += [f"CASE WHEN {over(f'_n_{n}')} > 0 THEN {total} END AS `{n}`", f"coalesce({over(f'_n_{n}')}, 0L) AS `{n}_count`"]
    level = "[length(bin(_z - _a + 1)) - 1]"
    added += [f"{pick}(`_fwd_{n}`{level}, `_back_{n}`{level}) AS `{n}`" for n, pick in extremes.items()]
    return out.selectExpr(*_quoted(columns), *added)
