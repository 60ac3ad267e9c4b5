"""Exact quantiles by brackets: no sort, and no shuffle of what can't hold a wanted rank.

One pass takes a mergeable sketch (Greenwald-Khanna summaries) of every column
and group, which gives each wanted rank a bracket of two values. Its rank error
is bounded, so the bracket holds the rank and about four errors' worth of rows.
A second pass counts, in one aggregate, the rows below each bracket and the
distinct values inside it with their counts: rows outside all brackets fall into
one combined row of each group and task, so only what the brackets hold is
shuffled. A bracket with too many distinct values for one task is narrowed by a
sketch of its inside, one that missed its rank is widened to the side where it
lies; both go through the same two steps again. Several columns share the
passes as columns, so no row is multiplied.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gradeframe.operators.joins import attach
from gradeframe.session import settle

#: The sketch's rank error is at most rows / SKETCH_ACCURACY.
SKETCH_ACCURACY = 10_000
#: Half a bracket's width in errors, for groups of TIGHT or more times the
#: accuracy in rows, and for those of WHOLE or more times; below that the whole
#: group is its own bracket. Either leaves more room than the error and two ranks.
NARROW, WIDE = 2, 20
TIGHT, WHOLE = 8, 0.15
#: Distinct values of one bracket that one task may rank.
RANKED_VALUES = 1 << 20
#: Steps of the grid that narrows a bracket; far coarser than the sketch's error.
GRID = 256
#: Columns that share one pass.
COLUMNS_PER_PASS = 8


def _clean(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


class _Slots:
    """The wanted ranks of some columns: (slot, column, probability)."""

    def __init__(self, columns: int, probabilities: Sequence[float]):
        self.columns, self.probabilities = columns, list(probabilities)
        self.all = [(k, c, p) for k, (c, p) in enumerate((c, p) for c in range(columns) for p in self.probabilities)]

    def names(self, *prefixes: str) -> list[str]:
        return [f"{prefix}{k}" for prefix in prefixes for k, _, _ in self.all]


def _exprs(texts: Sequence[str]) -> list[Column]:
    return [F.expr(t) for t in texts]


def _first_brackets(rows: DataFrame, slots: _Slots, by: list[str], accuracy: int, also: Sequence[Column]) -> DataFrame:
    """Brackets of all ranks, counts and ends of all columns, per group; one pass over the rows."""
    slacks = [w / accuracy for w in (NARROW, WIDE)]
    asked = [min(max(q, 0.0), 1.0) for p in slots.probabilities for w in slacks for q in (p - w, p + w)]
    told = f"array({', '.join(f'{q!r}D' for q in asked)})"
    parts = [
        part for c in range(slots.columns)
        for part in (f"count(_v{c}) AS _n{c}", f"min(_v{c}) AS _min{c}", f"max(_v{c}) AS _max{c}", f"approx_percentile(_v{c}, {told}, {accuracy}) AS _q{c}")
    ]
    sketch = rows.groupBy(*by).agg(*_exprs(parts), *also)
    ends = []
    for k, c, p in slots.all:
        at = 4 * slots.probabilities.index(p)
        for name, end, reaches, tight in (("_a", "_min", p <= slacks[1], at), ("_z", "_max", p >= 1 - slacks[1], at + 1)):
            ends.append(
                f"CASE WHEN _n{c} < {WHOLE * accuracy!r}D OR {reaches} THEN {end}{c} WHEN _n{c} < {TIGHT * accuracy}L THEN _q{c}[{tight + 2}] "
                f"ELSE _q{c}[{tight}] END AS {name}{k}")
    return _small(sketch.selectExpr("*", *ends).drop(*[f"_q{c}" for c in range(slots.columns)]), by)


def _small(table: DataFrame, by: list[str]) -> DataFrame:
    """A reduced table, computed once; without groups it has a handful of rows and comes back as literals."""
    if by:
        return settle(table)
    rows = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(table.schema, row)]) for row in table.collect()]
    if not rows:
        return table.limit(0)
    return table.sparkSession.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def _around(rows: DataFrame, brackets: DataFrame, slots: _Slots, by: list[str]) -> DataFrame:
    """Distinct combinations of values inside the brackets, with row counts and counts below; one pass.

    A row outside all brackets has only NULL keys, so all of a task's are one row.
    """
    sizes = [f"_n{c}" for c in range(slots.columns)]
    keyed = attach(rows, brackets.select(*by, *sizes, *slots.names("_a", "_z")), by)
    keys = [f"CASE WHEN _v{c} BETWEEN _a{k} AND _z{k} THEN _v{c} END AS _s{k}" for k, c, _ in slots.all]
    below = [f"count_if(_v{c} < _a{k}) AS _b{k}" for k, c, _ in slots.all]
    return keyed.groupBy(*by, *_exprs(keys)).agg(F.expr("count(1) AS _c"), *_exprs(below), *[F.max(n).alias(n) for n in sizes])


def _by_slot(around: DataFrame, slots: _Slots, by: list[str]) -> DataFrame:
    """A row for each slot and row of `around`: a value inside or NULL, rows with it, rows below, and the wanted rank."""
    items = ", ".join(
        f"struct({k} AS _k, {c} AS _column, {p!r}D AS probability, _s{k} AS _v, if(_s{k} IS NULL, 0L, _c) AS _c, _b{k} AS _b, _n{c} AS n, "
        f"floor((_n{c} - 1) * {p!r}D) AS _lo, ceil((_n{c} - 1) * {p!r}D) AS _hi, (_n{c} - 1) * {p!r}D AS _at)" for k, c, p in slots.all)
    return around.selectExpr(*[f"`{b}`" for b in by], f"inline(array({items}))").filter("n > 0")


_RANK = ("_column", "probability", "n", "_lo", "_hi", "_at")


def _picked(around: DataFrame, slots: _Slots, by: list[str]) -> DataFrame:
    """The two values around each wanted rank; a task ranks the few values of a bracket."""
    bracket = W.partitionBy(*by, "_k")
    # The default frame of an ordered window takes equal values together.
    upto = F.sum("_b").over(bracket) + F.sum("_c").over(bracket.orderBy("_v"))
    placed = _by_slot(around, slots, by).withColumn("_upto", upto)
    return placed.groupBy(*by, "_k").agg(
        *[F.first(c).alias(c) for c in _RANK], F.sum("_b").alias("_below"), F.sum("_c").alias("_held"),
        F.expr("min(CASE WHEN _upto > _lo THEN _v END) AS _a"), F.expr("min(CASE WHEN _upto > _hi THEN _v END) AS _z"),
    )


def _state(slotted: DataFrame, many: str) -> DataFrame:
    """Which brackets missed their rank on which side, and which hold too many values."""
    return slotted.selectExpr("*", "_lo < _below AS _low", "_hi >= _below + _held AS _high", f"{many} AS _many")


def _bracketed(rows: DataFrame, slots: _Slots, by: list[str], accuracy: int, also: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """Brackets, and the values at the wanted ranks; each bracket holds its rank and few enough values for a task."""
    brackets = _first_brackets(rows, slots, by, accuracy, also)
    most = brackets.agg(F.expr(f"max(greatest({', '.join(f'_n{c}' for c in range(slots.columns))}, 0))")).first()[0] or 0
    # What lies between two values of the sketch is bounded by their ranks and its error.
    bounded = max((2 * NARROW + 2) * most / accuracy, (2 * WIDE + 2) * TIGHT, WHOLE * accuracy) <= RANKED_VALUES
    while True:
        around = _around(rows, brackets, slots, by)
        if not bounded:
            around = settle(around)
            held = _by_slot(around, slots, by).groupBy(*by, "_k").agg(
                *[F.first(c).alias(c) for c in _RANK], F.sum("_b").alias("_below"), F.sum("_c").alias("_held"), F.count("_v").alias("_values"))
            state = settle(_state(held, f"_values > {RANKED_VALUES}"))
            if _any(state):
                brackets = _small(_moved(rows, brackets, state, slots, by, accuracy), by)
                continue
        picked = _small(_picked(around, slots, by), by)
        state = _state(picked, "false")
        if not _any(state):
            return brackets, picked
        bounded = False
        brackets = _small(_moved(rows, brackets, state, slots, by, accuracy), by)


def _any(state: DataFrame) -> bool:
    return state.agg(F.expr("count_if(_low OR _high OR _many)")).first()[0] > 0


def _moved(rows: DataFrame, brackets: DataFrame, state: DataFrame, slots: _Slots, by: list[str], accuracy: int) -> DataFrame:
    """Brackets widened where they missed their rank, narrowed where they hold too many values."""
    told = ("_low", "_high", "_many", "_below", "_held", "_lo", "_hi")
    flags = state.groupBy(*by).pivot("_k", [k for k, _, _ in slots.all]).agg(*[F.first(t).alias(t) for t in told])
    wide = attach(rows, brackets.select(*by, *slots.names("_a", "_z")), by)
    grid = f"array({', '.join(f'{i / GRID!r}D' for i in range(GRID + 1))})"
    inner = wide.groupBy(*by).agg(*_exprs([
        f"approx_percentile(CASE WHEN _v{c} BETWEEN _a{k} AND _z{k} THEN _v{c} END, {grid}, {accuracy}) AS _g{k}" for k, c, _ in slots.all]))
    known = attach(attach(brackets, _small(flags, by), by), _small(inner, by), by)
    ends = {}
    for k, c, _ in slots.all:
        low, high, many, below, held, lo, hi = (f"`{k}_{t}`" for t in told)
        narrow = f"{many} AND NOT {low} AND NOT {high}"
        first = f"greatest(CAST(floor(({lo} - {below}) * {GRID} / {held}) AS INT) - 1, 0)"
        last = f"least(CAST(ceil(({hi} - {below} + 1) * {GRID} / {held}) AS INT) + 1, {GRID})"
        # Beyond a miss the bracket reaches the column's end, and narrows in the next step.
        ends[f"_a{k}"] = F.expr(f"CASE WHEN {low} THEN _min{c} WHEN {narrow} THEN _g{k}[{first}] ELSE _a{k} END")
        ends[f"_z{k}"] = F.expr(f"CASE WHEN {high} THEN _max{c} WHEN {narrow} THEN _g{k}[{last}] ELSE _z{k} END")
    return known.withColumns(ends).select(*brackets.columns)


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: Sequence[str] = (), accuracy: int = SKETCH_ACCURACY,
    also: Callable[[Column], Mapping[str, Column]] | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles of several columns: ``by``, ``column``, ``n``, ``probability``, ``value``.

    NULL and NaN values and NULL group keys are left out; a column without any
    value has no row, or one without probability and value if ``also`` is given.
    ``also`` names further aggregates of each column, taken in the first pass
    and returned beside.
    """
    by, probs, out = list(by), [float(p) for p in probabilities], None
    for first in range(0, len(columns), COLUMNS_PER_PASS):
        few = list(columns[first : first + COLUMNS_PER_PASS])
        rows = df.select(*by, *[_clean(name).alias(f"_v{c}") for c, name in enumerate(few)])
        if by:
            rows = rows.dropna(subset=by)
        if len(few) == 1:
            rows = rows.filter("_v0 IS NOT NULL")
        extra = [{} if also is None else also(F.col(f"_v{c}")) for c in range(len(few))]
        slots = _Slots(len(few), probs)
        brackets, picked = _bracketed(rows, slots, by, accuracy, [e.alias(f"_x{c}_{name}") for c, some in enumerate(extra) for name, e in some.items()])
        # Equal neighbours are taken as they are, which also keeps infinities.
        value = F.expr("CASE WHEN _a = _z THEN _a ELSE _a + (_z - _a) * (_at - _lo) END").alias("value")
        part = picked.select(*by, F.array(*[F.lit(n) for n in few])[F.col("_column")].alias("column"), "n", "probability", value)
        if also is not None:
            told = F.array(*[
                F.struct(F.lit(name).alias("column"), *[F.col(f"_x{c}_{x}").alias(x) for x in extra[c]]) for c, name in enumerate(few)])
            part = brackets.select(*by, F.inline(told)).join(part, [*by, "column"], "left")
        out = part if out is None else out.unionByName(part)
    return out


def quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    approx: bool = False,
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """Linear-interpolation quantiles per group, long form.

    Returns ``by`` columns, ``probability`` and ``value``. NULL and NaN values
    and NULL group keys are left out. ``approx`` returns the sketch's answer.
    """
    by, probs = list(by), [float(p) for p in probabilities]
    if approx:
        rows = df.select(*by, _clean(value).alias("_v")).dropna(subset=[*by, "_v"])
        wide = rows.groupBy(*by).agg(F.approx_percentile("_v", probs, accuracy).alias("_p"))
        pairs = F.arrays_zip(F.array(*[F.lit(p) for p in probs]).alias("probability"), F.col("_p").alias("value"))
        return wide.select(*by, F.inline(pairs)).toDF(*by, "probability", "value")
    return column_quantiles(df, [value], probs, by, accuracy).select(*by, "probability", "value")


def quantiles_wide(
    df: DataFrame, value: str, named: Mapping[str, float], by: Sequence[str] = (), approx: bool = False,
) -> DataFrame:
    """One row per group with a column per named quantile."""
    long = quantiles(df, value, list(dict.fromkeys(named.values())), by, approx)
    columns = [F.max(F.when(F.col("probability") == F.lit(float(p)), F.col("value"))).alias(n) for n, p in named.items()]
    return long.groupBy(*by).agg(*columns)


def quantile_values(df: DataFrame, value: str, probabilities: Sequence[float], approx: bool = False) -> list[float | None]:
    """Global quantiles as numbers (one per probability, so the driver gets a handful)."""
    found = {r["probability"]: r["value"] for r in quantiles(df, value, probabilities, approx=approx).collect()}
    return [found.get(float(p)) for p in probabilities]
