"""Pairwise co-moments of many columns by plain sums of centred products.

A first pass takes each column's count, mean and ends. With the means as
literals a pair needs plain sums only: of products and, where a column of the
pair has missing values, of both sides and their squares over the rows that
have both. Plain sums are a few simple buffers of generated code; pairs are
taken in square blocks of columns, so the width of an aggregate is bounded and
a pass reads the columns of two blocks. Where the rows that a pair shares lie
far from the columns' means, that pair is summed again around its own means, so
no result is the difference of two large numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, functions as F

#: Columns on a side of a block, without missing values and with.
BLOCK, MASKED_BLOCK = 16, 8
#: A pair is summed again when the squared shift of its mean exceeds its variance so many times.
SHIFTED = 1e4


@dataclass(frozen=True)
class CoMoments:
    """Of the rows that have both values: how many, and centred sums; `flat` if either side is constant."""

    n: int
    xx: float
    yy: float
    xy: float
    flat: bool

    def correlation(self) -> float | None:
        if self.flat or not self.n or not (self.xx * self.yy != 0.0):
            return None
        return self.xy / (self.xx**0.5 * self.yy**0.5)


def _sums(i: int, j: int, a: str, b: str, masked: bool) -> list[str]:
    """The sums of a pair; a and b are its centred values."""
    if not masked:
        return [f"sum({a} * {b}) AS xy_{i}_{j}"]
    x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    return [
        f"sum({a} * {b}) AS xy_{i}_{j}", f"count({x}) AS n_{i}_{j}", f"sum({x}) AS x_{i}_{j}", f"sum({y}) AS y_{i}_{j}",
        f"sum({x} * {a}) AS xx_{i}_{j}", f"sum({y} * {b}) AS yy_{i}_{j}",
    ]


def _around(text: str, mean: float) -> str:
    # NaN and infinite means make the sums NaN, as they should be.
    return f"({text} - double('{mean!r}'))"


def co_moments(df: DataFrame, columns: Sequence[str]) -> dict[tuple[int, int], CoMoments]:
    """Co-moments of all pairs of columns (first index not larger), over the rows that have both.

    NULL and NaN are missing. The driver gets a few numbers for each pair.
    """
    values = df.select(*[F.expr(f"CASE WHEN NOT isnan(CAST(`{c}` AS DOUBLE)) THEN CAST(`{c}` AS DOUBLE) END AS c{i}") for i, c in enumerate(columns)])
    k = len(columns)
    if not k:
        return {}
    texts = [t for i in range(k) for t in (f"count(c{i}) AS n{i}", f"avg(c{i}) AS m{i}", f"min(c{i}) AS a{i}", f"max(c{i}) AS z{i}")]
    first = values.agg(F.expr("count(1) AS n"), *[F.expr(t) for t in texts]).first()
    means = [first[f"m{i}"] if first[f"n{i}"] else 0.0 for i in range(k)]
    whole = [first[f"n{i}"] == first["n"] for i in range(k)]
    centred = [_around(f"c{i}", means[i]) for i in range(k)]
    own = {}

    side = BLOCK if all(whole) else MASKED_BLOCK
    blocks = [range(s, min(s + side, k)) for s in range(0, k, side)]
    out: dict[tuple[int, int], CoMoments] = {}
    again: dict[tuple[int, int], tuple[float, float]] = {}
    # Blocks on the diagonal come first and take the columns' own sums along.
    for rows, cols in sorted(combinations_with_replacement(blocks, 2), key=lambda b: b[0] != b[1]):
        pairs = [(i, j) for i in rows for j in cols if i < j]
        texts = [t for i, j in pairs for t in _sums(i, j, centred[i], centred[j], not (whole[i] and whole[j]))]
        if rows == cols:
            texts += [t for i in rows for t in (f"sum({centred[i]}) AS s{i}", f"sum({centred[i]} * {centred[i]}) AS ss{i}")]
        told = values.agg(*[F.expr(t) for t in texts]).first()
        if rows == cols:
            own |= {name: told[name] for i in rows for name in (f"s{i}", f"ss{i}")}
        for i, j in pairs:
            if whole[i] and whole[j]:
                n, x, y, xx, yy = first["n"], own[f"s{i}"], own[f"s{j}"], own[f"ss{i}"], own[f"ss{j}"]
            else:
                n, x, y, xx, yy = (told[f"{name}_{i}_{j}"] for name in ("n", "x", "y", "xx", "yy"))
            if n and not (whole[i] and whole[j]) and any(s * s / n > SHIFTED * max(ss - s * s / n, 0.0) for s, ss in ((x, xx), (y, yy))):
                again[i, j] = (means[i] + x / n, means[j] + y / n)
            else:
                flat = first[f"a{i}"] == first[f"z{i}"] or first[f"a{j}"] == first[f"z{j}"]
                out[i, j] = _finished(n, x, y, xx, yy, told[f"xy_{i}_{j}"], flat)
    for some in (list(again)[s : s + MASKED_BLOCK**2] for s in range(0, len(again), MASKED_BLOCK**2)):
        texts = []
        for i, j in some:
            texts += _sums(i, j, _around(f"c{i}", again[i, j][0]), _around(f"c{j}", again[i, j][1]), True)
            texts += [f"{end}(CASE WHEN c{b} IS NOT NULL THEN c{a} END) AS {end}_{name}_{i}_{j}" for end in ("min", "max") for name, a, b in (("x", i, j), ("y", j, i))]
        told = values.agg(*[F.expr(t) for t in texts]).first()
        for i, j in some:
            n, x, y, xx, yy, xy = (told[f"{name}_{i}_{j}"] for name in ("n", "x", "y", "xx", "yy", "xy"))
            flat = any(told[f"min_{name}_{i}_{j}"] == told[f"max_{name}_{i}_{j}"] for name in "xy")
            out[i, j] = _finished(n, x, y, xx, yy, xy, flat)
    for i in range(k):
        s, ss, n = own[f"s{i}"], own[f"ss{i}"], first[f"n{i}"]
        out[i, i] = _finished(n, s, s, ss, ss, ss, first[f"a{i}"] == first[f"z{i}"])
    return out


def _finished(n: int, x: float | None, y: float | None, xx: float | None, yy: float | None, xy: float | None, flat: bool) -> CoMoments:
    if not n:
        return CoMoments(0, 0.0, 0.0, 0.0, True)
    return CoMoments(n, max(xx - x * x / n, 0.0), max(yy - y * y / n, 0.0), xy - x * y / n, flat)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete correlation matrix in long form: a, b, corr.

    A column that is constant over a pair's rows gives NULL.
    """
    found = co_moments(df, columns)
    rows = [(columns[i], columns[j], found[min(i, j), max(i, j)].correlation()) for i in range(len(columns)) for j in range(len(columns))]
    return df.sparkSession.createDataFrame(rows, "a string, b string, corr double")
