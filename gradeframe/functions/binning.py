"""Right-closed binning on fixed and quantile edges, and winsorising."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.functions.clean import clip_upper
from gradeframe.operators.quantiles import quantile_values


def fixed_bins(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the right-closed bin ``(edges[i], edges[i+1]]``; outside is NULL.

    A last edge of infinity leaves the top bin open.
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("need one more edge than labels")
    out = F.when(c.isNull() | F.isnan(c.cast("double")) | (c <= F.lit(edges[0])), F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        out = out.when(c <= F.lit(upper), F.lit(label))
    return out


def quantile_bins(df: DataFrame, column: str, labels: Sequence[str], out: str, clip_at: float | None = None) -> DataFrame:
    """Quantile bins with the lowest value included; equal values share a bin.

    ``clip_at`` winsorises the column at that quantile before the edges are
    taken. Tied edges merge their bins (the upper label is then unused).
    """
    c = F.col(column).cast("double")
    if clip_at is not None:
        (cap,) = quantile_values(df, column, [clip_at])
        c = clip_upper(c, F.lit(cap))
    df = df.withColumn(out, c)
    edges = quantile_values(df, out, [i / len(labels) for i in range(1, len(labels))])
    v = F.col(out)
    chain = F.when(v.isNull() | F.isnan(v), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        chain = chain.when(v <= F.lit(edge), F.lit(label))
    return df.withColumn(out, chain.otherwise(F.lit(labels[-1])))


def winsorise(df: DataFrame, column: str, quantile: float, out: str | None = None) -> DataFrame:
    """Cap a column at one of its own global quantiles."""
    (cap,) = quantile_values(df, column, [quantile])
    return df.withColumn(out or column, clip_upper(F.col(column).cast("double"), F.lit(cap)))


def at_or_above_quantile(df: DataFrame, column: str, quantile: float) -> DataFrame:
    (cut,) = quantile_values(df, column, [quantile])
    return df.filter(F.col(column) >= F.lit(cut))


def at_or_below_quantile(df: DataFrame, column: str, quantile: float) -> DataFrame:
    (cut,) = quantile_values(df, column, [quantile])
    return df.filter(F.col(column) <= F.lit(cut))
