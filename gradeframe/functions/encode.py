"""Category, season and label codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, functions as F


def literal_map(mapping: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def code_of(c: Column, mapping: Mapping, unknown=-1) -> Column:
    """Dictionary code; an unknown or missing category gets ``unknown``."""
    return F.coalesce(F.try_element_at(literal_map(mapping), c), F.lit(unknown))


def season_code(month: Column) -> Column:
    """Spring 0, summer 1, autumn 2, else (missing month included) 3."""
    m = F.coalesce(month, F.lit(0))
    return (
        F.when(m.between(3, 5), 0).when(m.between(6, 8), 1).when(m.between(9, 11), 2).otherwise(3)
    )


def season_label(month: Column, labels: Sequence[str]) -> Column:
    """Season as text; ``labels`` are ordered spring, summer, autumn, winter."""
    spring, summer, autumn, winter = labels
    m = F.coalesce(month, F.lit(0))
    return (
        F.when(m.between(3, 5), spring)
        .when(m.between(6, 8), summer)
        .when(m.between(9, 11), autumn)
        .otherwise(winter)
    )


def label_index(c: Column, labels: Sequence[str], missing: str, strict: bool = False) -> Column:
    """Class index in ``labels`` order; a missing label counts as ``missing``.

    A label that is not listed is NULL, or with ``strict`` an error, so that no
    row leaves a training set unnoticed.
    """
    index = code_of(F.coalesce(c, F.lit(missing)), {v: i for i, v in enumerate(labels)}, None)
    if strict:
        index = F.coalesce(index, F.raise_error(F.concat(F.lit("unknown label: "), c)).cast("int"))
    return index


def label_of(index: Column, labels: Sequence[str]) -> Column:
    """Class name at a 0-based index."""
    return F.try_element_at(F.array(*[F.lit(v) for v in labels]), index.cast("int") + 1)


def first_argmax(values: Column) -> Column:
    """0-based position of the largest array element; the first one wins a tie."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def blend(left: Column, right: Column, left_weight: float) -> Column:
    """Weighted mean of two probability arrays."""
    w = float(left_weight)
    return F.zip_with(left, right, lambda a, b: a * F.lit(w) + b * F.lit(1.0 - w))
