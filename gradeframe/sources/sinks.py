"""CSV outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

BYTE_ORDER_MARK = "\ufeff"


def write_csv(df: DataFrame, path: str, bom: bool = False, files: int | None = None) -> None:
    """Header CSV, written in parallel.

    With ``bom`` every part file starts with the UTF-8 byte order mark. ``files``
    lowers the number of part files; leave it unset for large outputs.
    """
    if bom:
        df = df.withColumnRenamed(df.columns[0], BYTE_ORDER_MARK + df.columns[0])
    if files is not None:
        df = df.coalesce(files)
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_importance(importance: DataFrame, path: str) -> None:
    """Ranked importance table, one row per feature, in one file."""
    write_csv(importance.orderBy(F.desc("importance"), "feature"), path, files=1)


def probability_columns(df: DataFrame, classes: Sequence[str], key: Sequence[str], probability: str = "probability") -> DataFrame:
    """Key columns and one probability column per class."""
    array = vector_to_array(F.col(probability))
    wide = df.select(*key, array.alias("_p"))
    return wide.select(*key, *[F.get("_p", F.lit(i)).alias(c) for i, c in enumerate(classes)])


def write_probabilities(df: DataFrame, classes: Sequence[str], key: Sequence[str], path: str) -> None:
    write_csv(probability_columns(df, classes, key), path)
