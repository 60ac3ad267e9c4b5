"""Materialise-or-reuse tables and models, keyed by what they were made from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F


def _files(df: DataFrame) -> list[str]:
    """Path, size and change time of all files a table is read from; each folder is listed once."""
    spark = df.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    marks, wanted = [], {p.toUri().getPath() for p in paths}
    for parent in {p.getParent().toString(): p.getParent() for p in paths}.values():
        listing = parent.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(parent)
        marks += [f"{s.getPath()}|{s.getLen()}|{s.getModificationTime()}" for s in listing if s.getPath().toUri().getPath() in wanted]
    return sorted(marks)


def _plan(df: DataFrame) -> str:
    """What a table does with its sources: the optimised plan without names that change from run to run."""
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.debug.maxToStringFields")
    conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        return df._jdf.queryExecution().optimizedPlan().canonicalized().toString()
    finally:
        conf.set("spark.sql.debug.maxToStringFields", before)


def fingerprint(tables: Mapping[str, DataFrame], settings: Mapping | None = None) -> str:
    """Digest of input tables and settings.

    A table over files is identified by its plan (filters, columns, joins) and by
    its files' names, sizes and change times, without reading rows; a table with
    any other source by its plan and an order-free hash of its rows.
    """
    parts = [json.dumps(dict(settings or {}), sort_keys=True, default=str)]
    for name in sorted(tables):
        df = tables[name]
        plan = _plan(df)
        files = _files(df)
        parts.append(f"{name}|{df.schema.json()}")
        if files and "LocalRelation" not in plan and "LogicalRDD" not in plan and "Range (" not in plan:
            parts += [plan, *files]
        else:
            digest = F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)")
            got = df.agg(F.count(F.lit(1)).alias("n"), F.sum(digest).alias("h")).first()
            parts.append(f"{got['n']}|{got['h']}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:24]


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def reuse_or_write(spark: SparkSession, root: str, name: str, mark: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read ``root/name-mark`` when a finished write is there, else build and write it."""
    path = f"{root}/{name}-{mark}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def reuse_or_fit(spark: SparkSession, root: str, name: str, mark: str, loader: Callable, fit: Callable):
    """Load the model at ``root/name-mark`` when complete, else fit and save it."""
    path = f"{root}/{name}-{mark}"
    if path_exists(spark, f"{path}/metadata/_SUCCESS") and path_exists(spark, f"{path}/data/_SUCCESS"):
        return loader(path)
    model = fit()
    model.write().overwrite().save(path)
    return model
