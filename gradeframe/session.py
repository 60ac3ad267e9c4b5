"""Session settings the library relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Session settings to run the feature plans with. They are about a hundred
# columns wide, and a generated method beyond 8000 bytes is never compiled by
# the JVM, so Spark should fall back to its split projections there.
SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def with_settings(builder):
    """Apply the settings to a session builder."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for cut lineage: the cluster's own, else a local one for tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="gradeframe-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Compute a reduced table once and cut its lineage, so later uses only read it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, columns) -> DataFrame:
    """Hash-partition a small table over many tasks before its rows multiply.

    Adaptive execution merges small partitions but keeps a requested number, so
    the rows an explode makes of them stay on all tasks. The number differs
    from the session's, because Spark drops a repartition that merely repeats
    the partitioning of the aggregate below it.
    """
    number = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1
    return df.repartition(number, *columns)
