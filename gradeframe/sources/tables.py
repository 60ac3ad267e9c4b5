"""Declared input schemas and CSV scans."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from gradeframe.functions.clean import iso_date
from gradeframe.parallel import run_together

#: First lines read at the same time, a task each.
HEADER_READERS = 16
#: Name of the column that takes lines with a wrong number of values.
WHOLE_LINE = "_whole_line"
TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "date": T.DateType()}


def _schema(columns: str) -> T.StructType:
    """Schema from ``name type`` pairs, without needing a session as ``fromDDL`` does."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


# Column names and types of the five input tables.
FACT = _schema(
    "sido string, sigungu string, eupmyeondong string, stn int, ABATT_DATE date, JUDGE_DATE date, "
    "JUDGE_SEX string, WEIGHT int, BACKFAT double, REA double, WINDEX double, WGRADE string, INSFAT double, "
    "YUKSAK double, FATSAK double, TISSUE double, GROWTH double, COST_AMT double, AGE int, BIRTH_YMD int, "
    "CATTLE_NO string, FARM_UNIQUE_NO string, LAST_GRADE string"
)
WEATHER = _schema(
    "stn int, date date, ta_max double, rn_day double, ta_min double, rhm_avg double, ws_davg double"
)
AREA = _schema("FARM_UNIQUE_NO string, C2023 double, C2024 double, C2025 double, AREA double")
DEATH = _schema("FARM_UNIQUE_NO string, BIRTH_YMD int, DEAD_YMD int, DEAD_REASON string")
LINEAGE = _schema(
    "CATTLE_NO string, KPN_NO string, FATHER_CATTLE_NO string, MOTHER_ANIMAL_NO string, "
    "F_GMOTHER_ANIMAL_NO string, F_GFATHER_CATTLE_NO string, M_GMOTHER_ANIMAL_NO string, M_GFATHER_CATTLE_NO string"
)


def _typed(name: str, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.DateType):
        return iso_date(F.col(name)).alias(name)
    if isinstance(data_type, T.IntegerType):
        # Whole numbers may be written with a decimal point ("20240131.0").
        return F.col(name).try_cast("double").try_cast("int").alias(name)
    return F.col(name).try_cast(data_type).alias(name)


def _header(spark: SparkSession, file: str) -> str | None:
    """First line of a file: one task that stops after the first buffer of its first block."""
    lines = spark.read.text(file).select("value", F.col("_metadata.file_block_start").alias("at"))
    row = lines.filter("at = 0").head()
    return None if row is None else row["value"]


def headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files of a CSV path by their first line; files without any line are left out.

    What is read is bounded by the number of files, not by their sizes.
    """
    jvm = spark._jvm
    files = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).toString() for f in spark.read.text(path).inputFiles()]
    lines = run_together(spark, [partial(_header, spark, f) for f in files], HEADER_READERS, "headers")
    found: dict[str, list[str]] = {}
    for file, line in sorted(zip(files, lines)):
        if line is not None:
            found.setdefault(line, []).append(file)
    return dict(sorted(found.items()))


def _by_name(spark: SparkSession, path: str) -> DataFrame:
    """All files of a CSV path as text columns, matched by name.

    Spark takes one header for all files of a scan, so files with another column
    order are scanned apart.
    """
    groups = headers(spark, path)
    if len(groups) <= 1:
        return spark.read.option("header", True).csv(path)
    scans = [spark.read.option("header", True).csv(files) for files in groups.values()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def rejected(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Ledger of what ``read_csv`` can't take: file, block (its first byte), column and value.

    Each value that does not fit its column's type is a row. A line with more or
    fewer values than its file's header is a row as well, whole, with a NULL column.
    """
    types = {f.name: f.dataType for f in schema if not isinstance(f.dataType, T.StringType)}
    parts = []
    for files in headers(spark, path).values():
        names = spark.read.option("header", True).csv(files).columns
        whole = T.StructType([T.StructField(n, T.StringType()) for n in [*names, WHOLE_LINE]])
        # A pruned scan would not notice further values. Spark wants a plain column beside the whole line.
        scan = spark.read.schema(whole).option("header", True).option("columnPruning", False)
        raw = scan.option("columnNameOfCorruptRecord", WHOLE_LINE).csv(files)
        entry = lambda column, value, bad: F.struct(F.lit(column).cast("string").alias("column"), value.alias("value"), bad.alias("bad"))
        entries = [entry(None, F.col(WHOLE_LINE), F.col(WHOLE_LINE).isNotNull() & (F.coalesce(F.length(f"`{names[0]}`"), F.lit(0)) >= 0))] + [
            entry(n, F.col(f"`{n}`"), F.trim(F.col(f"`{n}`")).isNotNull() & (F.trim(F.col(f"`{n}`")) != "") & _typed(n, types[n]).isNull())
            for n in names if n in types
        ]
        listed = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                            F.filter(F.array(*entries), lambda e: e["bad"]).alias("bad"))
        parts.append(listed.select("file", "block", F.explode("bad").alias("bad")).select("file", "block", "bad.column", "bad.value"))
    if not parts:
        return spark.createDataFrame([], "file string, block long, column string, value string")
    return reduce(DataFrame.unionByName, parts)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """Header CSV by column name, with declared types and an optional column subset.

    Reads UTF-8 with or without a byte order mark; files may differ in column
    order. Unused columns are pruned from the scan. A wanted column the file
    lacks is left out, and a value that does not fit its type is NULL.
    """
    raw = _by_name(spark, path)
    wanted = [f for f in schema if columns is None or f.name in columns]
    return raw.select([_typed(f.name, f.dataType) for f in wanted if f.name in raw.columns])


def read_full_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every column of the file, in file order; those in ``schema`` get its type."""
    raw = _by_name(spark, path)
    types = {f.name: f.dataType for f in schema}
    return raw.select([_typed(c, types.get(c, T.StringType())) for c in raw.columns])
