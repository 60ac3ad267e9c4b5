"""The shared test tables cast into the roles of a grading data set.

Each role is a DataFrame builder and the SQL text of the same relation. The
test tables hold no NULLs, so roles put sentinels and NULLs in by rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeframe.operators.joins import lookup_join


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _case(column: str, mapping: dict[str, str]):
    out = None
    for k, v in mapping.items():
        hit = F.col(column) == k
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return out


QUALITY_BY_PRIORITY = {
    "1-URGENT": "1++", "2-HIGH": "1+", "3-MEDIUM": "1", "4-NOT SPECIFIED": "2", "5-LOW": "3",
}
YIELD_BY_STATUS = {"F": "A", "O": "B", "P": "C"}
SEX_BY_STATUS = {"F": "암", "O": "수", "P": "거세"}


def graded_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Graded graded_rows, one row per order."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("animal"), F.col("o_custkey").alias("farm"),
        F.col("o_orderdate").cast("date").alias("judged"), "o_orderpriority", "o_orderstatus",
        F.col("o_totalprice").alias("weight"),
    )
    holders = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("farm"), F.col("c_nationkey").alias("stn"), F.col("c_mktsegment").alias("region")
    )
    key = F.col("animal")
    grade = F.when(key % 29 == 0, "등외").when(key % 31 != 0, F.concat(
        _case("o_orderpriority", QUALITY_BY_PRIORITY), _case("o_orderstatus", YIELD_BY_STATUS)))
    return lookup_join(orders, holders, ["farm"], "inner").select(
        "animal", "farm", "stn", "region", "judged",
        F.date_sub("judged", (key % 900).cast("int")).alias("born"),
        _case("o_orderstatus", SEX_BY_STATUS).alias("sex"), grade.alias("grade"), "weight",
        F.when(key % 23 == 0, -99.0).otherwise(F.col("weight") / 10).alias("cost"),
        F.when(key % 19 == 0, "-99.0").otherwise(_case("o_orderstatus", YIELD_BY_STATUS)).alias("wgrade"),
        (key % 9 + 1).cast("double").alias("marbling"), F.col("o_orderpriority").alias("priority"),
    )


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily station readings, one row per line item."""
    lines = table(spark, sf, "lineitem").select(
        "l_suppkey", F.col("l_shipdate").cast("date").alias("date"), "l_quantity", "l_discount", "l_tax",
        "l_extendedprice", "l_linenumber",
    )
    stations = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("stn")
    )
    return lookup_join(lines, stations, ["l_suppkey"], "inner").select(
        "stn", "date", F.col("l_quantity").alias("ta_max"), (F.col("l_quantity") - 10).alias("ta_min"),
        (F.col("l_tax") * 1000.0 + 0.0).alias("rhm_avg"),
        F.when(F.col("l_linenumber") != 6, F.col("l_discount") + 0.0).alias("rn_day"),
        F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") / 10000.0).alias("ws_davg"),
    )


def farm_area(spark: SparkSession, sf: str) -> DataFrame:
    """Farms with three yearly head counts and an area; -99 is missing."""
    orders = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("y"))
    heads = orders.groupBy(F.col("o_custkey").alias("farm")).agg(
        *[F.count_if(F.col("y") == y).cast("double").alias(f"C{y}") for y in (1998, 1999, 2000)]
    )
    farms = table(spark, sf, "customer").select(F.col("c_custkey").alias("farm"), "c_acctbal")
    # One row per farm on both sides: a plain equi join, its strategy left to Spark.
    out = farms.join(heads, "farm", "left")
    key = F.col("farm")
    seen = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, -99.0).otherwise(F.col(c)).alias(c)
    return out.select(
        "farm", seen("C1998"), seen("C1999"), seen("C2000"),
        F.when(key % 11 == 0, -99.0).when(key % 13 == 0, 0.0).otherwise(F.abs("c_acctbal")).alias("AREA"),
    )


def deaths(spark: SparkSession, sf: str) -> DataFrame:
    """Death log: returned lines, with the order date as birth and the ship date as death."""
    lines = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(
        F.col("l_orderkey"), F.col("l_shipdate").cast("date").alias("dead"), "l_linestatus", "l_linenumber"
    )
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("farm"), F.col("o_orderdate").cast("date").alias("born")
    )
    compact = lambda c: F.date_format(c, "yyyyMMdd").cast("int")
    return lookup_join(lines, orders, ["l_orderkey"], "inner").select(
        "farm", compact("born").alias("born_ymd"),
        F.when(F.col("l_linenumber") == 7, -99).otherwise(compact("dead")).alias("dead_ymd"),
        F.when(F.col("l_linenumber") == 3, "-99").otherwise(F.col("l_linestatus")).alias("reason"),
    )


def offspring(spark: SparkSession, sf: str) -> DataFrame:
    """Measured offspring with sire and strain, one row per line item."""
    lines = table(spark, sf, "lineitem").select("l_partkey", F.col("l_quantity").alias("score"), "l_returnflag", "l_extendedprice")
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", "p_brand", "p_type").alias("sire"), F.col("p_type").alias("kpn")
    )
    return lookup_join(lines, parts, ["l_partkey"], "inner").select(
        "sire", "kpn", F.nullif("score", F.lit(50.0)).alias("score"), F.col("l_returnflag").alias("flag"),
        F.col("l_extendedprice").alias("price"),
    )


def _sql_case(column: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {whens} END"


SQL = {
    "graded_rows": f"""
        SELECT o_orderkey AS animal, o_custkey AS farm, c_nationkey AS stn, c_mktsegment AS region,
               CAST(o_orderdate AS DATE) AS judged,
               CAST(o_orderdate AS DATE) - CAST(o_orderkey % 900 AS INTEGER) AS born,
               {_sql_case('o_orderstatus', SEX_BY_STATUS)} AS sex,
               CASE WHEN o_orderkey % 29 = 0 THEN '등외' WHEN o_orderkey % 31 <> 0 THEN
                 {_sql_case('o_orderpriority', QUALITY_BY_PRIORITY)} || {_sql_case('o_orderstatus', YIELD_BY_STATUS)} END AS grade,
               o_totalprice AS weight,
               CASE WHEN o_orderkey % 23 = 0 THEN -99e0 ELSE o_totalprice / 10 END AS cost,
               CASE WHEN o_orderkey % 19 = 0 THEN '-99.0' ELSE {_sql_case('o_orderstatus', YIELD_BY_STATUS)} END AS wgrade,
               CAST(o_orderkey % 9 + 1 AS DOUBLE) AS marbling, o_orderpriority AS priority
        FROM orders JOIN customer ON c_custkey = o_custkey""",
    "daily": """
        SELECT s_nationkey AS stn, CAST(l_shipdate AS DATE) AS date, l_quantity AS ta_max, l_quantity - 10 AS ta_min,
               l_tax * 1e3 + 0e0 AS rhm_avg, CASE WHEN l_linenumber <> 6 THEN l_discount + 0e0 END AS rn_day,
               CASE WHEN l_linenumber <> 7 THEN l_extendedprice / 1e4 END AS ws_davg
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey""",
    "daily_index": """
        SELECT *, (ta_max + ta_min) / 2 AS ta_avg,
               ((ta_max + ta_min) / 2 * 1.8e0 + 32) - (0.55e0 - rhm_avg * 0.0055e0) * ((ta_max + ta_min) / 2 * 1.8e0 - 26) AS thi
        FROM daily""",
    "monthly": """
        SELECT stn, CAST(date_trunc('month', date) AS DATE) AS month, avg(ta_avg) AS ta_mean, avg(thi) AS thi_mean,
               max(thi) AS thi_max, avg(rhm_avg) AS rhm_mean, count(*) FILTER (WHERE thi >= 80) AS heat2d,
               count(*) FILTER (WHERE thi >= 85) AS heat3d, count(*) FILTER (WHERE ta_min < -5) AS cold_d,
               coalesce(sum(rn_day), 0) AS rn_sum, avg(ta_max) AS ta_max_mean, avg(ta_min) AS ta_min_mean,
               avg(ws_davg) AS ws_mean
        FROM daily_index GROUP BY 1, 2""",
    "farm_area": """
        SELECT c_custkey AS farm, coalesce(nullif(h.c98, 0), -99) AS C1998, coalesce(nullif(h.c99, 0), -99) AS C1999,
               coalesce(nullif(h.c00, 0), -99) AS C2000,
               CASE WHEN c_custkey % 11 = 0 THEN -99e0 WHEN c_custkey % 13 = 0 THEN 0e0 ELSE abs(c_acctbal) END AS AREA
        FROM customer LEFT JOIN (
          SELECT o_custkey, CAST(count(*) FILTER (WHERE year(o_orderdate) = 1998) AS DOUBLE) AS c98,
                 CAST(count(*) FILTER (WHERE year(o_orderdate) = 1999) AS DOUBLE) AS c99,
                 CAST(count(*) FILTER (WHERE year(o_orderdate) = 2000) AS DOUBLE) AS c00
          FROM orders GROUP BY 1) h ON h.o_custkey = c_custkey""",
    "farms": """
        SELECT farm, a / nullif(k, 0) AS avg_cattle, a / nullif(k, 0) / nullif(area_m, 0) AS density,
               area_m / nullif(a / nullif(k, 0), 0) AS area_per_head, C1998, C1999, C2000
        FROM (SELECT farm, nullif(C1998, -99) AS C1998, nullif(C1999, -99) AS C1999, nullif(C2000, -99) AS C2000,
                     nullif(AREA, -99) AS area_m,
                     coalesce(nullif(C1998, -99), 0) + coalesce(nullif(C1999, -99), 0) + coalesce(nullif(C2000, -99), 0) AS a,
                     (C1998 <> -99)::INT + (C1999 <> -99)::INT + (C2000 <> -99)::INT AS k
              FROM farm_area)""",
    "deaths": """
        SELECT o_custkey AS farm, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS born_ymd,
               CASE WHEN l_linenumber = 7 THEN -99 ELSE CAST(strftime(l_shipdate, '%Y%m%d') AS INTEGER) END AS dead_ymd,
               CASE WHEN l_linenumber = 3 THEN '-99' ELSE l_linestatus END AS reason
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'""",
    "offspring": """
        SELECT p_brand || '/' || p_type AS sire, p_type AS kpn, nullif(l_quantity, 50) AS score,
               l_returnflag AS flag, l_extendedprice AS price
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
}

_NEEDS = {
    "daily_index": ["daily"], "monthly": ["daily", "daily_index"], "farms": ["farm_area"],
}


def with_roles(names: str, body: str) -> str:
    """SQL with the named roles as common table expressions, before ``body``."""
    ordered: list[str] = []
    for name in names.split():
        for n in [*_NEEDS.get(name, []), name]:
            if n not in ordered:
                ordered.append(n)
    head = ",\n".join(f"{n} AS ({SQL[n]})" for n in ordered)
    body = body.strip()
    return f"WITH {head}{',' if body.startswith(',') else ''}\n{body.lstrip(',')}"


def sql_round(expression: str, digits: int = 4) -> str:
    """The same tolerant half-up rounding as ``stable_round``."""
    return f"floor(({expression}) * 1e{digits} + 0.500001e0) / 1e{digits}"
