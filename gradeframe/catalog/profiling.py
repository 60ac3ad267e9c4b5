"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeframe.catalog import roles
from gradeframe.catalog.cleaning import _farms
from gradeframe.catalog.registry import query
from gradeframe.catalog.roles import sql_round as r, with_roles
from gradeframe.functions import clean, domain
from gradeframe.functions.clean import stable_round
from gradeframe.operators import profile, quantiles
from gradeframe.session import settle

_QUALITY_SQL = "nullif(regexp_extract(grade, '^(1\\+\\+|1\\+|1|2|3|등외)', 1), '')"


# The grades and one class that never occurs.
LISTED = [*domain.GRADES, "미판정"]


def _rounded(df, columns, digits=4):
    return df.withColumns({c: stable_round(F.col(c), digits) for c in columns})


def _graded(spark, sf):
    return roles.graded_rows(spark, sf).withColumn("quality", domain.quality_of(F.col("grade")))


@query("SELECT c_mktsegment AS region, count(*) AS n FROM customer GROUP BY 1")
def value_counts(spark, sf):
    return profile.value_counts(roles.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("region")), "region")


@query(with_roles("graded_rows", f"""SELECT grade, {r('count(*) * 1e0 / sum(count(*)) OVER ()', 6)} AS share FROM graded_rows
    WHERE grade IS NOT NULL GROUP BY 1"""))
def value_shares(spark, sf):
    return _rounded(profile.value_shares(roles.graded_rows(spark, sf), "grade").drop("n"), ["share"], 6)


@query(with_roles("graded_rows", f"""
    SELECT sex, {', '.join(f"{r(f'count(*) FILTER (WHERE q = {chr(39)}{v}{chr(39)}) * 1e0 / count(*)', 6)} AS {chr(34)}{v}{chr(34)}" for v in domain.QUALITY)}
    FROM (SELECT sex, {_QUALITY_SQL} AS q FROM graded_rows) WHERE q IS NOT NULL GROUP BY 1"""))
def crosstab_share(spark, sf):
    return _rounded(profile.crosstab_share(_graded(spark, sf), "sex", "quality", domain.QUALITY), domain.QUALITY, 6)


@query("""SELECT CAST(month(o_orderdate) AS INTEGER) AS month, """ + ", ".join(
    f"{r(f'avg(o_totalprice) FILTER (WHERE year(o_orderdate) = {y})')} AS \"{y}\"" for y in range(1995, 2002)) + " FROM orders GROUP BY 1")
def pivot_means(spark, sf):
    df = roles.table(spark, sf, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("month"), "o_totalprice")
    years = list(range(1995, 2002))
    return _rounded(profile.pivot_means(df, "month", "y", years, "o_totalprice"), [str(y) for y in years])


@query(with_roles("graded_rows", f""", q AS (SELECT region, coalesce({_QUALITY_SQL} IN ('1++', '1+'), false)::INT AS high FROM graded_rows)
    SELECT region, {r('avg(high)', 6)} AS rate, {r('(SELECT avg(high) FROM q)', 6)} AS overall FROM q GROUP BY 1"""))
def member_rate(spark, sf):
    return _rounded(profile.member_rate(_graded(spark, sf), "region", "quality", domain.HIGH_QUALITY), ["rate", "overall"], 6)


_SEASON_CASE = ("CASE WHEN month(judged) BETWEEN 3 AND 5 THEN '봄(3-5)' WHEN month(judged) BETWEEN 6 AND 8 THEN '여름(6-8)' "
                "WHEN month(judged) BETWEEN 9 AND 11 THEN '가을(9-11)' ELSE '겨울(12-2)' END")


@query(with_roles("graded_rows", f""", q AS (SELECT {_SEASON_CASE} AS season, coalesce({_QUALITY_SQL} IN ('1++', '1+'), false)::INT AS high FROM graded_rows)
    SELECT season, {r('avg(high)', 6)} AS rate, {r('(SELECT avg(high) FROM q)', 6)} AS overall,
           list_position(['봄(3-5)', '여름(6-8)', '가을(9-11)', '겨울(12-2)'], season) - 1 AS rank FROM q GROUP BY 1"""))
def season_rate(spark, sf):
    from gradeframe.functions.encode import season_label

    df = _graded(spark, sf).withColumn("season", season_label(F.month("judged"), domain.SEASONS))
    rates = profile.member_rate(df, "season", "quality", domain.HIGH_QUALITY)
    return profile.in_list_order(_rounded(rates, ["rate", "overall"], 6), "season", domain.SEASONS)


@query(with_roles("graded_rows farm_area farms", f""", s AS (
      SELECT farm, CASE WHEN avg_cattle <= 0 THEN NULL WHEN avg_cattle <= 2 THEN 'a' WHEN avg_cattle <= 4 THEN 'b'
                        WHEN avg_cattle IS NOT NULL THEN 'c' END AS size FROM farms),
    q AS (SELECT size, coalesce({_QUALITY_SQL} IN ('1++', '1+'), false)::INT AS high FROM graded_rows LEFT JOIN s USING (farm))
    SELECT size, {r('avg(high)', 6)} AS rate, {r('(SELECT avg(high) FROM q)', 6)} AS overall FROM q WHERE size IS NOT NULL GROUP BY 1"""))
def herd_size_rate(spark, sf):
    from gradeframe.functions.binning import fixed_bins
    from gradeframe.operators.joins import lookup_join

    size = fixed_bins(F.col("avg_cattle"), [0, 2, 4, float("inf")], ["a", "b", "c"])
    farms = settle(_farms(spark, sf).select("farm", size.alias("size")))
    df = lookup_join(_graded(spark, sf), farms, ["farm"], "left")
    return _rounded(profile.member_rate(df, "size", "quality", domain.HIGH_QUALITY), ["rate", "overall"], 6)


@query(with_roles("graded_rows", f"""SELECT count(*) AS n_rows, count(c) AS n_valid, {r('avg(c)')} AS mean, {r('min(c)')} AS min,
    {r('max(c)')} AS max, {r('median(c)')} AS median FROM (SELECT nullif(cost, -99) AS c FROM graded_rows)"""))
def scalars(spark, sf):
    df = clean.null_if_sentinel(roles.graded_rows(spark, sf).select("cost"), ["cost"])
    return _rounded(profile.scalars(df, "cost"), ["mean", "min", "max", "median"])


@query(with_roles("offspring", "SELECT count(DISTINCT sire) AS sire, count(DISTINCT kpn) AS kpn, count(DISTINCT score) AS score FROM offspring"))
def distinct_counts(spark, sf):
    return profile.distinct_counts(roles.offspring(spark, sf), ["sire", "kpn", "score"])


def _describe_sql(column: str, source: str) -> str:
    return (f"SELECT '{column}' AS \"column\", count({column}) AS n, {r(f'avg({column})')} AS mean, {r(f'stddev_samp({column})')} AS std, "
            f"{r(f'min({column})')} AS min, {r(f'quantile_cont({column}, 0.25)')} AS q25, {r(f'quantile_cont({column}, 0.5)')} AS q50, "
            f"{r(f'quantile_cont({column}, 0.75)')} AS q75, {r(f'max({column})')} AS max FROM {source}")


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(_describe_sql(c, "lineitem") for c in _NUMERIC))
def describe(spark, sf):
    out = profile.describe(roles.table(spark, sf, "lineitem"), _NUMERIC)
    return _rounded(out, ["mean", "std", "min", "q25", "q50", "q75", "max"])


@query("WITH s AS (SELECT l_partkey, count(*) AS size FROM lineitem GROUP BY 1) " + _describe_sql("size", "s"))
def group_size_summary(spark, sf):
    out = profile.group_size_summary(roles.table(spark, sf, "lineitem"), "l_partkey")
    return _rounded(out, ["mean", "std", "min", "q25", "q50", "q75", "max"])


_PROBS = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


@query(" UNION ALL ".join(
    f"SELECT l_returnflag AS flag, {p}e0 AS probability, {r(f'quantile_cont(l_extendedprice, {p})')} AS value FROM lineitem GROUP BY 1" for p in _PROBS))
def exact_quantiles(spark, sf):
    """The counted-bucket way on purpose, so that it is compared on whole tables."""
    df = roles.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return _rounded(quantiles.quantiles(df, "l_extendedprice", _PROBS, ["flag"]), ["value"])


_CORR = ["l_quantity", "l_extendedprice", "disc", "tax", "l_linenumber"]


@query("WITH x AS (SELECT *, nullif(l_discount, 0.05) AS disc, nullif(l_tax, 0.02) AS tax FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 6)} AS corr FROM x" for a in _CORR for b in _CORR))
def correlations(spark, sf):
    df = roles.table(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_linenumber",
        F.nullif("l_discount", F.lit(0.05)).alias("disc"), F.nullif("l_tax", F.lit(0.02)).alias("tax"),
    )
    return _rounded(profile.correlations(df, _CORR), ["corr"], 6)


def _histogram_sql(source: str, value: str, bins: int, by: str = "") -> str:
    g, on, grp = (f"{by}, ", f"{by}, ", f"GROUP BY {by}") if by else ("", "", "")
    return f"""WITH v AS (SELECT {g}{value} AS v FROM {source}),
      e AS (SELECT {g}CASE WHEN max(v) > min(v) THEN min(v) ELSE min(v) - 0.5 END AS low,
                   (CASE WHEN max(v) > min(v) THEN max(v) - min(v) ELSE 1e0 END) / {bins} AS width, count(v) AS total FROM v {grp}),
      c AS (SELECT {'v.' + by + ',' if by else ''} CAST(least(floor((v.v - low) / width), {bins - 1}) AS INTEGER) AS bin, count(*) AS n
            FROM v {'JOIN e USING (' + by + ')' if by else ', e'} WHERE v.v IS NOT NULL GROUP BY ALL),
      g AS (SELECT e.*, CAST(b AS INTEGER) AS bin FROM e CROSS JOIN range({bins}) t(b))
      SELECT {on}bin, {r('low + bin * width')} AS low, {r('low + bin * width + width')} AS high, coalesce(n, 0) AS n,
             {r('coalesce(n, 0) / (total * width)', 6)} AS density FROM g LEFT JOIN c USING ({on}bin)"""


@query(_histogram_sql("events", "value", 50))
def histogram(spark, sf):
    out = profile.histogram(roles.table(spark, sf, "events"), "value", 50)
    return _rounded(_rounded(out, ["low", "high"]), ["density"], 6)


@query(_histogram_sql("events", "value", 40, "event_type"))
def histogram_by_group(spark, sf):
    out = profile.histogram(roles.table(spark, sf, "events"), "value", 40, ["event_type"])
    return _rounded(_rounded(out, ["low", "high"]), ["density"], 6)


@query(with_roles("graded_rows", f""", v AS (SELECT {_QUALITY_SQL} AS quality, nullif(cost, -99) AS c FROM graded_rows),
    q AS (SELECT quality, quantile_cont(c, 0.25) AS q25, quantile_cont(c, 0.5) AS q50, quantile_cont(c, 0.75) AS q75
          FROM v WHERE c IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
    f AS (SELECT *, q25 - (q75 - q25) * 1.5 AS a, q75 + (q75 - q25) * 1.5 AS z FROM q)
    SELECT quality, count(*) AS n, {r('any_value(q25)')} AS q25, {r('any_value(q50)')} AS q50, {r('any_value(q75)')} AS q75,
           {r('min(c) FILTER (WHERE c BETWEEN a AND z)')} AS whisker_low, {r('max(c) FILTER (WHERE c BETWEEN a AND z)')} AS whisker_high,
           count(*) FILTER (WHERE NOT (c BETWEEN a AND z)) AS outliers
    FROM v JOIN f USING (quality) WHERE c IS NOT NULL GROUP BY 1"""))
def box_stats(spark, sf):
    df = clean.null_if_sentinel(_graded(spark, sf), ["cost"])
    out = profile.box_stats(df, "cost", "quality")
    return _rounded(out, ["q25", "q50", "q75", "whisker_low", "whisker_high"])


def _null_sql(name: str, source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS \"table\", '{c}' AS \"column\", count(*) AS n_rows, {len(columns)} AS n_columns, "
        f"count(*) - count({c}) AS nulls, {r(f'(count(*) - count({c})) * 100e0 / count(*)')} AS null_pct FROM {source}" for c in columns)


@query(with_roles("graded_rows daily", """, a AS (SELECT animal, grade, nullif(cost, -99) AS cost, nullif(wgrade, '-99.0') AS wgrade FROM graded_rows) """
    + _null_sql("graded_rows", "a", ["animal", "grade", "cost", "wgrade"]) + " UNION ALL "
    + _null_sql("daily", "daily", ["stn", "date", "ta_max", "ta_min", "rhm_avg", "rn_day", "ws_davg"])))
def null_profile(spark, sf):
    df = roles.graded_rows(spark, sf).select("animal", "grade", "cost", "wgrade")
    df = clean.null_if_text(clean.null_if_sentinel(df, ["cost"]), ["wgrade"])
    return _rounded(profile.null_profiles({"graded_rows": df, "daily": roles.daily(spark, sf)}), ["null_pct"])


@query(with_roles("graded_rows", f"""
    SELECT CAST(i AS INTEGER) AS rank, g AS grade, (SELECT count(*) FROM graded_rows WHERE grade = g) AS n,
           {r("(SELECT count(*) FROM graded_rows WHERE grade = g) * 100e0 / (SELECT count(*) FROM graded_rows)")} AS pct
    FROM (SELECT unnest(range({len(LISTED)})) AS i, unnest([{', '.join(f"'{g}'" for g in LISTED)}]) AS g)"""))
def class_distribution(spark, sf):
    df = roles.graded_rows(spark, sf)
    return _rounded(profile.class_distribution(df, "grade", LISTED), ["pct"])


@query(with_roles("graded_rows", f"""
    SELECT g AS grade, CAST(i AS INTEGER) AS rank, (SELECT count(*) FROM graded_rows WHERE grade = g) AS n
    FROM (SELECT unnest(range({len(LISTED)})) AS i, unnest([{', '.join(f"'{g}'" for g in LISTED)}]) AS g)"""))
def list_order_filled(spark, sf):
    """Counts in grade order, an absent grade kept with 0."""
    counts = profile.value_counts(roles.graded_rows(spark, sf), "grade")
    return profile.in_list_order(counts, "grade", LISTED, {"n": 0})


@query("SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, brand LIMIT 10")
def top_k(spark, sf):
    counts = profile.value_counts(roles.table(spark, sf, "part").select(F.col("p_brand").alias("brand")), "brand")
    return profile.top_k(counts, "n", 10, "brand")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def preview(spark, sf):
    return profile.preview(roles.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
