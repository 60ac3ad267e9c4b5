"""Queries that roll a daily series up and join facts to it."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeframe.catalog import roles
from gradeframe.catalog.registry import query
from gradeframe.catalog.roles import sql_round as r, with_roles
from gradeframe.functions import clean, domain, weather
from gradeframe.functions.clean import stable_round
from gradeframe.operators import profile, timeseries
from gradeframe.session import settle

FULL = ["ta_mean", "thi_mean", "thi_max", "rhm_mean", "rn_sum", "ta_max_mean", "ta_min_mean", "ws_mean"]
COUNTS = ["heat2d", "heat3d", "cold_d"]
FLOOR = "1995-01-01"


def monthly(spark, sf, aggregates=weather.full_aggregates):
    return timeseries.monthly_rollup(weather.with_index(roles.daily(spark, sf)), ["stn"], "date", aggregates())


def _rounded(df, columns, digits=4):
    return df.withColumns({c: stable_round(F.col(c), digits) for c in columns})


@query(with_roles("monthly", f"""
    SELECT stn, month, {', '.join(f'{r(c)} AS {c}' for c in FULL)}, {', '.join(COUNTS)} FROM monthly"""))
def monthly_weather(spark, sf):
    return _rounded(monthly(spark, sf), FULL)


@query(with_roles("monthly", f"""
    SELECT stn, month, {', '.join(f'{r(c)} AS {c}' for c in FULL[:5])}, {', '.join(COUNTS)} FROM monthly"""))
def monthly_weather_base(spark, sf):
    return _rounded(monthly(spark, sf, weather.base_aggregates), FULL[:5])


@query(with_roles("monthly", f"SELECT stn, month, {r('thi_mean')} AS thi_mean, heat2d, heat3d FROM monthly"))
def monthly_index(spark, sf):
    return _rounded(monthly(spark, sf, weather.index_aggregates), ["thi_mean"])


@query(with_roles("graded_rows monthly", f"""
    SELECT CAST(date_trunc('month', judged) AS DATE) AS month, count(*) AS n, {r('avg(m.thi_mean)')} AS thi_mean,
           {r("avg(CASE WHEN grade LIKE '1+%' THEN 1e0 ELSE 0e0 END)")} AS high_rate
    FROM graded_rows a LEFT JOIN monthly m ON m.stn = a.stn AND m.month = CAST(date_trunc('month', a.judged) AS DATE)
    GROUP BY 1"""))
def weather_by_class(spark, sf):
    """Flagship: facts joined to their station's month, index mean and high-class rate per month."""
    facts = roles.graded_rows(spark, sf).select("stn", "judged", "grade")
    lookup = settle(monthly(spark, sf, weather.index_aggregates))
    joined = timeseries.month_join(facts, lookup, ["stn"], "judged")
    high = clean.is_member(domain.quality_of(F.col("grade")), domain.HIGH_QUALITY).cast("double")
    return joined.groupBy(clean.month_start("judged").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), stable_round(F.avg("thi_mean"), 4).alias("thi_mean"),
        stable_round(F.avg(high), 4).alias("high_rate"),
    )


@query(with_roles("graded_rows monthly", f"""
    SELECT animal, {r('s.thi_mean')} AS s_thi_mean, s.heat2d AS s_heat2d, {r('b.thi_mean')} AS b_thi_mean, b.heat2d AS b_heat2d
    FROM graded_rows a
    LEFT JOIN monthly s ON s.stn = a.stn AND s.month = CAST(date_trunc('month', judged) AS DATE)
    LEFT JOIN monthly b ON b.stn = a.stn AND b.month = CAST(date_trunc('month', born) AS DATE)"""))
def month_weather_join(spark, sf):
    lookup = settle(monthly(spark, sf, weather.index_aggregates).drop("heat3d"))
    out = roles.graded_rows(spark, sf).select("animal", "stn", "judged", "born")
    for prefix, date in (("s_", "judged"), ("b_", "born")):
        out = timeseries.month_join(out, clean.with_prefix(lookup, prefix, ["stn", "month"]), ["stn"], date)
    return _rounded(out.drop("stn", "judged", "born"), ["s_thi_mean", "b_thi_mean"])


_LAGS = {"s_": 0, "p1_": 1, "p2_": 2, "p3_": 3}


@query(with_roles("graded_rows monthly", f"""
    SELECT animal, {', '.join(f"{r(f'{p}.ta_mean')} AS {p}_ta_mean, {p}.cold_d AS {p}_cold_d, {r(f'{p}.rn_sum')} AS {p}_rn_sum"
                              for p in ('s', 'p1', 'p2', 'p3'))}
    FROM graded_rows a {' '.join(f"LEFT JOIN monthly {p} ON {p}.stn = a.stn AND {p}.month = CAST(date_trunc('month', judged) - INTERVAL {k} MONTH AS DATE)"
                             for p, k in (('s', 0), ('p1', 1), ('p2', 2), ('p3', 3)))}"""))
def lag_month_weather(spark, sf):
    metrics = settle(monthly(spark, sf).select("stn", "month", "ta_mean", "cold_d", "rn_sum"))
    lookup = timeseries.lagged_lookup(metrics, ["stn"], "month", _LAGS)
    out = timeseries.month_join(roles.graded_rows(spark, sf).select("animal", "stn", "judged"), lookup, ["stn"], "judged")
    return _rounded(out.drop("stn", "judged"), [f"{p}{m}" for p in _LAGS for m in ("ta_mean", "rn_sum")])


REAR_MEANS = {
    "rear_ta_mean": "avg(ta_mean)", "rear_ta_max": "avg(ta_max_mean)", "rear_ta_min": "avg(ta_min_mean)",
    "rear_thi_mean": "avg(thi_mean)", "rear_thi_max": "max(thi_max)", "rear_rhm_mean": "avg(rhm_mean)",
    "rear_rn_total": "coalesce(sum(rn_sum), 0)",
    "rear_summer_thi": "avg(thi_mean) FILTER (WHERE month(x.month) IN (6, 7, 8))",
    "rear_winter_ta": "avg(ta_mean) FILTER (WHERE month(x.month) IN (12, 1, 2))",
}
REAR_COUNTS = {
    "rear_heat2d_total": "coalesce(sum(heat2d), 0)", "rear_heat3d_total": "coalesce(sum(heat3d), 0)",
    "rear_cold_d_total": "coalesce(sum(cold_d), 0)", "rear_month_cnt": "count(ta_mean)",
    "rear_summer_heat": "CASE WHEN count(*) FILTER (WHERE month(x.month) IN (6, 7, 8)) > 0 THEN coalesce(sum(heat2d) FILTER (WHERE month(x.month) IN (6, 7, 8)), 0) END",
    "rear_winter_cold": "CASE WHEN count(*) FILTER (WHERE month(x.month) IN (12, 1, 2)) > 0 THEN coalesce(sum(cold_d) FILTER (WHERE month(x.month) IN (12, 1, 2)), 0) END",
}


@query(with_roles("graded_rows monthly", f""", a AS (
    SELECT animal, stn, judged, CASE WHEN born < DATE '{FLOOR}' THEN DATE '{FLOOR}' ELSE born END AS born FROM graded_rows),
    x AS (SELECT animal, stn, CAST(unnest(generate_series(date_trunc('month', born), date_trunc('month', judged), INTERVAL 1 MONTH)) AS DATE) AS month
          FROM a WHERE born <= judged),
    f AS (SELECT animal, {', '.join(f'{r(e)} AS {n}' for n, e in REAR_MEANS.items())},
                 {', '.join(f'CAST({e} AS BIGINT) AS {n}' for n, e in REAR_COUNTS.items())}
          FROM x LEFT JOIN monthly m ON m.stn = x.stn AND m.month = x.month GROUP BY animal)
    SELECT animal, f.* EXCLUDE (animal) FROM a LEFT JOIN f USING (animal)"""))
def rearing_weather(spark, sf):
    facts = roles.graded_rows(spark, sf).select("animal", "stn", "born", "judged")
    lookup = settle(monthly(spark, sf))
    floor = F.lit(FLOOR).cast("date")
    table = timeseries.interval_measures(facts, lookup, ["stn"], "born", "judged", *weather.rearing_measures(), floor=floor)
    out = timeseries.apply_interval_table(facts, table, ["stn"], "born", "judged", floor)
    return _rounded(out.drop("stn", "born", "judged"), list(REAR_MEANS))


@query(with_roles("graded_rows daily", f""", q AS (SELECT DISTINCT stn, judged FROM graded_rows),
    d AS (SELECT q.stn, q.judged, sum(ta_max) / count(ta_max) AS mx, count(*) FILTER (WHERE ta_max >= 33) AS heat
          FROM q JOIN daily w ON w.stn = q.stn AND w.date BETWEEN q.judged - 30 AND q.judged - 1 GROUP BY 1, 2)
    SELECT animal, {r('mx')} AS pre30d_ta_max_mean, heat AS pre30d_heat_days FROM graded_rows LEFT JOIN d USING (stn, judged)"""))
def preceding_weather(spark, sf):
    facts = roles.graded_rows(spark, sf).select("animal", "stn", "judged")
    sums = {
        "high": F.col("ta_max"), "days": F.col("ta_max").isNotNull().cast("long"),
        "pre30d_heat_days": F.coalesce(F.col("ta_max") >= 33, F.lit(False)).cast("long"),
    }
    out = timeseries.preceding_days(facts, roles.daily(spark, sf), ["stn"], "date", "judged", 30, sums)
    mean = clean.safe_ratio(F.col("high"), F.col("days"))
    return out.select("animal", stable_round(mean, 4).alias("pre30d_ta_max_mean"), "pre30d_heat_days")


@query(with_roles("graded_rows daily", f""", per AS (
      SELECT stn, date, sum(ta_max - ta_min) AS rng, count(*) AS n, count(*) FILTER (WHERE ta_max >= 33) AS heat,
             count(*) FILTER (WHERE ta_min <= -8) AS cold FROM daily GROUP BY 1, 2),
    s AS (SELECT DISTINCT stn FROM daily), q AS (SELECT DISTINCT stn, born, judged FROM graded_rows),
    g AS (SELECT q.stn, q.born, q.judged, coalesce(sum(rng), 0) AS rng, CAST(coalesce(sum(n), 0) AS BIGINT) AS n,
                 CAST(coalesce(sum(heat), 0) AS BIGINT) AS heat, CAST(coalesce(sum(cold), 0) AS BIGINT) AS cold
          FROM q JOIN s USING (stn) LEFT JOIN per ON per.stn = q.stn AND per.date BETWEEN q.born AND q.judged GROUP BY 1, 2, 3)
    SELECT animal, {r('rng / nullif(n, 0)')} AS diurnal_range_mean, heat AS heat_days, cold AS cold_days
    FROM graded_rows LEFT JOIN g USING (stn, born, judged)"""))
def rearing_days(spark, sf):
    facts = roles.graded_rows(spark, sf).select("animal", "stn", "born", "judged")
    count = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    sums = {
        "rng": F.col("ta_max") - F.col("ta_min"), "n": F.lit(1).cast("long"),
        "heat_days": count(F.col("ta_max") >= 33), "cold_days": count(F.col("ta_min") <= -8),
    }
    out = timeseries.interval_daily_sums(facts, roles.daily(spark, sf), ["stn"], "date", "born", "judged", sums)
    mean = clean.safe_ratio(F.col("rng"), F.col("n"))
    return out.select("animal", stable_round(mean, 4).alias("diurnal_range_mean"), "heat_days", "cold_days")


@query(with_roles("daily", f"""
    SELECT date, {', '.join(f'{r(f"avg({c})")} AS {c}' for c in ('ta_max', 'ta_min', 'rn_day', 'rhm_avg', 'ws_davg'))}
    FROM daily GROUP BY date"""))
def daily_means(spark, sf):
    columns = ["ta_max", "ta_min", "rn_day", "rhm_avg", "ws_davg"]
    return _rounded(timeseries.daily_means(roles.daily(spark, sf), "date", columns), columns)


@query(with_roles("graded_rows", f"""
    SELECT CAST(date_trunc('month', judged) AS DATE) AS month, count(*) AS n, {r('avg(weight)')} AS mean_weight,
           {r('avg(marbling)')} AS mean_marbling FROM graded_rows GROUP BY 1"""))
def monthly_trend(spark, sf):
    return roles.graded_rows(spark, sf).groupBy(clean.month_start("judged").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), stable_round(F.avg("weight"), 4).alias("mean_weight"),
        stable_round(F.avg("marbling"), 4).alias("mean_marbling"),
    )


@query(with_roles("deaths", """, d AS (
      SELECT CAST(date_trunc('month', try_strptime(CAST(dead_ymd AS VARCHAR), '%Y%m%d')) AS DATE) AS month FROM deaths),
    e AS (SELECT min(month) AS a, max(month) AS z FROM d),
    s AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 MONTH)) AS DATE) AS month FROM e)
    SELECT s.month, count(d.month) AS n FROM s LEFT JOIN d USING (month) GROUP BY 1"""))
def monthly_gapfill(spark, sf):
    df = roles.deaths(spark, sf)
    return timeseries.gap_filled_counts(df.select(clean.compact_date("dead_ymd").alias("dead")), "dead")


@query("""WITH d AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders),
    e AS (SELECT least(min(month), DATE '1990-03-01') AS a, greatest(max(month), DATE '2003-11-01') AS z FROM d),
    s AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 MONTH)) AS DATE) AS month FROM e)
    SELECT s.month, count(d.month) AS n FROM s LEFT JOIN d USING (month) GROUP BY 1""")
def seasonal_gapfill(spark, sf):
    """The same over a range that is wider than the data."""
    orders = roles.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    return timeseries.gap_filled_counts(orders, "d", start="1990-03-15", end="2003-11-15")


@query(with_roles("graded_rows monthly", f"""
    SELECT nullif(regexp_extract(grade, '^(1\\+\\+|1\\+|1|2|3|등외)', 1), '') AS quality, {r('avg(heat2d)')} AS heat2d
    FROM graded_rows a LEFT JOIN monthly m ON m.stn = a.stn AND m.month = CAST(date_trunc('month', judged) AS DATE)
    WHERE grade IS NOT NULL GROUP BY 1"""))
def heat_by_class(spark, sf):
    lookup = settle(monthly(spark, sf, weather.index_aggregates))
    joined = timeseries.month_join(roles.graded_rows(spark, sf).select("stn", "judged", "grade"), lookup, ["stn"], "judged")
    quality = joined.withColumn("quality", domain.quality_of(F.col("grade"))).dropna(subset=["quality"])
    return quality.groupBy("quality").agg(stable_round(F.avg("heat2d"), 4).alias("heat2d"))


@query(with_roles("daily daily_index", f"""
    SELECT CAST(month(date) AS INTEGER) AS month, {', '.join(f'{r(f"avg(thi) FILTER (WHERE year(date) = {y})")} AS "{y}"' for y in range(1995, 2002))}
    FROM daily_index GROUP BY 1"""))
def yearly_index_pivot(spark, sf):
    df = weather.with_index(roles.daily(spark, sf)).select(F.year("date").alias("year"), F.month("date").alias("month"), "thi")
    years = list(range(1995, 2002))
    return _rounded(profile.pivot_means(df, "month", "year", years, "thi"), [str(y) for y in years])
