"""Queries over cleaning, scalar, code and bin functions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gradeframe.catalog import roles
from gradeframe.catalog.registry import query
from gradeframe.catalog.roles import sql_round as r, with_roles
from gradeframe.functions import binning, clean, domain, encode, weather
from gradeframe.functions.clean import stable_round
from gradeframe.operators import joins, profile
from gradeframe.plans import training


@query(with_roles("graded_rows", """
    SELECT animal, nullif(cost, -99) AS cost, nullif(wgrade, '-99.0') AS wgrade FROM graded_rows"""))
def sentinel_clean(spark, sf):
    df = roles.graded_rows(spark, sf).select("animal", "cost", "wgrade")
    return clean.null_if_text(clean.null_if_sentinel(df, ["cost"]), ["wgrade"])


_TEXT_DATE = "CASE WHEN o_orderkey % 50 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END"
_COMPACT = ("CASE WHEN o_orderkey % 41 = 0 THEN '-99' WHEN o_orderkey % 43 = 0 THEN '20240231' "
            "ELSE strftime(o_orderdate, '%Y%m%d') END")


@query(f"""
    WITH d AS (SELECT o_orderkey AS animal, TRY_CAST({_TEXT_DATE} AS DATE) AS judged,
                      CAST(try_strptime({_COMPACT}, '%Y%m%d') AS DATE) AS born FROM orders)
    SELECT animal, judged, born, CAST(coalesce(year(judged), 0) AS INTEGER) AS judged_year,
           CAST(coalesce(month(judged), 0) AS INTEGER) AS judged_month,
           CASE WHEN month(judged) BETWEEN 3 AND 5 THEN 0 WHEN month(judged) BETWEEN 6 AND 8 THEN 1
                WHEN month(judged) BETWEEN 9 AND 11 THEN 2 ELSE 3 END AS judged_season,
           CASE WHEN month(born) BETWEEN 3 AND 5 THEN '봄(3-5)' WHEN month(born) BETWEEN 6 AND 8 THEN '여름(6-8)'
                WHEN month(born) BETWEEN 9 AND 11 THEN '가을(9-11)' ELSE '겨울(12-2)' END AS born_season,
           CAST(date_trunc('month', judged) AS DATE) AS judged_from,
           CAST(judged - INTERVAL 1 MONTH AS DATE) AS lag1, CAST(judged - INTERVAL 2 MONTH AS DATE) AS lag2,
           CAST(judged - INTERVAL 3 MONTH AS DATE) AS lag3
    FROM d""")
def date_parts(spark, sf):
    key = F.col("o_orderkey")
    raw = roles.table(spark, sf, "orders").select(
        key.alias("animal"),
        F.when(key % 50 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("judged"),
        F.when(key % 41 == 0, -99).when(key % 43 == 0, 20240231)
        .otherwise(F.date_format("o_orderdate", "yyyyMMdd").cast("int")).alias("born"),
    )
    df = raw.withColumns({"judged": clean.iso_date("judged"), "born": clean.compact_date("born")})
    judged = F.col("judged")
    return df.select(
        "animal", "judged", "born", clean.year_or_zero(judged).alias("judged_year"),
        clean.month_or_zero(judged).alias("judged_month"), encode.season_code(F.month(judged)).alias("judged_season"),
        encode.season_label(F.month("born"), domain.SEASONS).alias("born_season"),
        clean.month_start("judged").alias("judged_from"),
        *[clean.shift_months("judged", k).alias(f"lag{k}") for k in (1, 2, 3)],
    )


@query(with_roles("deaths", f""", d AS (
    SELECT farm, CAST(try_strptime(CAST(dead_ymd AS VARCHAR), '%Y%m%d') AS DATE)
                 - CAST(try_strptime(CAST(born_ymd AS VARCHAR), '%Y%m%d') AS DATE) AS days FROM deaths)
    SELECT farm, days, {r('days / 30.44e0')} AS months,
           {r('CASE WHEN days / 30.44e0 > 40 THEN 40 ELSE days / 30.44e0 END')} AS months_capped FROM d"""))
def death_lifespans(spark, sf):
    df = roles.deaths(spark, sf)
    dead, born = clean.compact_date("dead_ymd"), clean.compact_date("born_ymd")
    months = clean.months_between(dead, born)
    return df.select(
        "farm", clean.days_between(dead, born).cast("long").alias("days"), stable_round(months, 4).alias("months"),
        stable_round(clean.clip_upper(months, F.lit(40.0)), 4).alias("months_capped"),
    )


@query(with_roles("graded_rows", f""", m AS (SELECT avg(nullif(cost, -99)) AS mu FROM graded_rows)
    SELECT animal, CASE WHEN born < DATE '1995-01-01' THEN DATE '1995-01-01' ELSE born END AS born_from,
           {r('coalesce(nullif(cost, -99), mu)')} AS cost, coalesce(grade, '등외') AS grade,
           CAST(floor(coalesce(nullif(cost, -99), -999) + 0.5e0) AS BIGINT) AS cost_code
    FROM graded_rows, m"""))
def fill_and_clip(spark, sf):
    df = clean.null_if_sentinel(roles.graded_rows(spark, sf), ["cost"])
    filled = clean.fill_with_mean(df.withColumn("raw", F.col("cost")), "cost", df)
    floor = F.lit("1995-01-01").cast("date")
    out = filled.select(
        "animal", clean.clip_lower(F.col("born"), floor).alias("born_from"), stable_round(F.col("cost"), 4).alias("cost"),
        "grade", F.round(F.coalesce("raw", F.lit(-999.0)), 0).alias("cost_code"),
    )
    return clean.narrow(clean.fill_nulls(out, {"grade": domain.OUTSIDE}), {"cost_code": "long"})


@query(with_roles("farm_area farms deaths", f""", d AS (SELECT farm, count(*) AS n FROM deaths GROUP BY 1)
    SELECT farm, {r('avg_cattle')} AS avg_cattle, {r('density', 6)} AS density, {r('area_per_head')} AS area_per_head,
           coalesce(n, 0) AS death_cnt, {r('coalesce(n, 0) / (coalesce(avg_cattle, 1) + 1)')} AS death_rate,
           {r('(C1999 - C1998) / nullif(C1998, 0)')} AS change_1999, {r('(C2000 - C1999) / nullif(C1999, 0)')} AS change_2000
    FROM farms LEFT JOIN d USING (farm)"""))
def farm_features(spark, sf):
    df = _farms(spark, sf)
    deaths = roles.deaths(spark, sf).groupBy("farm").agg(F.count(F.lit(1)).alias("death_cnt"))
    # Both sides have one row per farm, so no key is heavy: a plain equi join.
    out = df.join(deaths, "farm", "left").withColumn("death_cnt", F.coalesce("death_cnt", F.lit(0)))
    return out.select(
        "farm", stable_round(F.col("avg_cattle"), 4).alias("avg_cattle"), stable_round(F.col("density"), 6).alias("density"),
        stable_round(clean.safe_ratio(F.col("AREA"), F.col("avg_cattle")), 4).alias("area_per_head"), "death_cnt",
        stable_round(clean.smoothed_death_rate(F.col("death_cnt"), F.col("avg_cattle")), 4).alias("death_rate"),
        stable_round(clean.change_rate(F.col("C1998"), F.col("C1999")), 4).alias("change_1999"),
        stable_round(clean.change_rate(F.col("C1999"), F.col("C2000")), 4).alias("change_2000"),
    )


def _farms(spark, sf):
    years = ["C1998", "C1999", "C2000"]
    df = clean.null_if_sentinel(roles.farm_area(spark, sf), [*years, "AREA"])
    df = df.withColumn("avg_cattle", clean.row_mean(*[F.col(c) for c in years]))
    return df.withColumn("density", clean.safe_ratio(F.col("avg_cattle"), F.col("AREA")))


_GRADES_SQL = "[" + ", ".join(f"'{g}'" for g in domain.GRADES) + "]"


@query(with_roles("graded_rows", f"""
    SELECT animal, CASE sex WHEN '암' THEN 0 WHEN '수' THEN 1 WHEN '거세' THEN 2 ELSE -1 END AS sex_code,
           CASE region WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE -1 END AS region_code,
           CAST(coalesce(16 - nullif(list_position({_GRADES_SQL}, grade), 0), 0) AS INTEGER) AS score,
           CAST(list_position({_GRADES_SQL}, coalesce(grade, '등외')) - 1 AS INTEGER) AS label,
           coalesce(grade, '등외') AS decoded
    FROM graded_rows"""))
def category_codes(spark, sf):
    label = domain.grade_index(F.col("grade"))
    return roles.graded_rows(spark, sf).select(
        "animal", domain.sex_code(F.col("sex")).alias("sex_code"),
        encode.code_of(F.col("region"), {"BUILDING": 0, "MACHINERY": 1}).alias("region_code"),
        domain.grade_score(F.col("grade")).alias("score"), label.alias("label"),
        encode.label_of(label, domain.GRADES).alias("decoded"),
    )


@query(with_roles("daily daily_index", f"""
    SELECT stn, date, {r('ta_avg')} AS ta_avg, {r('thi')} AS thi, CAST(coalesce(thi >= 80, false) AS INTEGER) AS heat2,
           CAST(coalesce(thi >= 85, false) AS INTEGER) AS heat3, CAST(coalesce(ta_min < -5, false) AS INTEGER) AS cold
    FROM daily_index"""))
def weather_index(spark, sf):
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return weather.with_index(roles.daily(spark, sf)).select(
        "stn", "date", stable_round(F.col("ta_avg"), 4).alias("ta_avg"), stable_round(F.col("thi"), 4).alias("thi"),
        flag(F.col("thi") >= weather.HEAT_MODERATE).alias("heat2"), flag(F.col("thi") >= weather.HEAT_SEVERE).alias("heat3"),
        flag(F.col("ta_min") < weather.COLD_BELOW).alias("cold"),
    )


@query(with_roles("graded_rows", """, a AS (
    SELECT animal, CAST((judged - born) // 30 AS INTEGER) AS age,
           CASE sex WHEN '암' THEN 0 WHEN '수' THEN 1 ELSE 2 END AS sex_code,
           CASE WHEN month(judged) BETWEEN 3 AND 5 THEN 0 WHEN month(judged) BETWEEN 6 AND 8 THEN 1
                WHEN month(judged) BETWEEN 9 AND 11 THEN 2 ELSE 3 END AS season FROM graded_rows)
    SELECT animal, age, CAST(age * age AS DOUBLE) AS age_sq, age * sex_code AS age_sex, age * season AS age_season FROM a"""))
def interaction_terms(spark, sf):
    age = F.col("age")
    df = roles.graded_rows(spark, sf).withColumn("age", F.floor(F.datediff("judged", "born") / 30).cast("int"))
    return df.select(
        "animal", "age", (age * age).cast("double").alias("age_sq"),
        (age * domain.sex_code(F.col("sex"))).alias("age_sex"),
        (age * encode.season_code(F.month("judged"))).alias("age_season"),
    )


@query(with_roles("graded_rows", """
    SELECT animal, nullif(regexp_extract(grade, '^(1\\+\\+|1\\+|1|2|3|등외)', 1), '') AS quality,
           nullif(regexp_extract(grade, '(A|B|C)$', 1), '') AS yield,
           coalesce(regexp_extract(grade, '^(1\\+\\+|1\\+|1|2|3|등외)', 1) IN ('1++', '1+'), false) AS high
    FROM graded_rows"""))
def grade_parts(spark, sf):
    quality = domain.quality_of(F.col("grade"))
    return roles.graded_rows(spark, sf).select(
        "animal", quality.alias("quality"), domain.yield_of(F.col("grade")).alias("yield"),
        clean.is_member(quality, domain.HIGH_QUALITY).alias("high"),
    )


@query(with_roles("daily", f"""
    SELECT stn AS s_stn, sum(coalesce(ta_max, -999)) AS s_ta_max, sum(coalesce(ta_min, -999)) AS s_ta_min,
           {r('sum(coalesce(rn_day, -999))')} AS s_rn_day, -999e0 * count(*) AS s_gust, 'ta_max,ta_min,rn_day,gust' AS features
    FROM daily GROUP BY stn"""))
def feature_vectors(spark, sf):
    """Chosen features, a column the table lacks, and the assembled vector, summed per station."""
    daily = clean.add_missing(clean.present_columns(roles.daily(spark, sf), ["stn", "ta_max", "ta_min", "rn_day", "none"]), ["gust"])
    names = clean.numeric_features(daily, ["stn"])
    matrix = training.feature_matrix(daily, names, ["stn"])
    parts = vector_to_array("features")
    wide = matrix.select("stn", *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])
    sums = wide.groupBy("stn").agg(*[F.sum(n).alias(n) for n in names])
    sums = sums.withColumn("rn_day", stable_round(F.col("rn_day"), 4))
    return clean.with_prefix(sums, "s_", []).withColumn("features", F.lit(",".join(names)))


@query(f"""SELECT o_orderpriority AS priority, count(*) AS n, {r('count(*) * 100e0 / sum(count(*)) OVER ()')} AS pct
    FROM orders GROUP BY 1""")
def share_of_total(spark, sf):
    counts = profile.value_counts(roles.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("priority")), "priority")
    return profile.with_share(counts, "n", "pct", 100.0).withColumn("pct", stable_round(F.col("pct"), 4))


@query(with_roles("farm_area farms", """, b AS (
    SELECT farm, CASE WHEN avg_cattle <= 0 THEN NULL WHEN avg_cattle <= 2 THEN 'a' WHEN avg_cattle <= 4 THEN 'b'
                      WHEN avg_cattle <= 6 THEN 'c' WHEN avg_cattle IS NOT NULL THEN 'd' END AS size FROM farms)
    SELECT size, count(*) AS n FROM b GROUP BY 1"""))
def fixed_bins(spark, sf):
    size = binning.fixed_bins(F.col("avg_cattle"), [0, 2, 4, 6, float("inf")], ["a", "b", "c", "d"])
    return _farms(spark, sf).select(size.alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n"))


@query(with_roles("farm_area farms", """, cap AS (SELECT quantile_cont(density, 0.99) AS c FROM farms),
    w AS (SELECT farm, least(density, c) AS d FROM farms, cap WHERE density IS NOT NULL),
    e AS (SELECT quantile_cont(d, 0.25) AS q1, quantile_cont(d, 0.5) AS q2, quantile_cont(d, 0.75) AS q3 FROM w)
    SELECT farm, CASE WHEN d <= q1 THEN '저밀도' WHEN d <= q2 THEN '중저' WHEN d <= q3 THEN '중고' ELSE '고밀도' END AS band
    FROM w, e UNION ALL SELECT farm, NULL FROM farms WHERE density IS NULL"""))
def quantile_bins(spark, sf):
    return binning.quantile_bins(_farms(spark, sf), "density", domain.DENSITY_LABELS, "band", clip_at=0.99).select("farm", "band")


@query(f"""WITH cap AS (SELECT quantile_cont(o_totalprice, 0.95) AS c FROM orders)
    SELECT o_orderkey AS animal, {r('least(o_totalprice, c)')} AS weight FROM orders, cap""")
def winsorise(spark, sf):
    df = roles.table(spark, sf, "orders").select(F.col("o_orderkey").alias("animal"), F.col("o_totalprice").alias("weight"))
    return binning.winsorise(df, "weight", 0.95).withColumn("weight", stable_round(F.col("weight"), 4))


@query("""WITH cap AS (SELECT quantile_cont(o_totalprice, 0.75) AS c FROM orders)
    SELECT o_orderkey AS animal, o_totalprice AS weight FROM orders, cap WHERE o_totalprice >= c""")
def top_quartile_rows(spark, sf):
    df = roles.table(spark, sf, "orders").select(F.col("o_orderkey").alias("animal"), F.col("o_totalprice").alias("weight"))
    return binning.at_or_above_quantile(df, "weight", 0.75)


@query("""SELECT l_returnflag AS flag, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    WHERE CAST(o_orderdate AS DATE) <= CAST(l_shipdate AS DATE) AND nullif(l_linenumber, 7) IS NOT NULL
      AND month(l_shipdate) IN (6, 7, 8) AND l_linestatus = 'F' GROUP BY 1""")
def valid_rows(spark, sf):
    """Valid intervals, no missing measure, summer months, one category."""
    lines = roles.table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_shipdate").cast("date").alias("end"), "l_returnflag", "l_linestatus",
        F.nullif("l_linenumber", F.lit(7)).alias("measure"),
    )
    orders = roles.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("start"))
    kept = lines.dropna(subset=["measure"]).filter(F.month("end").isin(6, 7, 8) & (F.col("l_linestatus") == "F"))
    both = joins.lookup_join(kept, orders, ["l_orderkey"], "inner").filter("start <= end")
    return both.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"))


_YI = {k: v for k, v in domain.YIELD_INDEX.items()}
_YI_CASE = " ".join(
    f"WHEN sex = '{s}' THEN ({v[0]}e0 + fat * {v[1]}e0 + eye * {v[2]}e0 + kg * {v[3]}e0) / kg * 100e0" for s, v in _YI.items())
_YG_CASE = " ".join(
    f"WHEN sex = '{s}' AND yi >= {v[4]}e0 THEN 'A' WHEN sex = '{s}' AND yi >= {v[5]}e0 THEN 'B' WHEN sex = '{s}' THEN 'C'" for s, v in _YI.items())


@query(with_roles("graded_rows", f""", m AS (
    SELECT animal, sex, marbling AS fat, marbling * 10 AS eye, weight / 1e3 AS kg FROM graded_rows),
    i AS (SELECT animal, sex, CASE {_YI_CASE} END AS yi FROM m)
    SELECT animal, {r('yi')} AS yield_index, CASE {_YG_CASE} END AS yield_grade FROM i"""))
def yield_index(spark, sf):
    df = roles.graded_rows(spark, sf).select(
        "animal", "sex", F.col("marbling").alias("fat"), (F.col("marbling") * 10).alias("eye"), (F.col("weight") / 1000.0).alias("kg")
    )
    df = df.withColumn("yi", domain.yield_index(F.col("sex"), F.col("fat"), F.col("eye"), F.col("kg")))
    return df.select("animal", stable_round(F.col("yi"), 4).alias("yield_index"), domain.yield_grade(F.col("sex"), F.col("yi")).alias("yield_grade"))


@query(f"""SELECT c_custkey AS farm, region, coalesce(CAST(list_position([{', '.join(f"'{n}'" for n in domain.REGIONS)}], region) - 1 AS INTEGER), -1) AS code
    FROM (SELECT c_custkey, [{', '.join(f"'{n}'" for n in domain.REGIONS)}, '미상'][CAST(c_custkey % 21 AS INTEGER) + 1] AS region FROM customer)""")
def region_codes(spark, sf):
    """The region dictionary over all its names, an unknown name and a missing one."""
    names = F.array(*[F.lit(n) for n in [*domain.REGIONS, "미상"]])
    df = roles.table(spark, sf, "customer").select(F.col("c_custkey").alias("farm"), F.get(names, (F.col("c_custkey") % 21).cast("int")).alias("region"))
    return df.withColumn("code", domain.region_code(F.col("region")))
