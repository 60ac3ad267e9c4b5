"""Queries over sampling, folds, metrics, training and output."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Window, functions as F

from gradeframe.catalog import roles, weathering
from gradeframe.catalog.registry import query
from gradeframe.catalog.roles import sql_round as r, with_roles
from gradeframe.functions import clean, domain, encode, weather
from gradeframe.functions.clean import stable_round
from gradeframe.operators import encoding, joins, metrics, sampling
from gradeframe.plans import grading, stopping, training
from gradeframe.session import checkpoint_dir, settle
from gradeframe.sources import sinks, store, tables

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _rounded(df, columns, digits=4):
    return df.withColumns({c: stable_round(F.col(c), digits) for c in columns})


def _keys(spark, sf):
    return roles.table(spark, sf, "orders").select(F.col("o_orderkey").alias("animal"), F.col("o_orderpriority").alias("priority"))


# md5 is the hash both engines have; the default of the library is xxhash64.
_HASHED = "SELECT o_orderkey AS animal, o_orderpriority AS priority, md5(o_orderkey || ':42') AS h FROM orders"


@query(f"SELECT animal FROM ({_HASHED}) ORDER BY h, animal LIMIT 5000")
def sample_rows(spark, sf):
    return sampling.sample_rows(_keys(spark, sf), ["animal"], 5000, method="md5").select("animal")


@query(f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY h, animal) AS rn,
      count(*) OVER (PARTITION BY priority) AS n, count(*) OVER () AS total FROM ({_HASHED}))
    SELECT animal, priority FROM h WHERE rn <= floor(3000e0 * n / total) + 1""")
def stratified_sample(spark, sf):
    """A quarter-sized hash range, so that split points fall inside ranges."""
    return sampling.stratified_sample(_keys(spark, sf), ["animal"], "priority", 3000, method="md5", rows_per_range=1000)


@query(f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY h, animal) AS rn,
      count(*) OVER (PARTITION BY priority) AS n FROM ({_HASHED}))
    SELECT animal, priority, rn <= floor(n * 0.2e0 + 0.5) AS is_validation FROM h""")
def stratified_holdout(spark, sf):
    return sampling.stratified_holdout(_keys(spark, sf), ["animal"], "priority", 0.2, method="md5", rows_per_range=1000)


@query(f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY h, animal) - 1 AS rn,
      count(*) OVER (PARTITION BY priority) AS n FROM ({_HASHED}))
    SELECT animal, priority, CAST((rn >= floor(n * 1 / 3e0))::INT + (rn >= floor(n * 2 / 3e0))::INT AS INTEGER) AS fold FROM h""")
def stratified_folds(spark, sf):
    return sampling.stratified_folds(_keys(spark, sf), ["animal"], "priority", 3, method="md5", rows_per_range=1000)


@query("SELECT DISTINCT o_orderpriority AS priority, true AS plausible FROM orders")
def stratified_sample_approx(spark, sf):
    """Bernoulli sample per class: every class is there, with a size within six deviations of the expected one."""
    keys = _keys(spark, sf)
    got = sampling.stratified_sample_approx(keys, "priority", {p: 0.25 for p in PRIORITIES}).groupBy("priority").agg(F.count(F.lit(1)).alias("n"))
    whole = keys.groupBy("priority").agg(F.count(F.lit(1)).alias("of"))
    off = F.abs(F.coalesce("n", F.lit(0)) - 0.25 * F.col("of"))
    return whole.join(got, "priority", "left").select("priority", (off <= 6 * F.sqrt(0.25 * 0.75 * F.col("of"))).alias("plausible"))


@query(with_roles("graded_rows", "SELECT year(judged) <= 1997 AS is_train, count(*) AS n FROM graded_rows GROUP BY 1"))
def time_split(spark, sf):
    train, later = sampling.split_by_year(roles.graded_rows(spark, sf).select("animal", "judged"), "judged", 1997)
    both = joins.stack_rows(train.withColumn("is_train", F.lit(True)), later.withColumn("is_train", F.lit(False)))
    return both.groupBy("is_train").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT o_orderpriority AS priority, count(*) AS n,
    {r('(SELECT count(*) FROM orders) * 1e0 / ((SELECT count(DISTINCT o_orderpriority) FROM orders) * count(*))', 6)} AS weight FROM orders GROUP BY 1""")
def class_weights(spark, sf):
    return _rounded(metrics.class_weights(_keys(spark, sf), "priority"), ["weight"], 6)


_PAIRS = """SELECT o_orderkey AS animal, o_orderpriority AS label, CASE WHEN o_orderkey % 3 = 0 THEN '3-MEDIUM'
    WHEN o_orderkey % 7 = 0 THEN '6-NONE' ELSE o_orderpriority END AS predicted FROM orders"""


def _pairs(spark, sf):
    key = F.col("o_orderkey")
    predicted = F.when(key % 3 == 0, "3-MEDIUM").when(key % 7 == 0, "6-NONE").otherwise(F.col("o_orderpriority"))
    return roles.table(spark, sf, "orders").select(key.alias("animal"), F.col("o_orderpriority").alias("label"), predicted.alias("predicted"))


_F1 = f"""p AS ({_PAIRS}), c AS (SELECT label AS class FROM p UNION SELECT predicted FROM p),
    s AS (SELECT class, (SELECT count(*) FROM p WHERE label = class) AS support, (SELECT count(*) FROM p WHERE predicted = class) AS predicted,
                 (SELECT count(*) FROM p WHERE label = class AND predicted = class) AS tp FROM c)"""


@query(f"WITH {_F1} SELECT {r('avg(2e0 * tp / (support + predicted))', 6)} AS macro_f1, count(*) AS n_classes FROM s")
def macro_f1(spark, sf):
    return _rounded(metrics.macro_f1(_pairs(spark, sf), "label", "predicted"), ["macro_f1"], 6)


@query(f"""WITH {_F1} SELECT class, support, predicted, tp, {r('coalesce(tp * 1e0 / nullif(predicted, 0), 0)', 6)} AS precision,
    {r('coalesce(tp * 1e0 / nullif(support, 0), 0)', 6)} AS recall, {r('2e0 * tp / (support + predicted)', 6)} AS f1 FROM s""")
def class_f1(spark, sf):
    return _rounded(metrics.class_f1(_pairs(spark, sf), "label", "predicted"), ["precision", "recall", "f1"], 6)


@query(f"WITH p AS ({_PAIRS}) SELECT label, " + ", ".join(
    f"count(*) FILTER (WHERE predicted = '{c}') AS \"{c}\"" for c in [*PRIORITIES, "6-NONE"]) + " FROM p GROUP BY 1")
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(_pairs(spark, sf), "label", "predicted", [*PRIORITIES, "6-NONE"])


@query(f"""WITH f AS (SELECT o_orderkey % 5 AS fold, avg(o_totalprice) / 1e6 AS f1, count(*) % 97 AS rounds FROM orders GROUP BY 1)
    SELECT {r('avg(f1)', 6)} AS mean_score, {r('stddev_pop(f1)', 6)} AS std_score, {r('avg(rounds)')} AS mean_rounds,
           CAST(floor(avg(rounds) * 1.1e0) AS BIGINT) AS refit_rounds FROM f""")
def score_summary(spark, sf):
    folds = roles.table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 5).alias("fold")).agg(
        (F.avg("o_totalprice") / 1e6).alias("f1"), (F.count(F.lit(1)) % 97).alias("rounds")
    )
    return _rounded(_rounded(metrics.score_summary(folds, "f1", "rounds"), ["mean_score", "std_score"], 6), ["mean_rounds"])


_PROBS = "[l_quantity % 7, l_linenumber, l_quantity % 5]"


@query(f"""SELECT i AS winner, label, count(*) AS n FROM (
      SELECT CAST(list_position({_PROBS}, list_max({_PROBS})) - 1 AS INTEGER) AS i FROM lineitem)
    JOIN (SELECT unnest([0, 1, 2]) AS i, unnest(['a', 'b', 'c']) AS label) USING (i) GROUP BY 1, 2""")
def argmax_label(spark, sf):
    values = F.array(F.col("l_quantity") % 7, F.col("l_linenumber").cast("double"), F.col("l_quantity") % 5)
    winner = encode.first_argmax(values)
    df = roles.table(spark, sf, "lineitem").select(winner.alias("winner"))
    df = df.withColumn("label", encode.label_of(F.col("winner"), ["a", "b", "c"]))
    return df.groupBy("winner", "label").agg(F.count(F.lit(1)).alias("n"))


def _voter(spark, sf, step):
    """Per-row class probabilities derived from the order's own numbers."""
    p = ((F.col("o_orderkey") * step) % 101) / 200.0
    return roles.table(spark, sf, "orders").select(F.col("o_orderkey").alias("animal"), F.array(p, 0.5 - p, F.lit(0.5)).alias("probability"))


_VOTE = lambda step: f"((o_orderkey * {step}) % 101) / 200e0"
_BLEND = ", ".join(f"({a}) * 0.6e0 + ({b}) * (1e0 - 0.6e0)" for a, b in (
    (_VOTE(7), _VOTE(13)), (f"0.5e0 - {_VOTE(7)}", f"0.5e0 - {_VOTE(13)}"), ("0.5e0", "0.5e0")))


@query(f"""WITH b AS (SELECT o_orderkey AS animal, [{_BLEND}] AS p FROM orders)
    SELECT animal, {r('p[1]', 6)} AS p0, {r('p[2]', 6)} AS p1, {r('p[3]', 6)} AS p2 FROM b""")
def prob_blend(spark, sf):
    out = training.blended(_voter(spark, sf, 7), _voter(spark, sf, 13), "animal", 0.6, ["a", "b", "c"])
    return out.select("animal", *[stable_round(F.get("probability", F.lit(i)), 6).alias(f"p{i}") for i in range(3)])


@query(with_roles("daily", f"""SELECT stn, count(*) AS n, {r('avg(ta_max)')} AS ta_max, {r('sum(rn_day)')} AS rn_day,
    count(ws_davg) AS windy FROM daily GROUP BY 1"""))
def csv_round_trip(spark, sf):
    """Daily readings written as CSV with a byte order mark and read back by declared schema."""
    path = f"{checkpoint_dir(spark)}/csv_round_trip-{store.fingerprint({'l': roles.table(spark, sf, 'lineitem')})}"
    sinks.write_csv(roles.daily(spark, sf), path, bom=True)
    back = tables.read_csv(spark, path, tables.WEATHER, ["stn", "ta_max", "rn_day", "ws_davg"])
    return back.groupBy("stn").agg(
        F.count(F.lit(1)).alias("n"), stable_round(F.avg("ta_max"), 4).alias("ta_max"),
        stable_round(F.sum("rn_day"), 4).alias("rn_day"), F.count("ws_davg").alias("windy"),
    )


@query(with_roles("daily", f"""SELECT stn, date, count(*) AS n, {r('sum(ta_max)')} AS ta_max, {r('sum(ta_min)')} AS ta_min, {r('sum(rhm_avg)')} AS rhm_avg,
    {r('sum(rn_day)')} AS rn_day, {r('sum(ws_davg)')} AS ws_davg FROM daily GROUP BY 1, 2"""))
def csv_full_round_trip(spark, sf):
    """Every column of the daily readings, dates included, through two CSV files with different column orders."""
    path = f"{checkpoint_dir(spark)}/csv_full-{store.fingerprint({'l': roles.table(spark, sf, 'lineitem')})}"
    daily = roles.daily(spark, sf)
    even = daily.filter("stn % 2 = 0")
    sinks.write_csv(even, path, bom=True)
    daily.filter("stn % 2 <> 0 OR stn IS NULL").select(*reversed(daily.columns)).write.mode("append").option("header", True).csv(path)
    back = tables.read_csv(spark, path, tables.WEATHER)
    sums = [stable_round(F.sum(c), 4).alias(c) for c in ("ta_max", "ta_min", "rhm_avg", "rn_day", "ws_davg")]
    return back.groupBy(F.col("stn").cast("long").alias("stn"), "date").agg(F.count(F.lit(1)).alias("n"), *sums)


@query("""WITH bad AS (SELECT 'date' AS "column", 'on ' || o_orderkey % 13 AS value FROM orders WHERE o_orderkey % 5 = 0
      UNION ALL SELECT 'ta_max', 'x' || o_orderkey % 10 FROM orders WHERE o_orderkey % 7 = 0)
    SELECT "column", value, count(*) AS n FROM bad GROUP BY 1, 2""")
def csv_rejects(spark, sf):
    """What two CSV files of different column orders hold that does not fit its declared type."""
    orders, key = roles.table(spark, sf, "orders"), F.col("o_orderkey")
    path = f"{checkpoint_dir(spark)}/csv_rejects-{store.fingerprint({'o': orders})}"
    rows = orders.select(
        key.alias("stn"), F.when(key % 5 == 0, F.concat(F.lit("on "), key % 13)).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"),
        F.when(key % 7 == 0, F.concat(F.lit("x"), key % 10)).otherwise(F.col("o_totalprice").cast("string")).alias("ta_max"),
    )
    sinks.write_csv(rows.filter("stn % 2 = 0"), path, bom=True)
    rows.filter("stn % 2 <> 0").select("ta_max", "date", "stn").write.mode("append").option("header", True).csv(path)
    return tables.rejected(spark, path, tables.WEATHER).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT o_orderpriority AS feature, {r('sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders)', 6)} AS importance,
    row_number() OVER (ORDER BY sum(o_totalprice) DESC) AS place FROM orders GROUP BY 1""")
def importance_file(spark, sf):
    """A ranked importance file, read back: each feature's share and its place in the file."""
    orders = roles.table(spark, sf, "orders")
    path = f"{checkpoint_dir(spark)}/importance-{store.fingerprint({'o': orders})}"
    shares = orders.groupBy(F.col("o_orderpriority").alias("feature")).agg(F.sum("o_totalprice").alias("s"))
    sinks.write_importance(shares.select("feature", (F.col("s") / F.sum("s").over(Window.partitionBy())).alias("importance")), path)
    back = spark.read.schema("feature string, importance double").option("header", True).csv(path)
    place = (F.monotonically_increasing_id() + 1).alias("place")
    return back.select("feature", "importance", place).select("feature", stable_round(F.col("importance"), 6).alias("importance"), "place")


@query("""SELECT o_orderkey AS animal, (o_orderkey * 7) % 101 / 200e0 AS a, (o_orderkey * 3) % 101 / 200e0 AS b,
    1 - ((o_orderkey * 7) % 101 + (o_orderkey * 3) % 101) / 200e0 AS c FROM orders""")
def probability_file(spark, sf):
    """Class probabilities written as one column per class and read back."""
    orders, key = roles.table(spark, sf, "orders"), F.col("o_orderkey")
    path = f"{checkpoint_dir(spark)}/probabilities-{store.fingerprint({'o': orders})}"
    first, second = (key * 7) % 101, (key * 3) % 101
    votes = F.array(first / F.lit(200.0), second / F.lit(200.0), 1 - (first + second) / F.lit(200.0))
    sinks.write_probabilities(orders.select(key.alias("animal"), array_to_vector(votes).alias("probability")), ["a", "b", "c"], ["animal"], path)
    return spark.read.schema("animal long, a double, b double, c double").option("header", True).csv(path)


@query("""SELECT o_orderpriority AS priority, (SELECT count(DISTINCT o.o_orderpriority) FROM orders o WHERE o.o_orderpriority < orders.o_orderpriority) * 1e0 AS code,
    count(*) AS n FROM orders GROUP BY 1""")
def reuse_or_fit(spark, sf):
    """A stored model: the second request loads what the first one saved and fits nothing."""
    keys = _keys(spark, sf)
    mark = store.fingerprint({"orders": roles.table(spark, sf, "orders")}, {"model": "codes of priorities"})
    fit = lambda: StringIndexer(inputCol="priority", outputCol="code", stringOrderType="alphabetAsc").fit(keys)
    for make in (fit, None):
        model = store.reuse_or_fit(spark, checkpoint_dir(spark), "priority_codes", mark, StringIndexerModel.load, make)
    return model.transform(keys).groupBy("priority", "code").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1")
def reuse_or_write(spark, sf):
    """The second request reads what the first one wrote."""
    keys = _keys(spark, sf)
    mark = store.fingerprint({"orders": roles.table(spark, sf, "orders")}, {"columns": keys.columns})
    for _ in range(2):
        stored = store.reuse_or_write(spark, checkpoint_dir(spark), "keys", mark, lambda: keys)
    return stored.groupBy("priority").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- whole plans


def domain_tables(spark, sf):
    """Role tables under the domain's own column names."""
    key = F.col("animal")
    fact = roles.graded_rows(spark, sf).select(
        "animal", F.col("stn").cast("int").alias("stn"), F.lit("경기도").alias("sido"), F.col("judged").alias("ABATT_DATE"),
        F.date_format("born", "yyyyMMdd").cast("int").alias("BIRTH_YMD"), F.col("sex").alias("JUDGE_SEX"),
        (F.col("weight") / 1000).alias("WEIGHT"), F.floor(F.datediff("judged", "born") / 30).cast("int").alias("AGE"),
        key.cast("string").alias("CATTLE_NO"), F.col("farm").cast("string").alias("FARM_UNIQUE_NO"),
        F.col("grade").alias("LAST_GRADE"), F.when(key % 17 == 0, -99.0).otherwise(F.col("marbling")).alias("INSFAT"),
        F.when(key % 13 == 0, -99.0).otherwise(F.col("weight") / 10000).alias("BACKFAT"),
    )
    area = roles.farm_area(spark, sf).select(
        F.col("farm").cast("string").alias("FARM_UNIQUE_NO"), F.col("C1998").alias("C2023"), F.col("C1999").alias("C2024"),
        F.col("C2000").alias("C2025"), "AREA",
    )
    death = roles.deaths(spark, sf).select(F.col("farm").cast("string").alias("FARM_UNIQUE_NO"))
    lineage = roles.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("CATTLE_NO"), (F.col("o_orderkey") % 211).cast("string").alias("FATHER_CATTLE_NO"),
        F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 37).cast("string")).alias("KPN_NO"),
    )
    return fact, roles.daily(spark, sf), area, death, lineage


FLOOR = "1995-01-01"
_MONTH = lambda d: f"CAST(date_trunc('month', {d}) AS DATE)"
_SCORE = "CAST(coalesce(16 - nullif(list_position([" + ", ".join(f"'{g}'" for g in domain.GRADES) + "], grade), 0), 0) AS DOUBLE)"
_FEATURE_CHECK = ["age_sq", "s_thi_mean", "p1_ta_mean", "p2_cold_d", "p3_rn_sum", "b_ws_mean", "avg_cattle", "density", "death_rate",
                  "farm_grade_loo", "farm_grade_std", "rear_ta_mean", "rear_month_cnt"]


@query(with_roles("graded_rows monthly farm_area farms deaths", f""", t AS (
      SELECT *, {_SCORE} AS score, (judged - born) // 30 AS age, CASE WHEN born < DATE '{FLOOR}' THEN DATE '{FLOOR}' ELSE born END AS start FROM graded_rows),
    e AS (SELECT farm, sum(score) AS s, count(*) AS c, stddev_samp(score) AS d FROM t GROUP BY 1),
    x AS (SELECT animal, stn, CAST(unnest(generate_series(date_trunc('month', start), date_trunc('month', judged), INTERVAL 1 MONTH)) AS DATE) AS month
          FROM t WHERE start <= judged),
    f AS (SELECT animal, avg(ta_mean) AS ta, count(ta_mean) AS mc FROM x LEFT JOIN monthly m ON m.stn = x.stn AND m.month = x.month GROUP BY 1),
    dc AS (SELECT farm, count(*) AS n FROM deaths GROUP BY 1)
    SELECT animal, CAST(age * age AS DOUBLE) AS age_sq, {r('m0.thi_mean')} AS s_thi_mean, {r('m1.ta_mean')} AS p1_ta_mean,
           CAST(m2.cold_d AS DOUBLE) AS p2_cold_d, {r('m3.rn_sum')} AS p3_rn_sum, {r('mb.ws_mean')} AS b_ws_mean, {r('avg_cattle')} AS avg_cattle,
           {r('density')} AS density, {r('coalesce(dc.n, 0) / (coalesce(avg_cattle, 1) + 1)')} AS death_rate,
           {r('(e.s - score) / greatest(e.c - 1, 1)')} AS farm_grade_loo, {r('e.d')} AS farm_grade_std,
           {r('f.ta')} AS rear_ta_mean, CAST(f.mc AS DOUBLE) AS rear_month_cnt
    FROM t JOIN e USING (farm) LEFT JOIN farms USING (farm) LEFT JOIN dc USING (farm) LEFT JOIN f USING (animal)
    LEFT JOIN monthly mb ON mb.stn = t.stn AND mb.month = {_MONTH('born')}
    """ + " ".join(f"LEFT JOIN monthly m{k} ON m{k}.stn = t.stn AND m{k}.month = CAST(date_trunc('month', judged) - INTERVAL {k} MONTH AS DATE)" for k in range(4))))
def training_features(spark, sf):
    """The full feature plan over whole tables; a column of every feature family is compared."""
    fact, daily, area, death, _ = domain_tables(spark, sf)
    df = grading.training_features(fact, grading.lookups(daily, area, death), FLOOR)
    return df.select("animal", *[stable_round(F.col(c), 4).alias(c) for c in _FEATURE_CHECK])


@query(with_roles("graded_rows", f""", t AS (SELECT *, nullif(CASE WHEN animal % 17 = 0 THEN -99 ELSE marbling END, -99) AS ins,
      nullif(CASE WHEN animal % 13 = 0 THEN -99 ELSE weight / 10000 END, -99) AS fat, animal % 211 AS sire,
      CASE WHEN animal % 5 <> 0 THEN animal % 37 END AS kpn FROM graded_rows),
    s AS (SELECT sire, avg(ins) AS m FROM t WHERE ins IS NOT NULL GROUP BY 1), k AS (SELECT kpn, avg(ins) AS m FROM t WHERE ins IS NOT NULL AND kpn IS NOT NULL GROUP BY 1),
    f AS (SELECT farm, avg(ins) AS i, avg(fat) AS b FROM t GROUP BY 1)
    SELECT animal, {r('s.m')} AS father_insfat, {r('k.m')} AS kpn_insfat, {r('f.i')} AS farm_insfat, {r('f.b')} AS farm_backfat
    FROM t LEFT JOIN s USING (sire) LEFT JOIN k ON k.kpn = t.kpn LEFT JOIN f USING (farm)"""))
def baseline_features(spark, sf):
    """The baseline feature plan; its target statistics are compared."""
    fact, daily, area, death, lineage = domain_tables(spark, sf)
    lookups = grading.lookups(daily, area, death, base=True)
    parents = grading.pedigree(lineage)
    df = grading.baseline_features(fact, lookups, parents, grading.target_statistics(fact, parents))
    names = ["father_insfat", "kpn_insfat", "farm_insfat", "farm_backfat"]
    return df.select("animal", *[stable_round(F.col(c), 4).alias(c) for c in names])


# The whole plans: every column of the feature lists, SQL and columns from the same lists.

_SEASON = lambda d: f"CASE WHEN month({d}) BETWEEN 3 AND 5 THEN 0 WHEN month({d}) BETWEEN 6 AND 8 THEN 1 WHEN month({d}) BETWEEN 9 AND 11 THEN 2 ELSE 3 END"
_SEX = "CASE sex WHEN '암' THEN 0 WHEN '수' THEN 1 WHEN '거세' THEN 2 ELSE -1 END"
_AGE = "(judged - born) // 30"
_ROW_SQL = {
    "stn": "t.stn", "WEIGHT": "weight / 1000", "AGE": _AGE, "abatt_year": "year(judged)", "abatt_month": "month(judged)", "abatt_season": _SEASON("judged"),
    "birth_year": "year(born)", "birth_month": "month(born)", "birth_season": _SEASON("born"), "sex_code": _SEX, "sido_code": str(domain.REGIONS.index("경기도")),
}
_INTERACTION_SQL = {"age_sq": f"{_AGE} * ({_AGE})", "age_sex": f"{_AGE} * ({_SEX})", "age_abatt_season": f"{_AGE} * ({_SEASON('judged')})"}
_FARM_SQL = {"avg_cattle": "avg_cattle", "density": "density", "death_cnt": "coalesce(dc.n, 0)", "death_rate": "coalesce(dc.n, 0) / (coalesce(avg_cattle, 1) + 1)"}
_FULL_SQL = _ROW_SQL | _INTERACTION_SQL | _FARM_SQL | {
    "farm_grade_loo": "(e.s - score) / greatest(e.c - 1, 1)", "farm_grade_cnt": "e.c", "farm_grade_std": "e.d",
    **{p + m: f"m{k}.{m}" for p, k in [*grading.LAGS.items(), ("b_", "b")] for m in weather.FULL_METRICS}, **{c: f"f.{c}" for c in grading.REARING_FEATURES},
}
_BASELINE_SQL = _ROW_SQL | _FARM_SQL | {
    "farm_insfat": "h.i", "farm_backfat": "h.b", "father_insfat": "s.m", "kpn_insfat": "k.m",
    **{p + m: f"m{k}.{m}" for p, k in (("s_", 0), ("b_", "b")) for m in grading.BASE_METRICS},
}
_MONTHS = lambda lags: f"LEFT JOIN monthly mb ON mb.stn = t.stn AND mb.month = {_MONTH('born')} " + " ".join(
    f"LEFT JOIN monthly m{k} ON m{k}.stn = t.stn AND m{k}.month = CAST(date_trunc('month', judged) - INTERVAL {k} MONTH AS DATE)" for k in lags)
_ALL = lambda names, sql: ", ".join(f"{r(sql[c])} AS {c}" for c in names)


def _all_columns(df, names):
    return df.select("animal", *[stable_round(F.col(c).cast("double"), 4).alias(c) for c in names])


@query(with_roles("graded_rows monthly farm_area farms deaths", f""", t AS (
      SELECT *, {_SCORE} AS score, CASE WHEN born < DATE '{FLOOR}' THEN DATE '{FLOOR}' ELSE born END AS start FROM graded_rows),
    e AS (SELECT farm, sum(score) AS s, count(*) AS c, stddev_samp(score) AS d FROM t GROUP BY 1),
    x AS (SELECT animal, stn, CAST(unnest(generate_series(date_trunc('month', start), date_trunc('month', judged), INTERVAL 1 MONTH)) AS DATE) AS month
          FROM t WHERE start <= judged),
    f AS (SELECT animal, {", ".join(f"{(weathering.REAR_MEANS | weathering.REAR_COUNTS)[c]} AS {c}" for c in grading.REARING_FEATURES)}
          FROM x LEFT JOIN monthly m ON m.stn = x.stn AND m.month = x.month GROUP BY 1),
    dc AS (SELECT farm, count(*) AS n FROM deaths GROUP BY 1)
    SELECT animal, {_ALL(grading.FEATURES, _FULL_SQL)}
    FROM t JOIN e USING (farm) LEFT JOIN farms USING (farm) LEFT JOIN dc USING (farm) LEFT JOIN f USING (animal) {_MONTHS(range(4))}"""))
def training_features_all(spark, sf):
    """The full feature plan with all of its columns."""
    fact, daily, area, death, _ = domain_tables(spark, sf)
    return _all_columns(grading.training_features(fact, grading.lookups(daily, area, death), FLOOR), grading.FEATURES)


@query(with_roles("graded_rows monthly farm_area farms deaths", f""", t AS (SELECT *, nullif(CASE WHEN animal % 17 = 0 THEN -99 ELSE marbling END, -99) AS ins,
      nullif(CASE WHEN animal % 13 = 0 THEN -99 ELSE weight / 10000 END, -99) AS fat, animal % 211 AS sire,
      CASE WHEN animal % 5 <> 0 THEN animal % 37 END AS kpn FROM graded_rows),
    s AS (SELECT sire, avg(ins) AS m FROM t WHERE ins IS NOT NULL GROUP BY 1), k AS (SELECT kpn, avg(ins) AS m FROM t WHERE ins IS NOT NULL AND kpn IS NOT NULL GROUP BY 1),
    h AS (SELECT farm, avg(ins) AS i, avg(fat) AS b FROM t GROUP BY 1),
    dc AS (SELECT farm, count(*) AS n FROM deaths GROUP BY 1)
    SELECT animal, {_ALL(grading.BASELINE_FEATURES, _BASELINE_SQL)}
    FROM t LEFT JOIN s USING (sire) LEFT JOIN k ON k.kpn = t.kpn LEFT JOIN h USING (farm) LEFT JOIN farms USING (farm) LEFT JOIN dc USING (farm) {_MONTHS([0])}"""))
def baseline_features_all(spark, sf):
    """The baseline feature plan with all of its columns."""
    fact, daily, area, death, lineage = domain_tables(spark, sf)
    parents = grading.pedigree(lineage)
    df = grading.baseline_features(fact, grading.lookups(daily, area, death, base=True), parents, grading.target_statistics(fact, parents))
    return _all_columns(df, grading.BASELINE_FEATURES)


PARAMS = training.ForestParams(tree_grid=(5, 10), depth=5, min_rows=5, bins=32)
SMALL = ["WEIGHT", "AGE", "sex_code", "abatt_month", "s_thi_mean", "farm_grade_loo"]


def _learning_set(spark, sf):
    """Features, folds and fold-safe encodings for the five-class label."""
    fact, daily, area, death, _ = domain_tables(spark, sf)
    label = F.coalesce(domain.quality_of(F.col("LAST_GRADE")), F.lit(domain.OUTSIDE))
    df = grading.with_row_features(grading.typed_fact(fact)).withColumn("grade_score", domain.grade_score(F.col("LAST_GRADE")).cast("double"))
    classes = [*domain.QUALITY, domain.OUTSIDE]
    df = df.withColumn("quality", encode.label_index(label, classes, domain.OUTSIDE))
    yields = [*domain.YIELD, domain.OUTSIDE]
    df = df.withColumn("yield", encode.label_index(F.coalesce(domain.yield_of(F.col("LAST_GRADE")), F.lit(domain.OUTSIDE)), yields, domain.OUTSIDE))
    monthly = clean.with_prefix(settle(grading.monthly_weather(daily)).select("stn", "month", "thi_mean"), "s_", ["stn", "month"])
    from gradeframe.operators.timeseries import month_join

    df = month_join(df, monthly, ["stn"], "ABATT_DATE")
    df = sampling.stratified_folds(df, ["animal"], "quality", 2)
    return settle(encoding.with_fold_encoding(df, "FARM_UNIQUE_NO", "grade_score", "fold", 2, "farm_grade_loo")), classes, yields


def _cross_validated(df, classes, label, params=PARAMS):
    return training.cross_validate(df, "animal", SMALL, label, "fold", 2, classes, params, per_fold={"farm_grade_loo": "farm_grade_loo"})


# Learned values differ between engines, so these queries register what holds for
# any right model: every row once, known classes, probabilities of a distribution.

_LEARNED = "1e0 AS total, true AS known, true AS first_max"


def _checked(found, classes, key):
    """Per row: the sum of its probabilities, whether its class is listed and the first most likely one."""
    total = F.aggregate("probability", F.lit(0.0), lambda a, p: a + p)
    best = encode.label_of(encode.first_argmax(F.col("probability")), classes)
    return found.select(*key, F.round(total, 6).alias("total"), F.col("predicted_class").isin(classes).alias("known"), (F.col("predicted_class") == best).alias("first_max"))


@query(with_roles("graded_rows", f"SELECT animal, {_LEARNED} FROM graded_rows"))
def oof_predictions(spark, sf):
    """Out-of-fold class probabilities: each row is predicted once, by a model that has not seen it."""
    df, classes, _ = _learning_set(spark, sf)
    return _checked(_cross_validated(df, classes, "quality").predictions, classes, ["animal"])


@query("SELECT CAST(2 AS BIGINT) AS folds, true AS in_range, true AS between_folds, true AS grown")
def fold_scores(spark, sf):
    """Fold scores and the overall macro-F1 lie between 0 and 1; the refit size follows the folds' sizes."""
    df, classes, _ = _learning_set(spark, sf)
    cv = _cross_validated(df, classes, "quality")
    overall = metrics.macro_f1(cv.predictions, "label", "predicted").select(F.col("macro_f1").alias("_all"))
    rows = joins.attach(cv.folds, overall, [])
    return rows.agg(
        F.count_distinct("fold").alias("folds"), F.bool_and(F.col("f1").between(0, 1) & F.col("_all").between(0, 1)).alias("in_range"),
        (F.abs(F.avg("f1") - F.first("_all")) < 0.2).alias("between_folds"), F.bool_and(F.col("trees").isin(*PARAMS.tree_grid)).alias("grown"),
    )


@query("SELECT CAST(unnest([0, 1]) AS INTEGER) AS fold, CAST(24 AS BIGINT) AS curve_length, true AS least, true AS cut_there, true AS refit_follows")
def early_stopping(spark, sf):
    """Each fold grows one forest and cuts it where the validation log-loss is least; the refit size follows the folds'."""
    df, classes, _ = _learning_set(spark, sf)
    params = training.ForestParams(tree_grid=(24,), depth=5, min_rows=5, bins=32, stop_after=24)
    cv = _cross_validated(df, classes, "quality", params)
    rows, label, sizes = [], "quality", [r["trees"] for r in cv.folds.orderBy("fold").collect()]
    for i, trees in enumerate(sizes):
        columns = [f"{c}_{i}" if c == "farm_grade_loo" else c for c in SMALL]
        data = training.with_classes(training.feature_matrix(df, columns, ["animal", "fold", label]), label, classes)
        train = training.with_classes(training.weighted(data.filter(F.col("fold") != i), "label"), "label", classes)
        curve = stopping.loss_curve(params.forest(24).fit(train), data.filter(F.col("fold") == i))
        rows.append((i, len(curve), abs(curve[trees - 1] - min(curve)) < 1e-9, cv.models[i].getNumTrees == trees, cv.refit_trees == int(sum(sizes) / 2 * 1.1)))
    return spark.createDataFrame(rows, "fold int, curve_length long, least boolean, cut_there boolean, refit_follows boolean")


@query(with_roles("graded_rows", """
    SELECT animal, stn, judged, CAST(round(weight, 2) AS DOUBLE) AS weight, true AS known FROM graded_rows WHERE year(judged) > 1996"""))
def scored_orders(spark, sf):
    """Train on earlier years, score later rows: all original rows and columns, each with a listed class."""
    fact, daily, area, death, _ = domain_tables(spark, sf)
    train, later = sampling.split_by_year(fact, "ABATT_DATE", 1996)
    lookups = grading.lookups(daily, area, death)
    learn = settle(grading.training_features(train, lookups, FLOOR))
    encodings = settle(grading.encoding_table(train))
    rows = grading.scoring_features(later, lookups, encodings, train, FLOOR)
    model = training.fit_all(learn, "animal", grading.FEATURES, "label", domain.GRADES, 5, PARAMS)
    found = training.predict_rows(model, rows, later, "animal", grading.FEATURES, domain.GRADES, "LAST_GRADE", domain.OUTSIDE)
    return found.select(
        "animal", F.col("stn").cast("long").alias("stn"), F.col("ABATT_DATE").alias("judged"), F.round(F.col("WEIGHT") * 1000, 2).alias("weight"),
        F.col("LAST_GRADE").isin(domain.GRADES).alias("known"),
    )


@query("SELECT unnest(['WEIGHT', 'AGE', 'sex_code', 'abatt_month', 's_thi_mean', 'farm_grade_loo']) AS feature, true AS valid, 1e0 AS total")
def feature_importance(spark, sf):
    """Importances of a model over all rows: one for each feature, none negative, together one."""
    df, classes, _ = _learning_set(spark, sf)
    names = [f"{c}_0" if c == "farm_grade_loo" else c for c in SMALL]
    model = training.fit_all(df, "animal", names, "quality", classes, 5, PARAMS)
    found = training.importance_table(model, SMALL)
    total = found.agg(F.round(F.sum("importance"), 6).alias("total"))
    return joins.attach(found.select("feature", (F.col("importance") >= 0).alias("valid")), total, [])


@query(with_roles("graded_rows", "SELECT animal, true AS known FROM graded_rows"))
def two_part_class(spark, sf):
    """Quality and yield predicted apart and joined into one of the listed classes."""
    df, classes, yields = _learning_set(spark, sf)
    parts = [
        _cross_validated(df, c, label).predictions.select("animal", F.col("predicted_class").alias(label))
        for label, c in (("quality", classes), ("yield", yields))
    ]
    both = parts[0].join(parts[1], "animal")
    return both.select("animal", domain.join_grade(F.col("quality"), F.col("yield")).isin(domain.GRADES).alias("known"))


@query(with_roles("graded_rows", f"SELECT animal, {_LEARNED} FROM graded_rows"))
def stacked_classes(spark, sf):
    """A second classifier on two models' votes, which it never learns from models that saw the held-out fold."""
    df, classes, _ = _learning_set(spark, sf)
    first = training.ForestParams(tree_grid=(5,), depth=5, min_rows=5, bins=32)
    other = training.ForestParams(tree_grid=(5,), depth=3, min_rows=5, bins=32, seed=7)
    found = training.nested_stack(
        df, "animal", SMALL, "quality", "fold", 2, classes, [first, other], first, per_fold={"farm_grade_loo": "farm_grade_loo"})
    return _checked(found, classes, ["animal"])
