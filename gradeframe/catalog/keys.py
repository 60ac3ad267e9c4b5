"""Queries over lookups, encodings, key sets and row alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeframe.catalog import roles
from gradeframe.catalog.cleaning import _farms
from gradeframe.catalog.registry import query
from gradeframe.catalog.roles import sql_round as r, with_roles
from gradeframe.functions import binning, clean, domain
from gradeframe.functions.clean import stable_round
from gradeframe.operators import encoding, joins, sampling
from gradeframe.session import settle

_SCORE_SQL = "CAST(coalesce(16 - nullif(list_position([" + ", ".join(f"'{g}'" for g in domain.GRADES) + "], grade), 0), 0) AS DOUBLE)"


def _scored(spark, sf):
    return roles.graded_rows(spark, sf).select(
        "animal", "farm", "judged", "weight", domain.grade_score(F.col("grade")).cast("double").alias("score")
    )


def _rounded(df, columns, digits=4):
    return df.withColumns({c: stable_round(F.col(c), digits) for c in columns})


@query(with_roles("graded_rows farm_area farms deaths", f""", d AS (SELECT farm, count(*) AS n FROM deaths GROUP BY 1)
    SELECT animal, {r('avg_cattle')} AS avg_cattle, {r('density', 6)} AS density, coalesce(n, 0) AS death_cnt
    FROM graded_rows LEFT JOIN farms USING (farm) LEFT JOIN d USING (farm)"""))
def farm_join(spark, sf):
    farms = _farms(spark, sf).select("farm", "avg_cattle", "density")
    deaths = encoding.group_size(roles.deaths(spark, sf), "farm", "death_cnt")
    lookup = settle(farms.join(deaths, "farm", "full"))
    out = joins.lookup_join(roles.graded_rows(spark, sf).select("animal", "farm"), lookup, ["farm"], "left")
    return out.select(
        "animal", stable_round(F.col("avg_cattle"), 4).alias("avg_cattle"), stable_round(F.col("density"), 6).alias("density"),
        F.coalesce("death_cnt", F.lit(0)).alias("death_cnt"),
    )


@query(with_roles("offspring", f"SELECT sire, {r('avg(score)')} AS sire_score FROM offspring WHERE score IS NOT NULL GROUP BY 1"))
def sire_means(spark, sf):
    return _rounded(encoding.target_means(roles.offspring(spark, sf), "sire", {"sire_score": "score"}, True), ["sire_score"])


@query(with_roles("offspring", f"SELECT kpn, {r('avg(score)')} AS kpn_score, {r('avg(price)')} AS kpn_price FROM offspring GROUP BY 1"))
def strain_means(spark, sf):
    out = encoding.target_means(roles.offspring(spark, sf), "kpn", {"kpn_score": "score", "kpn_price": "price"})
    return _rounded(out, ["kpn_score", "kpn_price"])


@query(with_roles("deaths", "SELECT farm, count(*) AS death_cnt FROM deaths GROUP BY 1"))
def death_counts(spark, sf):
    return encoding.group_size(roles.deaths(spark, sf), "farm", "death_cnt")


@query(with_roles("graded_rows", f"""
    SELECT farm, {r(f'avg({_SCORE_SQL})')} AS farm_grade_mean, count(*) AS farm_grade_cnt,
           {r(f'stddev_samp({_SCORE_SQL})')} AS farm_grade_std FROM graded_rows GROUP BY 1"""))
def encoding_stats(spark, sf):
    out = encoding.encoding_stats(_scored(spark, sf), "farm", "score", "farm_grade")
    return _rounded(out, ["farm_grade_mean", "farm_grade_std"])


@query(with_roles("graded_rows", f""", t AS (SELECT animal, farm, {_SCORE_SQL} AS score FROM graded_rows),
    s AS (SELECT farm, sum(score) AS s, count(score) AS c, avg(score) AS m, stddev_samp(score) AS d FROM t GROUP BY 1)
    SELECT animal, {r('(s - score) / greatest(c - 1, 1)')} AS farm_grade_loo, {r('m')} AS farm_grade_mean, c AS farm_grade_cnt,
           {r('d')} AS farm_grade_std FROM t JOIN s USING (farm)"""))
def loo_encoding(spark, sf):
    out = encoding.with_leave_one_out(_scored(spark, sf), "farm", "score", "farm_grade")
    names = ["farm_grade_loo", "farm_grade_mean", "farm_grade_std"]
    return _rounded(out.select("animal", *names, "farm_grade_cnt"), names)


@query(with_roles("offspring", f""", s AS (SELECT sire, sum(score) AS s, count(score) AS c FROM offspring GROUP BY 1)
    SELECT o.sire, o.price, {r('CASE WHEN c > 1 THEN (s - score) / (c - 1) END')} AS sire_score_loo, c AS sire_score_cnt
    FROM offspring o JOIN s USING (sire)"""))
def sire_loo_encoding(spark, sf):
    """Leave-one-out by sire, NULL for a singleton."""
    out = encoding.with_leave_one_out(roles.offspring(spark, sf), "sire", "score", "sire_score", singleton="null")
    return _rounded(out.select("sire", "price", "sire_score_loo", "sire_score_cnt"), ["sire_score_loo"])


@query(with_roles("graded_rows", f""", t AS (SELECT animal, farm, year(judged) AS y, {_SCORE_SQL} AS score FROM graded_rows),
    s AS (SELECT farm, avg(score) AS m, count(*) AS c, stddev_samp(score) AS d FROM t WHERE y <= 1996 GROUP BY 1),
    g AS (SELECT avg(score) AS mu FROM t WHERE y <= 1996)
    SELECT animal, {r('m')} AS farm_grade_loo, {r('coalesce(m, mu)')} AS farm_grade_mean, coalesce(c, 0) AS farm_grade_cnt,
           {r('d')} AS farm_grade_std FROM (SELECT * FROM t WHERE y > 1996) LEFT JOIN s USING (farm), g"""))
def encoding_lookup(spark, sf):
    """Encodings trained up to a year, looked up for the later rows."""
    train, later = sampling.split_by_year(_scored(spark, sf), "judged", 1996)
    stats = settle(encoding.encoding_stats(train, "farm", "score", "farm_grade"))
    out = encoding.apply_encoding(later, stats, "farm", "farm_grade").withColumn("farm_grade_loo", F.col("farm_grade_mean"))
    out = clean.fill_with_mean(out, "farm_grade_mean", train.select(F.col("score").alias("farm_grade_mean")))
    names = ["farm_grade_loo", "farm_grade_mean", "farm_grade_std"]
    return _rounded(out.select("animal", *names, "farm_grade_cnt"), names)


@query(with_roles("graded_rows", f""", t AS (SELECT animal, farm, animal % 3 AS fold, {_SCORE_SQL} AS score FROM graded_rows),
    s AS (SELECT farm, sum(score) AS s, count(*) AS c FROM t GROUP BY 1),
    f AS (SELECT farm, fold, sum(score) AS s, count(*) AS c FROM t GROUP BY 1, 2),
    k AS (SELECT t.*, s.s - coalesce(f.s, 0) AS rest, s.c - coalesce(f.c, 0) AS others, i FROM t CROSS JOIN range(3) r(i)
          JOIN s USING (farm) LEFT JOIN f ON f.farm = t.farm AND f.fold = i)
    SELECT animal, {', '.join(f"max(CASE WHEN i = {i} THEN " + r("CASE WHEN fold = i THEN rest / nullif(others, 0) ELSE (rest - score) / greatest(others - 1, 1) END") + f" END) AS farm_grade_{i}" for i in range(3))}
    FROM k GROUP BY animal"""))
def fold_encoding(spark, sf):
    """Fold-safe encodings for all folds, from one aggregate and one join."""
    df = _scored(spark, sf).withColumn("fold", F.col("animal") % 3)
    out = encoding.with_fold_encoding(df, "farm", "score", "fold", 3, "farm_grade")
    names = [f"farm_grade_{i}" for i in range(3)]
    return _rounded(out.select("animal", *names), names)


@query(with_roles("offspring", f"""
    SELECT sire, {r('avg(score)')} AS sire_score, count(score) AS n FROM offspring WHERE score IS NOT NULL
    GROUP BY 1 HAVING count(score) >= 30"""))
def sire_support(spark, sf):
    out = encoding.mean_with_support(roles.offspring(spark, sf), "sire", "score", 30, "sire_score", "n")
    return _rounded(out, ["sire_score"])


@query(with_roles("offspring", f""", s AS (
      SELECT sire, {r('avg(score)', 6)} AS m FROM offspring WHERE score IS NOT NULL GROUP BY 1 HAVING count(score) >= 30),
    q AS (SELECT quantile_cont(m, 0.25) AS a, quantile_cont(m, 0.75) AS z FROM s),
    b AS (SELECT sire, band FROM (SELECT sire, 'top' AS band FROM s, q WHERE m >= z UNION ALL SELECT sire, 'bottom' FROM s, q WHERE m <= a)),
    c AS (SELECT band, flag, count(*) AS n FROM offspring JOIN b USING (sire) GROUP BY 1, 2)
    SELECT band, flag, n, {r('n / sum(n) OVER (PARTITION BY band)')} AS share FROM c"""))
def sire_semi_join(spark, sf):
    """Class shares among the offspring of the best and the worst sires."""
    born = roles.offspring(spark, sf)
    stat = settle(encoding.mean_with_support(born, "sire", "score", 30, "m", "n").withColumn("m", stable_round(F.col("m"), 6)))
    bands = {"top": binning.at_or_above_quantile(stat, "m", 0.75), "bottom": binning.at_or_below_quantile(stat, "m", 0.25)}
    parts = []
    for band, sires in bands.items():
        counts = settle(
            joins.keep_key_members(born, sires, ["sire"]).groupBy(F.lit(band).alias("band"), "flag").agg(F.count(F.lit(1)).alias("n"))
        )
        total = counts.agg(F.sum("n")).scalar()
        parts.append(counts.withColumn("share", stable_round(F.col("n") / total, 4)))
    return joins.stack_rows(*parts)


@query("""SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS left_keys,
           (SELECT count(DISTINCT c_custkey) FROM customer) AS right_keys,
           (SELECT count(DISTINCT o_custkey) FROM orders JOIN customer ON c_custkey = o_custkey) AS matched_keys,
           floor((SELECT count(DISTINCT o_custkey) FROM orders JOIN customer ON c_custkey = o_custkey)
             * 100e0 / (SELECT count(DISTINCT o_custkey) FROM orders) * 1e4 + 0.500001e0) / 1e4 AS match_pct""")
def join_coverage(spark, sf):
    left = roles.table(spark, sf, "orders")
    right = roles.table(spark, sf, "customer")
    return _rounded(joins.key_coverage(left, right, "o_custkey", "c_custkey"), ["match_pct"])


@query("""SELECT DISTINCT o_custkey AS key FROM orders INTERSECT SELECT c_custkey FROM customer""")
def shared_keys(spark, sf):
    left = roles.table(spark, sf, "orders")
    return joins.shared_keys(left, roles.table(spark, sf, "customer"), "o_custkey", "c_custkey")


@query("SELECT DISTINCT p_brand AS brand FROM part")
def distinct_values(spark, sf):
    return roles.table(spark, sf, "part").select(F.col("p_brand").alias("brand")).distinct()


@query("""SELECT farm, seen, animal, line FROM (
      SELECT *, row_number() OVER (PARTITION BY farm ORDER BY seen NULLS LAST, animal NULLS LAST, line) AS rn FROM (
        SELECT nullif(l_suppkey, 3) AS farm, CASE WHEN l_linenumber > 1 THEN l_shipdate END AS seen, nullif(l_orderkey, 7) AS animal, l_linenumber AS line
        FROM lineitem) WHERE farm IS NOT NULL) WHERE rn = 1""")
def lookup_dedupe(spark, sf):
    """The first row of each key, where a NULL never comes before a value; rows without a key go."""
    df = roles.table(spark, sf, "lineitem").select(
        F.nullif("l_suppkey", F.lit(3)).alias("farm"), F.when(F.col("l_linenumber") > 1, F.col("l_shipdate")).alias("seen"),
        F.nullif("l_orderkey", F.lit(7)).alias("animal"), F.col("l_linenumber").alias("line"),
    )
    return joins.unique_lookup(df, ["farm"], ["seen", "animal", "line"])


@query("""SELECT l_orderkey AS animal, l_linenumber AS line, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_keys(spark, sf):
    df = roles.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("animal"), F.col("l_linenumber").alias("line"))
    return joins.duplicate_keys(df, ["animal", "line"])


@query(with_roles("graded_rows", f"""
    SELECT animal, weight, {_SCORE_SQL} AS score FROM graded_rows"""))
def column_concat(spark, sf):
    """Two feature frames of the same rows put side by side by their key."""
    df = roles.graded_rows(spark, sf)
    left = df.select("animal", "weight")
    return left.join(_scored(spark, sf).select("animal", "score"), "animal", "left")


@query("""SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey // 2 END AS animal, o_totalprice AS weight,
           CASE WHEN o_orderkey % 5 = 0 THEN '등외' ELSE coalesce((SELECT min(p.o_orderstatus) FROM orders p
             WHERE p.o_orderpriority <> '5-LOW' AND p.o_orderkey // 2 = o.o_orderkey // 2), '등외') END AS grade FROM orders o""")
def aligned_predictions(spark, sf):
    """Every original row with its prediction, with missing and repeated keys on either side."""
    half = F.floor(F.col("o_orderkey") / 2).cast("long")
    orders = roles.table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 5 != 0, half).alias("animal"), F.lit("?").alias("grade"), F.col("o_totalprice").alias("weight"))
    scored = roles.table(spark, sf, "orders").filter("o_orderpriority <> '5-LOW'")
    predicted = scored.select(half.alias("animal"), F.col("o_orderstatus").alias("grade"))
    predicted = joins.stack_rows(predicted, predicted.withColumn("animal", F.lit(None).cast("long")))
    return joins.align_predictions(orders, predicted, ["animal"], "grade", domain.OUTSIDE)


@query("""SELECT o_orderstatus AS part, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS BIGINT) AS only_f FROM orders
    GROUP BY 1""")
def stacked_rows(spark, sf):
    """Chunks of one table put under each other; a column one chunk lacks is NULL there."""
    df = roles.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("part"), "o_orderkey")
    out = joins.stack_rows(df.filter("part = 'F'"), df.filter("part = 'O'").drop("o_orderkey"), df.filter("part NOT IN ('F', 'O')").drop("o_orderkey"))
    return out.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("only_f"))
