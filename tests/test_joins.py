"""Lookup joins in both ways, keys and alignment."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gradeframe.operators import encoding, joins, timeseries


def content(df):
    return sorted(map(str, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key, as identical copies; some keys are NULL."""
    rnd = random.Random(3)
    data = [("hot", 1.0)] * 1000 + [(f"k{rnd.randrange(400)}", float(rnd.randrange(9))) for _ in range(1900)] + [(None, 2.0)] * 100
    lookup = [(f"k{i}", i) for i in range(0, 400, 2)] + [("hot", -1), ("unused", 5)]
    return spark.createDataFrame(data, "k string, x double").repartition(6), spark.createDataFrame(lookup, "k string, v int")


@pytest.mark.parametrize("how", ["left", "inner"])
def test_both_ways_give_the_same_rows(skewed, how):
    fact, lookup = skewed
    small = joins.lookup_join(fact, lookup, ["k"], how)
    large = joins.lookup_join(fact, lookup, ["k"], how, broadcast_bytes=0)
    assert small.columns == large.columns
    assert content(small) == content(large)
    if how == "left":
        assert large.count() == fact.count()


def test_hot_key_without_a_match(spark, skewed):
    fact, lookup = skewed
    lookup = lookup.filter("k <> 'hot'")
    for how in ("left", "inner"):
        assert content(joins.lookup_join(fact, lookup, ["k"], how)) == content(joins.lookup_join(fact, lookup, ["k"], how, broadcast_bytes=0))


def test_hot_and_missing_keys_are_spread_over_tasks(spark, skewed):
    fact, lookup = skewed
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = joins.lookup_join(fact.repartition(64), lookup, ["k"], "left", broadcast_bytes=0)
        places = joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") == "hot").alias("h"))
        got = places.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["h"] for r in got) == 1000
    assert max(r["h"] for r in got) < 400
    plain = fact.groupBy(F.hash("k") % 8).count().agg(F.max("count")).first()[0]
    assert max(r["n"] for r in got) < plain


def test_hot_keys_are_bounded_by_their_share(skewed):
    fact, _ = skewed
    assert [r["k"] for r in joins.hot_keys(fact, ["k"], 0.2).collect()] == ["hot"]
    assert joins.hot_keys(fact, ["k"], 0.001).count() <= 1000


def test_a_key_below_the_share_is_hot_by_what_a_task_may_hold(skewed):
    fact, _ = skewed
    assert joins.hot_keys(fact, ["k"], 0.5).count() == 0
    assert [r["k"] for r in joins.hot_keys(fact, ["k"], 0.5, task_rows=900).collect()] == ["hot"]
    assert joins.hot_keys(fact, ["k"], 0.5, task_rows=1000).count() == 0


def test_hot_keys_stay_bounded_where_tasks_hold_little(skewed, monkeypatch):
    fact, _ = skewed
    monkeypatch.setattr(joins, "HOT_KEYS", 3)
    assert joins.hot_keys(fact, ["k"], 0.5, task_rows=1).count() <= 3


@pytest.mark.parametrize("how", ["left", "inner"])
def test_values_of_hot_keys_beyond_the_broadcast_are_copied(skewed, monkeypatch, how):
    fact, lookup = skewed
    monkeypatch.setattr(joins, "HEAVY_BYTES", 0)
    for table in (lookup, lookup.filter("k <> 'hot'")):
        want = content(joins.lookup_join(fact, table, ["k"], how))
        assert content(joins.lookup_join(fact, table, ["k"], how, broadcast_bytes=0)) == want


@pytest.mark.parametrize("limit", [joins.BROADCAST_BYTES, 6000, 0])
def test_several_lookups_on_one_key(spark, skewed, limit):
    fact, lookup = skewed
    other = spark.createDataFrame([(f"k{i}", f"w{i}") for i in range(0, 400, 3)] + [("hot", "h"), (None, "n")], "k string, w string")
    third = spark.createDataFrame([("k7", 1.5), ("elsewhere", 2.5)], "k string, z double")
    got = joins.lookup_joins(fact, [lookup, other, third], ["k"], broadcast_bytes=limit)
    want = fact
    for table in (lookup, other, third):
        want = joins.lookup_join(want, table, ["k"])
    assert got.columns == want.columns == ["k", "x", "v", "w", "z"]
    assert content(got) == content(want) and got.count() == fact.count()


def test_several_lookups_move_the_fact_once(spark, skewed):
    fact, lookup = skewed
    tables = [lookup.withColumnRenamed("v", f"v{i}") for i in range(3)]
    marked = fact.withColumn("_mark", F.monotonically_increasing_id())
    shuffles = lambda df: sum("_mark" in line for line in outputs_of_exchanges(df))
    assert shuffles(joins.lookup_joins(marked, tables, ["k"], broadcast_bytes=0)) == 1
    one_by_one = marked
    for table in tables:
        one_by_one = joins.lookup_join(one_by_one, table, ["k"], broadcast_bytes=0)
    assert shuffles(one_by_one) == 3


def outputs_of_exchanges(df):
    """What each shuffle of the plan moves."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    blocks = [b for b in text.split("\n\n") if re.match(r"\s*\(\d+\) Exchange", b)]
    return [line for b in blocks for line in b.splitlines() if line.startswith("Input")]


def test_leave_one_out_and_interval_joins_beyond_the_broadcast_limit(spark, skewed):
    fact, _ = skewed
    a = encoding.with_leave_one_out(fact, "k", "x", "e")
    b = encoding.with_leave_one_out(fact, "k", "x", "e", broadcast_bytes=0)
    rounded = lambda d: content(d.withColumns({c: F.round(F.col(c) + 1e-9, 5) for c in ("e_loo", "e_mean", "e_std")}))
    assert rounded(a) == rounded(b)
    monthly = spark.sql("select cast(id % 3 as int) stn, add_months(date'2020-01-01', cast(id div 3 as int)) month, id x from range(60)")
    spans = spark.sql("select id, cast(id % 4 as int) stn, date_add(date'2020-02-10', cast(id as int)) s, date_add(date'2020-05-01', cast(id * 2 as int)) e from range(300)")
    out = [
        timeseries.interval_rollup(spans, monthly, ["stn"], "s", "e", [F.sum("x").alias("x")], broadcast_bytes=n)
        for n in (joins.BROADCAST_BYTES, 0)
    ]
    assert content(out[0]) == content(out[1])


def test_unique_lookup_keeps_rows_and_is_deterministic(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", 5, "q"), (None, 0, "n")], "k string, o int, v string")
    expected = [("a", 1, "y"), ("b", 5, "q")]
    for n in (1, 4):
        assert sorted(map(tuple, joins.unique_lookup(df.repartition(n), ["k"], ["o"]).collect())) == expected
    fact = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "k string")
    assert joins.lookup_join(fact, joins.unique_lookup(df, ["k"], ["o"]), ["k"]).count() == 4


def test_assert_unique(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(ValueError, match="repeats"):
        joins.assert_unique(df, ["k"])
    assert joins.assert_unique(df, ["k", "v"]) is df


def test_null_never_matches_null(spark):
    fact = spark.createDataFrame([(None, 1)], "k string, x int")
    lookup = spark.createDataFrame([(None, 2)], "k string, v int")
    for limit in (0, joins.BROADCAST_BYTES):
        assert joins.lookup_join(fact, lookup, ["k"], broadcast_bytes=limit).first()["v"] is None


def test_coverage_ignores_null(spark):
    left = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    right = spark.createDataFrame([("b",), ("c",), (None,)], "j string")
    assert tuple(joins.key_coverage(left, right, "k", "j").first()) == (2, 2, 1, 50.0)
    assert [r["key"] for r in joins.shared_keys(left, right, "k", "j").collect()] == ["b"]


def test_alignment_fills_gaps_and_keeps_the_row_count(spark):
    base = spark.createDataFrame([(1, "?"), (2, "?"), (3, "?")], "id int, g string")
    pred = spark.createDataFrame([(1, "A"), (1, "A"), (3, "B")], "id int, g string")
    out = joins.align_predictions(base, pred, ["id"], "g", "등외")
    assert sorted(map(tuple, out.collect())) == [(1, "A"), (2, "등외"), (3, "B")]


def test_stack_rows_by_name(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2,)], "i int")
    assert sorted(map(tuple, joins.stack_rows(a, b).collect())) == [(1, "x"), (2, None)]


def test_key_members_semi_join(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    keys = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert sorted(map(tuple, joins.keep_key_members(df, keys, ["k"]).collect())) == [("a", 1), ("a", 2)]
