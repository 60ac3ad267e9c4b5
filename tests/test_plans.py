"""What the physical plans must and must not contain."""

import re
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gradeframe.catalog import learning, roles
from gradeframe.operators import joins
from gradeframe.plans import grading

TRAINING = {"oof_predictions", "fold_scores", "scored_orders", "feature_importance", "two_part_class", "stacked_classes"}
ROOT = Path(__file__).resolve().parent.parent


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - TRAINING))
def test_no_cross_join_and_no_python_worker(spark, sf, name):
    plan = plan_of(entry.queries()[name](spark, sf))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|ArrowEvalPython|BatchEvalPython|MapInPandas", plan)


def test_scan_reads_only_the_used_columns(spark, sf):
    plan = plan_of(roles.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").agg(F.sum("l_quantity")))
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in plan
    assert re.search(r"ReadSchema: struct<l_quantity:double,l_returnflag:string>", plan)


def test_monthly_rollup_combines_before_the_shuffle(spark, sf):
    plan = plan_of(grading.monthly_weather(roles.daily(spark, sf)))
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange hashpartitioning") == 1


def test_feature_joins_do_not_move_the_fact_when_lookups_are_small(spark, sf):
    fact, daily, area, death, _ = learning.domain_tables(spark, sf)
    fact = fact.transform(joins.settle)
    df = grading.training_features(fact, grading.lookups(daily, area, death), learning.FLOOR)
    plan = plan_of(df)
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_whole_feature_queries_return_every_feature(spark, sf):
    assert learning.training_features_all(spark, sf).columns == ["animal", *grading.FEATURES]
    assert learning.baseline_features_all(spark, sf).columns == ["animal", *grading.BASELINE_FEATURES]


def test_feature_joins_beyond_the_broadcast_limit_give_the_same_rows(spark, sf):
    fact, daily, area, death, _ = learning.domain_tables(spark, sf)
    fact = joins.settle(fact)
    tables = grading.lookups(daily, area, death)
    got = []
    for limit in (joins.BROADCAST_BYTES, 0):
        df = grading.training_features(fact, tables, learning.FLOOR, broadcast_bytes=limit)
        df = df.select("animal", *[F.col(c).cast("double").alias(c) for c in grading.FEATURES])
        got.append(df.toPandas().set_index("animal").sort_index())
    # Sums arrive in any order, so equal up to rounding noise.
    pd.testing.assert_frame_equal(got[0], got[1], check_exact=False, rtol=1e-9, atol=1e-9)
    assert len(got[0]) == fact.count()


def test_scoring_has_every_training_feature(spark, sf):
    fact, daily, area, death, _ = learning.domain_tables(spark, sf)
    tables = grading.lookups(daily, area, death)
    train, later = fact.filter("year(ABATT_DATE) < 2000"), fact.filter("year(ABATT_DATE) >= 2000")
    rows = grading.scoring_features(later, tables, joins.settle(grading.encoding_table(train)), train, learning.FLOOR)
    assert set(grading.FEATURES) <= set(rows.columns)
    assert "farm_grade_mean" not in grading.FEATURES
    assert rows.count() == later.count()


def test_baseline_plan_has_its_features(spark, sf):
    fact, daily, area, death, lineage = learning.domain_tables(spark, sf)
    parents = grading.pedigree(lineage)
    statistics = grading.target_statistics(fact, parents)
    got, names = [], ["s_thi_mean", "father_insfat", "farm_backfat"]
    for limit in (joins.BROADCAST_BYTES, 0):
        df = grading.baseline_features(fact, grading.lookups(daily, area, death, base=True), parents, statistics, broadcast_bytes=limit)
        assert set(grading.BASELINE_FEATURES) <= set(df.columns)
        got.append(df.select("animal", *names).toPandas().set_index("animal").sort_index())
    pd.testing.assert_frame_equal(got[0], got[1], check_exact=False, rtol=1e-9, atol=1e-9)


def test_duplicate_farm_rows_do_not_multiply_the_fact(spark, sf):
    fact, daily, area, death, _ = learning.domain_tables(spark, sf)
    tables = grading.lookups(daily, area.unionByName(area), death)
    assert grading.with_farm(fact, tables.farms).count() == fact.count()


def test_sources_use_no_local_checkpoint_or_rdd():
    for path in (ROOT / "gradeframe").rglob("*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text and ".rdd" not in text, path


@pytest.mark.parametrize("plan", ["training", "baseline"])
def test_rows_move_by_animal_and_farm_before_the_weather_widens_them(spark, sf, plan, monkeypatch):
    """Lookups that grow with the table shuffle the rows; calendar lookups stay small and are broadcast."""
    moved = []
    one, several = joins.lookup_join, joins.lookup_joins

    def seen(join):
        def run(fact, lookups, on, *args, **options):
            if list(on) in ([grading.FARM], ["CATTLE_NO"]):
                moved.append(fact.columns)
            return join(fact, lookups, on, *args, **options)
        return run

    fact, daily, area, death, lineage = learning.domain_tables(spark, sf)
    tables, parents = grading.lookups(daily, area, death, base=plan == "baseline"), grading.pedigree(lineage)
    statistics = grading.target_statistics(fact, parents) if plan == "baseline" else None
    monkeypatch.setattr(joins, "lookup_join", seen(one))
    monkeypatch.setattr(joins, "lookup_joins", seen(several))
    if plan == "baseline":
        grading.baseline_features(fact, tables, parents, statistics)
    else:
        grading.training_features(fact, tables, learning.FLOOR)
    assert len(moved) == (2 if plan == "baseline" else 1)
    assert not [c for columns in moved for c in columns if c in grading.WEATHER_FEATURES + grading.REARING_FEATURES]
