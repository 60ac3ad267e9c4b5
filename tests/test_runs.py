"""The end-to-end runs and the exploratory report, from CSV files to CSV files."""

import pytest
from pyspark.sql import functions as F

from gradeframe.catalog import learning, roles
from gradeframe.functions import domain
from gradeframe.plans import explore, grading, runs, training
from gradeframe.sources import sinks, tables

PARAMS = training.ForestParams(tree_grid=(3,), depth=4, min_rows=2, bins=16)


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The role tables as the CSV files of a data set, sentinels included."""
    root = tmp_path_factory.mktemp("csv")
    fact, daily, area, death, lineage = learning.domain_tables(spark, sf)
    fact = fact.withColumns({
        "sigungu": F.lit("s"), "eupmyeondong": F.lit("e"), "JUDGE_DATE": F.col("ABATT_DATE"), "WEIGHT": F.col("WEIGHT").cast("int"),
        "REA": F.col("AGE") * 2.0, "WINDEX": F.col("AGE") * 1.5, "WGRADE": F.lit("-99.0"), "YUKSAK": F.col("INSFAT"),
        "FATSAK": F.lit(3.0), "TISSUE": F.lit(-99.0), "GROWTH": F.col("INSFAT"), "COST_AMT": F.col("WEIGHT") * 10.0,
    }).drop("animal")
    death = roles.deaths(spark, sf).select(
        F.col("farm").cast("string").alias("FARM_UNIQUE_NO"), F.col("born_ymd").alias("BIRTH_YMD"),
        F.col("dead_ymd").alias("DEAD_YMD"), F.col("reason").alias("DEAD_REASON"),
    )
    late = F.year("ABATT_DATE") >= 2000
    scoring = fact.filter(late).select(*[c for c in fact.columns if c not in ("INSFAT", "BACKFAT", "LAST_GRADE")]).withColumn("note", F.lit("n"))
    for name, df in {"train": fact.filter(~late), "scoring": scoring, "weather": daily, "area": area, "death": death, "lineage": lineage}.items():
        sinks.write_csv(df, str(root / name), bom=True)
    return str(root)


@pytest.fixture(scope="module")
def inputs(spark, folder):
    return runs.read_inputs(spark, folder, "train", "scoring", "weather", "area", "death", "lineage")


def test_inputs_are_typed(inputs):
    types = dict(inputs.train.dtypes)
    assert types["ABATT_DATE"] == "date" and types["BIRTH_YMD"] == "int" and types["FARM_UNIQUE_NO"] == "string"
    assert inputs.train.filter("ABATT_DATE is null or stn is null").count() == 0
    assert "note" in inputs.scoring.columns


def test_full_run(spark, inputs, tmp_path, monkeypatch):
    result = runs.full_run(inputs, "CATTLE_NO", PARAMS, 2, learning.FLOOR, str(tmp_path / "store"))
    assert result.predictions.count() == inputs.scoring.count()
    assert set(inputs.scoring.columns) < set(result.predictions.columns)
    assert {r["LAST_GRADE"] for r in result.predictions.select("LAST_GRADE").distinct().collect()} <= set(domain.GRADES)
    assert result.out_of_fold.count() == inputs.train.count()
    assert result.importance.count() == len(grading.FEATURES)
    assert result.distribution.agg(F.sum("n")).first()[0] == inputs.scoring.count()
    assert 0 <= result.scores.first()["oof_macro_f1"] <= 1
    runs.write_result(result, str(tmp_path / "out"), "CATTLE_NO")
    back = spark.read.option("header", True).csv(str(tmp_path / "out" / "predictions"))
    assert back.count() == inputs.scoring.count() and "LAST_GRADE" in back.columns
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "oof_predictions")).columns == ["CATTLE_NO", *domain.GRADES]
    monkeypatch.setattr(training, "choose_trees", lambda *a, **k: pytest.fail("fitted again"))
    again = runs.full_run(inputs, "CATTLE_NO", PARAMS, 2, learning.FLOOR, str(tmp_path / "store"))
    assert again.scores.first() == result.scores.first()


def test_baseline_run(inputs):
    result = runs.baseline_run(inputs, "CATTLE_NO", 800, PARAMS)
    assert result.predictions.count() == inputs.scoring.count()
    assert result.importance.count() == len(grading.BASELINE_FEATURES)
    assert result.out_of_fold is None and 0 <= result.scores.first()["macro_f1"] <= 1


def test_every_section_of_the_report(spark, folder, inputs):
    death = tables.read_csv(spark, f"{folder}/death", tables.DEATH)
    fact = explore.cleaned(inputs.train).cache()
    assert fact.filter("TISSUE is not null or WGRADE is not null").count() == 0
    sections = {
        "shapes": explore.shapes({"train": fact, "death": death}), "grades": explore.grade_counts(fact),
        "sex": explore.quality_by_sex(fact), "age": explore.age_by_sex(fact), "scatter": explore.age_and_weight(fact, "CATTLE_NO", 100),
        "correlation": explore.correlation_matrix(fact), "regions": explore.region_rates(fact), "season": explore.season_rates(fact),
        "born": explore.season_rates(fact, "birth_season"), "trend": explore.monthly_trend(fact),
        "readings": explore.daily_readings(inputs.weather),
        "coverage": explore.coverage(fact, inputs.weather, inputs.area, death, inputs.lineage),
    }
    groups = [
        explore.yield_boxes(fact), {k: v for k, v in explore.quality_boxes(fact).items() if k != "TISSUE"},
        explore.farm_area(inputs.area), explore.deaths(death), explore.lineage(inputs.lineage), explore.prices(fact),
        explore.heat(fact, inputs.weather, [1999, 2000]), explore.sires(fact, inputs.lineage, 3), explore.herd_rates(fact, inputs.area),
    ]
    for i, group in enumerate(groups):
        sections.update({f"{i}.{k}": v for k, v in group.items()})
    empty = [name for name, df in sections.items() if df.isEmpty()]
    assert not empty
    assert sections["scatter"].count() == 100
    assert {r["table"]: r["match_pct"] for r in sections["coverage"].collect()}["lineage"] == 100.0
    assert [r["abatt_season"] for r in sections["season"].collect()] == domain.SEASONS
