"""CSV scans and sinks, the store and its fingerprints."""

import datetime as dt

from pyspark.sql import functions as F

from gradeframe.functions import clean
from gradeframe.sources import sinks, store, tables


def write(path, text, encoding="utf-8-sig"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_csv_by_name_with_mark_and_bad_values(spark, tmp_path):
    path = write(tmp_path / "w.csv", "date,stn,ta_max,extra\n2024-01-31,5,-99,q\nbad,7.0,x,q\n")
    df = tables.read_csv(spark, path, tables.WEATHER)
    assert df.columns == ["stn", "date", "ta_max"]
    assert [tuple(r) for r in df.collect()] == [(5, dt.date(2024, 1, 31), -99.0), (7, None, None)]
    assert clean.null_if_sentinel(df, ["ta_max"]).filter("ta_max is not null").count() == 0
    assert tables.read_csv(spark, path, tables.WEATHER, ["ta_max"]).columns == ["ta_max"]


def test_full_scan_keeps_every_column(spark, tmp_path):
    path = write(tmp_path / "f.csv", "CATTLE_NO,AGE,note\n0012,30,hi\n")
    df = tables.read_full_csv(spark, path, tables.FACT)
    assert df.columns == ["CATTLE_NO", "AGE", "note"] and tuple(df.first()) == ("0012", 30, "hi")


def test_scan_prunes_columns(spark, tmp_path):
    path = write(tmp_path / "p.csv", "stn,date,ta_max,rn_day\n1,2024-01-01,2,3\n")
    plan = tables.read_csv(spark, path, tables.WEATHER).select("stn")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<stn:string>" in plan


def test_csv_sink_mark_and_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("등외", 1), ("1++A", 2)], "LAST_GRADE string, n int")
    sinks.write_csv(df, str(tmp_path / "out"), bom=True, files=1)
    (part,) = (tmp_path / "out").glob("part-*.csv")
    raw = part.read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfLAST_GRADE") and raw.count(b"LAST_GRADE") == 1
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert sorted(r["LAST_GRADE"] for r in back.collect()) == ["1++A", "등외"]


def test_ranked_importance_file(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.1), ("b", 0.9)], "feature string, importance double")
    sinks.write_importance(df, str(tmp_path / "fi"))
    (part,) = (tmp_path / "fi").glob("part-*.csv")
    assert part.read_text().split() == ["feature,importance", "b,0.9", "a,0.1"]


def test_fingerprint_follows_files_settings_and_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    first = store.fingerprint({"t": spark.read.parquet(path)}, {"k": 3})
    assert first == store.fingerprint({"t": spark.read.parquet(path)}, {"k": 3})
    assert first != store.fingerprint({"t": spark.read.parquet(path)}, {"k": 4})
    spark.range(6).write.mode("overwrite").parquet(path)
    assert first != store.fingerprint({"t": spark.read.parquet(path)}, {"k": 3})
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    assert store.fingerprint({"t": rows}) == store.fingerprint({"t": rows.orderBy(F.desc("i"))})
    assert store.fingerprint({"t": rows}) != store.fingerprint({"t": rows.filter("i = 1")})


def test_reuse_or_write_reads_the_finished_table_only(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for mark in ("m1", "m1", "m2"):
        assert store.reuse_or_write(spark, str(tmp_path), "x", mark, build).count() == 3
    assert len(calls) == 2


def test_probability_columns(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(1, Vectors.dense([0.25, 0.75]))], ["id", "probability"])
    out = sinks.probability_columns(df, ["x", "y"], ["id"])
    assert out.columns == ["id", "x", "y"] and tuple(out.first()) == (1, 0.25, 0.75)


def test_headers_read_one_block_of_each_file(spark, tmp_path):
    rows = "".join(f"{i},2024-01-01,{i}.5\n" for i in range(20_000))
    write(tmp_path / "a.csv", "stn,date,ta_max\n" + rows)
    write(tmp_path / "b c.csv", "ta_max,stn,date\n1.5,7,2024-02-01\n", encoding="utf-8")
    write(tmp_path / "d.csv", "stn,date\n9,2024-03-01\n", encoding="utf-8")
    (tmp_path / "e.csv").write_text("")
    context = spark.sparkContext
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    context.setLocalProperty("spark.jobGroup.id", "first lines")
    try:
        found = tables.headers(spark, str(tmp_path))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        splits = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("first lines") for s in tracker.getJobInfo(j).stageIds]
    assert sum(s.numTasks for s in stages) <= 4 < splits
    assert sorted(len(files) for files in found.values()) == [1, 1, 1]
    back = tables.read_csv(spark, str(tmp_path), tables.WEATHER)
    assert back.count() == 20_002
    assert sorted(map(tuple, back.filter("stn in (7, 9) and date > '2024-01-31'").select("stn", "ta_max").collect())) == [(7, 1.5), (9, None)]


def test_ledger_of_rejected_values_and_lines(spark, tmp_path):
    write(tmp_path / "a.csv", "stn,date,ta_max,note\n1,2024-01-01,2.5,x\nfive,2024-13-01,,y\n2,2024-01-02,3,z,more\n")
    write(tmp_path / "b.csv", "ta_max,stn,date\nhot,3,2024-01-03\n 4 ,4,2024-01-04\n", encoding="utf-8")
    got = {(r["file"][-5:], r["block"], r["column"], r["value"]) for r in tables.rejected(spark, str(tmp_path), tables.WEATHER).collect()}
    assert got == {
        ("a.csv", 0, "stn", "five"), ("a.csv", 0, "date", "2024-13-01"), ("a.csv", 0, None, "2,2024-01-02,3,z,more"), ("b.csv", 0, "ta_max", "hot"),
    }
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.csv").write_text("")
    assert tables.rejected(spark, str(tmp_path / "none"), tables.WEATHER).count() == 0
