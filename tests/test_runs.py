"""Runs that are recorded, repeated and compared with the run before."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import runs


def test_history_of_recorded_runs(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    found = lambda *keys: spark.createDataFrame([(k, 1) for k in keys], "rule string, n int")
    at = lambda day: F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp")
    runs.record(found("a", "b", "b", None), path, "p", "007", at(1))
    runs.record(found("wrong"), path, "p", "2", at(2))
    runs.record(found("b", "c", None), path, "p", "2", at(2))  # repeated: replaces, counts once
    runs.record(found(), path, "p", "3", at(3))
    runs.record(found("a"), path, "q", "1", at(1))
    got = {tuple(r) for r in runs.history(*runs.recorded(spark, path), ["rule"]).collect()}
    assert got == {("p", "007", 1, 3, 3, 0), ("p", "2", 2, 3, 1, 1), ("p", "3", 3, 0, 0, 3), ("q", "1", 1, 1, 1, 0)}


def test_a_run_that_did_not_finish_is_left_out(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    rows = spark.createDataFrame([("a",)], "rule string")
    runs.record(rows, path, "p", "1", F.lit("2024-01-01").cast("timestamp"))
    rows.withColumns({"started_at": F.lit("2024-01-02").cast("timestamp"), "project": F.lit("p"), "run_id": F.lit("2")}).write.mode("append").partitionBy("project", "run_id").parquet(f"{path}/findings")
    assert [r.run_id for r in runs.recorded(spark, path)[1].collect()] == ["1"]


def test_nothing(spark):
    none = spark.createDataFrame([], "project string, run_id string, started_at timestamp, rule string")
    assert runs.history(none, none, ["rule"]).count() == 0


def test_locations(spark):
    assert runs.location(spark, "t").endswith("/tables/shared/t")
    spark.conf.set("spark.siltstone.dir.project", "hdfs://x/{project}/.data")
    try:
        assert runs.location(spark, "t", "mine") == "hdfs://x/mine/.data/t"
    finally:
        spark.conf.unset("spark.siltstone.dir.project")
    with pytest.raises(ValueError, match="no name"):
        runs.location(spark, "t", "../other")
