"""Stored analyses: insert, read, replace, refuse; one partition is read; SQL table functions."""

import threading

import pytest
from pyspark.sql import functions as F

from gleaner.sources import analyses


def tables(spark, name, n, mean=3.5):
    whole = spark.createDataFrame([(name, (mean, n), [("a", 1)])], "analysis_id string, metrics struct<mean:double,n:int>, insights array<struct<area:string,rank:int>>")
    return whole, spark.range(n).select(F.lit(name).alias("analysis_id"), (F.col("id") + 1).alias("position"), F.concat(F.lit("r"), "id").alias("source_review_id"))


def test_insert_read_replace_refuse(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(analyses, "PART_ROWS", 10)
    path = str(tmp_path / "store")
    analyses.save(spark, *tables(spark, "007", 55), path)
    analyses.save(spark, *tables(spark, "b/c d", 3), path)
    with pytest.raises(ValueError, match="stored already"):
        analyses.save(spark, *tables(spark, "007", 1), path)
    assert [r["position"] for r in analyses.get_reviews(spark, path, "007").collect()] == list(range(1, 56))
    assert analyses.get_analysis(spark, path, "007").first()["metrics"]["mean"] == 3.5
    assert analyses.insights_view(spark, path, "b/c d").columns == ["analysis_id", "insights"]
    assert analyses.get_analysis(spark, path, "7").collect() == [] == analyses.get_reviews(spark, path, "none").collect()
    analyses.save(spark, *tables(spark, "007", 2, 1.0), path, replace=True)
    assert (analyses.get_reviews(spark, path, "007").count(), analyses.get_reviews(spark, path, "b/c d").count()) == (2, 3)
    whole, none = tables(spark, "007", 0, 2.0)
    analyses.save(spark, whole, none, path, replace=True)
    assert analyses.get_reviews(spark, path, "007").count() == 0 and analyses.metrics_view(spark, path, "007").first()["metrics"]["n"] == 0


def test_one_partition_is_read_and_split_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(analyses, "PART_ROWS", 10)
    path = str(tmp_path / "store")
    for name in ("x", "y"):
        analyses.save(spark, *tables(spark, name, 200), path)
    analyses.register(spark, path, "mine")
    got = spark.sql("SELECT position FROM mine_reviews('x')")
    assert got.count() == 200
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(analysis_id" in plan and "= x)" in plan
    assert all("analysis_id=x" in f for f in spark.sql("SELECT * FROM mine_reviews('x')").where("position > 0").select(F.input_file_name().alias("f")).toPandas()["f"])
    assert len(list((tmp_path / "store/reviews/analysis_id=x").glob("*.parquet"))) > 1
    assert spark.sql("SELECT metrics.n FROM mine_metrics('y')").first()["n"] == 200 and spark.sql("SELECT * FROM mine_insights('y')").columns == ["analysis_id", "insights"]


def test_of_two_writers_one_is_refused(spark, tmp_path):
    path, failed = str(tmp_path / "store"), []

    def write(n):
        try:
            analyses.save(spark, *tables(spark, "same", n), path)
        except ValueError as e:
            failed.append(str(e))

    writers = [threading.Thread(target=write, args=(n,)) for n in (4, 5)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert len(failed) == 1 and analyses.get_reviews(spark, path, "same").count() in (4, 5)


def test_what_is_refused_and_claims_of_failed_writes(spark, tmp_path):
    path = str(tmp_path / "store")
    whole, rows = tables(spark, "a", 3)
    with pytest.raises(ValueError, match="unknown"):
        analyses.save(spark, whole, rows.withColumn("analysis_id", F.lit("other")), path)
    with pytest.raises(ValueError, match="no id"):
        analyses.save(spark, whole.withColumn("analysis_id", F.lit(None).cast("string")), rows, path)
    with pytest.raises(ValueError, match="several"):
        analyses.save(spark, whole.unionByName(whole), rows, path)
    with pytest.raises(Exception, match="broken"):
        analyses.save(spark, whole, rows.withColumn("x", F.when(F.col("position") > 0, F.raise_error(F.lit("broken")))), path)
    analyses.save(spark, whole, rows, path)
    assert analyses.get_reviews(spark, path, "a").count() == 3
