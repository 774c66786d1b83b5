"""Bottom-k sketches against a window over all rows, and the coverage of intervals from them."""

import hashlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner.operators import ratings, sketches

KIND = "app_id int, country string, source_review_id string, rating int"


def frame(spark, n=700):
    rows = [(1, "us", str(i), i * i % 5 + 1) for i in range(n)] + [(2, "us", str(i), i % 5 + 1) for i in range(7)] + [(3, "us", "only", 4)]
    return spark.createDataFrame([*rows, (1, "us", None, 3), (1, "us", "no stars", None), (1, "us", "5", 1), (1, "us", "5", 1)], KIND)


def by_window(df, k, replicates, seed):
    """The same ranks, by a window for each replicate."""
    a, b = sketches.factors(replicates, seed)
    digit = lambda s, n: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "source_review_id")), s, n), 16, 10).cast("long")
    rows = df.where("source_review_id IS NOT NULL AND rating IS NOT NULL").withColumn("x", digit(1, 8) % sketches.PRIME).withColumn("low", digit(9, 7) * 8 + F.col("rating"))
    reps = df.sparkSession.createDataFrame([(r, int(x), int(y)) for r, (x, y) in enumerate(zip(a, b, strict=True))], "replicate int, a long, b long")
    order = Window.partitionBy("app_id", "replicate").orderBy(((F.col("a") * F.col("x") + F.col("b")) % sketches.PRIME).asc(), "low")
    drawn = rows.join(F.broadcast(reps)).withColumn("i", F.row_number().over(order)).where(F.col("i") <= k)
    return {(r["app_id"], r["replicate"]): sorted(r["v"]) for r in drawn.groupBy("app_id", "replicate").agg(F.collect_list("rating").alias("v")).collect()}


@pytest.mark.parametrize(("parts", "fan", "held"), [(1, 32, 64 << 20), (9, 2, 64 << 20), (9, 2, 1)])
def test_sketches_equal_a_window(spark, monkeypatch, parts, fan, held):
    """However the rows lie, however sketches are merged, and if a task passes its sketches on after every batch."""
    monkeypatch.setattr(sketches, "FAN", fan)
    monkeypatch.setattr(sketches, "HELD", held)
    monkeypatch.setattr(sketches, "ROWS", 64)
    df = frame(spark)
    got = sketches.bottom_k(df.repartition(parts), 20, 70, 5, "rating", "source_review_id", ["app_id", "country"]).collect()
    assert {(r["app_id"], r["replicate"]): sorted(r["values"]) for r in got} == by_window(df, 20, 70, 5)


def test_coverage_is_near_its_level(spark):
    df = frame(spark)
    counts = ratings.replicate_counts(df, 60, 50, 1)
    assert counts.where("app_id = 1 AND s1 + s2 + s3 + s4 + s5 <> 50").count() == 0
    stars = {(r["app_id"], r["rating"]): r for r in ratings.ci_coverage(df, counts=counts).collect()}
    assert stars[2, 1]["evaluable"] == 0 and stars[2, 1]["rate"] is None  # a census
    assert all(stars[1, s]["evaluable"] == 60 for s in range(1, 6)) and stars[1, 3]["rate"] == stars[1, 3]["covered"] / 60
    assert sum(stars[1, s]["rate"] for s in (1, 2, 5)) / 3 > 0.85
    mean = {r["app_id"]: r for r in ratings.mean_coverage(df, counts=counts, resamples=500).collect()}
    assert mean[1]["evaluable"] == 60 and mean[1]["rate"] > 0.8 and mean[3]["evaluable"] == 0


def test_no_rows(spark):
    assert ratings.ci_coverage(frame(spark).limit(0), 3).collect() == ratings.mean_coverage(frame(spark).limit(0), 3).collect() == []


def test_factors_come_from_md5():
    a, b = sketches.factors(2, 42)
    assert a[1] == 1 + int(hashlib.md5(b"42:a:1").hexdigest()[:8], 16) % (sketches.PRIME - 1) and b[0] < sketches.PRIME
