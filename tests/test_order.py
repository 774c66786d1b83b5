"""Positions of a distributed sort, and what draws and feeds take from their first rows."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import order, sampling
from gleaner.sources import reviews as source


def rows(n=900):
    rng = random.Random(1)
    return [(rng.choice(["hot", "hot", "hot", "a", None, "b"]), rng.randint(0, 50), i) for i in range(n)]


@pytest.mark.parametrize(("group", "parts"), [((), 7), (("g",), 5), (("g",), 1), (("g", "x"), 6)])
def test_positions_equal_sorting(spark, group, parts):
    data = rows()
    got = order.positions(spark.createDataFrame(data, "g string, x int, id long").repartition(4), [F.col("x").desc(), F.col("id")], group, partitions=parts)
    seen: dict = {}
    want = []
    for g, x, i in sorted(data, key=lambda r: (-r[1], r[2])):
        k = tuple({"g": g, "x": x}[c] for c in group)
        seen[k] = seen.get(k, 0) + 1
        want.append((g, x, i, seen[k]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_a_huge_group_is_dealt_over_all_ranges(spark):
    """The numbering's tasks hold ranges of like size, and the plan has no window over the table."""
    got = order.positions(spark.range(20_000).selectExpr("id", "1 AS g"), [F.md5(F.col("id").cast("string"))], ["g"], partitions=8)
    assert got.agg(F.min("position"), F.max("position"), F.countDistinct("position")).first() == (1, 20_000, 20_000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    sizes = [r["n"] for r in spark.read.parquet(got.inputFiles()[0].rsplit("/", 1)[0]).groupBy("_part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8


def test_positions_of_nothing_and_of_taken_names(spark):
    none = spark.createDataFrame([], "g string, x int")
    assert order.positions(none, [F.col("x")], ["g"]).collect() == []
    with pytest.raises(ValueError, match="position"):
        order.positions(none.withColumn("Position", F.lit(1)), [F.col("x")])


def brute_backfill(data, k, most, seed):
    import hashlib

    taken, passed, ids = [], [], set()
    for r in sorted(data, key=lambda r: (hashlib.md5(f"{seed}:{r[1]}".encode()).hexdigest(), r[1])):
        if len(taken) == k:
            break
        bad = "invalid_row" if not r[3] else "duplicate_review" if r[2] in ids else None
        ids.add(r[2])
        if bad:
            if len(passed) == most:
                break
            passed.append((r[1], bad, len(passed) + 1))
        else:
            taken.append(r[1])
    return sorted(taken), sorted(passed)


@pytest.mark.parametrize("most", [0, 3, 20])
def test_backfill_equals_drawing_one_by_one(spark, most):
    rng = random.Random(3)
    data = [("g", i, str(rng.randint(0, 150)), rng.choice([True, True, True, False, None])) for i in range(300)]
    df = spark.createDataFrame(data, "app_id string, rank long, source_review_id string, valid boolean").withColumn("country", F.lit("us"))
    taken, passed = sampling.backfilled_sample(df.repartition(5), 40, 9, most)
    want = brute_backfill(data, 40, most, 9)
    assert sorted(r["rank"] for r in taken.collect()) == want[0]
    assert sorted((r["replaced_rank"], r["reason"], r["replacement"]) for r in passed.collect()) == want[1]
    assert "WindowGroupLimit" in taken._jdf.queryExecution().executedPlan().toString()


def test_a_frame_picks_its_first_rows_before_they_are_moved(spark):
    entries = spark.range(5000).selectExpr("CAST(IF(id < 0, 2, 1) AS INT) AS app_id", "'us' AS country", "CAST(id DIV 50 AS BIGINT) AS page", "CAST(id % 50 AS INT) AS pos", "CAST(id % 3000 AS STRING) AS source_review_id", "'t' AS title", "CAST(id % 5 + 1 AS INT) AS rating")
    got = source.feed_frame(entries.repartition(6), 100)
    assert [(r["rank"], r["source_review_id"]) for r in got.orderBy("rank").collect()] == [(i, str(i)) for i in range(100)]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
