"""The data source of recorded collections: what is pushed down, which files are opened, what a broken document says."""

import json

import pytest

from gleaner.sources import snapshots


def document(app, seed, n, country="us", **more):
    reviews = [{"source_review_id": f"{app}-{seed}-{i}", "rank": i, "title": "t", "body": "b\n", "rating": i % 5 + 1, "created_at": "2026-01-02T03:04:05Z", "is_edited": i == 1, "reviewer": "never read", "source_flags": ["x"], **more} for i in range(n)]
    return json.dumps({"app": {"app_id": app, "country": country, "name": "n"}, "sampling": {"seed": seed, "requested": n, "reachable": 9}, "reviews": reviews})


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(a, "us", s, n, document(a, s, n)) for a in (1, 2, 3) for s in (42, 43) for n in (2, 3)]
    path = str(tmp_path / "app_id=9" / "recorded")  # a folder above that looks like a key
    snapshots.record(spark.createDataFrame(rows, "app_id long, country string, seed long, requested long, document string"), path)
    return path


def test_filters_are_pushed_and_files_left_unopened(spark, folder):
    got = snapshots.read_snapshots(spark, folder).where("app_id = 2 AND seed IN (42, 44) AND rank >= 1")
    assert sorted((r["source_review_id"], r["requested"]) for r in got.collect()) == [("2-42-1", 2), ("2-42-1", 3), ("2-42-2", 3)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    kept = plan[: plan.index("BatchScan")].split("Filter", 1)[-1].split("\n")[0]
    assert ">= 1" in kept and "= 2" not in kept.replace(">= 1", "") and "IN" not in kept  # Spark sees the pushed ones no more
    assert got.rdd.getNumPartitions() == 2  # a partition for each file that is opened
    assert snapshots.read_snapshots(spark, folder).rdd.getNumPartitions() == 12


def test_only_named_files_are_opened(folder):
    reader = snapshots.SnapshotReader(folder, None)
    left = list(reader.pushFilters([snapshots.EqualTo(("app_id",), 3), snapshots.EqualTo(("rating",), 1), snapshots.In(("seed",), (43,))]))
    assert [f.attribute for f in left] == [("rating",)]
    assert len(reader.partitions()) == 2 and all("app_id=3" in d.path and "seed=43" in d.path for d in reader.partitions())


def test_types_and_allowlist(spark, folder):
    r = snapshots.read_snapshots(spark, folder).where("app_id = 1 AND seed = 42 AND requested = 3 AND rank = 1").first()
    assert (r["rating"], r["is_edited"], r["source_flags"], r["reachable"], r["body"], str(r["created_at"]), r["country"]) == (2, True, ["x"], 9, "b\n", "2026-01-02 03:04:05", "us")
    assert "reviewer" not in r.asDict() and r["vote_count"] is None


def test_files_whose_paths_say_nothing(spark, tmp_path):
    (tmp_path / "a.snapshot.json").write_text(document(5, 1, 2) + "\n\n" + document(6, 1, 1) + "\n" + json.dumps({"app": None, "sampling": None, "reviews": None}))
    assert {r["app_id"] for r in snapshots.read_snapshots(spark, str(tmp_path)).where("app_id = 6").collect()} == {6}
    (tmp_path / "b.json").write_text("\n{broken\n")
    with pytest.raises(Exception, match=r"b\.json, line 2"):
        snapshots.read_snapshots(spark, str(tmp_path)).collect()


def test_replay_and_what_there_is(spark, folder):
    assert snapshots.replay(spark, folder, 1, "us", 42, 3).count() == 3
    assert snapshots.snapshot_catalogue(spark, folder).count() == 12
    with pytest.raises(ValueError, match=r"\(1, 'us', 42, 2\)"):
        snapshots.replay(spark, folder, 1, "us", 7, 3)
